"""Small awkward tables, and plain versions of what the operators compute."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Names that operators use inside, or give to their results, as further columns of the input.
CLASHING = (
    "fp g id k w row i h n s z key class low component base spans share size source_size target times taken lang_pred score candidates secrets "
    "redacted part hit left right path p text_ start end bits dim cell label rep _k _r _t _i _path _hits _gaps _spans _p _lang_pred _lang_score _first"
).split()
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` int" for c in CLASHING)


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source) with further columns whose names the operators use inside."""
    more = tuple(range(len(CLASHING)))
    return spark.createDataFrame([(a, b, c, d, len(b) if b is not None else None, *more) for a, b, c, d in rows], DOCS)


LONG = " ".join(f"word{k % 977} tail{k % 31}" for k in range(30_000))
AWKWARD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "one", "en", None), (5, "One two", None, "b"),
    (6, LONG, "en", "b"), (7, LONG, "en", "c"), (7, LONG, "en", "c"), (None, "no id at all here", "en", "a"),
    (None, None, None, None), (8, "é ß ﬁ 日本語 👩‍👧 <|endoftext|> don't I'LL ΑΣ", "de", "a"), (9, "aaaa " * 300, "en", "a"),
    (10, "\x1c\x85\xa0x y", "en", "a"), (11, "!!! ??? 123 456", None, "c"),
]


def component_of(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
