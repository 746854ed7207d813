import hashlib
import math
import re

import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.llm import pii
from tests.llm.helpers import AWKWARD, docs

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CASES = [
    "a@b.c_d@e.f, x@y.z.", "1.2.3.4.5.6.7.8 1.2.3.x4.5.6.7 300.1.1.1 001.2.3.255", "4111 1111 1111 1111 4111-1111-1111-1112",
    "+1 (425) 555-9684 or +49.30.123456 +1 23", "7" * 5000, "4 " * 3000, "a" * 20000, "é👩 jo@ex.org 👩 +44 20 7946 0958",
    "a@b@c.d.e@f..g @x.y", "1.1.1.1.1", "+12345678 +123456789 +123456789012345 +1234567890123456", "--1-2", "4111111111111111@1.2.3.4",
]


def luhn(d):
    s = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def plain(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(PLAIN[kind], text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False,
                "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def texts(rows, got):
    found = {}
    for r in got:
        found.setdefault(r.id, []).append([tuple(s) for s in r.base])
    for i, t, *_ in rows:
        assert plain(t) in found[i], t[:80]


def test_whole_table(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = pii.op7_pii(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain(rows[r.doc_id])
        said = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for _, k, _ in want) for n in range(4))
        assert set(said) <= set(r.spans.split(",")) | {""}


def test_awkward_rows(spark):
    rows = [*AWKWARD, *((100 + k, t, None, None) for k, t in enumerate(CASES))]
    got = pii.extract(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    texts(rows, got)
    assert pii.extract(docs(spark, [])).collect() == []


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="1234 .-+()@aZ_%é", max_size=60), min_size=60, max_size=60))
def test_any_text(spark, many):
    rows = [(k, t, None, None) for k, t in enumerate(many)]
    texts(rows, pii.extract(docs(spark, rows)).collect())


def test_patterns_discover(spark):
    """Numbers in a context that seeds fill are found, though no base pattern matches them; others are left alone."""
    rows = [(k, f"please call: +49{k:010} now", None, None) for k in range(40)]
    rows += [(100 + k, f"we ask: +{k:02} maybe, room {k * 37:05} is free", None, None) for k in range(20)]
    rows += [(200, "please call: +4912 now", None, None), (201, "version 4912 is out", None, None)]
    got = {r.id: r for r in pii.extract(docs(spark, rows)).collect()}
    assert [tuple(s) for s in got[200].spans] == [(13, 3, 18)] and got[200].base == []
    assert got[201].spans == [] and all(got[100 + k].spans == [] for k in range(20))
    assert all((13, 3, 26) in [tuple(s) for s in got[k].base] for k in range(40))


def plain_bootstrap(rows, rounds=3, support=5, confidence=0.9):
    """The pattern-instance graph in dictionaries: seeds, confidences, scores, and what sure patterns add."""
    shape = lambda w: regex.sub(r"[\p{L}--[A]]+", "a", regex.sub(r"\p{Lu}+", "A", regex.sub("[0-9]+", "9", w)), flags=regex.V1)
    found = []  # (row, start, end, pattern, word, kind of a base span that touches it)
    for k, text in enumerate(rows):
        text, base = text or "", plain(text)
        for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
            if not re.search("[0-9@]", m.group()):
                continue
            skip = len(regex.match(r"[^0-9\p{L}@+]*", m.group()).group())
            word = regex.sub(r"[^0-9\p{L}]+$", "", m.group()[skip:])
            before = re.findall(r"[^\x20\x09-\x0D]+", text[: m.start()])
            pattern = (re.sub("[0-9]+", "9", before[-1].lower()) if before else "", shape(word))
            touch = [n for a, n, b in base if a < m.end() and b > m.start()]
            found.append((k, m.start() + skip, m.start() + skip + len(word), pattern, word, touch[0] if touch else None))
    seed = {}
    for *_, word, n in found:
        if n is not None:
            seed[word] = max(n, seed.get(word, -1))
    edges = {(p, w) for _, _, _, p, w, _ in found}
    by_pattern, by_word = {}, {}
    for p, w in edges:
        by_pattern.setdefault(p, set()).add(w)
        by_word.setdefault(w, set()).add(p)
    score = {w: float(w in seed) for w in by_word}
    trust = {p: sum(w in seed for w in ws) >= support for p, ws in by_pattern.items()}
    for step in range(rounds + 1):
        sure = {p: sum(score[w] for w in ws) / (len(ws) + 1) for p, ws in by_pattern.items()}
        if step == rounds:
            break
        for w, ps in by_word.items():
            if w not in seed and any(trust[p] for p in ps):
                score[w] = 1 - math.prod(max(1 - sure[p], 1e-9) for p in ps if trust[p])
            elif w not in seed:
                score[w] = 0.0
    out = [{(a, n, b) for a, n, b in plain(t)} for t in rows]
    for k, a, b, p, _, touched in found:
        if touched is None and trust[p] and sure[p] >= confidence:
            n = [sum(seed.get(w) == j for w in by_pattern[p]) for j in range(4)]
            out[k].add((a, n.index(max(n)), b))
    return [sorted(x) for x in out]


def test_bootstrap_by_the_book(spark, sf_dir):
    """Spans of the bootstrap against the plain graph: the whole table, and texts whose patterns reach each other."""
    table = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    made = [f"please call: +49{k:010} or host 10.0.{k}.{k + 1} now" for k in range(30)] + ["please call: +49 or +4912", "host 10.0.3 is up", "call: +49 1"]
    made += [f"write to user{k}@ex{k}.org or {w}{k}@home today" for k in range(25) for w in ("", "x")] + ["LONG" * 40 + ": 12345"] * 8
    made += [f"{'n' * 90}: 4111 1111 1111 1111", f"{'n' * 90}: 77-11"] * 6 + [f"id{k} id{k + 1} id{k + 2}" for k in range(20)] + [None, "", "5"]
    for some in (table, made):
        got = {r.id: [tuple(s) for s in r.spans] for r in pii.extract(docs(spark, [(k, t, None, None) for k, t in enumerate(some)])).collect()}
        want = plain_bootstrap(some)
        assert [got[k] for k in range(len(some))] == want


def test_short_instances_are_found(spark):
    rows = [(k, f"please call: +49{k:010} now", None, None) for k in range(40)] + [(200, "please call: +4912", None, None), (201, "please call: +49", None, None)]
    got = {r.id: [tuple(s) for s in r.spans] for r in pii.extract(docs(spark, rows)).collect()}
    assert got[200] == [(13, 3, 18)] and got[201] == [(13, 3, 16)]
