"""Text rules as Column functions: terms, tokens, cleaning, snippets, numbering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"一-鿿"

# Words that never count as terms, in Chinese and English.
STOPWORDS_HAN = (
    "我们 你们 他们 这个 那个 这些 那些 一个 一种 可以 需要 如果 那么 因为 所以 但是 以及 并且 或者 不是 没有 进行 "
    "通过 对于 关于 之间 之后 之前 同时 由于 第一 一章 第二 第三 中的 目录 附录 前言 引言 序言 摘要 "
    "本书 书介 绍本 介绍 内容 主要 研究 问题 用于 相关 其中 包括"
).split()
STOPWORDS_ENGLISH = (
    "the and for are but not you all any can had her was one our out that with have this will from they"
).split()

# Words that mark a theorem line.
THEOREM_WORDS = "定理 定义 引理 推论 公理 命题 证明 Theorem Definition Lemma Corollary Axiom Proposition Proof".split()

# What a blank page says of itself.
BLANK_WORDS = "空白页 本页空白 无内容 没有内容 无文字 没有任何内容 空白 blank empty nocontent 无内容页".split()

# Function characters; a two-character term with one of them is a fragment.
FRAGMENT_CHARS = "的 了 么 呢 吗 吧 啊 之 其 及 也 都 而 但 且 被 把 从 将 这 那 或 所 与 为 是 在 以".split()

FULL_WIDTH = "".join(chr(c) for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), *range(0xFF10, 0xFF1A), 0x3000))
HALF_WIDTH = "".join(chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x30, 0x3A), 0x20))


def _none_of(words: Column, stop: list[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(stop))


def han_bigrams(text: Column) -> Column:
    """Overlapping pairs of neighbouring Han characters, without stopwords, repeats kept."""
    return _none_of(F.regexp_extract_all(text, F.lit(f"(?=([{HAN}]{{2}}))"), F.lit(1)), STOPWORDS_HAN)


def english_words(text: Column) -> Column:
    """Lower-cased ASCII words of three characters or more, without stopwords, repeats kept."""
    return _none_of(raw_words(text), STOPWORDS_ENGLISH)


def raw_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z\-]{2,}"), F.lit(0))


def terms(text: Column) -> Column:
    """All terms of a text: Han bigrams, then English words."""
    return F.concat(han_bigrams(text), english_words(text))


def query_tokens(text: Column) -> Column:
    """Distinct query tokens: whole Han runs of two or more, or identifiers; case matters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"[{HAN}]{{2,}}|[A-Za-z][A-Za-z0-9_]*"), F.lit(0)))


def clean_cluster_name(name: Column) -> Column:
    """Full-width to ASCII, anything but Han, letters, digits to single spaces, none between two Han characters."""
    s = F.translate(F.coalesce(name, F.lit("")), FULL_WIDTH, HALF_WIDTH)
    s = F.trim(F.regexp_replace(s, f"[^{HAN}A-Za-z0-9]+", " "))
    return F.regexp_replace(s, f"(?<=[{HAN}]) (?=[{HAN}])", "")


def clean_profile_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"(?U)[^\w]+", " "))


def clean_title(title: Column) -> Column:
    """Without bracketed spans; underscores to spaces."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"[（(【\[].*?[）)】\]]", " "), "_+", " ")


def strip_latex(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\{[^{}\n]*[A-Za-z0-9\\][^{}\n]*\}", " "), r"\\[A-Za-z]+", " ")


def is_fragment(term: Column) -> Column:
    return (F.length(term) == 2) & term.rlike("[" + "".join(FRAGMENT_CHARS) + "]")


def inner_bigrams(term: Column) -> Column:
    """Bigrams inside the Han runs of more than two characters of a term."""
    runs = F.regexp_extract_all(term, F.lit(f"[{HAN}]{{3,}}"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit("(?=(..))"), F.lit(1)))))


def is_blank_page(text: Column) -> Column:
    """Says a page that it is blank: nothing but marks, or at most 20 characters with a blank word."""
    norm = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[^0-9a-z{HAN}]", "")
    said = F.lit(False)
    for w in BLANK_WORDS:
        said = said | F.contains(norm, F.lit(w))
    return F.when(F.coalesce(text, F.lit("")) == "", False).when(norm == "", True).when(F.length(norm) > 20, False).otherwise(said)


def is_theorem(line: Column) -> Column:
    return line.rlike("|".join(THEOREM_WORDS))


def paragraphs(text: Column) -> Column:
    """The lines that are not blank, stripped."""
    return F.filter(F.transform(F.split(text, "\r?\n", -1), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")


def numbered_paragraphs(text: Column) -> Column:
    return F.array_join(F.transform(paragraphs(text), lambda p, i: F.concat(F.lit("【第"), (i + 1).cast("string"), F.lit("段】"), p)), "\n")


def citations(text: Column) -> Column:
    """(chapter, para) of each citation; a page citation has para 页."""
    pattern = r"【(?:《[^】]*》)?第\s*(\d+)\s*章\s*第\s*([\d\-]+)\s*段】|【第\s*(\d+)\s*页】"
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = lambda s, k: F.regexp_extract(s, pattern, k)
    return F.transform(
        whole,
        lambda s: F.when(part(s, 1) != "", F.struct(part(s, 1).cast("int").alias("chapter"), part(s, 2).alias("para"))).otherwise(
            F.struct(part(s, 3).cast("int").alias("chapter"), F.lit("页").alias("para"))
        ),
    )


def json_block(text: Column) -> Column:
    """The text from the first { to the last }, code fences taken off; null without one."""
    s = F.regexp_replace(F.trim(text), r"(?m)^```(?:json)?\s*|\s*```$", "")
    start = F.instr(s, "{")
    end = F.length(s) - F.instr(F.reverse(s), "}") + 1
    return F.when((start > 0) & F.contains(s, F.lit("}")), F.substring(s, start, F.greatest(end - start + 1, F.lit(0))))


def snippet(text: Column, word: str, radius: int = 30) -> Column:
    """The first hit with ``radius`` characters on both sides, … where cut; the text's head without a hit."""
    at = F.instr(text, word)
    start = F.greatest(F.lit(1), at - radius)
    end = F.least(F.length(text), at + len(word) - 1 + radius)
    cut = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, end - start + 1), F.when(end < F.length(text), "…").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.left(text, F.lit(2 * radius)))


def search_words(query: Column, strict: bool = False, most: int = 8) -> Column:
    """Words of a search query of three characters or more, at most ``most``, special characters taken out.

    ``strict`` also takes out digits and , - . / ; as the older rule with its wide character range did.
    """
    special = r'["*():^~+\-<>{}\[\]]' if not strict else r'["*():^~+-<>{}\[\]]'
    words = F.split(F.trim(F.regexp_replace(F.coalesce(query, F.lit("")), special, " ")), r"\s+")
    return F.slice(F.filter(words, lambda w: F.length(w) >= 3), 1, most)


def highlight(text: Column, words: list[str]) -> Column:
    """HTML with each hit of a word, in any case, marked; the text's own markup is escaped first."""
    import re

    s = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    if not words:
        return s
    return F.regexp_replace(s, "(?i)(" + "|".join(re.escape(w) for w in words) + ")", "<mark>$1</mark>")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def quote_position(text: Column, quote: Column) -> Column:
    """Where a quote starts in a text when white space is squeezed in both; 0 if nowhere."""
    return F.position(F.trim(squeeze(quote)), squeeze(text))


def strip_markdown(text: Column) -> Column:
    for pattern, to in (
        (r"(?m)^#{1,6}\s+", ""), (r"(?m)^\s*>\s?", ""), (r"`{1,3}([^`]*)`{1,3}", "$1"), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"(\*\*|__)(.*?)\1", "$2"), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""),
    ):
        text = F.regexp_replace(text, pattern, to)
    return text


def unclosed_math(text: Column) -> Column:
    """Is there an odd number of $$ marks?"""
    return F.regexp_count(text, F.lit(r"\$\$")) % 2 == 1


def session_key(book: Column, mode: Column, session: Column) -> Column:
    return F.when(book.isNotNull(), F.concat_ws(":", F.lit("book"), book.cast("string"), mode)).otherwise(F.concat(F.lit("global:"), session.cast("string")))


def unescape_quotes(text: Column) -> Column:
    return F.replace(text, F.lit('\\"'), F.lit('"'))


def mask_key(key: Column) -> Column:
    """First three and last four characters; all stars for eight or fewer."""
    n = F.length(key)
    stars = lambda k: F.repeat(F.lit("*"), k)
    return F.when(n <= 8, stars(n)).otherwise(F.concat(F.left(key, F.lit(3)), stars(n - 7), F.right(key, F.lit(4))))


def utf16_units(text: Column) -> Column:
    """The UTF-16 code units of a text, two for a character beyond the basic plane, as browsers number them."""
    digits = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    return F.transform(digits, lambda d: F.conv(d, 16, 10).cast("long"))


def rolling_hash(text: Column, start: int, factor: int) -> Column:
    """h = h * factor + code unit, modulo 2**32, over the UTF-16 code units of a text."""
    return F.aggregate(utf16_units(text), F.lit(start).cast("long"), lambda h, u: (h * factor + u) % (1 << 32))


def list_fingerprint(texts: Column) -> Column:
    """djb2 over a list of texts, each followed by a comma, so that where they part counts."""
    joined = F.array_join(F.transform(texts, lambda x: F.concat(F.coalesce(x, F.lit("")), F.lit(","))), "")
    return rolling_hash(joined, 5381, 33)
