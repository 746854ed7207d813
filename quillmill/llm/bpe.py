"""Operator 1: BPE encoding and decoding with a pair occurrence index."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from quillmill.llm.common import release, table

#: A partition's texts are taken in blocks of about so many characters, so memory does not follow the partition.
BLOCK_CHARS = 8_000_000
#: Encoded pieces kept by a task between blocks; emptied when full. Bounds memory, never results.
CACHE_PIECES = 200_000
#: The ids and decoded text of so many texts of a block are held at once.
PART_TEXTS = 256

_WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\p{White_Space}+")


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


def _ranges(category: str) -> str:
    """The code points of categories that start so in Python's Unicode tables, as the inside of a character class."""
    out, start = [], None
    for k in range(sys.maxunicode + 2):
        inside = k <= sys.maxunicode and unicodedata.category(chr(k)).startswith(category)
        if inside and start is None:
            start = k
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{k - 1:08x}")
            start = None
    return "".join(out)


class Bpe:
    """A word-end BPE vocabulary (``tokenizers`` JSON): lower-cased NFC words, byte-level symbols, ``</w>`` at ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.end = model["end_of_word_suffix"] or ""
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        pattern = split["pattern"]["Regex"]
        ascii_ = pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(r"\s", r"\t-\r\x20")
        for a, b in ((r"\p{L}", _ranges("L")), (r"\p{N}", _ranges("N")), (r"\s", _WHITE)):
            pattern = pattern.replace(a, b)
        self.pieces, self.ascii_pieces = re.compile(pattern), re.compile(ascii_)
        self.newer = re.compile("[" + _ranges("Cn") + "]")
        self.path = path
        self.library = None
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        n = max(self.tokens) + 1
        left = np.array([self.ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([self.ids[b] for _, b in pairs], dtype=np.int64)
        made = np.array([self.ids[a + b] for a, b in pairs], dtype=np.int64)
        self.n, self.left, self.right, self.made = n, left, right, made
        self.keys, first = np.unique(left * n + right, return_index=True)
        self.rank_of = first.astype(np.int64)
        chars = _byte_chars()
        self.mid = np.array([self.ids[c] for c in chars], dtype=np.int32)
        self.last = np.array([self.ids[c + self.end] for c in chars], dtype=np.int32)
        self.strings = pa.array([self.tokens.get(i) for i in range(n)], pa.large_string())
        self.forget()

    def forget(self) -> None:
        """Empties the store of encoded pieces: their rows by piece, and the ids of all rows one after the other.

        Special tokens are rows too. A line break before them keeps them apart: no piece holds white space.
        """
        self.rows: dict[str, int] = defaultdict(count().__next__)
        for token in self.special:
            self.rows["\n" + token]
        self.ids_of = np.array(list(self.special.values()), dtype=np.uint32)
        self.start_of = np.arange(len(self.special) + 1, dtype=np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, or -1."""
        key = a.astype(np.int64) * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], -1)

    def merge(self, symbols: np.ndarray, nxt: np.ndarray, prv: np.ndarray) -> np.ndarray:
        """Applies all merges in place to the linked symbols; returns which symbols are left.

        The index maps each active rank to the positions of its pair. The lowest active rank is taken, all its
        positions that still hold the pair are merged at once, and the pairs this makes are added to their lists.
        """
        alive, merged = np.ones(len(symbols), dtype=bool), np.zeros(len(symbols), dtype=bool)
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            if not len(at):
                return
            rank = self.ranks(symbols[at], symbols[nxt[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True):
                if not index[r]:
                    heapq.heappush(heap, r)
                index[r].append(part)

        add(np.flatnonzero(nxt >= 0).astype(np.int32))
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)  # a pair is added when it arises, once, so no two parts share a position
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            a, b = self.left[r], self.right[r]
            at = at[alive[at] & (symbols[at] == a) & (nxt[at] >= 0)]
            at = at[symbols[nxt[at]] == b]
            if a == b and len(at) > 1:  # in a run of equal symbols, pairs are taken from the left
                at = np.sort(at)
                taken, last = [], -1
                for p in at.tolist():
                    if p != last:
                        taken.append(p)
                        last = int(nxt[p])
                at = np.array(taken, dtype=at.dtype)
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            symbols[at] = self.made[r]
            alive[gone] = False
            nxt[at] = after
            has = after >= 0
            prv[after[has]] = at[has]
            before = prv[at]
            before = before[before >= 0]
            merged[at] = True
            before = before[~merged[before]]  # those merged themselves are among ``at``
            merged[at] = False
            add(np.concatenate([before, at[has]]))
        return alive

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words (runs without white space), one after the other, and where each word's ids start.

        Words are made of pieces that are merged each for themselves; pieces not stored yet are merged, each once.
        """
        row = self.rows
        known = len(row)
        rows, many = array("i"), array("i")
        for word in words:
            if word.isascii() and word.isalpha():
                rows.append(row[word.lower()])
                many.append(1)
                continue
            before = len(rows)
            for part in self.specials.split(word) if "<|" in word else (word,):
                if part in self.special:
                    rows.append(row["\n" + part])
                elif part:
                    rows.extend([row[piece] for piece in self.cut(part)])
            many.append(len(rows) - before)
        if len(row) > known:
            ids, start = self.encode_pieces(list(islice(row, known, None)))
            self.start_of = np.concatenate([self.start_of, start[1:] + len(self.ids_of)])
            self.ids_of = np.concatenate([self.ids_of, ids])
        ids, start = _gathered(self.ids_of, self.start_of, np.array(rows, dtype=np.int32))
        return ids, start[_starts(np.array(many, dtype=np.int32))]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and where each piece's ids start.

        All pieces' symbols are in one pair occurrence index.
        """
        if all(map(str.isascii, pieces)):
            size = np.fromiter(map(len, pieces), dtype=np.int32, count=len(pieces))
            raw = np.frombuffer("".join(pieces).encode(), dtype=np.uint8)
        else:
            coded = [p.encode() for p in pieces]
            size = np.fromiter(map(len, coded), dtype=np.int32, count=len(coded))
            raw = np.frombuffer(b"".join(coded), dtype=np.uint8)
            del coded
        ends = np.cumsum(size, dtype=np.int32) - 1
        symbols = self.mid[raw]
        symbols[ends] = self.last[raw[ends]]
        n = len(raw)
        nxt = np.arange(1, n + 1, dtype=np.int32)
        nxt[ends] = -1
        prv = np.arange(-1, n - 1, dtype=np.int32)
        prv[ends[:-1] + 1] = -1
        alive = self.merge(symbols, nxt, prv)
        of = np.repeat(np.arange(len(pieces), dtype=np.int32), size)[alive]
        return symbols[alive].astype(np.uint32), _starts(np.bincount(of, minlength=len(pieces)))

    def cut(self, part: str) -> list[str]:
        """The pieces of a word that are merged each for themselves, normalized."""
        if part.isascii():
            return self.ascii_pieces.findall(part.lower())
        if not part.isprintable() and self.newer.search(part):
            # characters newer than Python's Unicode tables: their class and case are the library's
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            text = self.library.normalizer.normalize_str(part)
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        if not unicodedata.is_normalized("NFC", part):
            part = unicodedata.normalize("NFC", part)
        part = part.replace("Σ", "σ").lower()
        return [part] if part.isalpha() else self.pieces.findall(part)

    def decode(self, ids) -> str:
        """The text of ids: their vocabulary entries, special ones included, joined by spaces (no decoder is set)."""
        return " ".join([self.tokens[i] for i in ids])

    def decode_all(self, ids: np.ndarray, start: np.ndarray) -> pa.Array:
        """``decode`` of the ids of many texts, one after the other, and where each text's ids start."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(start, pa.int32()), self.strings.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))

    def encode_parts(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of whole texts, one after the other, and where each text's ids start: a part of the texts at a time."""
        code: dict[str, int] = defaultdict(count().__next__)
        codes, bounds = array("i"), array("q", [0])
        for x in texts:
            codes.extend(map(code.__getitem__, _words(x)))
            bounds.append(len(codes))
        if len(self.rows) > CACHE_PIECES:
            self.forget()
        words = list(code)
        del code
        ids, start = self.encode_words(words)
        del words
        codes, bounds = np.array(codes, dtype=np.int32), np.array(bounds, dtype=np.int64)
        for at in range(0, len(texts), PART_TEXTS):
            cut = bounds[at : at + PART_TEXTS + 1]
            part, starts = _gathered(ids, start, codes[cut[0] : cut[-1]])
            yield part, starts[cut - cut[0]]

    def encode_texts(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """For each whole text its ids (little-endian unsigned 32-bit) and their decoded text."""
        for ids, start in self.encode_parts(texts):
            for a, b, text in zip(start[:-1].tolist(), start[1:].tolist(), self.decode_all(ids, start).to_pylist(), strict=True):
                yield ids[a:b].astype("<u4").tobytes(), text


def _starts(sizes: np.ndarray) -> np.ndarray:
    """Where each of adjoining runs of these sizes starts, and where the last one ends."""
    out = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def _gathered(values: np.ndarray, start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``rows`` of ``values``, of which run k begins at ``start[k]``, one after the other, and where each starts."""
    first = start[rows]
    size = start[1:][rows] - first
    at = _starts(size)
    return values[np.arange(at[-1]) + np.repeat(first - at[:-1], size)], at


def _words(text: str | None) -> list[str]:
    """The runs without white space; U+001C to U+001F do not count as white space in the vocabulary's pattern."""
    if not text:
        return []
    return [w for w in _SPACE.split(text) if w] if _ODD_SPACE.search(text) else text.split()


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary, kept by the worker. ``path`` must exist on each worker, as installed package data does."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    held, size = [], 0
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            held.append(part)
            size += part[column].nbytes
            if size >= BLOCK_CHARS:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def encode(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text: (id, n_tokens, ids binary, decoded string), one row per input row, no shuffle.

    ``ids`` holds little-endian unsigned 32-bit ids; ``decoded`` is the decoding of exactly these ids. A null or
    empty text has no tokens and decodes to the empty string. Repeated rows are encoded again, a null id is
    kept, other columns are not looked at. An empty table gives an empty table. Words are cut once per block of texts,
    and their pieces encoded once through the pair occurrence index and reused from a bounded store.
    """

    def run(batches):
        bpe = load(vocab)
        for t in blocks(batches, "text"):
            at = 0
            for ids, start in bpe.encode_parts(t["text"].to_pylist()):
                raw = memoryview(ids.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        t["id"].slice(at, len(start) - 1).combine_chunks(),
                        pa.array(np.diff(start), pa.int64()),
                        pa.array([raw[4 * a : 4 * b] for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)], pa.binary()),
                        bpe.decode_all(ids, start).cast(pa.string()),
                    ],
                    ["id", "n_tokens", "ids", "decoded"],
                )
                at += len(start) - 1

        bpe.forget()
        release()

    kind = dict(docs.dtypes)[id_col]
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return src.mapInArrow(run, f"id {kind}, n_tokens bigint, ids binary, decoded string")


def _digests(raw: memoryview, start: np.ndarray) -> list[str]:
    """The SHA-256 of each of adjoining runs of bytes, in hex."""
    cut = start.tolist()
    return [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cut, cut[1:], strict=False)]


def digests(docs: DataFrame, vocab: str) -> DataFrame:
    """``encode`` reduced to digests inside the same worker pass: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches):
        bpe = load(vocab)
        for t in blocks(batches, "text"):
            n, ids_sha, text_sha = [], [], []
            for ids, start in bpe.encode_parts(t["text"].to_pylist()):
                n += np.diff(start).tolist()
                ids_sha += _digests(memoryview(ids.astype("<u4").tobytes()), 4 * start)
                text = bpe.decode_all(ids, start)
                ends = np.frombuffer(text.buffers()[1], dtype=np.int64, count=text.offset + len(text) + 1)[text.offset :]
                text_sha += _digests(memoryview(text.buffers()[2] or b""), ends)
            yield pa.RecordBatch.from_arrays(
                [t["doc_id"].combine_chunks(), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        bpe.forget()
        release()

    kind = dict(docs.dtypes)["doc_id"]
    src = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
