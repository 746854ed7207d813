"""Operator 12: packing tokenized examples into sequences under several limits at once, by the dot-product heuristic."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.bpe import _byte_chars, _words, blocks
from quillmill.llm.common import release, table

#: A task packs so many examples or tokens at a time; bounds memory and the search for the best example.
BLOCK_ITEMS, BLOCK_TOKENS = 4096, 4_000_000
#: Encoded words and pieces of words kept by a task; emptied when full. Bounds memory (about 100 MB), never results.
CACHE_WORDS = 500_000


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold: tokens, segments (pieces of examples), and tokens that bear loss."""

    tokens: int = 2048
    segments: int = 32
    loss: int = 2048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits must be positive")


class Pool:
    """The examples (or what is left of them) that wait: item number, place of the first token left, tokens, prompt tokens left."""

    def __init__(self):
        self.rows = np.zeros((0, 4), dtype=np.int64)

    def add(self, rows) -> None:
        if len(rows):
            self.rows = np.concatenate([self.rows, np.asarray(rows, dtype=np.int64).reshape(-1, 4)])


def heads(tokens, prompt, left_tokens: int, left_loss: int):
    """How much of the front of each example goes into what is left of a sequence: prompt tokens bear no loss."""
    return np.minimum(np.minimum(tokens, left_tokens), prompt + left_loss)


def fill(pool: Pool, limits: Limits) -> list[tuple[int, int, int, int]]:
    """One sequence from the pool: pieces (item, start, length, prompt tokens in front). Takes what it uses out of the pool.

    Of the examples that fit whole, the one with the largest dot product of its demand with what is left of the
    sequence comes next, both as shares of the limits. Where none fits, or only one segment is left, the example that
    fills most is cut. Ends when a limit is reached or the pool is empty.
    """
    items, start, tokens, prompt = (pool.rows[:, k].copy() for k in range(4))
    loss = np.maximum(tokens - prompt, 0)
    waiting = np.ones(len(items), dtype=bool)
    t, s, w = limits.tokens, limits.segments, limits.loss
    out: list[tuple[int, int, int, int]] = []
    while t and s and waiting.any():
        fits = waiting & (tokens <= t) & (loss <= w)
        k = -1
        if fits.any():
            demand = tokens * (t / limits.tokens**2) + loss * (w / limits.loss**2) + s / limits.segments**2
            k = int(np.argmax(np.where(fits, demand, -1.0)))
        if k >= 0 and (s > 1 or tokens[k] == t):
            size = int(tokens[k])
        else:
            front = np.where(waiting, heads(tokens, prompt, t, w), 0)
            k = int(np.argmax(front))
            size = int(front[k])
            if not size:
                break
        out.append((int(items[k]), int(start[k]), size, int(prompt[k])))
        t, s, w = t - size, s - 1, w - max(size - int(prompt[k]), 0)
        if size == tokens[k]:
            waiting[k] = False
        else:
            start[k] += size
            tokens[k] -= size
            prompt[k] = max(int(prompt[k]) - size, 0)
            loss[k] = max(int(tokens[k] - prompt[k]), 0)
    pool.rows = np.stack([items, start, tokens, prompt], axis=1)[waiting]
    return out


def cut_at(pieces: list[tuple[int, int, int, int]], size: int):
    """Splits a sequence after ``size`` tokens: its pieces, and the rows that go back to the pool."""
    kept, back, at = [], [], 0
    for item, start, length, prompt in pieces:
        inside = min(length, max(size - at, 0))
        if inside:
            kept.append((item, start, inside, prompt))
        if inside < length:
            back.append((item, start + inside, length - inside, max(prompt - inside, 0)))
        at += length
    return kept, back


def rounds(pool: Pool, limits: Limits, last: bool) -> Iterator[list[tuple[int, int, int, int]]]:
    """Sequences from the pool. Full ones go out; one that no example can fill ends at the largest power of two below, where
    no padding is needed, and the rest waits again. A sequence that is only short of examples waits for the next block."""
    if limits.loss >= limits.tokens and len(pool.rows):  # whole sequences out of the front of long examples
        long = pool.rows[:, 2] >= limits.tokens
        for item, start, tokens, prompt in pool.rows[long].tolist():
            for at in range(0, tokens - limits.tokens + 1, limits.tokens):
                yield [(item, start + at, limits.tokens, max(prompt - at, 0))]
        full = pool.rows[:, 2] // limits.tokens * limits.tokens
        pool.rows[:, 1] += full
        pool.rows[:, 2] -= full
        pool.rows[:, 3] = np.maximum(pool.rows[:, 3] - full, 0)
        pool.rows = pool.rows[pool.rows[:, 2] > 0]
    while len(pool.rows):
        pieces = fill(pool, limits)
        size = sum(p[2] for p in pieces)
        if size < limits.tokens:
            short = not len(pool.rows) and len(pieces) < limits.segments
            if short and not last:
                pool.add([(i, a, n, p) for i, a, n, p in pieces])
                return
            pieces, back = cut_at(pieces, 1 << (size.bit_length() - 1))
            pool.add(back)
        yield pieces


def pack(examples: DataFrame, limits: Limits = Limits(), id_col: str = "id", ids_col: str = "ids", prompt: Column | None = None) -> DataFrame:
    """Packs examples: (id, start long, length long, ids binary, doc_tokens long, loss long, sequence_id long, offset long), one row a piece.

    ``ids`` holds little-endian unsigned 32-bit token ids, of whole examples in ``examples`` and of pieces in the result;
    ``prompt`` is the number of tokens at an example's start that bear no loss (null or not given: none). A sequence keeps
    all ``limits``; every token lies in exactly one piece; offsets in a sequence have no gaps. Sequences are full or a power of two long, so
    none needs padding. Every partition is packed for itself, in blocks, in one pass and without a shuffle: no example is
    seen by more than one task, whatever their number or length. A sequence's id is its partition's number and its place
    there, so reruns over the same partitions agree. An example without ids (null or empty) has no piece. Null
    ids of rows are kept, repeated rows are packed again, other columns are not looked at, an empty table gives an empty table.
    """
    src = examples.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"), F.coalesce(prompt if prompt is not None else F.lit(None), F.lit(0)).cast("bigint").alias("prompt")
    )
    kind = dict(src.dtypes)["id"]

    def run(batches):
        base = TaskContext.get().partitionId() << 33
        pool, held = Pool(), {}  # held: item -> (id, ids), until its last token is placed
        state = {"items": 0, "sequences": 0, "kind": None}

        def write(sequences) -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for pieces in sequences:
                at = 0
                for item, start, length, front in pieces:
                    who, ids, total, left = held[item]
                    rows.append((who, start, length, ids[4 * start : 4 * (start + length)], total, max(length - front, 0), base + state["sequences"], at))
                    at += length
                    if left == length:
                        del held[item]
                    else:
                        held[item] = (who, ids, total, left - length)
                state["sequences"] += 1
                size += at
                if size >= 1 << 20:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

        def made(rows) -> pa.RecordBatch:
            kinds = [state["kind"], pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            names = ["id", "start", "length", "ids", "doc_tokens", "loss", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        new, tokens = [], 0
        for batch in batches:
            state["kind"] = batch.schema.field("id").type
            for who, ids, front in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                data = ids.as_py() or b""
                n = len(data) // 4
                if not n:
                    continue
                item = state["items"]
                state["items"] += 1
                held[item] = (who.as_py(), data, n, n)
                new.append((item, 0, n, min(max(front.as_py(), 0), n)))
                tokens += n
                if len(new) >= BLOCK_ITEMS or tokens >= BLOCK_TOKENS:
                    pool.add(new)
                    new, tokens = [], 0
                    yield from write(rounds(pool, limits, last=False))
        pool.add(new)
        yield from write(rounds(pool, limits, last=True))
        release()

    schema = f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, loss bigint, sequence_id bigint, offset bigint"
    return src.mapInArrow(run, schema)


#: Letters of Latin-1, whose lower case and normal form are plain, and behind them ASCII marks that belong to no contraction.
_SIMPLE = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")


class Encoder:
    """The tokenizers library over words: each distinct word is encoded once a block and kept in a bounded cache.

    A run of letters with marks behind it, as most words are, goes to the library's model as these two pieces; all other words
    take the library's whole way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.bytes = {k: c for k, c in enumerate(_byte_chars())}
        self.cache: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        got = self.cache.get(piece)
        if got is None:
            mapped = piece.lower() if piece.isascii() else piece.lower().encode().decode("latin-1").translate(self.bytes)
            got = self.cache[piece] = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return got

    def learn(self, words: set[str]) -> None:
        odd = []
        for word in words:
            m = _SIMPLE.fullmatch(word)
            if m is None:
                odd.append(word)
            elif m[2]:
                self.cache[word] = self.piece(m[1]) + self.piece(m[2])
            else:
                self.piece(word)
        for at in range(0, len(odd), 4096):
            part = odd[at : at + 4096]
            for word, got in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.cache[word] = array("I", got.ids).tobytes()

    def ids_of(self, texts: list[str | None]) -> Iterator[bytes]:
        """For each whole text its ids, little-endian unsigned 32-bit."""
        split = [_words(x) for x in texts]
        words = set().union(*split) - self.cache.keys()
        if len(self.cache) + len(words) > CACHE_WORDS:
            self.cache = {}
            words = set().union(*split)
        self.learn(words)
        get = self.cache.__getitem__
        for x in split:
            yield b"".join(map(get, x))


_encoders: dict[str, Encoder] = {}


def token_ids(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", end: int | None = None) -> DataFrame:
    """(id, ids binary): the ids of every whole text by the tokenizers library and, where given, an end id; a null text has only the latter.

    For vocabularies that cut texts at white space and drop it, as ``word_bpe_49k.json`` does: words are encoded for themselves.
    """
    tail = b"" if end is None else int(end).to_bytes(4, "little")

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if vocab not in _encoders:
            _encoders[vocab] = Encoder(vocab)
        encoder = _encoders[vocab]
        for block in blocks(batches, "text"):
            for at in range(0, block.num_rows, 1024):
                part = block.slice(at, 1024)
                got = [x + tail for x in encoder.ids_of(part["text"].to_pylist())]
                yield pa.RecordBatch.from_arrays([part["id"].combine_chunks(), pa.array(got, pa.binary())], ["id", "ids"])
        encoder.cache = {}
        release()

    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, ids binary")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    got = pack(token_ids(docs, public_tokenizers.path("word_bpe_49k.json"), end=1))
    return got.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss"
    )
