import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillmill.llm import bpe
from tests.llm.helpers import AWKWARD, docs

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)


def expected(text):
    ids = LIB.encode(text or "", add_special_tokens=False).ids
    return ids, LIB.decode(ids, skip_special_tokens=False)


def test_whole_table(spark, sf_dir):
    rows = {r.doc_id: r for r in bpe.op1_bpe(spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids, text = expected(d.text)
        got = rows[d.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_awkward_rows(spark):
    got = bpe.encode(docs(spark, AWKWARD), PATH).collect()
    assert len(got) == len(AWKWARD)
    want = sorted(((r[0], *expected(r[1])) for r in AWKWARD), key=str)
    assert sorted(((r.id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in got), key=str) == want


def test_empty_table(spark):
    assert bpe.encode(docs(spark, AWKWARD).limit(0), PATH).collect() == []
    assert bpe.digests(docs(spark, []), PATH).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    for t, (ids, text) in zip(texts, bpe.load(PATH).encode_texts(texts), strict=True):
        assert (np.frombuffer(ids, "<u4").tolist(), text) == expected(t)


def test_every_code_point():
    every = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    texts = ["".join(f"a{c}!{c}B{c}{c}" for c in every[k : k + 64]) for k in range(0, len(every), 64)]
    for t, (ids, text), e in zip(texts, bpe.load(PATH).encode_texts(texts), LIB.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids
        assert text == LIB.decode(e.ids, skip_special_tokens=False)


def test_equal_pairs_merge_from_the_left():
    b = bpe.load(PATH)
    words = ["n" * n for n in range(1, 60)] + ["lalala" * 5, "haha", "<|startoftext|>x<|endoftext|>"]
    ids, start = b.encode_words(words)
    for k, w in enumerate(words):
        mine = ids[start[k] : start[k + 1]].tolist()
        assert mine == expected(w)[0]
        assert b.decode(mine) == expected(w)[1]


def test_a_piece_is_merged_once_whatever_words_hold_it(monkeypatch):
    b, seen = bpe.Bpe(PATH), []
    merge = b.merge
    monkeypatch.setattr(b, "merge", lambda symbols, *more: seen.append(len(symbols)) or merge(symbols, *more))
    for texts, symbols in ((["haus haus, (Haus) HAUS.", "haus..."], 4 + len(",().") + len("...")), (["Haus, baum", None], 4)):
        seen.clear()
        for t, (ids, text) in zip(texts, b.encode_texts(texts), strict=True):
            assert (np.frombuffer(ids, "<u4").tolist(), text) == expected(t)
        assert sum(seen) == symbols


def test_parts_of_a_block_and_a_full_store(monkeypatch):
    b = bpe.Bpe(PATH)
    monkeypatch.setattr(bpe, "PART_TEXTS", 3)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 4)
    texts = [r[1] for r in AWKWARD]
    for block in (texts, texts[::-1], texts[:1], []):
        got = [(np.frombuffer(ids, "<u4").tolist(), text) for ids, text in b.encode_texts(block)]
        assert got == [expected(t) for t in block]
