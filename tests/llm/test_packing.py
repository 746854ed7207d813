import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillmill.llm import packing
from quillmill.llm.packing import Limits, Pool, pack, rounds
from tests.llm import helpers

VOCAB = public_tokenizers.path("word_bpe_49k.json")


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def examples(spark, rows):
    data = [(i, None if n is None else bytearray(np.arange(n, dtype="<u4").tobytes()), p) for i, n, p in rows]
    return spark.createDataFrame(data, "id bigint, ids binary, prompt bigint").repartition(3, "id")


def checked(rows, limits, whole):
    """Pieces cover every example once, sequences have no gaps, keep their limits and need no padding."""
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append(r)
        docs[r["id"]].append(r)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= limits.tokens and (at == limits.tokens or at & (at - 1) == 0)
        assert len(pieces) <= limits.segments and sum(r["loss"] for r in pieces) <= limits.loss
    for i, n in whole.items():
        at = 0
        for r in sorted(docs.get(i, []), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == n and len(r["ids"]) == 4 * r["length"]
            assert np.frombuffer(r["ids"], "<u4").tolist() == list(range(at, at + r["length"]))
            at += r["length"]
        assert at == n
    assert set(docs) == {i for i, n in whole.items() if n}
    return seqs


@pytest.mark.parametrize("limits", [Limits(), Limits(64, 4, 40), Limits(64, 1, 64), Limits(100, 8, 7), Limits(16, 3, 16)])
def test_limits_hold_and_nothing_is_lost(spark, limits):
    rng = np.random.default_rng(5)
    sizes = [*rng.integers(1, 90, 300).tolist(), 5000, 1, 1, 64, 128, None, 0]
    rows = [(k, n, [None, 0, 10, 1_000_000, -3][k % 5]) for k, n in enumerate(sizes)]
    got = pack(examples(spark, rows), limits, prompt=F.col("prompt")).collect()
    checked(got, limits, {i: n or 0 for i, n, _ in rows})


def test_dot_product_takes_what_suits_the_scarce_dimension():
    """With loss scarce, an example that bears little comes before one of as many tokens that bears much."""
    pool = Pool()
    pool.add([(0, 0, 40, 0), (1, 0, 40, 38), (2, 0, 60, 0)])
    first = packing.fill(pool, Limits(100, 8, 62))
    assert [p[0] for p in first] == [2, 1]


def test_full_sequences_but_for_a_tail(spark):
    rows = [(k, 100 + k % 700, None) for k in range(2000)]
    seqs = checked(pack(examples(spark, rows)).collect(), Limits(), {i: n for i, n, _ in rows})
    short = [s for s in seqs.values() if sum(r["length"] for r in s) < 2048]
    assert len(short) <= 3 * 11  # three partitions, a tail of powers of two each


def test_blocks_carry_over(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ITEMS", 7)
    pool, placed = Pool(), defaultdict(int)
    for at in range(0, 70, 7):
        pool.add([(k, 0, 5 + k, 0) for k in range(at, at + 7)])
        for pieces in rounds(pool, Limits(32, 4, 32), last=at == 63):
            size = sum(p[2] for p in pieces)
            assert len(pieces) <= 4 and size <= 32 and size & (size - 1) == 0
            for item, _, n, _ in pieces:
                placed[item] += n
    assert placed == {k: 5 + k for k in range(70)} and not len(pool.rows)


def test_token_ids_equal_the_library(spark):
    more = [(50, "It's I'LL cliché-ÀÉ, <|endoftext|>x ǅ ß ÿ! (a) a's. don't", "en", "a"), (51, "ΑΣ ﬁ x<|startoftext|>", "en", "a")]
    rows = helpers.AWKWARD + more
    got = packing.token_ids(helpers.docs(spark, rows), VOCAB, end=1).collect()
    want = sorted((str(r[0]), np.array([*ids, 1], "<u4").tobytes()) for r, ids in zip(rows, library([r[1] for r in rows]), strict=True))
    assert sorted((str(r["id"]), bytes(r["ids"])) for r in got) == want


def test_query(spark, sf_dir):
    got = packing.op12_packing(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    ids = {r["doc_id"]: [*x, 1] for r, x in zip(docs, library([r["text"] for r in docs]), strict=True)}
    seqs, covered = defaultdict(int), defaultdict(int)
    for r in got:
        x = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(x)
        assert r["ids_crc32"] == zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        seqs[r["sequence_id"]] += r["length"]
        covered[r["doc_id"]] += r["length"]
    assert covered == {i: len(x) for i, x in ids.items()}
    assert all(n <= 2048 and (n == 2048 or n & (n - 1) == 0) for n in seqs.values())


def test_conversations_as_instruction_data(spark, sf_dir):
    """Turns of the assistant bear loss, the user's turn before them is the prompt."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    tokens = packing.token_ids(turns.withColumn("key", F.struct("conv_id", "turn", "role")), VOCAB, id_col="key", end=1)
    t = tokens.select("id.*", "ids")
    pairs = t.alias("u").join(t.alias("a"), F.expr("u.conv_id = a.conv_id and u.turn + 1 = a.turn and u.role = 'user' and a.role = 'assistant'"))
    pairs = pairs.select(F.struct("a.conv_id", "a.turn").alias("id"), F.expr("concat(u.ids, a.ids)").alias("ids"), (F.length("u.ids") / 4).cast("bigint").alias("prompt"))
    limits = Limits(512, 12, 300)
    got = pack(pairs, limits, prompt=F.col("prompt")).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.sum("loss").alias("w")).collect()
    assert got and all(r["n"] <= 512 and r["k"] <= 12 and r["w"] <= 300 for r in got)


def test_empty_and_awkward(spark):
    assert pack(examples(spark, [])).collect() == []
    rows = helpers.AWKWARD
    got = pack(packing.token_ids(helpers.docs(spark, rows), VOCAB, end=1)).collect()
    assert sum(r["length"] for r in got) == sum(len(x) + 1 for x in library([r[1] for r in rows]))
    assert sum(r["length"] for r in got if r["id"] is None) == sum(len(x) + 1 for x in library([r[1] for r in rows if r[0] is None]))
    with pytest.raises(ValueError):
        Limits(0)
