import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillmill.llm import fim, registry, sql
from tests.compare import compare, connect
from tests.llm import helpers

MORE = [
    (20, "a <P> b", "en", "a"), (21, "lone <S", "en", "a"), (22, " \n lead and trail \t ", "en", "a"), (23, "x", "en", "a"),
    *[(k, f"<{'P' * (k % 2)} some words {k} < > <{'M' * (k % 3)}", "en", "a") for k in range(100, 160)],
    *[(k, "q" * k, "en", "a") for k in range(200, 230)], (300, "\x00 \x1c   \U0001f469 é", "en", "a"),
]


def plain(doc_id, text, seed=42):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    d = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    spm = h[3] % 100 < 80
    return (doc_id, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}")


@pytest.fixture(scope="module")
def got(spark):
    df = fim.transform(helpers.docs(spark, helpers.AWKWARD + MORE))
    return df.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()


def test_brute_force(got):
    want = [plain(r[0], r[1]) for r in helpers.AWKWARD + MORE]
    key = lambda r: (str(r[0]), r[5])
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    assert {r[2] for r in want} == {"plain", "spm", "psm"}


def test_restored(got):
    texts = {(r[0], r[1] or "") for r in helpers.AWKWARD + MORE}
    assert {(r["id"], r["back"]) for r in got} == texts


def test_empty_table_and_seed(spark):
    none = fim.transform(helpers.docs(spark, []))
    assert none.collect() == [] and none.columns == ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = [(k, "one two three four", "en", "a") for k in range(50)]
    other = fim.transform(helpers.docs(spark, rows), seed=7, fim_percent=100, spm_percent=0).collect()
    assert {r["form"] for r in other} == {"psm"} and len({r["output"] for r in other}) > 5


def test_no_shuffle_and_one_match_at_a_time(spark):
    plan = fim.transform(helpers.docs(spark, helpers.AWKWARD))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    import tracemalloc

    text = "word " * 400_000
    tracemalloc.start()
    n = fim.count_units(text)
    assert n == 400_001 and fim.ends_of(text, 1000, n) == (4999, len(text))
    assert tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()


def test_twin(spark, sf_dir):
    assert compare(spark, sf_dir, connect(sf_dir), registry.queries()["op11_fill_in_middle"], sql.ORACLES["op11_fill_in_middle"]) == ""
