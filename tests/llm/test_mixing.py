import random
import re

from quillmill.llm import mixing
from tests.llm.helpers import AWKWARD, WORD, docs


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        rest = {s: w[s] for s in names if s not in fixed}
        left = total - sum(fixed.values())
        t = {s: left * x / sum(rest.values()) for s, x in rest.items()}
        over = [s for s in t if t[s] > cap * sizes[s]]
        if not over:
            return fixed | t
        fixed |= {s: cap * sizes[s] for s in over}


def check(rows, got, longest_matters=True):
    sizes, longest = {}, {}
    for _, t, _, s in rows:
        n = len(WORD.findall(t or ""))
        sizes[s] = sizes.get(s, 0) + n
        longest[s] = max(longest.get(s, 0), n)
    want = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken <= 2 * r.size and r.taken == r.times * r.size
        taken[r.source] += r.taken
    slack = 2 * max(longest.values(), default=0)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= slack
    assert abs(sum(taken.values()) - sum(want.values())) <= slack


def plain_taken(spark, rows, weights=(3, 1, 2), share=1.5, cap=2):
    """Weighted fair queueing by hand: every copy's finish time, all in one sorted list, until the budget is used up."""
    from pyspark.sql import functions as F

    df = docs(spark, rows)  # ids are unique here, so every row is the first of its likes
    by = {r.doc_id: r.r for r in df.select("doc_id", mixing.turn(F.col("doc_id"), mixing.row_keys(df)[0], F.lit(0), 6).alias("r")).collect()}
    turn = {k: by[r[0]] for k, r in enumerate(rows)}
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    of = {}
    for k, r in enumerate(rows):
        of.setdefault(r[3], []).append(k)
    sizes = {s: sum(size[k] for k in ks) for s, ks in of.items()}
    goal = plain_targets(sizes, weights, share, cap)
    low = lambda x: (x is not None, x if x is not None else 0)
    line = []
    for s, ks in of.items():
        cum = 0
        for k in sorted(ks, key=lambda k: (turn[k] % 2**64, low(rows[k][0]), size[k])):
            cum += size[k]
            for e in range(cap):
                if size[k] and goal[s]:
                    line.append(((cum + e * sizes[s]) / goal[s], (s is not None, (s or "").encode()), turn[k], low(rows[k][0]), size[k], e, k))
    times, left = [0] * len(rows), sum(goal.values())
    for *_, n, _, k in sorted(line):
        left -= n
        if left < 0:
            break
        times[k] += 1
    return times


def test_taken_of_each_document(spark, sf_dir, monkeypatch):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rng = random.Random(16)
    made = [(i, "w " * rng.randint(0, 30), "en", rng.choice(["hot", "hot", "a", "b", None])) for i in range(500)]
    for some in (rows, made):
        got = {r.id: r.times for r in mixing.mix(docs(spark, some)).collect()}
        assert [got[r[0]] for r in some] == plain_taken(spark, some)


def test_whole_table(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in d.collect()]
    got = mixing.mix(d).collect()
    assert len(got) == len(rows)
    check(rows, got)
    again = mixing.mix(d.repartition(5)).collect()
    assert sorted(got, key=str) == sorted(again, key=str)
    assert sorted(r.size for r in mixing.op6_mixing(spark, sf_dir).collect()) == sorted(len(WORD.findall(r[1] or "")) for r in rows)


def test_awkward_rows(spark):
    got = mixing.mix(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    check(AWKWARD, got)
    assert mixing.mix(docs(spark, [])).collect() == []
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix(docs(spark, [(1, None, None, None), (2, "", None, "a")])).collect())


def test_hot_source_and_many_windows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "WINDOW_ROWS", 10)
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 30), "en", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(900)]
    check(rows, mixing.mix(docs(spark, rows)).collect())


def test_targets_reshare(spark):
    for seed in range(6):
        rng = random.Random(seed)
        sizes = {f"s{k:02}": rng.choice([0, 1, 5, 100, 10_000]) for k in range(rng.randint(1, 12))}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r.source: r.target for r in mixing.targets(df, (3.0, 1.0, 2.0), 1.5, 2.0).collect()}
        want = plain_targets(sizes) if any(sizes.values()) else dict.fromkeys(sizes, 0.0)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in got)


def test_rows_of_the_mix(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = {r.id: r.times for r in mixing.mix(d).collect()}
    out = mixing.mixed_rows(d)
    assert out.columns == d.columns
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert n == {i: t for i, t in plan.items() if t}
    assert re is not None
    rows = mixing.mixed_rows(docs(spark, AWKWARD))
    assert rows.columns == docs(spark, AWKWARD).columns and rows.count() > 0


def words_of(rows):
    return sum(len(WORD.findall(r.text or "")) for r in rows)


def test_null_and_repeated_ids_keep_the_budget(spark, monkeypatch):
    """The rows of the mix have as many words as ``mix`` takes, whatever ids they share."""
    monkeypatch.setattr(mixing, "WINDOW_ROWS", 100)
    monkeypatch.setattr(mixing, "CHUNK", 7)
    nulls = [(None, f"three words {k}", "en", "a") for k in range(3000)]
    equal = [(None, "the same words again", "en", "a")] * 500 + [(7, "the same words again", "en", "b")] * 300
    shared = [(1, f"x{k} y z w" + " v" * (k % 3), "en", "a") for k in range(40)] + [(k, "p q", "en", None) for k in range(10)]
    for rows in (nulls, equal, shared, nulls[:100] + equal + shared):
        d = docs(spark, rows)
        plan, out = mixing.mix(d).collect(), mixing.mixed_rows(d).collect()
        check(rows, plan)
        assert words_of(out) == sum(r.taken for r in plan)
        times = {}
        for r in plan:
            times[r.id, r.source, r.size] = times.get((r.id, r.source, r.size), 0) + r.times
        got = {}
        for r in out:
            key = r.doc_id, r.source, len(WORD.findall(r.text))
            got[key] = got.get(key, 0) + 1
        assert got == {k: n for k, n in times.items() if n}
        again = mixing.mixed_rows(d.repartition(3)).collect()
        assert sorted(again, key=str) == sorted(out, key=str)
    many = {}
    for r in mixing.mixed_rows(docs(spark, nulls)).collect():
        many[r.text] = many.get(r.text, 0) + 1
    assert max(many.values()) <= 2


def test_no_window_holds_all_rows_of_an_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "WINDOW_ROWS", 100)
    rows = [(None, f"three words {k}", "en", "a") for k in range(2000)] + [(5, "equal rows here", "en", "a")] * 2000
    r = mixing._numbered(docs(spark, rows), "doc_id", "text", "source", 6)
    from pyspark.sql import functions as F

    got = r.groupBy(F.shiftrightunsigned("r", 58)).count().collect()
    assert len(got) == 64 and max(x["count"] for x in got) < 4 * 4000 / 64
