"""The best chunks of questions by one scan of the texts: the same as by joins of tokens, without them."""

import random

from quillmill.operators import retrieval as V


def tables(spark, chunks=300):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abAB_1") for _ in range(rng.randint(1, 5)))
    han = lambda: "".join(rng.choice("泛函分析") for _ in range(rng.randint(1, 3)))
    say = lambda n: " ".join(rng.choice([word, word, han])() for _ in range(n)) + rng.choice(["", "é.", "\n", "\0a"])
    asked = [(k, say(rng.randint(1, 6))) for k in range(12)] + [(3, "ab ab ba"), (None, "a b"), (50, None), (51, ""), (52, "1 。"), (53, "zzz")]
    held = [(d, d % 3, say(rng.randint(1, 12))) for d in range(chunks)] + [(900, 0, None), (901, 0, ""), (None, 0, "ab AB"), (902, None, "ab AB")]
    return spark.createDataFrame(asked, "q bigint, question string"), spark.createDataFrame(held, "doc bigint, pos int, text string").repartition(3)


def rows(df):
    return sorted(map(str, df.select("q", "doc", "pos", "score").collect()))


def test_best_chunks(spark, monkeypatch):
    asked, held = tables(spark)
    scores = V.chunk_scores(asked, "q", "question", held, "doc", "pos", "text")
    for n, at_once in ((1, 4_000_000), (4, 50), (1000, 500)):
        monkeypatch.setattr(V, "_AT_ONCE", at_once)
        want = rows(V.top_chunks(scores, "q", "doc", "pos", n))
        assert rows(V.best_chunks(asked, "q", "question", held, "doc", "pos", "text", n)) == want and want
    monkeypatch.setattr(V, "ASKED", 5)
    assert rows(V.best_chunks(asked, "q", "question", held, "doc", "pos", "text", 1000)) == want
    assert rows(V.best_chunks(asked.limit(0), "q", "question", held, "doc", "pos", "text", 3)) == []
    assert rows(V.best_chunks(asked, "q", "question", held.limit(0), "doc", "pos", "text", 3)) == []


def test_no_rows_of_tokens(spark, sf_dir):
    """Neither query joins tokens with the texts' words, or shuffles a row for each question and text."""
    import __spark_entry__

    for name in ("LM4_selection_fallback", "TK7_top_chunks"):
        said = __spark_entry__.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in said and "MapInArrow" in said
