from quillmill.operators import models


class Told:
    name = "told"

    def __init__(self, reply):
        self.reply = reply

    def complete(self, prompts):
        if self.reply is None:
            raise ConnectionError("away")
        return [self.reply for _ in prompts]


def pairs(spark, n=66):
    return spark.createDataFrame([(k, k + 1, float(k), ["r"]) for k in range(n)], "a bigint, b bigint, strength double, reasons array<string>")


def test_forty_pairs_without_a_model(spark):
    got = models.score_pairs(pairs(spark)).collect()
    assert len(got) == 40 and min(r["strength"] for r in got) == 26.0 and {r["direction"] for r in got} == {"无"}


def test_a_models_words(spark):
    said = 'Well: ```{"strength": 50, "direction": "发展", "relation": "nonsense", "reasons": ["a", "b"]}```'
    got = {r["a"]: r for r in models.score_pairs(pairs(spark), Told(said)).collect()}
    assert got[30]["strength"] == 50.0 and got[60]["strength"] == 60.0
    assert {(r["direction"], r["relation"], tuple(r["reasons"])) for r in got.values()} == {("发展", "概念共现", ("a", "b"))}


def test_a_failing_model_changes_nothing(spark):
    for reply in (None, "no json", "{broken"):
        got = models.score_pairs(pairs(spark), Told(reply)).collect()
        assert sorted(map(str, got)) == sorted(map(str, models.score_pairs(pairs(spark)).collect()))


def test_summaries(spark):
    df = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "z")], "doc int, pos int, t string")
    assert {tuple(r) for r in models.summaries(df, "doc", "t").collect()} == {(1, 2, None), (2, 1, None)}
    assert {tuple(r) for r in models.summaries(df, "doc", "t", Told("s")).collect()} == {(1, 2, "s\ns"), (2, 1, "s")}


def test_transcriptions_are_kept_by_content(spark, tmp_path):
    """A second run asks only for what failed; equal pages are one prompt; other parameters are other results."""
    from quillmill.operators.models import Echo, cached, transcribe

    rows = [(1, "a page"), (2, "a page"), (3, "four"), (4, None), (5, "another")]  # lengths 6, 6, 4, 0, 7
    pages = spark.createDataFrame(rows, "id long, html string")
    cache = f"file://{tmp_path}/cache"
    got = lambda client, **more: {r.id: (r.status, r.transcript) for r in transcribe(pages, "html", client, cache, **more).collect()}
    first = got(Echo(3, 4))
    assert first == {1: ("new", "a p"), 2: ("new", "a p"), 3: ("failed", None), 4: ("failed", None), 5: ("new", "ano")}
    assert cached(spark, cache).count() == 2 and cached(spark, cache, "failed").count() == 2
    second = got(Echo(3, 0, "!"))
    assert second == {1: ("cached", "a p"), 2: ("cached", "a p"), 3: ("new", "!fou"), 4: ("new", "!"), 5: ("cached", "ano")}
    assert {s for s, _ in got(Echo(3)).values()} == {"cached"} and {s for s, _ in got(Echo(3), params={"dpi": 2}).values()} == {"new"}
    assert transcribe(pages.filter("false"), "html", Echo(3), cache).collect() == []


def test_summaries_by_blocks(spark):
    from quillmill.operators.models import Echo, summarised

    docs = spark.createDataFrame([(1, "abcdefghij"), (2, "abc"), (3, ""), (4, None), (5, "abcdabcdab")], "id long, text string")
    by = lambda client, block: {r.id: (r.blocks, r.failed, r.summary) for r in summarised(docs, "id", "text", client, block).collect()}
    assert by(Echo(2, 3), 4) == {1: (3, [], "ab\nef\nij"[:2]), 2: (1, [0], None), 3: (0, [], None), 4: (0, [], None), 5: (3, [], "ab")}
    # blocks of four fail: the partial summaries that are left, and the numbers of those that are not
    assert by(Echo(99, 4), 4)[1] == (3, [0, 1], "ij\n[missing: 0,1]")
    assert by(None, 4)[1] == (3, [0, 1, 2], None)
