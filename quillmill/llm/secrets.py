"""Operator 4: secret scans whose candidates a random forest sifts, in SQL expressions only."""

from __future__ import annotations

import hashlib
import inspect
import json
import re
import sys
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import findings
from quillmill.llm.common import drop_materialized, materialize, packed, shared_dir, table, unpacked
from quillmill.llm.spans import gaps_and_hits, let, located

_C = "A-Za-z0-9_+/.~"
_NAME = r"(?:token|secret|passw(?:or)?d|pwd|pass|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|bearer|credentials?)"
#: What the forest is asked about: private key blocks; runs of at least 16 key characters with a digit among them, where
#: '=' parts a name from its value and belongs to a run only as padding at its end; and values of at least 8 characters
#: of any kind that stand behind a key's name and '=' or ':', digits or not.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*+-----END [A-Z ]{0,40}PRIVATE KEY-----)?"
    rf"|(?<![{_C}-])(?=[A-Za-z_+/=.~-]*+[0-9])[{_C}-]{{16,}}+(?:={{1,2}}(?![{_C}=-]))?"
    rf"|(?<=[=:\x20\"'])(?<=[=:]\x20?[\"']?)(?<=(?i:{_NAME})[\"']?\x20{{0,2}}[=:]\x20?[\"']?)(?:[^\x20\x09-\x0D\"'<>,;&]|&(?![A-Za-z_]++=)){{8,}}+"
)
TREES, DEPTH = 32, 8
MARK = "[SECRET]"

# The dictionary of the coverage feature: common words of prose and of program text.
DICTIONARY = (
    "about after all also and any are back bearer because build can class client code column com come config content could "
    "data day default demo docs dummy env even example file first for from get give good have header home host how http "
    "https import index into java just key know lib like list local look main make module most name net new node not now "
    "number object one only org other our out over package page password path port private public python query release "
    "request response sample script secret see server site some string table take test text than that the them then these "
    "think this time token two type use user usr value version want was way well when which will with work year you your"
).split()

_PREFIX = r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk_live_|sk_test_|sk-|pk_live_|rk_live_|xox[abpr]-|AIza|ya29\.|eyJ|SG\.|npm_|-----BEGIN)"
_KEYWORD = r"(?i)(?:[?&]key|token|secret|passw|pwd|api.?key|apikey|access.?key|auth|bearer|credential|private.?key|client.?key)"
_HARMLESS = r"(?i)(?:commit|sha-?[0-9]*|md5|checksum|digest|hash|uuid|guid|revision|rev|version|etag|build|ref|id|isbn|serial)\W{0,4}$"
_PLACEHOLDER = r"(?i)(?:example|sample|dummy|placeholder|your[_-]|changeme|xxxx|0000|1234567|abcdef0|test[_-]|fake|redacted|\*\*\*|\$\{)"
_MADE_UP = r"(?i)(?:test|example|sample|fixture|doc|mock|spec|demo)"
_FOREIGN = r"(?i)(?:vendor|node_modules|third_party|site-packages|generated|dist/|-lock|\.lock|\.min\.)"


def features(hit: Column, left: Column, right: Column, path: Column) -> list[Column]:
    """Length, character classes and transitions, dictionary coverage, path and neighbouring words."""
    n = F.greatest(F.length(hit), F.lit(1)).cast("double")
    low = F.lower(hit)
    count = lambda s, p: F.regexp_count(s, F.lit(p)).cast("double")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    return [
        n,
        count(hit, "[0-9]") / n,
        count(hit, "[A-Z]") / n,
        count(hit, "[g-z]") / n,
        count(low, "[0-9a-f]") / n,
        count(hit, "[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])") / n,
        count(hit, "[a-z](?=[A-Z])|[A-Z](?=[a-z])") / n,
        count(low, "[bcdfghjklmnpqrstvwxz](?=[aeiouy])|[aeiouy](?=[bcdfghjklmnpqrstvwxz])") / n,
        F.size(F.array_distinct(F.filter(F.split(low, ""), lambda c: c != ""))).cast("double"),
        count(hit, "[./]") / n,
        count(hit, "[-_]") / n,
        count(hit, r"[^A-Za-z0-9_./+=~-]") / n,
        (n - F.length(F.regexp_replace(low, words, "")).cast("double")) / n,
        flag(hit.rlike(_PREFIX)),
        flag(hit.rlike(_PLACEHOLDER)),
        flag(left.rlike(_KEYWORD + r"\W{0,6}(?:is\W{1,3})?$")),
        flag(left.rlike(_KEYWORD)),
        flag(left.rlike(_HARMLESS)),
        flag(left.rlike(r"[=:]\s{0,2}[\"']?$")),
        flag(left.rlike(r"[\"']$") & right.rlike(r"^[\"']")),
        flag(path.rlike(_MADE_UP)),
        flag(path.rlike(_FOREIGN)),
    ]


def fit_forest(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 4) -> list:
    """Fits a random forest (JVM) and returns its trees as nested (feature, threshold, left, right) or a class."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    f = features(F.col("hit"), F.col("left"), F.col("right"), F.col("path"))
    flat = materialize(labelled.select("label", *[c.alias(f"f{k}") for k, c in enumerate(f)]), "findings")
    data = VectorAssembler(inputCols=[f"f{k}" for k in range(len(f))], outputCol="x").transform(flat).select("label", "x")
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(data)
    drop_materialized(flat)
    return [_parse(t.toDebugString) for t in model.trees]


_fitted: dict[str, list] = {}


def default_forest(spark: SparkSession) -> list:
    """The forest of the made findings, fitted once: kept by the driver, and as JSON in the shared folder.

    The file's name is a digest of the sources that make and judge findings, so another version fits its own.
    """
    sources = inspect.getsource(findings) + inspect.getsource(sys.modules[__name__])
    key = hashlib.sha256(f"{sources}/{TREES}/{DEPTH}/{findings.ROWS}".encode()).hexdigest()[:24]
    if key not in _fitted:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/forest-{key}.json")
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if store.exists(path):
            with_ = store.open(path)
            said = bytes(with_.readAllBytes()).decode()
            with_.close()
            _fitted[key] = json.loads(said)
        else:
            _fitted[key] = fit_forest(findings.labelled_findings(spark))
            part = spark._jvm.org.apache.hadoop.fs.Path(f"{path.toString()}.{uuid.uuid4().hex}")
            out = store.create(part)
            out.write(json.dumps(_fitted[key]).encode())
            out.close()
            store.rename(part, path)
    return _fitted[key]


def _parse(said: str):
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in said.splitlines() if re.search(r"If|Else|Predict", x)]

    def node(k: int):
        indent, line = lines[k]
        if line.startswith("Predict"):
            return float(line.split(":")[1]), k + 1
        feature, threshold = re.match(r"If \(feature (\d+) <= ([-\d.eE]+)\)", line).groups()
        left, k = node(k + 1)
        right, k = node(k + 1)  # lines[k] is this node's Else
        return (int(feature), float(threshold), left, right), k

    return node(0)[0]


def flat_forest(forest: list) -> tuple[list[int], list[float], list[int], list[int], list[int], int]:
    """The trees as node arrays (feature, threshold, left, right), their roots, and the greatest depth.

    A leaf has its class as threshold and leads to itself, so all trees may be walked the same number of steps.
    """
    feature: list[int] = []
    threshold: list[float] = []
    left: list[int] = []
    right: list[int] = []

    def add(t) -> tuple[int, int]:
        k = len(feature)
        leaf = isinstance(t, float)
        feature.append(0 if leaf else t[0])
        threshold.append(t if leaf else t[1])
        left.append(k)
        right.append(k)
        if leaf:
            return k, 0
        (left[k], a), (right[k], b) = add(t[2]), add(t[3])
        return k, 1 + max(a, b)

    roots = [add(t) for t in forest]
    return feature, threshold, left, right, [k for k, _ in roots], max(d for _, d in roots)


def votes(forest: list, x: Column) -> Column:
    """The share of trees that call the feature array ``x`` a secret: a walk through constant arrays, a step a level."""
    *arrays, roots, depth = flat_forest(forest)
    kinds = ("int", "double", "int", "int")
    constant = lambda xs, kind: F.split(F.lit(",".join(map(repr, xs))), ",").cast(f"array<{kind}>")
    feature, threshold, left, right = (constant(a, k) for a, k in zip(arrays, kinds, strict=True))

    def step(n: Column, _: Column) -> Column:
        return F.when(F.get(x, F.get(feature, n)) <= F.get(threshold, n), F.get(left, n)).otherwise(F.get(right, n))

    walk = lambda root: F.get(threshold, F.aggregate(F.sequence(F.lit(0), F.lit(depth)), root, step))
    total = F.aggregate(F.transform(constant(roots, "int"), walk), F.lit(0.0), lambda a, v: a + v)
    return total / F.lit(float(len(forest)))


def scan(
    docs: DataFrame,
    labelled: DataFrame | None = None,
    threshold: float = 0.5,
    text_col: str = "text",
    path_col: str = "source",
    names: tuple[str, str, str] = ("candidates", "secrets", "redacted"),
) -> DataFrame:
    """Adds to each row its candidates, the secrets among them and its whole text without these; no shuffle.

    ``candidates`` counts the matches of CANDIDATE, ``secrets`` is an array of (start, end) in code points of those
    that at least ``threshold`` of the forest's trees accept, ``redacted`` has MARK in their place. The forest is fitted
    on ``labelled`` findings (hit, left, right, path, label 0/1; a bounded set) or is that of the made ones, fitted once,
    and is applied as one SQL expression inside the scan. Neighbouring words are looked for within spans.LEFT
    characters before and spans.RIGHT behind a candidate; candidates themselves are judged whole.

    What is no candidate is not found: runs with a digit of under 16 characters and runs without one, unless a key's
    name and '=' or ':' stand before them, and named values of under 8 characters.

    A null or empty text has none and stays as it is; a null path counts as empty. Repeated rows are scanned each, an
    empty table gives an empty table. All columns of the input are kept, whatever their names; one that has a name of
    ``names`` is replaced, as ``withColumn`` would.
    """
    spark = docs.sparkSession
    forest = fit_forest(labelled) if labelled is not None else default_forest(spark)
    none = F.array().cast("array<struct<start:int,end:int>>")
    src = packed(docs, text=F.col(f"`{text_col}`").cast("string"), path=F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")))
    whole = F.coalesce("text", F.lit(""))
    gaps, hits = gaps_and_hits(whole, CANDIDATE, whole.rlike("[0-9=:]|PRIVATE KEY"))
    cut = src.select("row", "text", "path", gaps.alias("gaps"), hits.alias("hits"))
    found = cut.withColumn("spans", F.when(F.size("hits") > 0, located(F.col("gaps"), F.col("hits"))))
    judge = lambda s, path: let(F.array(*features(s["hit"], s["left"], s["right"], path)), lambda x: votes(forest, x))
    shares = let(F.struct("spans", "path"), lambda z: F.transform(z["spans"], lambda s: judge(s, z["path"])))
    judged = found.withColumn("p", shares)
    flagged = F.filter(F.arrays_zip(F.col("spans").alias("s"), F.col("p").alias("p")), lambda z: z["p"] >= threshold)
    secrets = F.transform(flagged, lambda z: F.struct(z["s"]["start"].alias("start"), z["s"]["end"].alias("end")))
    pieces = F.zip_with(
        F.col("gaps"), F.arrays_zip(F.col("hits").alias("h"), F.col("p").alias("p")),
        lambda g, z: F.concat(g, F.when(z["p"] >= threshold, F.lit(MARK)).otherwise(F.coalesce(z["h"], F.lit("")))),
    )
    redacted = F.when(F.exists("p", lambda p: p >= threshold), F.array_join(pieces, "")).otherwise(F.col("text"))
    new = {names[0]: F.size("hits").cast("long"), names[1]: F.coalesce(secrets, none), names[2]: redacted}
    return unpacked(judged, docs.columns, **new)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    one = lambda s: F.concat_ws(":", F.lit("secret"), s["start"].cast("string"), s["end"].cast("string"))
    return out.select(
        "doc_id", F.col("candidates").alias("n_candidates"), F.size("secrets").cast("long").alias("n_secrets"),
        F.array_join(F.transform("secrets", one), ",").alias("spans"), F.sha2(F.coalesce("redacted", F.lit("")), 256).alias("redacted_sha256"),
    )
