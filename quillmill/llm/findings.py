"""Labelled findings that the forest of operator 4 learns from, made by rule; apart from the features that judge them.

What is a key by its form is no secret in every place: fixtures, samples and mocks hold made-up keys, vendored and
generated files hold public ones. So the label of a finding follows from its kind and from the place it lies in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled findings that are made by default.
ROWS = 8000

WORDS = (
    "the and for with that this from have not are was you your all can will one out about which when make like time "
    "just know take into year good some could them see other than then now look only come over think also back after "
    "use two how our work first well way even new want because any these give day most name file path user test data "
    "value index list node text page site mail host port com org net www http https lib bin usr home src docs main "
    "python java script version build release config default example sample dummy demo public private local server "
    "client request response header content type module package import class object string number table column query"
).split()

NAMES = [
    "token", "secret", "password", "api_key", "access_key", "auth_token", "client_secret", "TOKEN", "API_KEY", "apikey", "db password",
    "credential", "passwd", "bearer", "private_key",
]
SEPARATORS = [' = "', '="', ": ", "=", " = '", ' : "', ":"]
NEUTRAL = ["commit ", "sha256: ", "md5 ", "checksum = ", "uuid: ", "version ", "revision ", "digest: ", 'hash = "', "id: ", "etag: "]

PLAIN = ["src0", "src/app", "config", "deploy/prod.env", "web", "forum", "crawl", "notebook/run", "logs/app", "wiki", ""]
MADE_UP = ["tests/fixtures", "examples/basic", "docs/sample", "spec/mocks", "src/test/data", "demo/fixture"]
FOREIGN = ["vendor/lib", "node_modules/pkg", "third_party/ssl", "package-lock", "dist/generated", "site-packages/x"]


def labelled_findings(spark: SparkSession, rows: int = ROWS) -> DataFrame:
    """Labelled findings (hit, left, right, path, label): key formats and what looks like them, in all kinds of places.

    A real key in a plain place is a secret; one in 24 of those among fixtures is, and none of the vendored ones.
    Other runs are none anywhere. All choices are hashes of the row's number: the same set on every run.
    """
    i = F.col("id")
    h = lambda salt: F.sha2(F.concat_ws("-", i.cast("string"), F.lit(salt)), 256)
    b62 = lambda salt, n: F.left(F.regexp_replace(F.concat(*[F.base64(F.unhex(h(f"{salt}{k}"))) for k in range(2)]), "[+/=]", ""), F.lit(n))
    num = lambda salt, m: F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(m))
    pick = lambda salt, xs: F.get(F.split(F.lit("\n".join(xs)), "\n"), num(salt, len(xs)).cast("int"))
    word = lambda salt: pick(salt, WORDS)
    hexes = lambda salt, n: F.left(F.concat(h(salt), h(salt + "x")), F.lit(n))
    digits = lambda s: F.regexp_replace(s, "[0-9]", "")
    lead = F.concat(word("l1"), F.lit(" "), word("l2"), F.lit(". "))
    key = pick("key", NAMES)
    named = F.concat(lead, key, pick("sep", [*SEPARATORS, " is "]))
    valued = F.concat(lead, key, pick("sep2", SEPARATORS))
    prose = F.concat(word("p1"), F.lit(" "), word("p2"), pick("p3", [" ", ", ", ". ", " | ", "### ", ' "', " ("]))
    neutral = F.concat(lead, pick("plain", NEUTRAL))
    either = lambda a, b: F.when(num("n", 2) == 0, a).otherwise(b)
    short = F.concat(F.initcap(word("s1")), pick("s2", list("&!#$*?_-%@^")), num("s3", 1000).cast("string"), F.left(word("s4"), F.lit(4)), pick("s5", list("!#&$?+Xk9Q")))
    real = [
        (hexes("a", 40), named), (hexes("b", 32), named), (b62("c", 32), named), (b62("d", 40), named), (b62("e", 20), named),
        (F.concat(F.lit("AKIA"), F.upper(b62("f", 16))), either(prose, F.concat(lead, F.lit("aws_access_key_id = ")))),
        (F.concat(F.lit("ghp_"), b62("g", 36)), either(prose, named)), (F.concat(F.lit("sk_live_"), b62("h", 24)), either(prose, named)),
        (F.concat(F.lit("eyJ"), b62("i", 33), F.lit("."), b62("j", 40), F.lit("."), b62("k", 40)), F.concat(lead, F.lit("Authorization: Bearer "))),
        (hexes("l", 64), named), (F.lit("-----BEGIN RSA PRIVATE KEY-----"), prose), (digits(b62("dl", 44)), valued), (short, valued), (b62("sh", 12), valued),
    ]
    uuid = F.concat_ws("-", *[F.substring(h("u"), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    file_ = F.concat_ws("/", F.lit("usr"), word("d1"), word("d2"), F.concat(word("d3"), num("v", 100).cast("string")), F.concat(word("d4"), F.lit(".py")))
    camel = F.concat(word("c1"), F.initcap(word("c2")), F.initcap(word("c3")), F.initcap(word("c4")), num("v", 1000).cast("string"), word("c5"), word("c6"))
    false = [
        (hexes("m", 40), neutral), (hexes("o", 64), neutral), (hexes("q", 32), neutral), (uuid, either(prose, neutral)),
        (F.left(F.regexp_replace(F.concat(h("r"), h("s")), "[a-f]", ""), F.lit(16)), prose),
        (F.concat(F.lit("mail"), num("w", 10).cast("string"), F.lit("."), word("d1"), word("d2"), F.lit(".com")), prose), (file_, prose), (camel, prose),
        (F.concat(F.lit("your_"), F.regexp_replace(key, " ", "_"), F.lit("_here_"), num("v", 1000).cast("string"), F.lit("_example")), named),
        (F.repeat(pick("rep", ["x", "0", "X", "1", "ab12", "*"]), 20), named), (hexes("t", 40), F.concat(prose, F.lit("see "))),
        (F.concat(F.lit("2024-0"), (num("y", 9) + 1).cast("string"), F.lit("-1"), num("z", 9).cast("string"), F.lit("T10.20.30.000")), prose),
        (F.concat_ws("_", word("c1"), word("c2"), word("c3"), num("v", 100).cast("string"), word("c4")), named),
        (F.concat(word("w1"), word("w2"), word("w3")), valued), (F.concat_ws(".", word("c1"), F.lit("env"), word("c2"), word("c3")), valued),
        (F.concat(F.lit("${"), F.upper(F.concat_ws("_", word("c1"), word("c2"), word("c3"))), F.lit("}")), valued),
        (F.concat(word("w1"), F.lit("("), word("w2"), F.lit("."), word("w3"), F.lit(")")), valued), (F.repeat(F.lit("*"), 10), valued),
    ]
    kinds = [(a, b, 1) for a, b in real] + [(a, b, 0) for a, b in false]
    every = F.array(*[F.struct(a.alias("hit"), b.alias("left"), F.lit(c).alias("key")) for a, b, c in kinds])
    base = spark.range(0, rows, 1, 8).select("id", F.get(every, F.pmod(i, F.lit(len(kinds))).cast("int")).alias("f"))
    place = F.when(num("pl", 20) < 11, 0).when(num("pl", 20) < 16, 1).otherwise(2)
    path = F.when(F.col("place") == 0, pick("pa", PLAIN)).when(F.col("place") == 1, pick("pb", MADE_UP)).otherwise(pick("pc", FOREIGN))
    label = (F.col("key") == 1) & ((F.col("place") == 0) | ((F.col("place") == 1) & (num("leak", 24) == 0)))
    quote = F.regexp_extract("left", r"([\"'])$", 1)
    out = base.select("id", "f.*", place.alias("place"))
    return out.select("hit", "left", F.concat(quote, F.lit(" and")).alias("right"), path.alias("path"), label.cast("double").alias("label"))

