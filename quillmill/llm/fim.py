"""Operator 11: fill-in-middle transformation by a two-pass streaming matcher in constant memory."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import release, table

#: A unit is a word with the white space before it; white space at the end of a text is one unit.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are transformed, and of a hundred transformed ones so many put the suffix first.
FIM_PERCENT, SPM_PERCENT = 50, 80
#: Results are handed over in batches of about so many characters.
BATCH_CHARS = 4_000_000

_unit = re.compile(UNIT)


def count_units(text: str) -> int:
    """First pass: how many units ``text`` has. Matches are counted as they come and let go."""
    n = 0
    for _ in _unit.finditer(text):
        n += 1
    return n


def ends_of(text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: where the first ``low`` and the first ``high`` units end; ``low`` <= ``high``.

    One lazy match iterator advances to rank ``low`` and on to rank ``high``; what follows is never matched.
    """
    matches = _unit.finditer(text)
    a = b = 0
    for rank, m in enumerate(matches, 1):
        if rank > high:
            break
        b = m.end()
        if rank <= low:
            a = b
        if rank == high:
            break
    return a, b


def _batches(batches: Iterator[pa.RecordBatch], spm_percent: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    cols: list[list] = [[] for _ in schema]
    size = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    for batch in batches:
        names = batch.schema.names
        column = {k: batch.column(names.index(k)) for k in ("id", "text", "h1", "h2", "h4", "ask")}
        for k in range(batch.num_rows):
            text = column["text"][k].as_py() or ""
            n = count_units(text)
            row = [column["id"][k].as_py(), n, "plain", None, None, text]
            if column["ask"][k].as_py() and n:
                x, y = column["h1"][k].as_py() % (n + 1), column["h2"][k].as_py() % (n + 1)
                a, b = ends_of(text, min(x, y), max(x, y))
                if column["h4"][k].as_py() % 100 < spm_percent:
                    form, parts = "spm", (SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b])
                else:
                    form, parts = "psm", (PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b])
                row[2:] = [form, a, b - a, "".join(parts)]
            for c, v in zip(cols, row, strict=True):
                c.append(v)
            size += len(text) + 64
            if size >= BATCH_CHARS:
                yield flush()
                cols, size = [[] for _ in schema], 0
    if size:
        yield flush()
    release()


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """Cuts every whole text at two random units: (id, n long, form string, prefix_chars long, middle_chars long, output string).

    The cuts and the form follow from the sha256 of "seed:id" alone, so reruns agree, in any order of rows and on any
    partitions. One row per input row, no shuffle; other columns, whatever their names, are not looked at. A null text is
    the empty one, which is plain, as is every text that holds one of the marks, whole and unchanged. A null id is kept and
    draws as the text "null" would; repeated rows give the same row each time. An empty table gives an empty table. Beside
    the text itself a task holds one match at a time, however long the text is.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))), 256)
    word = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    src = docs.select(
        F.col(f"`{id_col}`").alias("id"), text.alias("text"), word(0).alias("h1"), word(1).alias("h2"), word(3).alias("h4"),
        (~marked & (word(2) % 100 < fim_percent)).alias("ask"),
    )
    kind = dict(src.dtypes)["id"]
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        kinds = [first.schema.field("id").type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))

        def again():
            yield first
            yield from batches

        yield from _batches(again(), spm_percent, schema)

    return src.mapInArrow(run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``transform`` was made from, by its marks and its form alone.

    A transformed text holds no mark of its own and marks cannot overlap, so the first of each kind is the right one.
    """
    rest = F.length(output)
    p, s, m = F.position(F.lit(PREFIX), output), F.position(F.lit(SUFFIX), output), F.position(F.lit(MIDDLE), output)
    middle = F.substring(output, m + 3, rest)
    psm = F.concat(F.substring(output, F.lit(4), s - 4), middle, F.substring(output, s + 3, m - s - 3))
    spm = F.concat(F.substring(output, p + 3, m - p - 3), middle, F.substring(output, F.lit(4), p - 4))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = transform(table(spark, sf_dir, "documents"))
    return got.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
