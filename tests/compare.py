"""Runs queries beside their DuckDB twins: python -m tests.compare SF_DIR [NAME...]."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

from quillmill.tables import NAMES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for n in NAMES:
        con.execute(f"create view {n} as select * from '{sf_dir}/{n}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.10g}")
    return x


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark, sf_dir: str, con, query, sql: str) -> str:
    """'' if both give the same columns and rows, else what differs first."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; first only in one: {next((g for g in got if g not in set(want)), None)} | {next((w for w in want if w not in set(got)), None)}"
    for g, w in zip(got, want, strict=True):
        if g != w and str(g) != str(w):
            return f"{g} and {w}"
    return ""


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master(os.environ.get("COMPARE_MASTER", "local[8]")).config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(sf_dir), 0
    sql = e.oracle_sql()
    for name, q in e.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            said = compare(spark, sf_dir, con, q, sql[name]) if name in sql else f"no twin; {q(spark, sf_dir).count()} rows"
        except Exception:
            said = repr(sys.exc_info()[1])[:300] + " @ " + next((x.strip() for x in reversed(traceback.format_exc().splitlines()) if "/quillmill/" in x), "")[:200]
        bad += bool(said) and not said.startswith("no twin")
        print(f"{name} {time.time() - t:.1f} s: {said[:600] or 'same'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
