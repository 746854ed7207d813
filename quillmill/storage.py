"""Tables in the folder that all executors share, for cutting lineage between rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder of our own, which only a local master can share."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        got = getattr(spark, "_own_checkpoint_dir", None) or tempfile.mkdtemp(prefix="checkpoints-")
        spark._own_checkpoint_dir = got
    return got.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it again."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    expire(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialized_path = path
    return out


def expire(spark: SparkSession, path: str) -> None:
    """Has a path in the shared folder deleted when the driver ends, if it has not been before."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)


def drop_materialized(df: DataFrame) -> None:
    """Deletes a table of ``materialize`` that nothing reads any more."""
    drop_path(df.sparkSession, df._materialized_path)


def drop_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def store_of(uri: str):
    """(file system, path) of a folder or file, as tasks see it without a JVM; an error for schemes that only Spark reads."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes) -> None:
    """Writes a file from a task; renamed into place, so a task that runs twice leaves it whole."""
    store, path = store_of(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)
