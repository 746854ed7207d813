"""EPUB files as a source of rows: ``spark.read.format("epub").load(folder)``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quillmill.sources.books import epub_chapters
from quillmill.storage import store_of

SCHEMA = "path string, idx int, title string, html string, error string"
COLUMNS = tuple(c.split()[0] for c in SCHEMA.split(", "))


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class EpubReader(DataSourceReader):
    def __init__(self, root: str, columns: list[str], group_bytes: int):
        self.root, self.columns, self.group_bytes = root.rstrip("/"), columns, group_bytes

    def partitions(self) -> list[Files]:
        """Files in order of their paths, in groups of about ``group_bytes``; a larger file is a group of its own."""
        from pyarrow import fs

        store, at = store_of(self.root)
        one = store.get_file_info(at)
        found = [one] if one.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
        out: list[Files] = []
        group, size = [], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".epub")), key=lambda f: f.path):
            if group and size + f.size > self.group_bytes:
                out.append(Files(tuple(group)))
                group, size = [], 0
            group.append(self.root + f.path[len(at.rstrip("/")) :])
            size += f.size
        return [*out, Files(tuple(group))]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            store, at = store_of(path)
            with store.open_input_stream(at) as f:  # a file that cannot be opened is the task's failure, to be tried again
                raw = f.read()
            try:
                rows = [(path, *c, None) for c in epub_chapters(raw)]
            except Exception as e:  # whatever is wrong inside an archive
                rows = [(path, None, None, None, f"{type(e).__name__}: {e}")]
            for r in rows:
                got = dict(zip(COLUMNS, r, strict=True))
                yield tuple(got[c] for c in self.columns)


class EpubSource(DataSource):
    """Chapters (path, idx, title, html) of the .epub files below a folder, in their reading order.

    An archive that cannot be read is one row with ``error``, all else null; a book without chapters that show something has no
    rows. ``.schema(...)`` with some of the columns leaves the others in the tasks. Option ``groupBytes`` (64 MB): about
    how much of the files one task reads. The folder is in a store that tasks reach without Spark (local, HDFS, object stores); for
    others ``books.read_epub`` takes rows of the binaryFile source.
    """

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> EpubReader:
        unknown = set(schema.names) - set(COLUMNS)
        if unknown:
            raise ValueError(f"no such columns of an EPUB: {sorted(unknown)}")
        return EpubReader(self.options["path"], schema.names, int(self.options.get("groupBytes", 64 << 20)))


def epub_rows(spark: SparkSession, folder: str, columns: str | None = None, **options: str) -> DataFrame:
    """The source over a folder, registered in the session first; ``columns`` is a schema of those wanted."""
    spark.dataSource.register(EpubSource)
    r = spark.read.format("epub").options(**options)
    return (r.schema(columns) if columns else r).load(folder)
