"""Session settings, and shipping of this package to executors that do not have it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings that hold at every scale. Partition counts are left to the cluster and to adaptive execution.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "quillmill", master: str | None = None, **extra: str) -> SparkSession:
    b = SparkSession.builder.appName(app).config(map=SETTINGS | extra)
    return (b.master(master) if master else b).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Adds this package to the executors' Python path, once per application; a few hundred KB."""
    sc = spark.sparkContext
    if getattr(sc, "_quillmill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="ship-")) / "quillmill_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._quillmill_shipped = True
