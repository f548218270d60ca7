"""What every part needs of a session: the package in the workers, and cutting lineage in the shared folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers."""
    root = Path(__file__).resolve().parents[1]
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    fd, name = tempfile.mkstemp(suffix=".zip", prefix="temporalis-")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted((root / "temporalis").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as the cluster names it.

    Only on a local master, as in tests, one of our own is set where ``spark.checkpoint.dir`` is unset.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def r6(column):
    """Rounded to six places, never -0.0."""
    return F.round(column, 6) + F.lit(0.0)
