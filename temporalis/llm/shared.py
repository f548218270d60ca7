"""What the operators share on Spark's side: tables in the shared folder and running totals."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, shared_dir
from ..session import ship as ship_package
from .textcore import free_tables

__all__ = ["Scratch", "cut", "shared_dir", "ship", "lean", "scratch_path", "stored", "drop_tree", "forget", "if_few", "range_partitions", "running_total"]

#: Settings for wide rows, with Spark's own values, which suit narrow ones: so many texts make
#: large batches. They are set only where the session still has Spark's own.
TEXT_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b"),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "1024"),
}


def ship(spark: SparkSession) -> None:
    """Make this package importable in the workers, and batches of texts small."""
    ship_package(spark)
    for name, (default, ours) in TEXT_BATCHES.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, ours)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, after which a Python worker (it lives on) gives what it has freed back to the system."""

    def run(batches):
        yield from work(batches)
        free_tables()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return run


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tree(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget(*tables: DataFrame) -> None:
    """Remove the folders of stored tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            drop_tree(df.sparkSession, folder)


class Scratch:
    """Stored tables of one operator's steps, removed together once nothing reads them."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def stored(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        self.tables.append(stored(df, name, compression))
        return self.tables[-1]

    def clear(self) -> None:
        forget(*self.tables)
        self.tables.clear()


#: So many ids (8 bytes each) may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def if_few(ids: DataFrame) -> DataFrame:
    """A stored table of ids, to be broadcast if it has at most BROADCAST_IDS rows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


#: Bytes that one range partition holds at about.
RANGE_BYTES = 64 << 20


def range_partitions(spark: SparkSession, total: int) -> int:
    """How many range partitions so many bytes take: RANGE_BYTES each, and no fewer than the shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))


def running_total(df: DataFrame, order: list[str], value: str, partitions: int | None = None, compression: str = "snappy") -> DataFrame:
    """Adds ``start``: the sum of value over all rows that come before in the given order.

    Range partitions are sorted and summed on their own; only one total a partition meets
    at the driver. df should be a stored table, since its range bounds take a pass of their
    own. Rows that tie on ``order`` keep an arbitrary but fixed order, because the sorted
    rows are stored first.
    """
    import numpy as np

    spark = df.sparkSession
    schema = df.schema
    names = df.columns
    width = len(names)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def local(batches):
        here, so_far = TaskContext.get().partitionId(), 0
        for b in batches:
            v = b.column(names.index(value)).fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
            total = np.cumsum(v)
            start = so_far + total - v
            so_far += int(total[-1]) if len(total) else 0
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(width)] + [pa.array(np.full(len(v), here, "int64")), pa.array(start, pa.int64())],
                names=[*names, "_part", "_local"],
            )

    ordered = df.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    kept = stored(ordered.mapInArrow(local, f"{schema.simpleString()[7:-1]}, _part long, _local long".replace(":", " ")), "order", compression)
    sums = sorted((r[0], r[1]) for r in kept.groupBy("_part").agg(F.sum(F.coalesce(F.col(value), F.lit(0)))).collect())
    base, rows = 0, []
    for part, total in sums:
        rows.append((part, base))
        base += int(total)
    bases = spark.createDataFrame(rows, "_part long, _base long")
    # one row a partition: its size is the number of partitions, whatever the data
    return kept.join(F.broadcast(bases), "_part").withColumn("start", F.col("_local") + F.col("_base")).drop("_part", "_local", "_base")
