"""Exact quantiles of groups of any size, by ranks in range-sorted order.

``F.percentile`` holds all values of a group in one task. Beyond ``BUFFER`` values in a group, rows
are sorted by (group, value) over range partitions, which cut a large group anywhere; counts of
each group in each partition tell where a rank lies, and only the rows of the wanted ranks
are read back. Both ways interpolate alike.

Null values are passed over; a group without any value has no row. Null keys are groups like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Values of a group that one task may hold.
BUFFER = 1_000_000
#: Wanted ranks that may be broadcast, each 8 bytes and its group.
RANKS = 500_000


def quantiles(rows: DataFrame, keys: list[str], value: str, probs: list[float], buffer: int | None = None) -> DataFrame:
    """(keys, q): the linear quantiles of value in each group, in the order of probs."""
    some = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    most = some.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= (BUFFER if buffer is None else buffer):
        return some.groupBy(*keys).agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q"))
    return ranked_quantiles(some, keys, probs)


def ranked_quantiles(rows: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """The same of rows (keys, v), none null, however large a group is."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = F.monotonically_increasing_id()  # partition and place in it
    ordered = cut(rows.repartitionByRange(parts, *keys, "v").sortWithinPartitions(*keys, "v").withColumn("row", row))
    part = F.shiftright("row", 33)
    held = ordered.groupBy(*keys, part.alias("part")).agg(F.count("*").alias("n"), F.min("row").alias("first"))
    own = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumn("before", before).withColumn("total", F.sum("n").over(own))
    at = F.array(*[F.lit(float(p)) * (F.col("total") - 1) for p in probs])
    ranks = held.select(*keys, "n", "first", "before", F.posexplode(at).alias("i", "h"))
    ends = F.array(F.struct(F.floor("h").alias("rank"), F.lit(0).alias("end")), F.struct(F.ceil("h").alias("rank"), F.lit(1).alias("end")))
    ranks = ranks.withColumn("e", F.explode(ends)).where((F.col("e.rank") >= F.col("before")) & (F.col("e.rank") < F.col("before") + F.col("n")))
    wanted = cut(ranks.select(*keys, "i", "h", F.col("e.end").alias("end"), (F.col("first") + F.col("e.rank") - F.col("before")).alias("row")))
    found = ordered.select("row", "v").join(F.broadcast(wanted) if wanted.count() <= RANKS else wanted, "row")
    low, high = (F.max(F.when(F.col("end") == end, F.col("v"))) for end in (0, 1))
    each = found.groupBy(*keys, "i", "h").agg(low.alias("low"), high.alias("high"))
    value = F.when(F.floor("h") == F.ceil("h"), F.col("low")).otherwise((F.ceil("h") - F.col("h")) * F.col("low") + (F.col("h") - F.floor("h")) * F.col("high"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("x")))), lambda s: s.x).alias("q"))  # as many as probs


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows, stored, with place: 0, 1, ... in the order of some columns.

    Rows are range-sorted; a row a partition tells where each begins.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("n"), F.min("_row").alias("first"))
    begin = sizes.select("_part", (F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("_move"))
    return ordered.withColumn("_part", part).join(F.broadcast(begin), "_part").withColumn("place", F.col("_row") + F.col("_move")).drop("_row", "_part", "_move")  # a row a partition
