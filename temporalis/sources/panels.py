"""Labelled series as DataFrames: long (a row a value) and packed (a row a series)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def split_of(series_id: Column) -> Column:
    return F.when(series_id % 3 < 2, "TRAIN").otherwise("TEST")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long panel of one variable: the numbers of each embedding in order."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return t.select(F.col("vec_id").alias("series_id"), F.col("label").cast("string").alias("label"), split_of(F.col("vec_id")).alias("split"), F.lit(0).alias("var"), F.posexplode("embedding").alias("t", "x")).withColumn("x", F.col("x").cast("double"))


def packed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, packed: no shuffle, since a row holds its series."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return t.select(F.col("vec_id").alias("series_id"), F.col("label").cast("string").alias("label"), split_of(F.col("vec_id")).alias("split"), F.array(F.col("embedding").cast("array<double>")).alias("vars"))


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long panel: each user's summed value by day and event type (zero where there is none).

    The label is the user's most frequent type. The grid of types and days is small and
    independent of the number of users.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", F.to_date("ts").alias("dt"), "value")
    cells = e.groupBy("user_id", "event_type", "dt").agg(F.sum("value").alias("x"), F.count("*").alias("n"))
    label = cells.groupBy("user_id", "event_type").agg(F.sum("n").alias("n")).groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "event_type")).alias("top")).select("user_id", F.col("top.event_type").alias("label"))
    kinds = e.agg(F.array_sort(F.collect_set("event_type")).alias("k")).select(F.posexplode("k").alias("var", "event_type"))
    days = e.agg(F.min("dt").alias("a"), F.max("dt").alias("z")).select(F.posexplode(F.sequence("a", "z")).alias("t", "dt"))
    # types times days: a few hundred rows
    grid = label.crossJoin(F.broadcast(kinds.crossJoin(days)))
    out = grid.join(cells, ["user_id", "event_type", "dt"], "left")
    return out.select(F.col("user_id").alias("series_id"), "label", split_of(F.col("user_id")).alias("split"), "var", "t", F.coalesce("x", F.lit(0.0)).alias("x"))


def quarterly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long panel: each customer's number (0) and price (1) of orders by quarter, from the table's first quarter to its last.

    The grid of quarters is as long as the table's span of dates. Without any dated order it has no step.
    """
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).alias("quarter"), "o_totalprice").where("quarter is not null")
    span = o.agg(F.min("quarter").alias("first"), F.max("quarter").alias("last"))
    cells = o.groupBy(F.col("o_custkey").alias("c_custkey"), "quarter").agg(F.count("*").cast("double").alias("n"), F.sum("o_totalprice").alias("price"))
    steps = span.where("first is not null").select(F.posexplode(F.sequence("first", "last")).alias("t", "quarter"))
    grid = c.crossJoin(F.broadcast(steps)).join(cells, ["c_custkey", "quarter"], "left")  # a row a quarter
    both = F.array(F.coalesce("n", F.lit(0.0)), F.coalesce("price", F.lit(0.0)))
    return grid.select(F.col("c_custkey").alias("series_id"), F.col("c_mktsegment").alias("label"), split_of(F.col("c_custkey")).alias("split"), "t", F.posexplode(both).alias("var", "x")).select("series_id", "label", "split", "var", "t", "x")


def packed(long: DataFrame) -> DataFrame:
    """Pack a long panel; a series' values are gathered in order of step, its arrays in order of variable."""
    values = long.groupBy("series_id", "label", "split", "var").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda s: s.x).alias("xs"))
    return values.groupBy("series_id", "label", "split").agg(F.transform(F.array_sort(F.collect_list(F.struct("var", "xs"))), lambda s: s.xs).alias("vars"))


def unpacked(panel: DataFrame) -> DataFrame:
    inner = panel.select("series_id", "label", "split", F.posexplode("vars").alias("var", "xs"))
    return inner.select("series_id", "label", "split", "var", F.posexplode("xs").alias("t", "x"))
