"""Bounded samples of labelled rows, for the models that are trained here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, rows: int) -> DataFrame:
    """(doc_id, label, text) of at most ``rows`` labelled ids, those of the least hash.

    An id labelled twice takes its highest label. The ids that are broadcast are at most
    ``rows``, whatever the tables hold.
    """
    picked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.cast("int").alias("label"))
        .where("doc_id is not null and label is not null")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text")
