"""Corpus pipeline: five stages over documents, each on all that the one before kept.

Each row is judged by itself: rows that repeat a doc_id, or have none, are filtered, masked
and packed like any others, and of near-duplicates one row stays, whatever its id. A null
text counts as empty: it isn't toxic, goes for its lack of letters, and would otherwise be
no one's duplicate, hold no secret, and pack as its end id alone. An empty table passes all
stages with no rows. Other columns, whatever their names, stay with their rows up to packing.
"""

from pyspark.sql import functions as F

from temporalis.llm.langid import train_languages, with_main_language
from temporalis.llm.neardup import near_duplicates
from temporalis.llm.packing import pack
from temporalis.llm.secrets import mask_secrets, train_secrets
from temporalis.llm.shared import if_few, stored
from temporalis.llm.tokens import tokenizer_path
from temporalis.llm.toxicity import train_toxicity, without_toxic

#: A text is rejected if its main language holds less than this share of its letters.
LEAST_SHARE = 0.4


def toxicity(spark, docs, sf_dir):
    """Documents that the ordinal model finds toxic go."""
    return without_toxic(docs, train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language(spark, docs, sf_dir):
    """Texts without a letter, or of no main language, go; if no language could be learned, only the former."""
    return with_main_language(docs, train_languages(docs), LEAST_SHARE)


def near_dedup(spark, docs, sf_dir):
    """One row of each group of near-duplicates stays: one with the smallest doc_id, or without any if all are.

    doc_id may be null or repeat, so rows get a key of their own, stored, so that retries can't deal the keys anew.
    """
    key = next(name for n in range(len(docs.columns) + 1) if (name := f"_row{n}") not in docs.columns)
    rows = stored(docs.withColumn(key, F.monotonically_increasing_id()), "rows", "zstd")
    groups = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", key)
    own = stored(groups.join(rows.select(key, "doc_id"), key).withColumn("order", order), "groups")
    first = stored(own.groupBy("component_id").agg(F.min("order").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    gone = stored(own.join(first, "component_id").where("order <> first").select(key), "gone")
    return rows.join(if_few(gone), key, "left_anti").drop(key)


def secrets(spark, docs, sf_dir):
    """Every secret is masked in its text."""
    return mask_secrets(docs, train_secrets(docs))


def packing(spark, docs, sf_dir):
    """Pieces of documents in sequences along the curve."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), literal=False)


STAGES = [("toxicity", toxicity), ("language_id", language), ("near_dedup", near_dedup), ("secret_scan", secrets), ("packing", packing)]
#: The stages hold trained models: SQL can't express them.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
