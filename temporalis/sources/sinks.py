"""Results of a run as files. File names are fixed values.

Settings and metrics, which have a row a run or class, are written by the driver of the run; their
functions take a ``write``, for files of this machine or (``shared_writer``) of any store that Spark
reaches. Explanations are as many as series, or as long as there are: Spark writes them, as folders of CSV parts.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict
from datetime import datetime
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .results import LOCAL

Write = Callable[[str, str], None]


def local_writer(path: str, text: str) -> None:
    Path(path).write_text(text, newline="")


def shared_writer(spark: SparkSession) -> Write:
    """Writes through Spark's file systems."""

    def write(path: str, text: str) -> None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
        out.write(bytearray(text.encode()))
        out.close()

    return write


def run_directory(spark: SparkSession, root: str, dataset: str, now: datetime) -> str:
    """A new directory named by data set and time, in any store that Spark reaches; it must not exist."""
    path = f"{root}/{dataset}_{now:%Y%m%d_%H%M%S}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(p):
        raise FileExistsError(path)
    files.mkdirs(p)
    return path


def save_config(config, path: Path | str, write: Write = local_writer) -> None:
    write(f"{path}/config.json", json.dumps(asdict(config), indent=2))


def save_accuracy(runs: list[dict], path: Path | str, write: Write = local_writer) -> None:
    mean = lambda k: float(np.mean([r[k] for r in runs]))
    head = {"mean_balanced_accuracy": mean("balanced_accuracy"), "std_balanced_accuracy": float(np.std([r["balanced_accuracy"] for r in runs])), "mean_macro_f1": mean("macro_f1")}
    head |= {f"mean_{k}": mean(k) for k in ("time_features_s", "time_train_s", "time_total_s")}
    write(f"{path}/accuracy.json", json.dumps(head | {"per_run": runs}, indent=2))


def save_locals(rows: DataFrame, path: Path | str) -> None:
    """rows have the columns of LOCAL; written in order of sample_idx."""
    names = [column.split()[0] for column in LOCAL.split(", ")]
    rows.select(*names).withColumn("precision_train", F.round("precision_train", 6)).orderBy("sample_idx").write.option("header", True).csv(f"{path}/local_explanations.csv")


def save_globals(disjuncts: DataFrame, kinds: DataFrame, path: Path | str) -> None:
    """disjuncts (class, first_id, formula), kinds (class, first_id, n_unique_locals, f1): two folders of CSV parts.

    global_disjuncts.csv has a row a disjunct; in global_explanations.csv each class has one text of them all, joined by the task that
    writes it, and classes come in order of their first explanation.
    """
    disjuncts.select("class", "first_id", "formula").write.option("header", True).csv(f"{path}/global_disjuncts.csv")
    texts = disjuncts.groupBy("class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_id", "formula"))), lambda x: x.formula), " | ").alias("formula"))
    rows = kinds.join(texts, "class").orderBy("first_id").select("class", "formula", F.col("n_unique_locals").cast("int").alias("n_unique_locals"), F.round("f1", 6).alias("f1"))
    rows.write.option("header", True).csv(f"{path}/global_explanations.csv")
