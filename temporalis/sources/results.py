"""Run directories: settings and metrics as JSON, explanations as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG = "dataset string, n_formulas int, depth_max int, batch_size int, threshold_corr double, max_iter int, only_temporal boolean, until_weight double, cv int, pool_size int, precision_threshold double, n_run int, base_seed int, output_dir string"
METRICS = {"run": "int", "seed": "int", "balanced_accuracy": "double", "accuracy": "double", "macro_f1": "double", "per_class": "map<string, struct<precision: double, recall: double, f1: double, support: int>>", "time_features_s": "double", "time_train_s": "double", "time_total_s": "double"}
MEANS = ["mean_balanced_accuracy", "std_balanced_accuracy", "mean_macro_f1", "mean_time_features_s", "mean_time_train_s", "mean_time_total_s"]
SUMMARY = ", ".join(f"{c} double" for c in MEANS) + ", per_run array<struct<" + ", ".join(f"{c}: {t}" for c, t in METRICS.items()) + ">>"
LOCAL = "sample_idx long, target_class string, formula string, n_picks int, precision_train double, n_tp long"
GLOBAL = "class string, formula string, n_unique_locals int, f1 double"
#: The names above are fixed values: those of the result files.
_KEYS = ["dataset", "n_formulas", "depth_max"]


def _run_dir(df: DataFrame) -> DataFrame:
    return df.withColumn("run_dir", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+(/part-[^/]*)?$", 1))


def load_results(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, locals, globals) of the directories that hold both settings and metrics.

    runs has a row a run with its class metrics as a map; the others are empty where no
    directory has explanations.
    """
    read = lambda name, schema: _run_dir(spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root))

    def sheet(name: str, schema: str) -> DataFrame:
        """One file a run, or a folder of that name with its parts."""
        found = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"{{{name},part-*.csv}}").csv(root)
        return _run_dir(found.where(F.col("_metadata.file_path").contains(f"/{name}")))

    keys = read("config.json", CONFIG).select("run_dir", *_KEYS)
    runs = read("accuracy.json", SUMMARY).join(keys, "run_dir").select("run_dir", *_KEYS, F.explode("per_run").alias("r")).select("run_dir", *_KEYS, "r.*")
    done = runs.select("run_dir", *_KEYS).distinct()
    return runs, sheet("local_explanations.csv", LOCAL).join(done, "run_dir"), sheet("global_explanations.csv", GLOBAL).join(done, "run_dir")


def class_metrics(runs: DataFrame) -> DataFrame:
    """A row a run and class."""
    return runs.select("run_dir", *_KEYS, "run", F.explode("per_class").alias("class", "m")).select("run_dir", *_KEYS, "run", "class", "m.*")


def summary(runs: DataFrame) -> DataFrame:
    """Means over runs of each setting; population deviation of the balanced accuracy."""
    return runs.groupBy(*_KEYS).agg(F.avg("balanced_accuracy").alias("mean_balanced_accuracy"), F.stddev_pop("balanced_accuracy").alias("std_balanced_accuracy"), F.avg("macro_f1").alias("mean_macro_f1"), F.count("*").alias("n_run"))


def accuracy_pivot(runs: DataFrame, depths: list[int]) -> DataFrame:
    """Mean balanced accuracy, a row for n_formulas (largest first) and a column a depth."""
    wide = runs.groupBy("dataset", "n_formulas").pivot("depth_max", depths).agg(F.avg("balanced_accuracy"))
    return wide.orderBy("dataset", F.col("n_formulas").desc())


def class_means(metrics: DataFrame) -> DataFrame:
    """Mean F1 of each class over a data set's runs; classes without any value are left out."""
    means = metrics.groupBy("dataset", "class").agg(F.avg("f1").alias("mean_f1"))
    return means.where(F.col("mean_f1").isNotNull())


def settings(runs: DataFrame) -> DataFrame:
    """Each data set's distinct settings, sorted."""
    return runs.select(*_KEYS).dropDuplicates().orderBy(*_KEYS)
