"""Labelled series in the public ``.ts`` text layout, read and written by Spark.

A file has header lines (``@name value``), then ``@data``, then a line a series: its variables, each a
comma-separated list of values (``?`` where one is missing), with ``:`` between them and the
label at the end. Files whose names end in ``_TRAIN.ts`` and ``_TEST.ts`` are the two splits. Spark
reads the lines by splits of files, so a file may be of any size; only header lines reach the driver.

A missing value is null. Lines that are empty or begin with ``#`` are passed over. Values with time stamps, or
series without a label, are an error, as is a value that isn't a number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import shared_writer


def header(spark: SparkSession, path: str) -> dict[str, str]:
    """The header of the files at path, names in lower case; where files differ, the least of their values."""
    lines = spark.read.text(path).where(F.trim("value").startswith("@")).select(F.trim("value").alias("v")).distinct().orderBy(F.col("v").desc()).collect()
    told = {}
    for r in lines:
        name, _, value = r.v[1:].partition(" ")
        told[name.lower()] = value.strip()
    return told


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Packed panel (series_id, label, split, vars) of the files at path (a file, folder or pattern).

    series_id tells a line, in order within each split of a file: write the panel before going over it twice.
    """
    told = header(spark, path)
    if told.get("timestamps", "false").lower() == "true":
        raise ValueError(f"{path}: values with time stamps")
    if not told.get("classlabel", "").lower().startswith("true"):
        raise ValueError(f"{path}: series without labels")
    line = F.trim("value")
    rows = spark.read.text(path).select(line.alias("line"), F.col("_metadata.file_path").alias("file")).where((F.col("line") != "") & ~F.col("line").rlike("^[@#]"))
    parts = F.split("line", ":")
    number = lambda v: F.when(F.trim(v) == "?", None).otherwise(F.trim(v).cast("double"))
    one = lambda text: F.transform(F.split(text, ","), number)
    split = F.when(F.col("file").rlike(r"(?i)_TEST\.ts(/[^/]*)?$"), "TEST").otherwise("TRAIN")
    return rows.select(F.monotonically_increasing_id().alias("series_id"), F.trim(F.element_at(parts, -1)).alias("label"), split.alias("split"), F.transform(F.slice(parts, 1, F.size(parts) - 1), one).alias("vars"))


def write_archive(panel: DataFrame, path: str, name: str) -> None:
    """Writes a packed panel as folders ``name_TRAIN.ts`` and ``name_TEST.ts`` of text parts, each folder with its header in a part of its own.

    Labels must not hold ``:`` or line breaks, nor begin a line (a series has a variable). Labels of the header are gathered: a row a class.
    """
    spark = panel.sparkSession
    odd = panel.where(F.col("label").isNull() | F.col("label").rlike(r"[:\n\r]") | (F.size("vars") < 1)).limit(1).collect()
    if odd:
        raise ValueError(f"a series that the layout can't hold: {odd[0].series_id}")
    labels = sorted(r.label for r in panel.select("label").distinct().collect())
    about = panel.agg(F.max(F.size("vars")).alias("dims"), F.max(F.exists("vars", lambda v: F.exists(v, lambda x: x.isNull()))).alias("gaps")).first()
    text = F.concat(F.array_join(F.transform("vars", lambda v: F.array_join(F.transform(v, lambda x: F.coalesce(x.cast("string"), F.lit("?"))), ",")), ":"), F.lit(":"), F.col("label"))
    write = shared_writer(spark)
    for split in ("TRAIN", "TEST"):
        out = f"{path}/{name}_{split}.ts"
        panel.where(F.col("split") == split).select(text.alias("value")).write.text(out)
        lines = [f"@problemName {name}", "@timeStamps false", f"@missing {str(bool(about.gaps)).lower()}", f"@univariate {str((about.dims or 1) == 1).lower()}", f"@classLabel true {' '.join(labels)}", "@data", ""]
        write(f"{out}/header.ts", "\n".join(lines))
