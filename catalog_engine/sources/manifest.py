"""Manifest text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalog_engine.functions import trim_space

WRONG_PARTS = "must be in the format: bucket, key, version_id"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    # Only "\n" ends a line; a "\r" before it is white space and trimmed.
    return spark.read.option("lineSep", "\n").text(path).select(
        trim_space(F.col("value")).alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )


def _line_numbers(lines: DataFrame, bad: DataFrame) -> DataFrame:
    """Numbers, from 0, of the bad lines within their file.

    Lines are counted per file block, a table of one row per block; only bad lines are
    joined to it.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        lines.groupBy("file", "block")
        .agg(F.count("*").alias("n"), F.min("id").alias("first"))
        .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    )
    return bad.join(blocks, ["file", "block"]).select(
        "file",
        (F.col("start") + F.col("id") - F.col("first")).alias("line_number"),
        "line",
        F.lit(WRONG_PARTS).alias("reason"),
    )


def read_manifest(
    spark: SparkSession, path: str, on_error: str = "fail"
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """``bucket,key,version_id`` lines as a table; blank lines are skipped.

    ``fail`` raises on the first line that does not have three parts, before anything is
    returned. ``reject`` returns the good rows and the bad lines with their numbers.
    """
    if on_error not in ("fail", "reject"):
        raise ValueError(f"unknown on_error: {on_error!r}")
    lines = _lines(spark, path)
    parts = F.split("line", ",")
    filled = lines.where("line <> ''")
    names = ("bucket", "key", "version_id")
    items = filled.where(F.size(parts) == 3).select(
        *[trim_space(parts[i]).alias(name) for i, name in enumerate(names)]
    )
    rejects = _line_numbers(lines, filled.where(F.size(parts) != 3))
    if on_error == "reject":
        return items, rejects
    first = rejects.orderBy("file", "line_number").first()
    if first:
        raise ValueError(f"invalid manifest line {first.line_number} of {first.file}: {WRONG_PARTS}")
    return items
