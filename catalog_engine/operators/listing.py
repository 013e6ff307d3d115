"""Text lines of the listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine.functions import epoch_text


def _line(*parts: Column | str) -> Column:
    pieces = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.concat(*pieces).alias("value")


def _utc(name: str) -> Column:
    return F.coalesce(F.concat(epoch_text(F.col(name)), F.lit(" UTC")), F.lit("N/A"))


def format_files(files: DataFrame) -> DataFrame:
    return files.select(
        _line(
            "Path: ", F.col("path"),
            ", Size: ", F.col("size"),
            " bytes, LastModified At: ", _utc("last_modified_at"),
        )
    )


def format_versions(versions: DataFrame) -> DataFrame:
    return versions.select(
        _line(
            "Size: ", F.col("size"),
            " bytes, LastModified At: ", _utc("last_modified_at"),
            ", SHA256: ", F.col("sha256"),
        )
    )


def format_events(events: DataFrame) -> DataFrame:
    return events.select(
        _line(
            "ID: ", F.col("started_at"),
            ", Started At: ", _utc("started_at"),
            ", Ended At: ", _utc("ended_at"),
            ", Details: ", F.coalesce("details", F.lit("N/A")),
        )
    )
