"""Listings as text: each asks, formats and writes below ``out``.

``out`` is a folder or an address; with ``bucket``, an ``s3://`` address must lie in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from catalog_engine import schemas
from catalog_engine.operators.catalog import files_as_of, list_versions, sample_live
from catalog_engine.operators.events import list_events
from catalog_engine.operators.listing import format_events, format_files, format_versions
from catalog_engine.operators.manifest import (
    check_bucket,
    format_status,
    parse_object_uri,
    restore_status,
    status_counts,
    to_manifest,
)
from catalog_engine.sources.sinks import write_listing


def check_output(spark: SparkSession, out: str, bucket: str | None) -> None:
    """Raises for an address that is malformed or outside ``bucket``."""
    if bucket is None or not out.startswith("s3://"):
        return
    parsed = parse_object_uri(spark.range(1).select(F.lit(out).alias("uri")))
    error = check_bucket(parsed, bucket).first().error
    if error:
        raise ValueError(f"{out}: {error}")


def list_files_to(
    catalog: DataFrame,
    out: str,
    dirs: Sequence[str] = (),
    as_of: int | str | None = None,
    bucket: str | None = None,
    manifest: bool = False,
    match: str = "like",
) -> None:
    """Files at a time, as text or as manifest lines of ``bucket``."""
    check_output(catalog.sparkSession, out, bucket)
    if manifest and bucket is None:
        raise ValueError("a manifest names its bucket")
    files = files_as_of(catalog, as_of, dirs, match)
    lines = to_manifest(files, bucket) if manifest else format_files(files)
    write_listing(lines, out, schemas.NO_FILES)


def list_versions_to(catalog: DataFrame, out: str, path: str, bucket: str | None = None) -> None:
    """All versions of one path."""
    check_output(catalog.sparkSession, out, bucket)
    write_listing(format_versions(list_versions(catalog, path)), out, schemas.NO_VERSIONS)


def list_events_to(events: DataFrame, out: str, type: str, bucket: str | None = None) -> None:
    """The backups or the restores."""
    check_output(events.sparkSession, out, bucket)
    empty = {"backup": schemas.NO_BACKUPS, "restore": schemas.NO_RESTORES}[type]
    write_listing(format_events(list_events(events, type)), out, empty)


def list_status_to(
    manifest: DataFrame, heads: DataFrame, out: str, bucket: str | None = None
) -> DataFrame:
    """Restore state of each manifest item; returns the counts."""
    check_output(manifest.sparkSession, out, bucket)
    spark, seen = manifest.sparkSession, Observation()
    counts = [F.count_if(c).alias(n) for n, c in status_counts().items()]
    status = restore_status(manifest, heads).observe(seen, *counts)
    format_status(status).write.mode("overwrite").text(out)
    # The counts of the rows that were written: the join runs once.
    row = seen.get
    return spark.range(1).select(*(F.lit(row[n]).cast("long").alias(n) for n in status_counts()))


def list_sample_to(
    catalog: DataFrame,
    out: str,
    n: int,
    seed: int | None = None,
    bucket: str | None = None,
    manifest: bool = False,
) -> None:
    """Some live files drawn at random, as text or as manifest lines of ``bucket``."""
    check_output(catalog.sparkSession, out, bucket)
    if manifest and bucket is None:
        raise ValueError("a manifest names its bucket")
    files = sample_live(catalog, n, seed)
    lines = to_manifest(files, bucket) if manifest else format_files(files)
    write_listing(lines, out, schemas.NO_FILES)
