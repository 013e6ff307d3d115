"""The log of backup and restore runs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_engine.functions import clean_details
from catalog_engine.operators.maintenance import DUPLICATE, event_reasons, validate_events
from catalog_engine.schemas import EVENTS


def event_row(
    spark: SparkSession,
    type: str,
    started_at: int,
    ended_at: int | None,
    details: str | None = None,
    created_at: int | None = None,
) -> DataFrame:
    """One run as a one-row events table."""
    created = int(time.time()) if created_at is None else created_at
    values = dict(
        started_at=started_at, ended_at=ended_at, type=type, details=details, created_at=created
    )
    row = spark.range(1).select(
        *[F.lit(values[f.name]).cast(f.dataType).alias(f.name) for f in EVENTS.fields]
    )
    return row.withColumn("details", clean_details(F.col("details")))


def append_events(events: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with ``rows`` added, and the rows refused with their reasons."""
    cleaned = rows.withColumn("details", clean_details(F.col("details")))
    accepted, rejects = validate_events(cleaned, events)
    return events.unionByName(accepted, allowMissingColumns=True), rejects


def append_event(
    events: DataFrame,
    type: str,
    started_at: int,
    ended_at: int | None,
    details: str | None = None,
    created_at: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Records one run: the events with it, and the row itself, with reasons, if refused.

    The log is asked for one key, which reaches its scan, and is not shuffled.
    """
    row = event_row(events.sparkSession, type, started_at, ended_at, details, created_at)
    taken = events.where(F.col("started_at") == started_at).exists()
    reasons = event_reasons()
    repeated = (F.size(reasons) == 0) & taken
    checked = row.withColumn(
        "reasons", F.when(repeated, F.array(F.lit(DUPLICATE))).otherwise(reasons)
    )
    accepted = checked.where(F.size("reasons") == 0).drop("reasons")
    rejects = checked.where(F.size("reasons") > 0).withColumn("copies", F.lit(1).cast("long"))
    return events.unionByName(accepted, allowMissingColumns=True), rejects


def filter_events(events: DataFrame, type: str) -> DataFrame:
    return events.where(F.col("type") == type)


def list_events(events: DataFrame, type: str) -> DataFrame:
    """Runs of one type, newest first."""
    return (
        filter_events(events, type)
        .orderBy(F.desc("started_at"))
        .select("started_at", "ended_at", "details")
    )
