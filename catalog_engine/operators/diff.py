"""Differences between a walk and the catalog, and deletion stamps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_engine.functions import normalize_dir, prefix_condition
from catalog_engine.operators.catalog import (
    CONDITIONS,
    KEY,
    join_prefixes,
    latest_versions,
    live_only,
    stored_keys,
    walked_paths,
)


def detect_changed(inventory: DataFrame, catalog: DataFrame) -> DataFrame:
    """Inventory rows that no undeleted version matches on path, size and mtime.

    Any version counts, not only the newest. Overlapping roots list a file twice; it comes
    out once. A short walk does not shuffle the catalog (``stored_keys``).
    """
    return inventory.dropDuplicates(KEY).join(stored_keys(catalog, inventory), KEY, "left_anti")


def _deleted_rows(
    catalog: DataFrame,
    inventory: DataFrame,
    dirs: Sequence[str],
    match: str,
    exclude_roots: Sequence[str],
) -> DataFrame:
    path = F.col("path")

    def under(roots: Sequence[str]):
        conditions = [prefix_condition(path, normalize_dir(r), match) for r in roots]
        return reduce(lambda a, b: a | b, conditions, F.lit(False))

    candidates, late = catalog, []
    for roots, how in ((dirs, "left_semi"), (exclude_roots, "left_anti")):
        if len(roots) > CONDITIONS:
            late.append((roots, how))
        elif how == "left_semi":
            candidates = candidates.where(under(roots))
        elif roots:
            candidates = candidates.where(~under(roots))
    gone = live_only(latest_versions(candidates)).join(walked_paths(inventory), "path", "left_anti")
    for roots, how in late:
        below = join_prefixes(gone.select("path"), [normalize_dir(r) for r in roots], match)
        gone = gone.join(below.distinct(), "path", how)
    return gone


def detect_deleted(
    catalog: DataFrame,
    inventory: DataFrame,
    dirs: Sequence[str],
    match: str = "like",
    exclude_roots: Sequence[str] = (),
) -> DataFrame:
    """Paths under ``dirs`` whose newest row is live and that the walk did not see.

    ``exclude_roots`` keeps trees the walk could not read out of the result. Overlapping
    directories give a path once. The rows stay partitioned by path from the ranking to the
    join.
    """
    return _deleted_rows(catalog, inventory, dirs, match, exclude_roots).select("path")


def detect_deletion_stamps(
    catalog: DataFrame,
    inventory: DataFrame,
    dirs: Sequence[str],
    deleted_at: int,
    match: str = "like",
    exclude_roots: Sequence[str] = (),
) -> DataFrame:
    """``detect_deleted`` and ``deletion_stamps`` in one ranking of the catalog, with their paths."""
    rows = _deleted_rows(catalog, inventory, dirs, match, exclude_roots)
    return rows.select("path", "row_seq", F.lit(deleted_at).cast("long").alias("deleted_at"))


def deletion_stamps(catalog: DataFrame, paths: DataFrame, deleted_at: int) -> DataFrame:
    """Stamps (row_seq, deleted_at) for the newest row of each path, stamped or not.

    The newest rows are found first: one row per path meets the join, however many versions
    a path has.
    """
    newest = latest_versions(catalog.select("path", "last_modified_at", "row_seq"))
    return newest.join(walked_paths(paths), "path", "left_semi").select(
        "row_seq", F.lit(deleted_at).cast("long").alias("deleted_at")
    )


def apply_stamps(
    catalog: DataFrame, stamps: DataFrame, on: Sequence[str] = ("row_seq",)
) -> DataFrame:
    """Catalog with stamps laid over ``deleted_at``.

    ``row_seq`` is unique on both sides, so the join is even; a small stamp set is broadcast
    by Spark after it has measured it.
    """
    stamped = stamps.select(*on, F.col("deleted_at").alias("_stamp"))
    return (
        catalog.join(stamped, list(on), "left")
        .withColumn("deleted_at", F.coalesce("_stamp", "deleted_at"))
        .select(*catalog.columns)
    )


def mark_deleted(catalog: DataFrame, paths: DataFrame, deleted_at: int) -> DataFrame:
    """The catalog with ``deleted_at`` set on the newest row of each given path."""
    return apply_stamps(catalog, deletion_stamps(catalog, paths, deleted_at))
