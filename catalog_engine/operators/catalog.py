"""Questions asked of the catalog: versions, live files, points in time."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalog_engine.functions import as_of_seconds, folded, prefix_condition, prefix_stem

KEY = ["path", "size", "last_modified_at"]
LISTING = ["path", "size", "last_modified_at", "version_id"]


def filter_prefix(df: DataFrame, prefix: str, match: str = "like") -> DataFrame:
    """Rows whose path starts with ``prefix``."""
    return df.where(F.col("path").isNotNull() & prefix_condition(F.col("path"), prefix, match))


#: Prefixes that one condition names; more are a table that is joined.
CONDITIONS = 32


def join_prefixes(rows: DataFrame, prefixes: Sequence[str], match: str = "like") -> DataFrame:
    """``rows``, each as often as ``prefixes`` match its path, by one equi-join.

    A path is looked up by its beginnings of all the lengths that prefixes (up to their first
    wildcard) have, so neither plan nor work per row grows with the number of prefixes.
    """
    stems = [(p, None) if match == "literal" else prefix_stem(p) for p in prefixes]
    table = [(stem, pattern, n) for (stem, pattern), n in Counter(stems).items()]
    spark = rows.sparkSession
    wanted = spark.createDataFrame(table, "_stem string, _pattern string, _copies int")
    key = F.col("path") if match == "literal" else folded(F.col("path"))
    cut = F.array(*(F.when(F.length("path") >= n, F.substring(key, 1, n)) for n in sorted({len(s) for s, _ in stems})))
    found = rows.withColumn("_stem", F.explode(F.array_compact(cut))).join(wanted, "_stem")
    found = found.where(F.col("_pattern").isNull() | F.rlike("path", F.col("_pattern")))
    return found.select(*rows.columns, F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")).drop("_copy")


def live_only(latest: DataFrame, as_of: int | None = None) -> DataFrame:
    """Rows not deleted, or with ``as_of`` deleted only after it."""
    live = F.col("deleted_at").isNull()
    return latest.where(live if as_of is None else live | (F.col("deleted_at") > as_of))


def latest_versions(catalog: DataFrame) -> DataFrame:
    """The newest row of each path, ties broken by insertion order.

    The rank-1 limit runs before the shuffle too, so a path with very many versions sends
    one row per map task, not all of them.
    """
    newest = Window.partitionBy("path").orderBy(F.desc("last_modified_at"), F.desc("row_seq"))
    return catalog.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")


def files_as_of(
    catalog: DataFrame,
    as_of: int | str | None = None,
    prefixes: Sequence[str] = ("",),
    match: str = "like",
    dedupe: bool = False,
) -> DataFrame:
    """Files that existed at ``as_of`` (epoch seconds, RFC 3339 text, or now).

    Rows modified later are dropped first, then the newest row of a path decides, then its
    deletion stamp. A path under several prefixes is listed once for each unless ``dedupe``;
    the catalog is scanned and shuffled once for all of them. Up to ``CONDITIONS`` prefixes are a
    condition of the scan; more are joined with what is live.
    """
    moment = as_of_seconds(as_of)
    if len(prefixes) > CONDITIONS:
        live = live_only(latest_versions(catalog.where(F.col("last_modified_at") <= moment)), moment)
        files = join_prefixes(live.select(*LISTING), prefixes, match)
        return files.dropDuplicates(["path"]) if dedupe else files
    conditions = [prefix_condition(F.col("path"), p, match) for p in (prefixes or [""])]
    known = catalog.where(F.col("last_modified_at") <= moment).where(
        reduce(lambda a, b: a | b, conditions)
    )
    files = live_only(latest_versions(known), moment).select(*LISTING)
    if len(conditions) == 1 or dedupe:
        return files
    matched = reduce(lambda a, b: a + b, [c.cast("int") for c in conditions])
    copies = F.explode(F.sequence(F.lit(1), matched))
    return files.select(*LISTING, copies.alias("_copy")).drop("_copy")


def list_files_multi(
    catalog: DataFrame,
    dirs: Sequence[str],
    as_of: int | str | None = None,
    match: str = "like",
    dedupe: bool = False,
) -> DataFrame:
    """Listing of several directories, or of everything where none is given."""
    return files_as_of(catalog, as_of, list(dirs) or [""], match, dedupe)


def list_versions(catalog: DataFrame, path: str) -> DataFrame:
    """All versions of one path, deleted ones included, newest first."""
    return (
        catalog.where(F.col("path") == path)
        .orderBy(F.desc("last_modified_at"), F.desc("row_seq"))
        .select("last_modified_at", "size", "sha256")
    )


def sample_live(catalog: DataFrame, n: int = 100, seed: int | str | None = None) -> DataFrame:
    """``n`` random live files. With ``seed`` the draw is the same every time."""
    live = live_only(latest_versions(catalog))
    draw = F.rand() if seed is None else F.md5(F.concat(F.lit(f"{seed}:"), F.col("path")))
    return live.orderBy(draw, "path").limit(n).select(*LISTING)


def stored_keys(catalog: DataFrame, asked: DataFrame) -> DataFrame:
    """Which of the (path, size, last_modified_at) asked for are stored, undeleted; once each.

    The semi join comes after the distinct: where few keys are asked for, Spark broadcasts
    them and moves the join down to the scan, and the catalog is not shuffled. Otherwise
    copies of a key are folded before the shuffle, so none gather in a task.
    """
    known = live_only(catalog).select(*KEY).distinct()
    return known.join(asked.select(*KEY).distinct(), KEY, "left_semi")


def file_exists(keys: DataFrame, catalog: DataFrame) -> DataFrame:
    """For each distinct (path, size, last_modified_at) asked for: is it stored, undeleted?"""
    known = stored_keys(catalog, keys).withColumn("exists", F.lit(True))
    return (
        keys.select(*KEY)
        .distinct()
        .join(known, KEY, "left")
        .select(*KEY, F.coalesce("exists", F.lit(False)).alias("exists"))
    )


def walked_paths(inventory: DataFrame) -> DataFrame:
    """The set of paths a walk has seen."""
    return inventory.select("path").distinct()
