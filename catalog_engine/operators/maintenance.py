"""Constraints, appends, schema steps and run counters."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalog_engine.schemas import EVENT_TYPES, FILES

DUPLICATE = "duplicate key"


def _reasons(checks: dict[str, Column]) -> Column:
    """Names of the checks a row fails; a null counts as failing."""
    failed = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    return F.array_compact(F.array(*failed))


def _optional(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) > 0)


def _file_reasons(columns: list[str]) -> Column:
    checks = {
        "path": F.length("path") > 0,
        "version_id": F.col("version_id").isNotNull(),
        "sha256": F.col("sha256").rlike(r"\A[0-9a-f]{64}\z"),
        "size": F.col("size") >= 0,
        "last_modified_at": F.col("last_modified_at") > 0,
    }
    if "deleted_at" in columns:
        checks["deleted_at"] = _optional("deleted_at")
    return _reasons(checks)


def _valid(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("reasons") == 0)


def _stored_keys(stored: DataFrame, firsts: DataFrame, key: list[str]) -> DataFrame:
    """Keys of ``firsts`` that ``stored`` holds already.

    The stored table is the left side of a semi join, so where the new keys are few (their
    size is known once they are staged) it is only scanned, not shuffled.
    """
    return stored.select(*key).join(firsts.select(*key), key, "left_semi").distinct()


def _split_first(
    rows: DataFrame, key: list[str], row_id: list[str], firsts: DataFrame, stored: DataFrame | None
) -> DataFrame:
    """Gives every valid row but the first of its key, or of a stored key, a reason.

    Only (key, row id) was aggregated into ``firsts``, with a partial step before the shuffle,
    and the answer goes back over the unique row id: copies of a key never meet in one task.
    """
    if stored is not None:
        firsts = firsts.join(_stored_keys(stored, firsts, key), key, "left_anti")
    return _flag_first(rows, row_id, firsts)


def _flag_first(rows: DataFrame, row_id: list[str], firsts: DataFrame) -> DataFrame:
    """Gives every valid row that is not among ``firsts``, by its unique id, a reason."""
    flags = firsts.select(*row_id, F.lit(True).alias("_first"))
    repeated = (F.size("reasons") == 0) & F.col("_first").isNull()
    reasons = F.when(repeated, F.array(F.lit(DUPLICATE))).otherwise(F.col("reasons"))
    return rows.join(flags, row_id, "left").withColumn("reasons", reasons).drop("_first")


def event_reasons() -> Column:
    """Names of the checks that a run fails."""
    return _reasons(
        {
            "started_at": F.col("started_at") > 0,
            "ended_at": _optional("ended_at"),
            "type": F.col("type").isin(*EVENT_TYPES),
        }
    )


def _fold_copies(rows: DataFrame, reasons: Column) -> DataFrame:
    """Equal rows as one with a count, and the checks each row fails."""
    return (
        rows.groupBy(*rows.columns)
        .agg(F.count("*").alias("copies"))
        .withColumn("reasons", reasons)
    )


def _unfold(flagged: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejects with counts; further copies of an accepted row are rejects."""
    ok = F.size("reasons") == 0
    rejects = flagged.where(~ok | (F.col("copies") > 1)).select(
        *columns,
        F.when(ok, F.col("copies") - 1).otherwise(F.col("copies")).alias("copies"),
        F.when(ok, F.array(F.lit(DUPLICATE))).otherwise(F.col("reasons")).alias("reasons"),
    )
    return flagged.where(ok).select(*columns), rejects


def validate_files(rows: DataFrame, catalog: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the table's constraints, and the others with ``reasons``.

    ``rows`` needs a unique ``row_seq``; of several rows with one (path, version_id) the
    lowest is accepted. With ``catalog``, keys it holds are refused as well.
    """
    key = ["path", "version_id"]
    checked = rows.withColumn("reasons", _file_reasons(rows.columns))
    firsts = _valid(checked).groupBy(*key).agg(F.min("row_seq").alias("row_seq"))
    flagged = _split_first(checked, key, ["row_seq"], firsts, catalog)
    ok = F.size("reasons") == 0
    columns = rows.columns
    return flagged.where(ok).select(*columns), flagged.where(~ok).select(*columns, "reasons")


def validate_events(rows: DataFrame, events: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """As ``validate_files`` for runs, keyed by ``started_at``.

    Equal rows are folded into one with a count, so rejects carry ``copies``. Of different
    rows with one key, the one that ended first is accepted, then by type and details.
    """
    key = ["started_at"]
    folded = _fold_copies(rows, event_reasons()).withColumn(
        "_id", F.sha2(F.to_json(F.struct(*rows.columns)), 256)
    )
    blank = F.lit("")
    order = F.struct(
        F.coalesce("ended_at", F.lit(0)), "type", F.coalesce("details", blank), F.col("_id")
    )
    firsts = _valid(folded).groupBy(*key).agg(F.min_by("_id", order).alias("_id"))
    return _unfold(_split_first(folded, key, ["_id"], firsts, events), rows.columns)


BUCKETS = 65536


def number_rows(rows: DataFrame, start: Column) -> DataFrame:
    """Gives each row a ``row_seq`` above ``start``: unique, and the same on every retry.

    (path, version_id) must be unique. Its digest picks one of 65,536 buckets; rows are
    counted within their bucket, and the numbers of the buckets interleave. So a path with
    very many versions is spread, and no task numbers the whole batch.
    """
    digest = F.md5(F.concat_ws("\x00", "path", "version_id"))
    bucket = F.conv(F.substring(digest, 1, 4), 16, 10).cast("long")
    in_bucket = Window.partitionBy("_bucket").orderBy("path", "version_id")
    return (
        rows.withColumn("_bucket", bucket)
        .withColumn("_n", F.row_number().over(in_bucket))
        .withColumn(
            "row_seq", start + (F.col("_n") - 1).cast("long") * BUCKETS + F.col("_bucket") + 1
        )
        .drop("_bucket", "_n")
    )


def high_water(catalog: DataFrame) -> Column:
    """The highest ``row_seq`` of a catalog as a scalar; 0 where it is empty."""
    return catalog.agg(F.coalesce(F.max("row_seq"), F.lit(0)).alias("row_seq")).scalar()


class Appended(NamedTuple):
    catalog: DataFrame
    accepted: DataFrame
    rejects: DataFrame


def append_versions(
    catalog: DataFrame,
    rows: DataFrame,
    row_seq: int | None = None,
    created_at: int | None = None,
    known: Callable[[DataFrame], DataFrame] | None = None,
    arrival: str | None = None,
) -> Appended:
    """Adds new versions: ``created_at`` is now, ``deleted_at`` null.

    ``row_seq`` is the last number in use, looked up in the catalog where not given. Rows
    that break a constraint or repeat a key come back as rejects, each with its reasons; of
    different rows with one new key, the oldest is accepted, or that of the lowest ``arrival``.
    ``known`` gives those of some keys that are stored; without it the catalog is asked.

    The rows are looked at once, with a partial step before the shuffle, for those accepted; only
    the rejects, where they are read, take a second look.
    """
    created = int(time.time()) if created_at is None else created_at
    start = high_water(catalog) if row_seq is None else F.lit(row_seq).cast("long")
    key = ["path", "version_id"]
    plain = [*key, "last_modified_at", "size", "sha256"]
    order = [*([arrival] if arrival else []), "last_modified_at", "size", "sha256"]
    columns = [*key, *order]
    reasons = _file_reasons(columns)
    valid = _valid(rows.select(*columns, reasons.alias("reasons")))
    firsts = valid.groupBy(*key).agg(F.min(F.struct(*order)).alias("lowest")).select(*key, "lowest.*")
    stored = _stored_keys(catalog, firsts, key) if known is None else known(firsts.select(*key))
    new = firsts.join(stored, key, "left_anti")
    accepted = (
        number_rows(new.select(*plain), start)
        .withColumn("created_at", F.lit(created).cast("long"))
        .withColumn("deleted_at", F.lit(None).cast("long"))
        .select(*FILES.names)
    )
    folded = _fold_copies(rows.select(*columns), reasons)
    _, rejects = _unfold(_flag_first(folded, columns, new), columns)
    rejects = rejects.select(*plain, "copies", "reasons")
    return Appended(catalog.unionByName(accepted, allowMissingColumns=True), accepted, rejects)


# Schema steps in order: (version, column, type).
STEPS = (
    (1, "created_at", "long"),
    (2, "deleted_at", "long"),
)


def current_schema_version(migrations: DataFrame) -> DataFrame:
    """The highest applied version, 0 where none is."""
    return migrations.agg(F.coalesce(F.max("version"), F.lit(0)).cast("long").alias("version"))


def upgrade_catalog(df: DataFrame, from_version: int = 0) -> DataFrame:
    """Applies the schema steps above ``from_version``, in order."""
    for version, column, type in STEPS:
        if version > from_version and column not in df.columns:
            df = df.withColumn(column, F.lit(None).cast(type))
    return df


def applied_steps(spark: SparkSession, from_version: int, applied_at: int) -> DataFrame:
    """Migration rows to append after ``upgrade_catalog``."""
    rows = [(version, applied_at) for version, *_ in STEPS if version > from_version]
    return spark.createDataFrame(rows, "version long, applied_at long")


def run_summary(
    changed: DataFrame,
    accepted: DataFrame,
    deleted: DataFrame,
    failed: DataFrame,
    started_at: int,
    ended_at: int,
) -> DataFrame:
    """One row of counters for a run."""
    parts = {"changed": changed, "inserted": accepted, "deleted": deleted, "failed": failed}
    counted = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
        for name, df in parts.items()
    ]
    rows = counted[0]
    for more in counted[1:]:
        rows = rows.unionAll(more)
    return rows.agg(
        *[F.sum(F.when(F.col("counter") == name, F.col("n"))).alias(name) for name in parts]
    ).withColumn("duration", F.lit(ended_at - started_at).cast("long"))
