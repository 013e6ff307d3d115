"""Catalog rows and walked paths arriving as a stream."""

from __future__ import annotations

import time
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_engine.operators.diff import detect_deletion_stamps
from catalog_engine.operators.events import event_row
from catalog_engine.operators.maintenance import append_versions, run_summary
from catalog_engine.schemas import INVENTORY, NEW_FILES
from catalog_engine.sources.catalog import by_path, by_place, last_row_seq, mark_of, read_catalog, state_before
from catalog_engine.sources.key_filter import TABLE, filter_of, known_keys
from catalog_engine.sources.runs import Run, run_folder

_ARRIVING = T.StructType(
    [T.StructField(f.name, f.dataType) for f in NEW_FILES.fields] + [T.StructField("batch", T.LongType())]
)


class IngestResult(NamedTuple):
    catalog: DataFrame
    summary: DataFrame
    rejects: DataFrame


def ingest_stream(
    stream: DataFrame,
    catalog_path: str,
    dirs: Sequence[str],
    now: int,
    profile: str = "default",
    details: str | None = None,
    ended_at: int | None = None,
    checkpoint: str | None = None,
    match: str = "like",
) -> IngestResult:
    """Drains a stream of walked files into a stored catalog, then stamps what is gone.

    Every row (path, version_id, sha256, size, last_modified_at) is a path the walk saw; one
    with a ``version_id`` is a new version as well. A micro-batch is only written, to a folder of
    its own, so its time does not depend on the catalog, and one that is repeated after a failure
    replaces itself. What arrived is tested against the key filters of the store once, after the
    stream has ended well: earlier batches come first. Then deletions are looked for, and the run is
    committed; before that readers see nothing of it. A failed query raises before all this.
    """
    spark = stream.sparkSession
    run = Run(spark, catalog_path, profile, now, "backup")
    before, _ = state_before(run, None, None)
    run.begin()
    walked = run_folder(catalog_path, "walked", profile, now)

    def store(rows: DataFrame, batch: int) -> None:
        numbered = rows.withColumn("batch", F.lit(batch).cast("long")).select(*_ARRIVING.names)
        numbered.write.mode("overwrite").parquet(f"{walked}/batch-{batch}")

    query = (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint or f"{catalog_path}/progress/{profile}-{now}")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()

    def known(keys: DataFrame) -> DataFrame:
        return known_keys(spark, catalog_path, profile, keys, now)

    ended = int(time.time()) if ended_at is None else ended_at
    try:
        arrived = spark.read.schema(_ARRIVING).option("recursiveFileLookup", "true").parquet(walked)
    except AnalysisException as error:
        # A stream without a row has no micro-batch.
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        arrived = spark.createDataFrame([], _ARRIVING)
    inventory = arrived.select(*INVENTORY.names)
    start = last_row_seq(spark, catalog_path, profile, before_run=now)
    appended = append_versions(
        before, arrived.where("version_id is not null"), start, ended_at, known, arrival="batch"
    )
    inserted = run.keep(by_path(appended.accepted), "versions")
    run.keep(mark_of(inserted), "marks")
    run.keep(filter_of(inserted), TABLE)
    rejects = run.keep(appended.rejects.select("path", "version_id", "reasons"), "rejects")
    now_stored = before.unionByName(inserted)
    stamps = run.keep(by_place(detect_deletion_stamps(now_stored, inventory, dirs, ended, match)), "deletions")
    ended = run.keep(event_row(spark, "backup", now, ended, details, ended), "events").first().ended_at
    run.commit()
    summary = run_summary(inventory, inserted, stamps, rejects, now, ended)
    return IngestResult(read_catalog(spark, catalog_path, profile), summary, rejects)
