"""Reading, staging and mapping helpers that the operators of this package share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_engine.session import work_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Rows that a task turns into Python objects at a time.
STEP = 1024

#: What separates the words of the contracts.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Removes the shuffle files of a query when it has ended, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(frame: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage and shuffle files end there."""
    spark = frame.sparkSession
    path, before = work_dir(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(path)


def discard(*staged: DataFrame) -> None:
    """Removes tables that ``stage`` gave and that nothing reads any more."""
    for frame in staged:
        spark = frame.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


#: Bytes of rows that go to a Python worker at a time: with Spark's 64 MB, texts would come 10,000 at a time, and
#: buffers for as many would lie beside the heap and in every worker.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def show_library(spark: SparkSession) -> None:
    """Lets Python workers import this library where it is not installed (as in local mode), and sends them
    a few megabytes at a time, if the session sets no limit itself."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    known = spark.sparkContext.environment
    paths = known.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), ROOT])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where lambdas refer to it."""
    return F.transform(F.array(value), body)[0]


def map_rows(
    frame: DataFrame,
    columns: list[str],
    make: Callable[[], Callable[..., dict[str, list]]],
    schema: str,
    step: int = STEP,
) -> DataFrame:
    """Maps Arrow batches of ``columns``: ``make()`` once a task gives a function from their
    Python lists to lists of output columns, in the order of ``schema``; ``step`` rows a time."""
    target = frame.sparkSession.createDataFrame([], schema).schema
    show_library(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(target)
        apply = make()
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            out = apply(*(column.to_pylist() for column in batch.columns))
            arrays = [
                out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type)
                for f in fields
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=fields)

    return frame.select(*columns).mapInArrow(run, target)


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """Whether the row is in one of the ``parts`` folds by CRC-32 of its id as text."""
    return F.coalesce(
        F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False)
    )
