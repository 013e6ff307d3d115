"""File content as rows of chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_engine.arrow import RowBatches
from catalog_engine.files import open_input
from catalog_engine.functions import n_chunks
from catalog_engine.schemas import CHUNK_SIZE

READ_SIZE = 8 * 1024 * 1024
# Content that one task reads, and reads again if it is lost.
TASK_BYTES = 256 * 1024 * 1024


#: Chunks whose numbers one array holds.
SEGMENT = 4_096


def number_chunks(files: DataFrame) -> DataFrame:
    """A row with its ``chunk_index`` for each of a row's ``n_chunks``.

    Segments come first and chunks within them second, so no row holds an array of all numbers.
    """
    zero = F.lit(0).cast("long")
    last = F.col("n_chunks") - 1
    segment = F.explode(F.sequence(zero, F.call_function("div", last, F.lit(SEGMENT))))
    start = F.col("_segment") * SEGMENT
    index = F.explode(F.sequence(start, F.least(last, start + (SEGMENT - 1))))
    return files.withColumn("_segment", segment).withColumn("chunk_index", index).drop("_segment")


def read_chunks(content: DataFrame, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Chunks of a binary ``content`` column; every other column goes along.

    Cell contents are limited to 2 GiB; larger files stay in storage (``read_file_chunks``).
    """
    others = [c for c in content.columns if c != "content"]
    size = F.length("content").cast("long")
    index = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1))
    start = (F.col("chunk_index") * chunk_size + 1).cast("int")
    # Generate and cut are fused by code generation: a content is not copied per chunk.
    return (
        content.withColumn("n_chunks", n_chunks(size, chunk_size))
        .select(*others, "content", "n_chunks", index.alias("chunk_index"))
        .select(
            *others,
            "chunk_index",
            "n_chunks",
            (F.col("chunk_index") == F.col("n_chunks") - 1).alias("is_last"),
            F.substring("content", start, F.lit(chunk_size)).alias("plaintext"),
        )
    )


def read_ranges(ranges: DataFrame, into: str, tasks: int | None = None) -> DataFrame:
    """Reads ``length`` bytes at ``offset`` of ``location`` into the binary column ``into``.

    The rows are dealt out evenly over ``tasks`` before they are read, so one long file is
    read by many of them. Bytes that cannot be read, or fewer than asked for, give null.
    """
    kept = [f for f in ranges.schema.fields if f.name not in ("offset", "length")]
    schema = T.StructType([*kept, T.StructField(into, T.BinaryType())])
    names = [f.name for f in kept]

    added = pa.schema([(into, pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = RowBatches(batch, names, added)
            where = [batch.column(n) for n in ("location", "offset", "length")]
            for i in range(batch.num_rows):
                location, offset, length = (c[i].as_py() for c in where)
                try:
                    with open_input(location) as file:
                        file.seek(offset)
                        piece = file.read(length)
                except OSError:
                    piece = None
                if piece is not None and len(piece) != length:
                    piece = None
                yield from out.add(i, piece)
            yield from out.rest()

    return ranges.repartition(tasks or _tasks(ranges)).mapInArrow(read, schema)


def _tasks(df: DataFrame) -> int:
    """Tasks for work on small rows that stand for much content: sizes tell nothing here."""
    spark = df.sparkSession
    parallel = spark.sparkContext.defaultParallelism
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * parallel)


def content_tasks(sizes: DataFrame, column: str) -> int:
    """Tasks for the content of a stored table of sizes: by bytes, and not fewer than ``_tasks``."""
    total = sizes.agg(F.sum(column)).first()[0] or 0
    return max(_tasks(sizes), -(-total // TASK_BYTES))


def read_file_chunks(
    files: DataFrame, chunk_size: int = CHUNK_SIZE, tasks: int | None = None
) -> DataFrame:
    """Chunks of files in storage, given as ``location`` and ``size``.

    The plan is made on metadata alone and the bytes are read last: headers and keys joined
    before this point never move content through a shuffle.
    """
    offset = F.col("chunk_index") * F.lit(chunk_size).cast("long")
    ranges = (
        number_chunks(files.withColumn("n_chunks", n_chunks(F.col("size"), chunk_size)))
        .withColumn("is_last", F.col("chunk_index") == F.col("n_chunks") - 1)
        .withColumn("offset", offset)
        .withColumn("length", F.least(F.lit(chunk_size).cast("long"), F.col("size") - offset))
    )
    return read_ranges(ranges, "plaintext", tasks)


def chunk_mark(index: Column, sha256: Column) -> Column:
    """A number for a chunk and its place; the sum over a file's chunks tells contents apart."""
    text = F.concat(index.cast("string"), F.lit(":"), sha256)
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")


def digest_files(
    files: DataFrame, tasks: int | None = None, chunk_size: int | None = None
) -> DataFrame:
    """Adds ``sha256`` of whole files in storage, null where one cannot be read.

    Each file is one stream of small reads; the files are dealt out over tasks. With
    ``chunk_size`` the same stream gives ``marks``, the sum of ``chunk_mark`` over its chunks.
    """
    names = files.columns
    added = [T.StructField("sha256", T.StringType())]
    if chunk_size:
        added.append(T.StructField("marks", T.StringType()))
    schema = T.StructType([*files.schema.fields, *added])

    def stream(file) -> tuple[str, str]:
        state, chunk, marks, index, held = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        while piece := file.read(min(READ_SIZE, (chunk_size or READ_SIZE) - held)):
            state.update(piece)
            chunk.update(piece)
            held += len(piece)
            if chunk_size is None:
                held = 0
            elif held == chunk_size:
                marks += mark(index, chunk.hexdigest())
                chunk, index, held = hashlib.sha256(), index + 1, 0
        if held or not index:
            marks += mark(index, chunk.hexdigest())
        return state.hexdigest(), str(marks)

    def mark(index: int, sha256: str) -> int:
        return int(hashlib.sha256(f"{index}:{sha256}".encode()).hexdigest()[:15], 16)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for location in batch.column("location").to_pylist():
                try:
                    with open_input(location) as file:
                        digests.append(stream(file))
                except OSError:
                    digests.append((None, None))
            columns = [pa.array([d[i] for d in digests], pa.string()) for i in range(len(added))]
            yield pa.record_batch(
                [*batch.columns, *columns], names=[*names, *(f.name for f in added)]
            )

    return files.repartition(tasks or _tasks(files)).mapInArrow(digest, schema)
