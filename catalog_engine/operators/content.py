"""Sealing, opening and hashing of file content, one row per chunk."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_engine.functions import n_chunks
from catalog_engine.schemas import (
    ARGON_MEMORY_KIB,
    ARGON_THREADS,
    ARGON_TIME,
    CHUNK_KEY,
    CHUNK_SIZE,
    FORMAT_VERSION,
    MAGIC_SIZE,
    NONCE_PREFIX_SIZE,
    NONCE_SIZE,
    SALT_SIZE,
)

ID_SIZE = 16

# Chunks of one file that may meet one parameter row in a join: 16 GiB at the default size.
SEGMENT = 1024


def big_endian(value: Column, width: int) -> Column:
    """An integer column as ``width`` bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * width, "0"))


def magic_bytes(magic: str) -> Column:
    if len(magic.encode()) != MAGIC_SIZE:
        raise ValueError(f"a container tag has {MAGIC_SIZE} bytes")
    return F.lit(magic).cast("binary")


@F.pandas_udf(T.BinaryType())
def _draw(seed: pd.Series) -> pd.Series:
    return pd.Series([os.urandom(SALT_SIZE + NONCE_PREFIX_SIZE + ID_SIZE) for _ in seed])


_draw = _draw.asNondeterministic()


def plan_headers(files: DataFrame, magic: str, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """One container header per new version; other columns go along.

    Salt and nonce prefix, and the version id, are drawn at random unless ``files`` brings
    them. Drawn ones change when a task runs again, so write the result before it is used
    (``backup_run`` does).
    """
    drawn = {
        "salt": F.substring("_draw", 1, SALT_SIZE),
        "nonce_prefix": F.substring("_draw", SALT_SIZE + 1, NONCE_PREFIX_SIZE),
        "version_id": F.lower(F.hex(F.substring("_draw", SALT_SIZE + NONCE_PREFIX_SIZE + 1, ID_SIZE))),
    }
    missing = {name: value for name, value in drawn.items() if name not in files.columns}
    if missing:
        files = files.withColumn("_draw", _draw(F.col("size"))).withColumns(missing).drop("_draw")
    values = {
        "argon_time": F.lit(ARGON_TIME),
        "argon_memory_kib": F.lit(ARGON_MEMORY_KIB).cast("long"),
        "argon_threads": F.lit(ARGON_THREADS),
        "chunk_size": F.lit(chunk_size).cast("long"),
    }
    header = F.concat(
        magic_bytes(magic),
        big_endian(F.lit(FORMAT_VERSION), 1),
        F.col("salt"),
        big_endian(values["argon_time"], 4),
        big_endian(values["argon_memory_kib"], 4),
        big_endian(values["argon_threads"], 1),
        F.col("nonce_prefix"),
        big_endian(values["chunk_size"], 4),
    )
    return files.select(
        "*",
        n_chunks(F.col("size"), chunk_size).alias("n_chunks"),
        *[value.alias(name) for name, value in values.items()],
        header.alias("header"),
    )


def chunk_nonce() -> Column:
    """Nonce prefix, chunk index and last-chunk flag as 12 bytes."""
    return F.concat(
        F.col("nonce_prefix"),
        big_endian(F.col("chunk_index"), 4),
        big_endian(F.col("is_last").cast("int"), 1),
    )


def _with_params(chunks: DataFrame, headers: DataFrame | None, keys: DataFrame | None) -> DataFrame:
    """Chunks with ``n_chunks``, ``header``, ``nonce_prefix`` and ``key``, if not there yet.

    The join key holds a segment number, one per 1,024 chunks, and a file's parameters are
    repeated for each of its segments: a file with a third of all chunks spreads over many
    tasks. Chunks without parameters stay, with nulls.

    Content that got its parameters per file, before it was split, needs no join here.
    """
    if headers is None and keys is None:
        return chunks
    chunks = chunks.withColumn(
        "_segment", F.call_function("div", F.col("chunk_index"), F.lit(SEGMENT))
    )
    if headers is not None:
        chunks = chunks.drop("n_chunks")
        last = F.call_function("div", F.col("n_chunks") - 1, F.lit(SEGMENT))
        params = headers.select(
            *CHUNK_KEY,
            "n_chunks",
            "nonce_prefix",
            "header",
            F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_segment"),
        )
    else:
        params = chunks.select(*CHUNK_KEY, "_segment").distinct()
    if keys is not None:
        params = params.join(keys.select(*CHUNK_KEY, "key"), CHUNK_KEY, "left")
    return chunks.join(params, [*CHUNK_KEY, "_segment"], "left").drop("_segment")


def chunk_nonces(chunks: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Adds the ``nonce`` of each chunk."""
    return _with_params(chunks, headers, None).withColumn("nonce", chunk_nonce())


def sealed_payload() -> Column:
    """AES-256-GCM of ``plaintext`` with the header as additional data: ciphertext and tag."""
    sealed = F.aes_encrypt(
        F.col("plaintext"),
        F.col("key"),
        F.lit("GCM"),
        F.lit("DEFAULT"),
        chunk_nonce(),
        F.col("header"),
    )
    # The built-in puts the nonce first; a container does not store it.
    return F.substring(sealed, F.lit(NONCE_SIZE + 1), F.length(sealed))


def opened_payload() -> Column:
    """The plaintext of ``payload``, null where it does not authenticate."""
    return F.try_aes_decrypt(
        F.concat(chunk_nonce(), F.col("payload")),
        F.col("key"),
        F.lit("GCM"),
        F.lit("DEFAULT"),
        F.col("header"),
    )


def seal_chunks(
    chunks: DataFrame, headers: DataFrame | None = None, keys: DataFrame | None = None
) -> DataFrame:
    """Encrypts each chunk; ``payload`` is null where a file has no header or key.

    ``chunk_sha256`` is kept beside it so that sealed data can be verified chunk by chunk.
    Pass no ``headers`` or ``keys`` if the chunks carry those columns.
    """
    return _with_params(chunks, headers, keys).select(
        *CHUNK_KEY,
        "chunk_index",
        "n_chunks",
        "is_last",
        sealed_payload().alias("payload"),
        F.sha2("plaintext", 256).alias("chunk_sha256"),
    )


def open_chunks(
    sealed: DataFrame, headers: DataFrame | None = None, keys: DataFrame | None = None
) -> DataFrame:
    """Authenticates and decrypts; ``plaintext`` is null where a chunk fails."""
    opened = _with_params(sealed, headers, keys).withColumn("plaintext", opened_payload())
    return opened.drop("payload", "key", "header", "nonce_prefix")


def _rolling_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over runs of rows sorted by file and chunk; a gap or a null gives null.

    Holds one batch and one hash state, however long a file is.
    """
    names = ["path", "version_id", "size", "sha256"]
    current = None
    state, size, seen, expected, whole = None, 0, 0, 0, False

    def result() -> pa.RecordBatch:
        digest = state.hexdigest() if whole and seen == expected else None
        row = [[current[0]], [current[1]], [size], [digest]]
        types = [pa.string(), pa.string(), pa.int64(), pa.string()]
        return pa.record_batch([pa.array(v, t) for v, t in zip(row, types)], names=names)

    for batch in batches:
        columns = [batch.column(n) for n in ("path", "version_id", "chunk_index", "n_chunks")]
        content = batch.column("plaintext")
        for i in range(batch.num_rows):
            path, version, index, count = (c[i].as_py() for c in columns)
            if (path, version) != current:
                if current is not None:
                    yield result()
                current = (path, version)
                state, size, seen, expected, whole = hashlib.sha256(), 0, 0, count, True
            piece = content[i]
            if not piece.is_valid or index != seen or count != expected:
                whole = False
            else:
                state.update(piece.as_buffer())
                size += len(piece.as_buffer())
            seen += 1
    if current is not None:
        yield result()


def file_digests(chunks: DataFrame) -> DataFrame:
    """SHA-256 and size of each file over its chunks in order.

    ``sha256`` is null for a file with a chunk missing, repeated or unopened. Files of one
    chunk are hashed where they lie and only their digests are shuffled. The chunks of larger
    files are brought together and hashed as a stream; a digest is sequential, so the task
    of a file runs as long as the file is, in the memory of one Arrow batch.
    """
    chunks = chunks.select(*CHUNK_KEY, "chunk_index", "n_chunks", "plaintext")
    single = F.coalesce(F.col("n_chunks") <= 1, F.lit(False))
    whole = (F.col("rows") == 1) & (F.col("chunk_index") == 0)
    small = (
        chunks.where(single)
        .select(
            *CHUNK_KEY,
            "chunk_index",
            F.length("plaintext").cast("long").alias("size"),
            F.sha2("plaintext", 256).alias("sha256"),
        )
        .groupBy(*CHUNK_KEY)
        .agg(
            F.count("*").alias("rows"),
            F.max("chunk_index").alias("chunk_index"),
            F.sum("size").alias("size"),
            F.min("sha256").alias("sha256"),
        )
        .select(*CHUNK_KEY, F.coalesce("size", F.lit(0)).alias("size"), F.when(whole, F.col("sha256")).alias("sha256"))
    )
    large = (
        chunks.where(~single)
        .repartition(*CHUNK_KEY)
        .sortWithinPartitions(*CHUNK_KEY, "chunk_index")
        .mapInArrow(_rolling_digests, "path string, version_id string, size long, sha256 string")
    )
    return small.unionByName(large)


def verify_sealed(
    sealed: DataFrame,
    headers: DataFrame | None = None,
    keys: DataFrame | None = None,
    digests: DataFrame | None = None,
) -> DataFrame:
    """Opens what was just sealed and compares it: one row per file with its ``status``.

    With ``digests`` (path, version_id, sha256) whole files are compared. Without, each
    chunk is held against its ``chunk_sha256``: no content is shuffled and a file of any
    length is checked in parallel.
    """
    opened = open_chunks(sealed, headers, keys)
    if digests is not None:
        expected = digests.select(*CHUNK_KEY, F.col("sha256").alias("expected"))
        return (
            file_digests(opened)
            .join(expected, CHUNK_KEY, "full")
            .select(
                *CHUNK_KEY,
                F.when(F.col("expected").isNull(), F.lit("missing"))
                .when(F.col("sha256").eqNullSafe(F.col("expected")), F.lit("ok"))
                .otherwise(F.lit("mismatch"))
                .alias("status"),
            )
        )
    good = F.coalesce(F.sha2("plaintext", 256) == F.col("chunk_sha256"), F.lit(False))
    return (
        opened.select(*CHUNK_KEY, "chunk_index", "n_chunks", good.alias("good"))
        .groupBy(*CHUNK_KEY, "chunk_index")
        .agg(F.max("n_chunks").alias("n_chunks"), F.count("*").alias("rows"), F.min("good").alias("good"))
        .groupBy(*CHUNK_KEY)
        .agg(
            F.min(F.col("good") & (F.col("rows") == 1)).alias("good"),
            F.count("*").alias("seen"),
            F.max("chunk_index").alias("last"),
            F.max("n_chunks").alias("n_chunks"),
        )
        .select(
            *CHUNK_KEY,
            F.when(
                F.col("good")
                & (F.col("seen") == F.col("n_chunks"))
                & (F.col("last") == F.col("n_chunks") - 1),
                F.lit("ok"),
            )
            .otherwise(F.lit("mismatch"))
            .alias("status"),
        )
    )
