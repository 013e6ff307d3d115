"""Integer arithmetic on file, chunk and object sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalog_engine.schemas import CHUNK_SIZE, HEADER_SIZE, TAG_SIZE

MIB = 1024 * 1024

# Part size by object size (below the bound, in bytes).
PART_TIERS = (
    (16 * MIB, 5 * MIB),
    (100 * MIB, 8 * MIB),
    (1024 * MIB, 16 * MIB),
)
LARGEST_PART = 32 * MIB


def _div(numerator: Column, denominator: Column) -> Column:
    return F.call_function("div", numerator, denominator)


def _as_column(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("long")


def n_chunks(size: Column, chunk_size: Column | int = CHUNK_SIZE) -> Column:
    """Chunks of a file: at least one, exact in 64-bit integers."""
    chunks = _div(size - F.lit(1), _as_column(chunk_size)) + F.lit(1)
    return F.when(size > 0, chunks).otherwise(F.lit(1)).cast("long")


def sealed_size(size: Column, chunk_size: Column | int = CHUNK_SIZE) -> Column:
    """Container size: header, content and one tag per chunk."""
    return F.lit(HEADER_SIZE) + size + F.lit(TAG_SIZE) * n_chunks(size, chunk_size)


def upload_parts(size: Column) -> Column:
    """Struct of part size and part count for an upload of ``size`` bytes."""
    part = F.lit(LARGEST_PART)
    for bound, part_size in reversed(PART_TIERS):
        part = F.when(size < bound, F.lit(part_size)).otherwise(part)
    part = part.cast("long")
    return F.struct(part.alias("part_size"), n_chunks(size, part).alias("part_count"))
