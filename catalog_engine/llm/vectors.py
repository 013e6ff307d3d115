"""Vectors of whole numbers from columns of floating-point arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def whole_rows(column: pa.Array, scale: int, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``floor(scale * x)`` of the vectors of a list column, ``x`` as double.

    Gives for each length the places in the column and a matrix of 64-bit numbers. Vectors that
    are null, or hold a null or non-finite component, are left out. A component of ``most`` or
    more is an error: sums of products would not be exact.
    """
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    if not len(rows):
        return []
    values = column.take(pa.array(rows))
    sizes = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = values.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    made = []
    for size in np.unique(sizes):
        of_size = np.flatnonzero(sizes == size)
        # A null component is NaN here.
        found = flat[starts[of_size][:, None] + np.arange(size)]
        good = np.isfinite(found).all(axis=1)
        if not good.any():
            continue
        scaled = np.floor(scale * found[good])
        if scaled.size and np.abs(scaled).max() >= most:
            raise ValueError(f"a component of {most / scale:g} or more leaves the exact range")
        made.append((rows[of_size[good]], scaled.astype(np.int64)))
    return made
