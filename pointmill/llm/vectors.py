"""Helpers of the operators on embeddings: vectors of Arrow columns as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scale of whole-number vectors.
SCALE = 256


def dimension(df: DataFrame, vec: str) -> int:
    """Entries of the longest vector, one at least; a shorter one is read as if zeros followed."""
    return max(1, int(df.agg(F.max(F.size(vec))).first()[0] or 1))


def matrix(column: pa.ListArray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector of finite entries only, and these vectors as rows of doubles."""
    sizes = np.array(column.value_lengths().fill_null(0))
    values = np.array(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), float)  # a null entry is not finite
    row = np.repeat(np.arange(len(column)), sizes)
    bad = np.bincount(row[~np.isfinite(values)], minlength=len(column)) > 0
    out = np.zeros((len(column), d))
    out[row, np.arange(row.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    ok = ~bad & np.array(column.is_valid())
    return ok, out[ok]


def whole_numbers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as 64-bit numbers; what is beyond them counts as the largest that a double tells apart."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def list_column(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
