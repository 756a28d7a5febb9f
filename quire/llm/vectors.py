"""Vectors as whole numbers: the part of an embeddings table that search and whitening work on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1024
LARGEST = 2.0 ** 43  # entries from here on have no exact floor(1024 * c) in a double


def usable(vec: Column) -> Column:
    """True where the vector is there, has entries, and all of them are numbers below 2 ** 43."""
    ok = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    return vec.isNotNull() & (F.size(vec) > 0) & ok


def usable_rows(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id (long), vec (array of double) of the usable rows."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("vec")).where(usable(F.col("vec")))


def matrix(vec: pa.Array) -> np.ndarray:
    """(rows, longest) array of floor(1024 * c); shorter vectors are filled with zeros."""
    flat = np.floor(vec.flatten().to_numpy(zero_copy_only=False) * SCALE)
    n = np.diff(vec.offsets.to_numpy())
    if len(n) and (n == n[0]).all():
        return flat.reshape(len(n), n[0])
    out = np.zeros((len(n), n.max(initial=0)))
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out
