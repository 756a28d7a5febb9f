"""A bounded, repeatable sample: the rows with the smallest hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smallest(stored: DataFrame, n: int, hash_col: str = "h", ties: tuple[str, ...] = ()) -> DataFrame:
    """The ``n`` rows of a stored table with the smallest 64-bit ``hash_col`` (then ``ties``).

    The hash is uniform, so a bound that about ``2 * n`` rows stay below is known from the row count;
    only those are ordered, whatever the size of the table."""
    total = stored.count()
    if total > 4 * n:
        below = stored.where(F.col(hash_col) < -(1 << 63) + (1 << 64) * 2 * n // total)
        if below.count() >= n:
            stored = below
    return stored.orderBy(hash_col, *ties).limit(n)
