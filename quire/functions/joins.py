"""Size-checked broadcast: a side is broadcast only when its size is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Row and byte limits above which a side is joined by shuffle instead of broadcast.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 256 * 1024 * 1024


def fits_broadcast(rows: int, row_bytes: float = 64) -> bool:
    return rows <= BROADCAST_MAX_ROWS and rows * row_bytes <= BROADCAST_MAX_BYTES


def measure(df: DataFrame, *string_cols: str) -> tuple[int, float]:
    """(rows, bytes per row): counted, with the real lengths of the string columns and
    eight bytes for each other column.  Term lengths have no bound of their own."""
    text = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in string_cols]
    rows, *lengths = df.agg(F.count(F.lit(1)), *text).first()
    fixed = 16 + 8 * len(df.columns) + 16 * len(string_cols)
    return rows, fixed + (sum(lengths) / rows if rows else 0)


def broadcast_if_small(df: DataFrame, rows: int | None = None, row_bytes: float | None = None) -> DataFrame:
    """Broadcast ``df`` when ``rows`` times ``row_bytes`` stays under the limits;
    otherwise return it unchanged so the planner uses a shuffle join (AQE splits
    skewed keys of the big side).  What the caller doesn't know is measured."""
    if rows is None or row_bytes is None:
        counted, measured = measure(df, *[f.name for f in df.schema.fields if f.dataType.simpleString() == "string"])
        rows, row_bytes = counted if rows is None else rows, measured if row_bytes is None else row_bytes
    return F.broadcast(df) if fits_broadcast(rows, row_bytes) else df
