"""Label rules: derive a class label from list lengths, flags or text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def label_any_nonempty(*sizes) -> Column:
    """0 when every list is empty, else 1 (the corpus preparation rule).
    Arguments are list lengths (``F.size(arr)`` or counts)."""
    total = sum((_c(s) for s in sizes[1:]), _c(sizes[0]))
    return F.when(total == 0, 0).otherwise(1).cast("int")


def label_all_nonempty(*sizes) -> Column:
    """1 ("violated") only when every list is non-empty (the statistics rule)."""
    cond = None
    for s in sizes:
        t = _c(s) > 0
        cond = t if cond is None else (cond & t)
    return F.when(cond, 1).otherwise(0).cast("int")


def label_from_rationales(size) -> Column:
    """1 when the rationale list is non-empty, else 0."""
    return (_c(size) > 0).cast("int")


def label_from_conclusion(conclusion, word: str = "inadmissible") -> Column:
    """0 (non-violation) when the conclusion reads ``word`` in any case, else 1."""
    return F.when(F.lower(_c(conclusion)) == F.lit(word.lower()), 0).otherwise(1).cast("int")


def rename_cast_label(df: DataFrame, src: str = "label", dst: str = "labels", to: str | None = "string") -> DataFrame:
    """Rename the target column and optionally cast it (e.g. to string for text targets)."""
    col = F.col(src).cast(to) if to else F.col(src)
    return df.withColumn(dst, col).drop(src) if src != dst else df.withColumn(dst, col)
