"""Class-vector helpers.  Class scores are kept as k plain double columns
(``prefix_0 .. prefix_{k-1}``) so every step stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def names(prefix: str, k: int) -> list[str]:
    return [f"{prefix}_{c}" for c in range(k)]


def part_start(i: Column, n: Column, k: Column) -> Column:
    """0-based start of part ``i`` when ``n`` items are cut in ``k`` near-equal
    contiguous parts, the first ``n mod k`` parts one item longer."""
    return i * F.floor(n / k).cast("int") + F.least(i, n % k)


def part_len(i: Column, n: Column, k: Column) -> Column:
    return F.floor(n / k).cast("int") + F.when(i < n % k, 1).otherwise(0)


def part_index(p: Column, n: Column, k: Column) -> Column:
    """The part that holds item ``p`` (0-based) of ``n`` items cut in ``k`` near-equal parts."""
    short, longer = F.floor(n / k).cast("int"), n % k
    edge = longer * (short + 1)
    return F.when(p < edge, F.floor(p / (short + 1)).cast("int")).otherwise(
        longer + F.floor((p - edge) / F.greatest(short, F.lit(1))).cast("int"))


def softmax(cols: list[Column]) -> list[Column]:
    """Row-wise softmax over k columns, maximum subtracted first."""
    m = F.greatest(*cols) if len(cols) > 1 else cols[0]
    exps = [F.exp(c - m) for c in cols]
    total = exps[0]
    for e in exps[1:]:
        total = total + e
    return [e / total for e in exps]


def argmax_first(cols: list[Column]) -> Column:
    """Index of the largest column; the first one wins a tie."""
    values = F.array(*cols)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
