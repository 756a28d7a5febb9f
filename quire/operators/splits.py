"""Repeatable splits keyed on ``md5(seed:doc_id)``.

``exact_split`` puts exactly ``ceil(n * frac)`` rows in the second part: the
rows with the smallest keys.  It never ranks the whole table in one task: a
bucket histogram on a key prefix (bounded, at most 16**prefix rows) locates
the bucket that holds the cut, only that bucket is ordered to find the cut
key, and the assignment itself is a narrow filter on the key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SEED = 777


def split_key(doc_col: str = "doc_id", seed: int = DEFAULT_SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(doc_col).cast("string")))


def key_bits(doc_col: str = "doc_id", seed: int = DEFAULT_SEED) -> Column:
    """The first 32 bits of the split key as a number."""
    return F.conv(F.substring(split_key(doc_col, seed), 1, 8), 16, 10).cast("long")


def hash_bucket(doc_col: str = "doc_id", seed: int = DEFAULT_SEED, buckets: int = 1000) -> Column:
    """Bucket 0..buckets-1 from the first 32 bits of the split key."""
    return (key_bits(doc_col, seed) % buckets).cast("int")


def hash_split(df: DataFrame, frac: float, seed: int = DEFAULT_SEED, doc_col: str = "doc_id",
               first: str = "train", second: str = "test", split_col: str = "split",
               where: Column | None = None) -> DataFrame:
    """Approximate split in one narrow pass: a row goes to ``second`` when the
    first 32 bits of its key are below ``frac * 2**32``.  Only rows matching
    ``where`` (default all) are reassigned."""
    to_second = key_bits(doc_col, seed) < math.ceil(frac * 2 ** 32)
    new = F.when(to_second, F.lit(second)).otherwise(F.lit(first))
    return _assign(df, new, split_col, where)


def _assign(df: DataFrame, new: Column, split_col: str, where: Column | None) -> DataFrame:
    if where is None:
        return df.withColumn(split_col, new)
    return df.withColumn(split_col, F.when(where, new).otherwise(F.col(split_col)))


def cut_key(df: DataFrame, frac: float, seed: int = DEFAULT_SEED, doc_col: str = "doc_id",
            where: Column | None = None, prefix: int = 4) -> str | None:
    """The largest key of the second part (``None`` when it is empty).

    Two small jobs: a histogram of key prefixes (at most ``16**prefix`` rows,
    cumulated in one task) locates the prefix bucket holding the cut; inside
    that bucket keys are counted (copies of a key collapse map-side) and
    cumulated to find the cut key.  Keys are expected to be unique per row.
    """
    rows = df if where is None else df.filter(where)
    keyed = rows.select(split_key(doc_col, seed).alias("k"))
    buckets = keyed.groupBy(F.substring("k", 1, prefix).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    w_all = Window.partitionBy()
    w_cum = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    cum = buckets.select("b", "c", F.sum("c").over(w_cum).alias("cum"), F.sum("c").over(w_all).alias("n"))
    cum = cum.withColumn("m", F.ceil(F.col("n") * F.lit(float(frac))).cast("long"))
    hit = cum.filter((F.col("cum") - F.col("c") < F.col("m")) & (F.col("m") <= F.col("cum"))).first()
    if hit is None:
        return None
    inside = int(hit["m"] - (hit["cum"] - hit["c"]))
    per_key = keyed.filter(F.substring("k", 1, prefix) == hit["b"]).groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    w_key = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    row = (per_key.select("k", F.sum("c").over(w_key).alias("cum")).filter(F.col("cum") >= inside)
           .agg(F.min("k").alias("k")).first())
    return row["k"]


def exact_split(df: DataFrame, frac: float, seed: int = DEFAULT_SEED, doc_col: str = "doc_id",
                first: str = "train", second: str = "test", split_col: str = "split",
                where: Column | None = None) -> DataFrame:
    """Seeded split with exactly ``ceil(n * frac)`` rows (of those matching
    ``where``) in ``second``.  Rows with the same id go together, so no document is in both
    parts: where ids repeat, ``second`` has the fewest whole ids that reach that number."""
    k = cut_key(df, frac, seed, doc_col, where)
    if k is None:
        new = F.lit(first)
    else:
        new = F.when(split_key(doc_col, seed) <= F.lit(k), F.lit(second)).otherwise(F.lit(first))
    return _assign(df, new, split_col, where)


def given_splits(df: DataFrame, parts: list[tuple[str, int]], seed: int = DEFAULT_SEED, doc_col: str = "doc_id",
                 split_col: str = "split") -> DataFrame:
    """Stand-in for corpora that ship pre-split: consecutive per-mille bucket
    ranges, e.g. ``[("train", 600), ("test", 200), ("dev", 200)]``."""
    b = hash_bucket(doc_col, seed)
    expr = None
    upper = 0
    for name, width in parts:
        upper += width
        cond = b < upper
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return df.withColumn(split_col, expr.otherwise(F.lit(parts[-1][0])))


# The split chains of each corpus, as (part split, second part, fraction, exact?).
RECIPES = {
    "news": [("train", "test", 0.2, True), ("train", "finetune", 0.2, True), ("finetune", "dev", 0.5, True)],
    "cases": [("dev", "finetune", 0.2, True)],
    "crisis": [("train", "test", 0.2, True), ("train", "dev", 0.2, True), ("dev", "finetune", 0.5, True)],
    "paragraph": [("train", "finetune", 0.2, False)],
    "flagged": [("train", "finetune", 0.2, True), ("finetune", "dev", 0.5, True)],
}

# Pre-split stand-ins (per mille) for corpora that come with their own parts.
GIVEN = {
    "cases": [("train", 600), ("test", 200), ("dev", 200)],
    "paragraph": [("train", 600), ("test", 200), ("validation", 200)],
    "flagged": [("train", 800), ("test", 200)],
}


def split_recipe(df: DataFrame, name: str, seed: int = DEFAULT_SEED, doc_col: str = "doc_id",
                 split_col: str = "split") -> DataFrame:
    """Apply a named chain of splits; the result has one ``split`` column.

    Corpora without given parts start all in ``train``; the ``cases``,
    ``paragraph`` and ``flagged`` recipes expect a ``split`` column and fall
    back to :data:`GIVEN` bucket ranges when it is absent.
    """
    if name not in RECIPES:
        raise ValueError(f"unknown recipe {name!r}; known: {sorted(RECIPES)}")
    if split_col not in df.columns:
        if name in GIVEN:
            df = given_splits(df, GIVEN[name], seed + 1, doc_col, split_col)
        else:
            df = df.withColumn(split_col, F.lit("train"))
    for part, second, frac, exact in RECIPES[name]:
        where = F.col(split_col) == part
        if exact:
            df = exact_split(df, frac, seed, doc_col, part, second, split_col, where)
        else:
            df = hash_split(df, frac, seed, doc_col, part, second, split_col, where)
    return df

