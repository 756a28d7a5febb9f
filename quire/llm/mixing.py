"""Mixing sources to target weights by hash-threshold histograms.

Every source gets a target number of words: its weight's share of the budget, at most
``max_repeat`` times what it has, the excess shared again by weight until nobody is above.
A source that must give ``target = whole * size + rest`` words gives every document ``whole``
times and, once more, the documents whose hash lies below a threshold.  The threshold comes
from histograms, not from a sort: words are summed by (source, hash bucket), the running sums
of the buckets (a bounded number per source) show which bucket the budget ends in, and only
that boundary bucket is split by the next hash digits, level by level.  What is left is a filter.

The hash is the first 60 bits of MD5 over the document id, so reruns and other engines agree.

Defined results: null and empty texts have size 0 and take nothing; a null source is a source
of its own, after all others; documents with equal ids share a hash and are taken together;
a null id counts as the empty string for the hash; an empty table gives an empty result, and a
table without a word gives targets of 0.  ``mix_sizes`` reads only id, source and text;
``mixed`` returns the input columns whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.ranking import global_row_number
from quire.llm.text import words_of
from quire.session import cut_lineage

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
HEX_DIGITS = 15          # of the hash: 60 bits
DIGITS_PER_LEVEL = 3     # 4096 buckets per source and level


def n_words(col: Column) -> Column:
    return F.size(words_of(col)).cast("long")


def hash_of(col: Column) -> Column:
    return F.substring(F.md5(F.coalesce(col.cast("string"), F.lit(""))), 1, HEX_DIGITS)


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, share: float = 1.0) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    ``sizes`` has source and size.  Sources are numbered in a distributed way; the sharing
    loop moves only two sums per round to the driver."""
    per_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    known = global_row_number(per_source.where("source IS NOT NULL").select("source", "source_size"), "source", "rn")
    n_known = F.lit(known.count())
    numbered = known.unionByName(per_source.where("source IS NULL").withColumn("rn", (n_known + 1).cast("long")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rn") - 1) % len(weights) + 1).cast("int"))
    state = cut_lineage(numbered.select("source", "source_size", weight.cast("long").alias("weight"), F.lit(False).alias("capped")))
    total = state.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    budget = int(total * share)
    while True:
        left, by_weight = state.agg(
            F.lit(budget) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size") * max_repeat)), F.lit(0)),
            F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))), F.lit(0))).first()
        # weight * left / by_weight > max_repeat * source_size, in whole numbers
        over = ~F.col("capped") & (F.col("weight").cast("decimal(38,0)") * F.lit(left)
                                   > F.col("source_size").cast("decimal(38,0)") * F.lit(max_repeat * max(by_weight, 1)))
        if by_weight == 0 or state.where(over).isEmpty():
            break
        state = cut_lineage(state.withColumn("capped", F.col("capped") | over))
    share_of = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(max(by_weight, 1)))
    target = F.when(F.col("capped"), (F.col("source_size") * max_repeat).cast("double")).otherwise(share_of)
    return cut_lineage(state.select("source", "source_size", "weight", target.alias("target")))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source: whole, upto - take every document ``whole`` times, and once more
    where its hash is below ``upto`` (a hex string of the hash's length, or null for none).

    ``sizes`` has source, size, hash.  Per level one sum over the boundary buckets' documents
    only; at most ``16 ** DIGITS_PER_LEVEL`` rows per source reach the running sums."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = cut_lineage(targets.select(
        "source", whole.cast("long").alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("rest"),
        F.lit("").alias("prefix")))
    for level in range(HEX_DIGITS // DIGITS_PER_LEVEL):
        at, n = level * DIGITS_PER_LEVEL, DIGITS_PER_LEVEL
        inside = sizes.alias("d").join(
            state.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))
            & (F.substring("d.hash", 1, at) == F.col("s.prefix")) & (F.col("s.rest") > 0))
        hist = inside.groupBy("s.source", "s.whole", "s.rest", "s.prefix", F.substring("d.hash", at + 1, n).alias("digits")).agg(
            F.sum("d.size").alias("words"))
        w = Window.partitionBy("source").orderBy("digits")
        running = hist.withColumn("upto", F.sum("words").over(w))
        # The boundary bucket is the first one whose running sum passes the rest; without one, all are taken.
        cut = (running.where(F.col("upto") > F.col("rest")).groupBy("source").agg(
            F.min(F.struct("digits", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"), "words")).alias("b")))
        state = cut_lineage(
            state.alias("s").join(cut.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")), "left").select(
                "s.source", "s.whole", F.coalesce("c.b.rest", F.lit(0.0)).alias("rest"),
                F.when(F.col("c.b").isNotNull(), F.concat("s.prefix", "c.b.digits"))
                .when(F.col("s.rest") > 0, F.concat("s.prefix", F.lit("g"))).otherwise(F.col("s.prefix")).alias("prefix"),
                F.coalesce("c.b.words", F.lit(0)).alias("words")))
    # The last bucket holds one hash value: take it when that comes nearer to the target.
    nearer = (F.length("prefix") == HEX_DIGITS) & (2 * F.col("rest") > F.col("words"))
    return state.select("source", "whole", F.when(nearer, F.concat("prefix", F.lit("g"))).otherwise(F.col("prefix")).alias("upto"))


def mix_sizes(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
              weights=WEIGHTS, max_repeat: int = MAX_REPEAT, share: float = 1.0) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken (= copies * size).

    The slim table (id, source, size, hash) is written once; texts are read only for it."""
    slim = cut_lineage(df.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"),
        hash_of(F.col(id_col)).alias("hash")))
    return mix(slim, weights, max_repeat, share)


def mix(slim: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, share: float = 1.0) -> DataFrame:
    """``mix_sizes`` over a stored table of id, source, size, hash."""
    targets = source_targets(slim, weights, max_repeat, share)
    cuts = thresholds(slim, targets)
    per_source = targets.alias("t").join(cuts.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source"))).select(
        "t.source", "t.source_size", "t.target", "c.whole", "c.upto")
    copies = F.col("p.whole") + F.when(F.col("d.hash") < F.col("p.upto"), 1).otherwise(0)
    return slim.alias("d").join(per_source.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select(
        "d.id", "d.source", "d.size", "p.source_size", "p.target", copies.cast("long").alias("copies"),
        (copies * F.col("d.size")).cast("long").alias("taken"))


def mixed(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
          weights=WEIGHTS, max_repeat: int = MAX_REPEAT, share: float = 1.0) -> DataFrame:
    """The mix itself: the rows of ``df``, each as many times as the mix takes it.

    A row's number of copies follows from its own source and hash, so the rows meet only the
    small table of thresholds, never each other.  A document without a word, which adds
    nothing to any budget, follows its source's thresholds like the others."""
    slim = cut_lineage(df.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"),
        hash_of(F.col(id_col)).alias("hash")))
    cuts = thresholds(slim, source_targets(slim, weights, max_repeat, share)).select(
        F.col("source").alias("__source"), F.col("whole").alias("__whole"), F.col("upto").alias("__upto"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                     F.col(source_col).cast("string").alias("__s"), hash_of(F.col(id_col)).alias("__hash"))
    copies = F.col("__whole") + F.when(F.col("__hash") < F.col("__upto"), 1).otherwise(0)
    with_copies = rows.join(cuts, F.col("__s").eqNullSafe(F.col("__source"))).withColumn("__copies", copies.cast("int"))
    return (with_copies.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
            .select("row.*"))


def q_mixing(spark, sf_dir) -> DataFrame:
    from quire.session import table

    m = mix_sizes(table(spark, sf_dir, "documents"))
    return m.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


SQL_MIXING = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS h
  FROM documents
), s AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source
), w AS (
  SELECT source, source_size, rn, CASE (rn - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), order_of_cap AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, rn) AS k FROM w
), run AS (
  SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_before,
    sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left,
    sum(source_size) OVER () AS total
  FROM order_of_cap
), first_free AS (
  SELECT min(k) AS k FROM run WHERE weight * (total - capped_before) <= 3 * source_size * weight_left
), t AS (
  SELECT source, rn, source_size, CASE WHEN run.k < f.k THEN CAST(3 * source_size AS DOUBLE)
    ELSE CAST(weight * (SELECT total - capped_before FROM run, first_free WHERE run.k = first_free.k) AS DOUBLE)
      / CAST((SELECT weight_left FROM run, first_free WHERE run.k = first_free.k) AS DOUBLE) END AS target
  FROM run, first_free f
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), e AS (
  SELECT d.doc_id, d.size, d.h, p.rn, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY rn ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
    sum(size) OVER (PARTITION BY rn, h) AS same_hash
  FROM e
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(size * (whole + CASE WHEN rest > 0 AND (upto <= rest OR 2 * (rest - (upto - same_hash)) > same_hash) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
