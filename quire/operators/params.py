"""Model parameters as tables, and model fusing by parameter averaging.

A parameter table holds one row per (model, parameter) with value columns; in
the linear text model the keys are ``(part, param)`` with ``part`` either
``body`` (one row per vocabulary term) or ``head`` (the class intercepts) and
the values are the class weights ``w_0 .. w_{k-1}``.  Generic tables (e.g. a
vector per model) use ``(pos)`` keys and one ``value`` column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.joins import broadcast_if_small

FUSED_ID = -1


def _group(df: DataFrame, group_cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if group_cols:
        return df, list(group_cols)
    return df.withColumn("__g", F.lit(0)), ["__g"]


def model_factors(params: DataFrame, model_col: str = "model_id", group_cols: Sequence[str] = (),
                  weights: DataFrame | Mapping | Sequence | None = None, apply_first_weight: bool = False,
                  models: DataFrame | None = None) -> DataFrame:
    """Multiplier of each model in the average: ``weight / n``.

    Models are ordered by id inside each fusing group; ``n`` is the number of
    models in the group.  As in the reference rule the first model's weight is
    ignored (factor ``1/n``) unless ``apply_first_weight``.  ``weights`` is a
    frame ``(model_col, weight)``, a dict, or a list in model order (its length
    must equal the number of models).  ``models`` (group and model columns) saves
    a pass over the parameters where the models are known from a smaller table.
    """
    params, g = _group(params if models is None else models, group_cols)
    models = params.select(*g, model_col).distinct()
    per_group = models.groupBy(*g).agg(F.min(model_col).alias("__first"), F.count(F.lit(1)).alias("__n"))
    f = models.join(per_group, g)
    if weights is None:
        f = f.withColumn("__w", F.lit(1.0))
    else:
        f = f.join(_weight_table(models, model_col, weights), model_col)
    first_w = F.col("__w") if apply_first_weight else F.lit(1.0)
    factor = F.when(F.col(model_col) == F.col("__first"), first_w).otherwise(F.col("__w")) / F.col("__n")
    return f.select(*g, model_col, factor.alias("__factor"))


def _weight_table(models: DataFrame, model_col: str, weights) -> DataFrame:
    """``(model_col, __w)``, one row per model; raises unless the weights name exactly the models."""
    ids = models.select(model_col).distinct()
    if isinstance(weights, DataFrame):
        w = weights.select(F.col(weights.columns[0]).alias(model_col), F.col(weights.columns[1]).cast("double").alias("__w"))
        odd = ids.withColumn("__m", F.lit(1)).join(w, model_col, "full").where("__m IS NULL OR __w IS NULL")
        if not odd.isEmpty():
            raise ValueError(f"no one-to-one weights for the models, e.g. {odd.first()[model_col]!r}")
        return w
    # compared before anything is collected: a list of weights bounds the number of models
    n = ids.count()
    if n != len(weights):
        raise ValueError(f"{len(weights)} weights for {n} models")
    names = [r[0] for r in ids.orderBy(model_col).collect()]
    if isinstance(weights, Mapping) and set(weights) != set(names):
        raise ValueError(f"weights for {sorted(weights)}, models {names}")
    pairs = [(m, float(weights[m])) for m in names] if isinstance(weights, Mapping) else list(zip(names, map(float, weights)))
    return F.broadcast(models.sparkSession.createDataFrame(pairs, f"{model_col} {dict(models.dtypes)[model_col]}, __w double"))


def average_models(params: DataFrame, key_cols: Sequence[str], value_cols: Sequence[str],
                   model_col: str = "model_id", group_cols: Sequence[str] = (), weights=None,
                   apply_first_weight: bool = False, factors_rows: int | None = None,
                   models: DataFrame | None = None) -> DataFrame:
    """Element-wise (weighted) mean of parameters over models, per group and key.

    ``sum(value * factor)`` is a partial aggregation: no model is held whole
    anywhere, and a hot key is combined map-side before the shuffle.
    """
    factors = model_factors(params, model_col, group_cols, weights, apply_first_weight, models)
    params, g = _group(params, group_cols)
    if factors_rows is not None:  # otherwise the planner decides, without a job to count
        factors = broadcast_if_small(factors, factors_rows, 48)
    joined = params.join(factors, [*g, model_col])
    out = joined.groupBy(*g, *key_cols).agg(*[F.sum(F.col(v) * F.col("__factor")).alias(v) for v in value_cols])
    return out.drop("__g") if not group_cols else out


BLOCK = 64


def to_blocks(models: DataFrame, vec_col: str, key_cols: Sequence[str], block: int = BLOCK) -> DataFrame:
    """``key_cols + [block, vals]``: each parameter tensor (an array) cut into blocks of ``block`` values."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(vec_col) - 1) / block).cast("int")), lambda i: F.struct(
        i.alias("block"), F.slice(vec_col, i * block + 1, F.lit(block)).cast("array<double>").alias("vals")))
    return models.where(F.size(vec_col) > 0).select(*key_cols, F.inline(cut))


def average_blocks(blocks: DataFrame, key_cols: Sequence[str] = (), model_col: str = "model_id", group_cols: Sequence[str] = (),
                   weights=None, apply_first_weight: bool = False, models: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """``average_models`` over real tensors: ``group + key_cols + [block, vals]``.

    A row is a block of values, so rows are fewer by the block size and nothing is exploded: the
    aggregator has one running sum per place of the block, combined map-side like any sum."""
    factors = model_factors(blocks, model_col, group_cols, weights, apply_first_weight, models)
    rows, g = _group(blocks, group_cols)
    joined = rows.join(factors, [*g, model_col])
    sums = [F.sum(F.get("vals", F.lit(i)) * F.col("__factor")).alias(f"__s{i}") for i in range(block)]
    out = joined.groupBy(*g, *key_cols, "block").agg(F.max(F.size("vals")).alias("__size"), *sums)
    told = out.select(*g, *key_cols, "block", F.slice(F.array(*[F.col(f"__s{i}") for i in range(block)]), F.lit(1), F.col("__size")).alias("vals"))
    return told.drop("__g") if not group_cols else told


def from_blocks(blocks: DataFrame, key_cols: Sequence[str], block: int = BLOCK) -> DataFrame:
    """``key_cols + [pos, value]``: one row per value, for readers of single parameters."""
    rows = blocks.select(*key_cols, "block", F.posexplode("vals").alias("__at", "value"))
    return rows.select(*key_cols, (F.col("block") * block + F.col("__at")).cast("int").alias("pos"), "value")


def check_compatible(params: DataFrame, key_cols: Sequence[str], model_col: str = "model_id",
                     group_cols: Sequence[str] = ()) -> DataFrame:
    """Parameter keys that some model of the group lacks: ``group + keys + [n_models, n_with_key]``.
    Empty when the models fit together."""
    params, g = _group(params, group_cols)
    n = params.select(*g, model_col).distinct().groupBy(*g).agg(F.count(F.lit(1)).alias("n_models"))
    have = params.groupBy(*g, *key_cols).agg(F.countDistinct(model_col).alias("n_with_key"))
    bad = have.join(n, g).filter(F.col("n_with_key") < F.col("n_models"))
    return bad.drop("__g") if not group_cols else bad


def assert_compatible(params: DataFrame, key_cols: Sequence[str], model_col: str = "model_id",
                      group_cols: Sequence[str] = ()) -> None:
    if not check_compatible(params, key_cols, model_col, group_cols).isEmpty():
        raise ValueError("parameters are missing in some models; only models with equal keys can be averaged")


def fuse_into(base: DataFrame, averaged: DataFrame, key_cols: Sequence[str], value_cols: Sequence[str],
              replace: Sequence[str] | None = ("body",), part_col: str = "part", model_col: str = "model_id",
              model_id: int = FUSED_ID) -> DataFrame:
    """Averaged values replace the base model's values; keys outside ``replace``
    parts (e.g. the classifier head) keep the base model's values."""
    avg = averaged.select(*key_cols, *[F.col(v).alias(f"__a_{v}") for v in value_cols])
    joined = base.drop(model_col).join(avg, list(key_cols), "left")
    if replace is None:
        use_avg = F.lit(True)
    else:
        use_avg = F.col(part_col).isin(list(replace))
    vals = [F.when(use_avg & F.col(f"__a_{v}").isNotNull(), F.col(f"__a_{v}")).otherwise(F.col(v)).alias(v)
            for v in value_cols]
    return joined.select(F.lit(model_id).cast("int").alias(model_col), *key_cols, *vals)


def fuse_models(base: DataFrame, models: DataFrame, k: int, weights=None, apply_first_weight: bool = False,
                model_id: int = FUSED_ID) -> DataFrame:
    """Linear text models: check keys, average the bodies, put them into ``base``."""
    w = [f"w_{c}" for c in range(k)]
    keys = ["part", "param", "param_id"]
    body = models.filter(F.col("part") == "body")
    assert_compatible(body, keys)
    avg = average_models(body, keys, w, weights=weights, apply_first_weight=apply_first_weight)
    return fuse_into(base, avg, keys, w, replace=("body",), model_id=model_id)


def write_params(params: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store a parameter table, one folder per model (readers prune by model).  ``overwrite`` replaces the
    folders of the models that ``params`` holds; all other models stored there stay."""
    params.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("model_id").parquet(path)


def read_params(spark, path: str, model_ids: Sequence[int] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if model_ids is not None:
        df = df.filter(F.col("model_id").isin(list(model_ids)))
    return df
