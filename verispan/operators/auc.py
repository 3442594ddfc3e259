"""Exact, tie-aware, weighted ROC-AUC, and what is built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import is_finite

#: Ranges of scores that a large group is cut into.
RANGES = 32


def roc_auc(rows: DataFrame, by: list[str], label: str = "label", score: str = "score", weight: str | None = None, ranges: int = RANGES) -> DataFrame:
    """(by..., auc, n_positive, n_negative): the chance that a positive scores above a negative, ties half.

    Rows with a null label, a non-finite score or weight, or a weight of 0 or less don't count. A group
    with one class has a null auc. Scores are summed up by value first (with map-side partial sums).
    Cumulative weights then take two levels: within ranges of scores, cut at approximate
    quantiles, and over the ranges of a group, so that no task sorts a whole group.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    kept = rows.select(*by, F.col(label).alias("_y"), F.col(score).cast("double").alias("_s"), w.alias("_w"))
    kept = kept.where(F.col("_y").isNotNull() & is_finite("_s") & is_finite("_w") & (F.col("_w") > 0))
    sums = kept.groupBy(*by, "_s").agg(F.sum(F.when(F.col("_y") == 1, F.col("_w")).otherwise(0.0)).alias("_p"), F.sum(F.when(F.col("_y") == 1, 0.0).otherwise(F.col("_w"))).alias("_n"))
    if ranges > 1:
        cuts = sums.groupBy(*by).agg(F.percentile_approx("_s", [k / ranges for k in range(1, ranges)], 1000).alias("_cuts"))
        joined = sums.join(cuts, by) if by else sums.crossJoin(F.broadcast(cuts))
        sums = joined.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_s")))).drop("_cuts")
        inner = W.partitionBy(*by, "_range").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
        parts = sums.withColumn("_before", F.coalesce(F.sum("_n").over(inner), F.lit(0.0)))
        parts = parts.groupBy(*by, "_range").agg(F.sum(F.col("_p") * (F.col("_before") + F.col("_n") / 2)).alias("_u"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
        outer = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
        parts = parts.withColumn("_u", F.col("_u") + F.col("_p") * F.coalesce(F.sum("_n").over(outer), F.lit(0.0)))
    else:
        inner = W.partitionBy(*by).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
        parts = sums.withColumn("_u", F.col("_p") * (F.coalesce(F.sum("_n").over(inner), F.lit(0.0)) + F.col("_n") / 2))
    whole = parts.groupBy(*by).agg(F.sum("_u").alias("_u"), F.sum("_p").alias("n_positive"), F.sum("_n").alias("n_negative"))
    area = F.when((F.col("n_positive") > 0) & (F.col("n_negative") > 0), F.col("_u") / (F.col("n_positive") * F.col("n_negative")))
    return whole.select(*by, area.alias("auc"), "n_positive", "n_negative")


def strict_mean(value: Column | str, groups: int) -> Column:
    """The mean of a value over its group, null unless all ``groups`` rows are there and defined."""
    return F.when(F.count(value) == groups, F.avg(value))


def feature_auc(rows: DataFrame, features: list[str], label: str, by: list[str], inverse: bool = False, ranges: int = RANGES) -> DataFrame:
    """(by..., feature, auc): the AUC of many columns in one pass over their long form."""
    long = rows.select(*by, label, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(k).alias("input_order"), F.col(f).cast("double").alias("value")) for k, f in enumerate(features)])))
    signed = long.withColumn("value", -F.col("value") if inverse else F.col("value"))
    return roc_auc(signed, [*by, "feature", "input_order"], label, "value", ranges=ranges)


def rank_features(rows: DataFrame, features: list[str], label: str, inverse: bool = False) -> DataFrame:
    """(rank, feature, auc): by AUC downwards, undefined last, ties in input order. One row a feature."""
    found = feature_auc(rows, features, label, [], inverse)
    order = W.orderBy(F.col("auc").desc_nulls_last(), "input_order", "feature")
    return found.select(F.row_number().over(order).alias("rank"), "feature", "auc")
