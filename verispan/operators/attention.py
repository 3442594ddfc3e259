"""Attention-shaped operators over vectors: causal pairs, top fractions, external context scores, copy heads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import cosine, dot
from .checks import require_none


def causal_pairs(rows: DataFrame, key: str, position: str, window: int | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """(key, query, key_position, q_*, k_*): pairs with key_position <= query in the same response.

    An equi-join on the response with a range residual; with ``window`` only the last ``window``
    positions count, and an extra join key of window-sized bins keeps far pairs from meeting at all.
    """
    q = rows.select(key, F.col(position).alias("query"), *[F.col(c).alias(f"q_{c}") for c in columns])
    k = rows.select(key, F.col(position).alias("key_position"), *[F.col(c).alias(f"k_{c}") for c in columns])
    if window is None:
        return q.join(k, key).where("key_position <= query")
    q = q.withColumn("_bin", F.explode(F.array(F.floor(F.col("query") / window), F.floor(F.col("query") / window) - 1)))
    k = k.withColumn("_bin", F.floor(F.col("key_position") / window))
    return q.join(k, [key, "_bin"]).where((F.col("key_position") <= F.col("query")) & (F.col("key_position") > F.col("query") - window)).drop("_bin")


def attention(pairs: DataFrame, by: list[str], query: Column | str, keys: Column | str, scale: float) -> DataFrame:
    """pairs with ``logit`` (scaled dot product) and ``weight`` (its softmax over the query's keys)."""
    scored = pairs.withColumn("logit", dot(query, keys) * scale)
    over = W.partitionBy(*by)
    scored = scored.withColumn("_e", F.exp(F.col("logit") - F.max("logit").over(over)))
    return scored.withColumn("weight", F.col("_e") / F.sum("_e").over(over)).drop("_e")


def top_fraction(pairs: DataFrame, by: list[str], score: str, position: str, fraction: float) -> DataFrame:
    """The best max(1, floor(n * fraction)) rows of each group by score, ties to the lower position."""
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.col(score).desc(), position))).withColumn("n_valid", F.count("*").over(W.partitionBy(*by)))
    return ranked.where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n_valid") * F.lit(fraction))))


def mean_vectors(rows: DataFrame, by: list[str], vector: str, size: int) -> DataFrame:
    """(by..., mean): element-wise means, by partial aggregation of ``size`` sums; no vectors are collected."""
    sums = rows.groupBy(*by).agg(*[F.avg(F.col(vector)[i].cast("double")).alias(f"_{i}") for i in range(size)])
    return sums.select(*by, F.array(*[F.col(f"_{i}") for i in range(size)]).alias("mean"))


def external_context_score(pairs: DataFrame, by: list[str], score: str, position: str, query: str, keys: str, size: int, fraction: float) -> DataFrame:
    """(by..., ecs): cosine of the query's state with the mean state of its most attended keys."""
    top = top_fraction(pairs, by, score, position, fraction)
    query_states = pairs.groupBy(*by).agg(F.any_value(query).alias("_q"))
    return mean_vectors(top, by, keys, size).join(query_states, by).select(*by, cosine("_q", "mean").alias("ecs"))


def kv_head(head: Column | str, groups: int) -> Column:
    """The key-value head of a query head under grouped-query attention."""
    return F.floor((F.col(head) if isinstance(head, str) else head) / groups).cast("int")


def gather(wanted: DataFrame, universe: DataFrame, key: list[str], position: str, value: str) -> DataFrame:
    """wanted (key..., position) with its place among the captured positions of its key, and that one's ``value``.

    A wanted position that wasn't captured is an error.
    """
    order = W.partitionBy(*key).orderBy(position)
    held = universe.select(*key, position, value, (F.row_number().over(order) - 1).alias("place"))
    found = wanted.join(held, [*key, position], "left")
    require_none(found.where("place is null").select(*key, position), "positions that weren't captured")
    return found


def gram(rows: DataFrame, left: str, right: str, size: int) -> DataFrame:
    """(i, j, value): sums of products of the vectors' elements; each task adds up one matrix of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x, y = (np.asarray(batch.column(c).flatten(), np.float64).reshape(-1, size) for c in ("left", "right"))
            total += x.T @ y
        at = np.arange(size * size)
        yield pa.RecordBatch.from_arrays([pa.array((at // size).astype(np.int32)), pa.array((at % size).astype(np.int32)), pa.array(total.ravel())], ["i", "j", "value"])

    both = rows.select(F.col(left).cast("array<double>").alias("left"), F.col(right).cast("array<double>").alias("right")).where("left is not null and right is not null")
    return both.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def trace_of_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(trace) of A @ B for long matrices (i, j, value), never forming the product."""
    return a.join(b.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("value").alias("other")), ["i", "j"]).agg(F.sum(F.col("value") * F.col("other")).alias("trace"))


def gershgorin(cells: DataFrame, by: list[str], scale: Column | float = 1.0) -> DataFrame:
    """Disks, fences and outliers of sampled matrices given as (by..., i, j, value).

    The radius is the scaled sum of a row's absolute off-diagonal values, as the whole matrix would have;
    a disk's two boundary points join the sample whose quartiles make the fences.
    """
    off = F.when(F.col("i") != F.col("j"), F.abs("value"))
    rows = cells.groupBy(*by, "i").agg(F.max(F.when(F.col("i") == F.col("j"), F.col("value"))).alias("center"), (F.sum(off) * scale).alias("radius"))
    points = rows.select(*by, "radius", F.explode(F.array(F.col("center") - F.col("radius"), F.col("center") + F.col("radius"))).alias("point"))
    fences = points.groupBy(*by).agg(F.percentile("point", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"), F.avg("radius").alias("mean_radius"), F.max("radius").alias("max_radius"), F.count("*").alias("n_points"))
    fences = fences.select(*by, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q3"), "mean_radius", "max_radius", "n_points")
    joined = points.join(fences, by) if by else points.crossJoin(F.broadcast(fences))
    return outliers(joined, by, "point")


def outliers(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Tukey fences from columns q1 and q3, and how many values lie outside."""
    spread = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - 1.5 * spread, F.col("q3") + 1.5 * spread
    kept = [c for c in rows.columns if c in ("q1", "q3", "mean_radius", "max_radius")]
    return rows.groupBy(*by, *kept).agg(
        F.max(spread).alias("iqr"), F.max(low).alias("lower_fence"), F.max(high).alias("upper_fence"),
        F.count_if((F.col(value) < low) | (F.col(value) > high)).alias("n_outliers"), (F.count_if((F.col(value) < low) | (F.col(value) > high)) / F.count("*")).alias("outlier_fraction"),
    )


def rank_copy_heads(heads: DataFrame) -> DataFrame:
    """Copy heads by the sum of two ordinal ranks: trace (absolute, downwards) and outliers (upwards).

    One row a (layer, head), so a model's few thousand heads at most.
    """
    tie = ["layer", "head"]
    ranked = heads.withColumns({
        "trace_rank": F.row_number().over(W.orderBy(F.col("absolute_trace").desc(), *tie)),
        "outlier_rank": F.row_number().over(W.orderBy("n_outliers", *tie)),
    })
    ranked = ranked.withColumn("rank_sum", F.col("trace_rank") + F.col("outlier_rank"))
    return ranked.withColumn("copying_rank", F.row_number().over(W.orderBy("rank_sum", F.col("absolute_trace").desc(), "n_outliers", *tie)))
