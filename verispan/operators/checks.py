"""Integrity checks as queries: each returns the offending rows or counts, and a guard that raises."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import is_finite


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """(keys..., n) of the keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_keys(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNull() | (F.col(key).cast("string") == ""))


def orphans(rows: DataFrame, parents: DataFrame, *keys: str) -> DataFrame:
    """Rows without a parent."""
    return rows.join(parents.select(*keys).distinct(), list(keys), "left_anti")


def bad_binary(df: DataFrame, *columns: str) -> DataFrame:
    """(column, bad): how many values aren't 0 or 1, all columns in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull() | ~F.col(c).cast("double").isin(0.0, 1.0)).alias(c) for c in columns])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("bad")) for c in columns])))


def bad_finite(df: DataFrame, *columns: str) -> DataFrame:
    """(column, bad): how many values are null, NaN or infinite."""
    counts = df.agg(*[F.count_if(~is_finite(F.col(c).cast("double"))).alias(c) for c in columns])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("bad")) for c in columns])))


SPLITS = ("original_split", "source_split", "split", "eval_split")


def test_rows(df: DataFrame) -> DataFrame:
    """(column, n): rows marked as test in any split column, whatever the case."""
    columns = [c for c in SPLITS if c in df.columns]
    counts = df.agg(*[F.count_if(F.lower(F.col(c)) == "test").alias(c) for c in columns])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns])))


def shared_keys(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys that both have."""
    return a.select(*keys).intersect(b.select(*keys))


def label_conflicts(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Keys with more than one label."""
    return df.groupBy(*keys).agg(F.min(label).alias("low"), F.max(label).alias("high")).where("low <> high")


def label_disagreements(a: DataFrame, b: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Keys of both sides whose labels differ."""
    left = a.groupBy(*keys).agg(F.max(label).alias("label_a"))
    right = b.groupBy(*keys).agg(F.max(label).alias("label_b"))
    return left.join(right, keys).where("label_a <> label_b")


def missing_columns(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]


def require_columns(df: DataFrame, columns: list[str]) -> None:
    if missing := missing_columns(df, columns):
        raise ValueError(f"missing columns: {', '.join(missing)}")


def unknown_values(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    """(column): distinct values that aren't known."""
    return df.select(column).where(~F.col(column).isin(*known)).distinct()


def require_none(df: DataFrame, what: str, show: int = 5) -> None:
    """Raise with the first rows, in order, if df has any."""
    if rows := df.orderBy(*df.columns).limit(show).collect():
        raise ValueError(f"{what}: " + ", ".join(str(tuple(r)) for r in rows))


def frame_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, with repeats, tagged by side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
