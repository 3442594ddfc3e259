"""Deterministic splits, shards and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.texts import natural_key


def hash_rank(seed: int, task: Column | str, response_id: Column | str) -> Column:
    """SHA-256 of seed, task and id with NUL between; its hex order is its byte order."""
    text = F.concat_ws("\0", F.lit(str(seed)), task, response_id)
    return F.sha2(text, 256)


def dev_split(rows: DataFrame, per_task: int, seed: int, task: str = "task", response_id: str = "response_id") -> DataFrame:
    """rows with ``is_dev``: the ``per_task`` rows of each task with the least hash, ties by natural id.

    Spark keeps only the best ranks of each task before the shuffle (window group limit), so a
    task with a third of all rows costs no sort of its own.
    """
    order = W.partitionBy(task).orderBy(hash_rank(seed, task, response_id), *natural_key(response_id))
    chosen = rows.select(task, response_id, F.row_number().over(order).alias("_rank")).where(F.col("_rank") <= per_task).select(task, response_id, F.lit(1).alias("is_dev"))
    return rows.join(chosen, [task, response_id], "left").withColumn("is_dev", F.coalesce("is_dev", F.lit(0)))


def partitions(rows: DataFrame, per_task: int, seed: int, task: str = "task", response_id: str = "response_id") -> DataFrame:
    """rows with ``eval_split``: test rows are test; train rows are dev or calibration_train."""
    train = dev_split(rows.where("split = 'train'"), per_task, seed, task, response_id)
    train = train.withColumn("eval_split", F.when(F.col("is_dev") == 1, "dev").otherwise("calibration_train")).drop("is_dev")
    return train.unionByName(rows.where("split = 'test'").withColumn("eval_split", F.lit("test")))


def in_total_order(rows: DataFrame, order: list[Column], number: str) -> DataFrame:
    """rows with their number from 1 in a total order, without one task sorting them all.

    Rows are sorted by ranges; counts of the ranges, one small row each, give the offsets.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = ranged.withColumn("_m", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_m", 33)).withColumn("_at", F.col("_m").bitwiseAND((1 << 33) - 1))
    sizes = tagged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    return tagged.join(F.broadcast(offsets), "_part").withColumn(number, F.col("_before") + F.col("_at") + 1).drop("_m", "_part", "_at", "_before")


def work_shard(rows: DataFrame, shards: int, index: int, order: list[Column], number: str = "ordinal") -> DataFrame:
    """Every ``shards``-th row of the order, from row ``index`` (0-based) on; the ordinal is from 0."""
    if shards < 1 or not 0 <= index < shards:
        raise ValueError("0 <= index < shards must hold")
    numbered = in_total_order(rows, order, number).withColumn(number, F.col(number) - 1)
    return numbered.where(F.col(number) % shards == index)


def position(value: Column | str, known: list[str]) -> Column:
    """The place of a value in a list, its length for others."""
    place = F.array_position(F.array(*[F.lit(k) for k in known]), F.col(value) if isinstance(value, str) else value)
    return F.when(place == 0, len(known)).otherwise(place - 1)


def example_order(splits: list[str], tasks: list[str]) -> list[Column]:
    """Split, task and natural id: the order of a dataset."""
    return [position("split", splits), position("task", tasks), *natural_key("response_id")]
