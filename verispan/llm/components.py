"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node reachable.

    Each round replaces every node's links by links to its smallest neighbour, first
    toward larger nodes, then toward smaller ones; the rounds end when no edge changes,
    which takes a number of rounds logarithmic in the components' size. Edges are never
    collected; hot nodes are met by partial minimums and a join that adaptive execution
    can split. Null ends and loops are ignored; no edges give no rows.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    links, path = stored(links, "links")
    before = _mark(links)
    while before[0]:
        large = _toward_smallest(_both_ways(links)).where("v > u").distinct()
        small = _small_star(large)
        after, fresh = stored(small, "links")
        drop_path(links.sparkSession, path)
        links, path, mark = after, fresh, _mark(after)
        if mark == before:
            break
        before = mark
    return links.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
        links.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    )


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("x"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["x"], row["s"]


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct(F.col("v").alias("c"), F.col("u").alias("w")), F.struct(F.col("u").alias("c"), F.col("v").alias("w")))).alias("e")).select("e.*")


def _toward_smallest(both: DataFrame) -> DataFrame:
    """Large star: each neighbour larger than the centre links to the centre's smallest neighbour or itself."""
    least = both.groupBy("c").agg(F.min("w").alias("m"))
    return both.where("w > c").join(least, "c").select(F.col("w").alias("v"), F.least("m", "c").alias("u"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, link to the smallest of them."""
    least = links.groupBy("v").agg(F.min("u").alias("m"))
    joined = links.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return joined.unionByName(least.select("v", F.col("m").alias("u"))).where("v <> u").distinct()
