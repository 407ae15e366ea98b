"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Every node's neighbours (the larger ones, or the smaller ones and itself) are tied to its smallest neighbour."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("m"))
    if larger:
        both = both.unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
    least = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("least"))
    joined = both.join(least, "n")
    if larger:
        out = joined.where("m > n").select(F.col("m").alias("u"), F.col("least").alias("v"))
    else:
        out = joined.select(F.col("m").alias("u"), F.col("least").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("least").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, a: str, b: str, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) of every node in the links, component being the smallest node reachable.

    Hubs are reduced by partial aggregation before their rows meet, each round is
    written to the shared folder, and only a row count and a checksum reach the driver.
    """
    edges = saved(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), name)
    before = None
    for _ in range(rounds):
        edges = saved(_star(_star(edges, True), False), name)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
