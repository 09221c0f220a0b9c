"""Connected components of an edge table by alternating large-star and small-star rounds.

A vertex with very many edges is joined to its least neighbour in every task (``hot_join``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import durable
from .hot import hot_join


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = durable(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")))
    return hot_join(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = durable(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    moved = hot_join(down, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u long, v long) to (id, component): every vertex that has an edge to another one, with the smallest
    id it can reach. Vertices without edges are not listed; null ends and loops are ignored; no edges, no rows."""
    now = durable(edges.where("u is not null and v is not null and u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")).distinct())
    was = None
    while (sign := _signature(now)) != was:
        was = sign
        if sign[0] == 0:
            break
        now = durable(_small_star(_large_star(now)))
    pairs = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return pairs.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
