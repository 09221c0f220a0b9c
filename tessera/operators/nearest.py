"""Exact search for near sparse vectors of length 1 by an inverted index of vector prefixes.

Cells are ranked by how few dictionary vectors hold them. What the cells from some rank on can add to a product is
bounded by the norm of that rest, and by its weights times the largest weights that the other side has there. The prefix
of a vector is its cells up to where that bound falls to the threshold: two vectors whose product is above it share a
cell of both prefixes. Only prefixes are joined, rarest cells first, so common cells, whose lists are long, are left out
of most of them. A pair's shared prefix cells give a partial product; that and the norms of what follows the last of
them bound the whole, and only pairs that the bound lets through fetch their cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import stored

SLACK = 1e-6  # room for rounding in bounds and in lengths


def _prefixes(cells: DataFrame, key: str, ranks: DataFrame, most: str, least: float) -> DataFrame:
    """(idx, ``key``, w, rank, after): the prefix of each vector, with the norm of its cells after each."""
    rest = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = cells.join(F.broadcast(ranks), "idx")  # a row a cell: as many as a vector has dimensions
    square = F.sum(F.col("w") * F.col("w")).over(rest)
    bound = F.least(F.sqrt(square), F.sum(F.abs("w") * F.col(most)).over(rest))
    rows = rows.withColumns({"square": square, "bound": bound}).where(F.col("bound") > least - SLACK)
    return rows.select("idx", key, "w", "rank", F.sqrt(F.greatest(F.col("square") - F.col("w") * F.col("w"), F.lit(0.0))).alias("after"))


def candidates(asked: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(q, d, partial, bound) of pairs that may have a product above ``least``, from (q, idx, w) and (d, idx, w). Vectors
    have length 1 or less; ``least`` is above 0."""
    counts = known.groupBy("idx").agg(F.count("*").alias("n"), F.max(F.abs("w")).alias("most_d"))
    most = asked.groupBy("idx").agg(F.max(F.abs("w")).alias("most_q"))
    ranks = counts.join(most, "idx").withColumn("rank", F.row_number().over(Window.orderBy("n", "idx"))).drop("n")  # a row a cell; cells of one side alone add nothing
    ranks = stored(ranks, "ranks")
    q = _prefixes(asked, "q", ranks, "most_d", least).select("idx", "q", "rank", F.col("w").alias("wq"), F.col("after").alias("aq"))
    d = _prefixes(known, "d", ranks, "most_q", least).select("idx", "d", F.col("w").alias("wd"), F.col("after").alias("ad"))
    met = q.join(d, "idx").groupBy("q", "d").agg(F.sum(F.col("wq") * F.col("wd")).alias("partial"), F.max_by(F.col("aq") * F.col("ad"), "rank").alias("after"))
    return met.withColumn("bound", F.col("partial") + F.col("after")).where(F.col("bound") > least - SLACK).drop("after")


def _numbered(vectors: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Cells by a number for each vector, and what each number stands for: texts of any length don't go through joins."""
    named = stored(vectors.select(F.col(key).alias("text")).distinct().withColumn(key, F.monotonically_increasing_id()), "named")
    return stored(vectors.withColumnRenamed(key, "text").join(named, "text").select(key, "idx", "w"), "cells"), named


def near_pairs(asked: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(q, d, sim) of all pairs whose product is above ``least``. Candidates meet cell by cell."""
    (asked, texts_q), (known, texts_d) = _numbered(asked, "q"), _numbered(known, "d")
    cells = candidates(asked, known, least).select("q", "d").join(asked, "q").join(known.withColumnRenamed("w", "v"), ["d", "idx"])
    sims = cells.groupBy("q", "d").agg(F.sum(F.col("w") * F.col("v")).alias("sim")).where(F.col("sim") > least)
    back = sims.withColumnRenamed("q", "nq").join(texts_q.select(F.col("q").alias("nq"), F.col("text").alias("q")), "nq")
    return back.withColumnRenamed("d", "nd").join(texts_d.select(F.col("d").alias("nd"), F.col("text").alias("d")), "nd").select("q", "d", "sim")
