"""Joins on keys that a third of all rows may hold, and names that no column has yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import durable

SHARE = 10_000  # a key is hot when it holds more than one in so many of all rows: there are fewer such keys than this


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores in front until no column of ``df`` has it, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def hot_join(many: DataFrame, one: DataFrame, on: str | list[str], count: str = "n", how: str = "inner") -> DataFrame:
    """``many`` joined to ``one``, which has each key once and, in ``count``, in how many rows of ``many`` it stands.

    Keys that hold more than one in ``SHARE`` of the counted rows go to every task - by their counts there are at most
    ``SHARE`` of them, as all of ``one`` does while it has no more rows - and no key that is shuffled holds a larger share. ``how`` is inner, left or left_semi; columns
    of ``one`` but ``count`` are kept by the first two. ``one`` is read three times, so it should be a checkpoint."""
    keys = [on] if isinstance(on, str) else on
    total, size = one.agg(F.coalesce(F.sum(count), F.lit(0)), F.count("*")).first()
    if size <= SHARE:
        return many.join(F.broadcast(one.drop(count)), keys, how)
    least = total // SHARE
    hot = one.where(F.col(count) > least).drop(count)
    cold = one.where(F.col(count) <= least).drop(count)
    if least == 0:
        return many.join(one.drop(count), keys, how)
    found = many.join(F.broadcast(hot), keys, "inner" if how == "left" else how)  # fewer than SHARE rows
    rest = many.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return found.unionByName(rest)


def repeated(df: DataFrame, key: str, id_col: str, *others: str) -> DataFrame:
    """(key, first, n, others) of the keys that more than one row of ``df`` holds: the smallest id, the count, and the
    other columns of the row with that id (the smallest of them, where the id repeats). One small row a key and task
    is shuffled."""
    least = F.min(F.struct(F.col(id_col).alias("first"), *others)).alias("least")
    return durable(df.groupBy(key).agg(least, F.count("*").alias("n")).where("n > 1").select(key, "least.*", "n"))
