"""Hooks for models, and a kept table of what they have answered.

``embedder`` makes a function from a text column to a vector column out of a model's loader; it goes wherever the library
takes ``embed``: clustering of columns, fields, values and nearest concepts. Other hooks are plain functions of columns -
``paraphrase`` (text to texts), ``infer`` (name, values to a search term and search terms of values) and ``describe``
(name, terminology to a sentence) - so a pandas UDF or an expression serves alike; what they leave empty falls back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions.vectors import sparse_value_vectors

Embed = Callable[[Column], Column]
_LOADED: dict[str, object] = {}  # of a worker


def _model(token: str, load: Callable):
    if token not in _LOADED:
        try:
            _LOADED[token] = load()
        except Exception:  # a model that can't be loaded gives zero vectors
            _LOADED[token] = None
    return _LOADED[token]


def embedder(load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int) -> Embed:
    """A column function that embeds texts by the model that ``load`` gives: a function of a list of texts to an array
    with a row of ``dim`` numbers for each. A worker loads it once and asks it for the distinct texts of a batch, trimmed
    of spaces. Vectors get length 1. Once loading or a call has failed, the worker gives zero vectors."""
    token = uuid.uuid4().hex

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            clean = texts.fillna("").str.strip()
            every, at = np.unique(clean.to_numpy(dtype=object).astype(str), return_inverse=True)
            out = np.zeros((len(every), dim), dtype=np.float32)
            if len(every) and (model := _model(token, load)) is not None:
                try:
                    found = np.asarray(model(every.tolist()), dtype=float).reshape(len(every), dim)
                    norm = np.sqrt((found**2).sum(1, keepdims=True))
                    out = np.where(norm > 1e-12, found / np.maximum(norm, 1e-12), found).astype(np.float32)
                except Exception:
                    _LOADED[token] = None
            yield pd.Series(list(out[at]))

    return F.pandas_udf(run, ArrayType(FloatType())).asNondeterministic()  # else filters would call it below a distinct


def text_vectors(rows: DataFrame, key: list[str], texts: str, embed: Embed | None = None) -> DataFrame:
    """(``key``, idx, w): vectors of length 1 of the texts of each row, by hashed grams, or by ``embed`` of the texts
    joined. Each text is embedded once, however many rows have it."""
    if embed is None:
        return sparse_value_vectors(rows, key, texts)
    named = rows.select(*key, F.array_join(texts, " | ").alias("embedded"))
    found = named.select("embedded").distinct().select("embedded", embed(F.col("embedded")).alias("vector"))
    cells = named.join(found, "embedded").select(*key, F.posexplode("vector").alias("idx", "w"))
    return cells.select(*key, "idx", F.col("w").cast("double").alias("w")).where("w <> 0")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def remembered(asked: DataFrame, key: str, path: str, make: Callable[[DataFrame], DataFrame], part: str | None = None, keep: Column | None = None) -> DataFrame:
    """What ``make`` answers to the distinct values of ``key``, with those that the table at ``path`` has not asked again.

    ``make`` takes rows (``key``) and gives rows (``key``, ...) once each. New answers are kept, by the hash of the key, as
    ``part`` of the table; a ``foreachBatch`` that passes its batch's number as ``part`` replaces what it wrote before it
    failed, so each answer is kept once. ``keep`` says which answers are worth it (others are asked again next time)."""
    spark = asked.sparkSession
    wanted = asked.select(key).where(F.col(key).isNotNull()).distinct().withColumn("hash", F.sha2(key, 256))
    part = part or uuid.uuid4().hex
    known = None
    if _exists(spark, path):
        known = spark.read.option("basePath", path).parquet(path).where(F.col("part") != part).drop("part")
        new = wanted.join(known.select("hash"), "hash", "left_anti")
    else:
        new = wanted
    own = f"{path}/part={part}"
    made = make(new.select(key)).withColumn("hash", F.sha2(key, 256))
    made.withColumn("kept", F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))).write.mode("overwrite").partitionBy("kept").parquet(f"{path}.new/part={part}")
    made = spark.read.schema(made.withColumn("kept", F.lit(True)).schema).parquet(f"{path}.new/part={part}")
    made.where("kept").drop("kept").write.mode("overwrite").parquet(own)
    answers = made.drop("kept")
    return answers.drop("hash") if known is None else answers.unionByName(known.join(wanted.select("hash"), "hash", "left_semi")).drop("hash")


def embedded(texts: DataFrame, path: str, embed: Embed, part: str | None = None) -> DataFrame:
    """(text, vector) of the distinct texts, embedded once for all runs that share ``path``; zero vectors aren't kept."""
    zero = F.exists("vector", lambda x: x != 0)
    return remembered(texts, "text", path, lambda rows: rows.select("text", embed(F.col("text")).alias("vector")), part, zero)
