"""What the classifiers share: bounded samples of rows to fit on, and scoring of whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text is a multiple of 5. A null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def least_hashed(ids: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` rows with the smallest hash of column id: the same at every run, spread over all rows."""
    return ids.orderBy(F.xxhash64("id"), "id").limit(limit)


def labelled_sample(labels: DataFrame, label_col: str, limit: int, id_col: str = "doc_id") -> DataFrame:
    """(id long, label int) of at most ``limit`` labelled rows that aren't held out. Null labels and ids are left out;
    of contradicting labels of one id the larger counts."""
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    return least_hashed(rows, limit)


def texts_of(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The texts of a bounded table of ids, one for each id, with its other columns."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "id")  # its rows have a documented limit


def score_texts(docs: DataFrame, score: Callable[[str], float], threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(``id_col``, held_out, score double, predicted int) for each row; a null text is scored as the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                scores = np.array([score(t) for t in part.column(2).to_pylist()], dtype=float)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
