"""Vector functions: cosine, L2 norm and hashed n-gram vectors in sparse form."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..runtime import durable, python_path
from .text import normalize_value

BLOCK = 1024  # most vectors in a block of all rows; a block of queries holds four times as many
ASKED = 256  # queries that are compared with a block at once
DIM = 2048
VALUES = 15
# Fixed weights of whole tokens and of character n-grams.
TOKEN_WEIGHT, GRAM_WEIGHTS = 1.0, {2: 0.30, 3: 0.70, 4: 0.55}


def dot(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double over the shorter length; 0 for null vectors and for those of no length."""
    n = F.least(F.size(a), F.size(b))
    na, nb = (dot(F.slice(x, F.lit(1), n), F.slice(x, F.lit(1), n)) for x in (a, b))
    return F.when(a.isNotNull() & b.isNotNull() & (na >= 1e-12) & (nb >= 1e-12), dot(a, b) / F.sqrt(na * nb)).otherwise(0.0)


def _cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``cosine`` of all pairs of rows."""
    n = min(q.shape[1], x.shape[1])
    q, x = q[:, :n], x[:, :n]
    nq, nx = (q * q).sum(1), (x * x).sum(1)
    with np.errstate(all="ignore"):
        sims = q @ x.T / np.sqrt(np.outer(nq, nx))
    return np.where((nq >= 1e-12)[:, None] & (nx >= 1e-12) & np.isfinite(sims), sims, 0.0)


def _blocks(rows: DataFrame, size: int, kind: str) -> DataFrame:
    """Rows (id, v) of a partition as blocks (dim, ids, vecs) of at most ``size`` vectors of one length, in numbers of ``kind``."""
    schema = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("vecs", pa.binary())])

    def block(ids: np.ndarray, vecs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([vecs.shape[1]], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([vecs.astype(kind).tobytes()], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pools: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy()
            for dim in np.unique(sizes).tolist():
                own = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                ids, vecs = own.column(0).to_numpy(), pc.list_flatten(own.column(1)).to_numpy().reshape(own.num_rows, dim).astype(kind)
                if dim in pools:
                    ids, vecs = (np.concatenate(x) for x in zip(pools[dim], (ids, vecs), strict=True))
                whole = len(ids) // size * size
                for lo in range(0, whole, size):
                    yield block(ids[lo : lo + size], vecs[lo : lo + size])
                pools[dim] = ids[whole:].copy(), vecs[whole:].copy()
        for ids, vecs in pools.values():
            if len(ids):
                yield block(ids, vecs)

    return rows.mapInArrow(run, "dim int, ids binary, vecs binary")


def nearest_cosines(rows: DataFrame, queries: Column, id_col: str, vector_col: str, block: int = BLOCK) -> DataFrame:
    """(a long, sim): for each row where ``queries`` holds, the largest ``cosine`` with any row of another id.

    All rows are searched, in blocks of vectors; each task holds one block of queries and its maxima, and compares a few
    of them at once. Null vectors and those with a null or non-finite component have cosine 0 with all; rows with a null
    id take no part; a query with no other row gives none."""
    python_path(rows.sparkSession)
    kind = "<f4" if rows.schema[vector_col].dataType.elementType == FloatType() else "<f8"
    vector = F.transform(F.coalesce(F.col(vector_col), F.array().cast("array<double>")), lambda x: F.coalesce(x.cast("double"), F.lit(float("nan"))))
    vecs = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where("id is not null")
    asked = vecs.where("asks").select("id", "v")
    parts = durable(_blocks(asked.repartition(max(1, -(-asked.count() // (4 * block)))), 4 * block, kind))
    parts = durable(parts.withColumn("part", F.monotonically_increasing_id()))
    salts = rows.sparkSession.sparkContext.defaultParallelism
    asks = parts.withColumns({"salt": F.explode(F.sequence(F.lit(0), F.lit(salts - 1))), "met": F.lit(False)})
    every = durable(_blocks(vecs.select("id", "v"), block, kind)).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
    numbers = F.array(*(F.lit(r.part) for r in parts.select("part").collect())).cast("array<bigint>")  # a number for each 4,096 queries
    every = every.withColumns({"part": F.explode(numbers), "met": F.lit(True)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, q, best = np.zeros(0, "<i8"), np.zeros((0, 0)), np.zeros(0)

        def found() -> pa.RecordBatch:
            known = best > -np.inf
            return pa.RecordBatch.from_arrays([pa.array(a[known]), pa.array(best[known])], names=["a", "sim"])

        for batch in batches:
            for r in range(batch.num_rows):
                dim, ids, vectors, met = (c[r].as_py() for c in batch.columns)
                b = np.frombuffer(ids, "<i8")
                v = np.frombuffer(vectors, kind).reshape(len(b), dim).astype("<f8")
                if not met:
                    yield found()
                    a, q, best = b, v, np.full(len(b), -np.inf)
                    continue
                for lo in range(0, len(a), ASKED):
                    some = slice(lo, lo + ASKED)
                    sims = np.where(a[some, None] == b, -np.inf, _cosines(q[some], v)).max(1)
                    best[some] = np.maximum(best[some], sims)
        yield found()

    # A block of queries, and then the blocks that it meets.
    met = asks.unionByName(every).repartition("part", "salt").sortWithinPartitions("part", "salt", "met").select("dim", "ids", "vecs", "met")
    return met.mapInArrow(run, "a long, sim double").groupBy("a").agg(F.max("sim").alias("sim"))


_KNOWN: dict[str, int] = {}  # of a worker: cells of grams it has met
_KNOWN_MOST = 1 << 17


def _cell(gram: str) -> int:
    """``fnv1a32`` of a gram, in ``DIM`` cells."""
    h = _KNOWN.get(gram)
    if h is None:
        h = 0x811C9DC5
        for byte in gram.encode("utf-8", "surrogatepass"):
            h = ((h ^ byte) * 0x01000193) & 0xFFFFFFFF
        if len(_KNOWN) >= _KNOWN_MOST:
            _KNOWN.clear()
        h = _KNOWN[gram] = h & (DIM - 1)
    return h


def _cells(normalized: list[str | None]) -> dict[int, float]:
    """Sums of weights: of tokens of two characters or more, and of character n-grams with spaces."""
    out: dict[int, float] = {}
    for s in normalized:
        for t in re.split("[^a-z0-9]+", s or ""):
            if len(t) >= 2:
                c = _cell(t)
                out[c] = out.get(c, 0.0) + TOKEN_WEIGHT
        for n, w in GRAM_WEIGHTS.items():
            for i in range(len(s or "") - n + 1):
                c = _cell(s[i : i + n])
                out[c] = out.get(c, 0.0) + w
    return out


def sparse_value_vectors(rows: DataFrame, key: list[str], values: str = "values") -> DataFrame:
    """(``key``, idx, w): the hashed vector of the first values of each row, of length 1, as rows that aren't zero.

    Values are normalized in Spark; a task's Python cuts them to grams and hashes each gram once while it remembers it."""
    python_path(rows.sparkSession)
    normalized = F.transform(F.slice(F.col(values), 1, VALUES), normalize_value)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(key))
            for lo in range(0, batch.num_rows, BLOCK):
                found = [_cells(v or []) for v in texts.slice(lo, BLOCK).to_pylist()]
                of = pa.array(np.repeat(np.arange(lo, lo + len(found)), [len(c) for c in found]))
                columns = [*(batch.column(i).take(of) for i in range(len(key))), pa.array([i for c in found for i in c], pa.int32()), pa.array([w for c in found for w in c.values()], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*key, "idx", "w"])

    grams = rows.select(*key, normalized.alias("__values")).mapInArrow(run, f"{schema}, idx int, w double")
    sums = grams.groupBy(*key, "idx").agg(F.sum("w").alias("w"))
    norms = sums.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return sums.join(norms, key).select(*key, "idx", (F.col("w") / F.col("norm")).alias("w"))


def sparse_cosines(vectors: DataFrame, key: str, within: list[str] | None = None) -> DataFrame:
    """(``within``, a, b, cosine) of pairs a < b that share an index, of vectors of length 1."""
    within = within or []
    a = vectors.select(*within, "idx", F.col(key).alias("a"), F.col("w").alias("wa"))
    b = vectors.select(*within, "idx", F.col(key).alias("b"), F.col("w").alias("wb"))
    return a.join(b, [*within, "idx"]).where("a < b").groupBy(*within, "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
