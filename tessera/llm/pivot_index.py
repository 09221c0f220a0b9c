"""Exact top-k inner products through a pivot-distance index.

Vectors of integers are lifted by one coordinate, sqrt(M - |x|^2) with M the largest squared norm (0 for a query), so
that |q - x|^2 = M + |q|^2 - 2 <q, x> and the nearest vector is the one with the largest product. Each vector is keyed
by its nearest pivot and the distance to it; distances are cut into rings (an annulus is a pivot and a ring), and an
annulus into blocks of bounded size. For a query at distance d from a pivot, the triangle inequality bounds every
product with vectors that lie between lo and hi from that pivot through max(0, d - hi, lo - d). An annulus has such an
interval for every pivot, its own and all others; the widest gap counts, or Cauchy-Schwarz by the largest norm in the
annulus, whichever bounds better.

A query sorts the annuli by that bound and expands them in waves, a few in the first, more in the next and the rest in
the last; its k best scores of a wave are the bound of the next one. It stops at the first annulus whose bound is below
its k-th best score: what lies beyond is never sent to a block. A query whose bounds exclude less than ``DULL`` of the
annuli after the first wave gains nothing by waiting, and expands all that is left at once; when no query has more to
come, the waves end. The table of annuli (at most pivots x (4 x rings + 1), with an interval a pivot, whatever the
number of vectors) is what the tasks need to decide it, so bounds are applied before any block is joined.

Blocks meet the queries that ask for them, by block and part of the queries. Both sides travel packed, 256 queries a row
and in the narrowest integers that hold the components, and both are large (``BLOCK``, ``QUERIES`` or ``BYTES``), so
what is sent grows by a vector for every ``BLOCK`` that a query asks for. Products are exact integers, and bounds leave
room for rounding.

Pivots are fitted on at most ``SAMPLE`` vectors (those with the smallest hash of the id); every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import durable, python_path

SAMPLE = 4096
BLOCK = 32_768  # most vectors of a block, about
QUERIES = 32_768  # most queries that meet a block at once, about
BYTES = 8 << 20  # most bytes of either, about
DULL = 0.1  # share of the annuli that bounds must exclude for a query to wait for another wave
WAVES = (0, 2, 8)  # ranks of the annuli at which a wave begins


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long, x as double; null for vectors that take no part."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return F.when(embedding.isNotNull() & (F.size(embedding) > 0) & good, whole)


def fit_pivots(sample: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """k-means centres of lifted vectors, from a farthest-first start."""
    if not len(sample):
        return sample
    chosen = [0]
    gap = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    pivots = sample[chosen].astype(float)
    for _ in range(rounds):
        near = _distances(sample, pivots).argmin(1)
        for p in range(len(pivots)):
            if (own := sample[near == p]).size:
                pivots[p] = own.mean(0)
    return pivots


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _lift(v: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([v, np.sqrt(np.maximum(top - (v**2).sum(1), 0))[:, None]], 1)


def _matrix(blob: bytes, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(blob, dtype=kind).reshape(-1, dim)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * q.shape[1] < 2**52:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def _upper(dq: np.ndarray, cells: dict[str, np.ndarray], square: np.ndarray, top: float, slack: float, reach: float) -> np.ndarray:
    """Upper bounds of the products of queries (rows) with annuli (columns), with room for rounding. ``dq``: distances of
    the queries to all pivots."""
    gap = np.zeros((len(dq), len(cells["cell"])))
    for j in range(dq.shape[1]):
        d = dq[:, j][:, None]
        np.maximum(gap, np.maximum(d - cells["hi"][:, j], cells["lo"][:, j] - d), out=gap)
    by_distance = (top + square[:, None] - np.maximum(0, gap - slack) ** 2) / 2 + slack * reach + 1
    return np.minimum(by_distance, np.sqrt(square)[:, None] * cells["norm"] * (1 + 1e-9) + 1)


def _search(dim: int, k: int, kind: str):
    """A block and the queries that ask for it to what can be among a query's best k."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for blob, vecs in zip(right["ids"].to_pylist(), right["vecs"].to_pylist(), strict=True) if left.num_rows else ():
            every, whole = np.frombuffer(blob, "<i8"), _matrix(vecs, dim, kind)
            for row in range(left.num_rows):
                part = {c: left[c][row] for c in ("ids", "bounds", "bound_ids")}
                qids, bound, bound_id = (part[c].values.to_numpy() for c in ("ids", "bounds", "bound_ids"))
                q = _matrix(left["vecs"][row].as_py(), dim, kind)
                for at in range(0, len(every), 4096):
                    ids = every[at : at + 4096]
                    for i, s in enumerate(_products(q, whole[at : at + 4096])):
                        hit = np.flatnonzero(((s > bound[i]) | ((s == bound[i]) & (ids <= bound_id[i]))) & (ids != qids[i]))
                        if len(hit) > k:
                            hit = hit[s[hit] >= np.partition(s[hit], len(hit) - k)[len(hit) - k]]
                        hit = hit[np.lexsort((ids[hit], -s[hit]))[:k]]
                        out.append((np.full(len(hit), qids[i]), ids[hit], s[hit]))
        columns = zip(*out, strict=True) if out else ([np.empty(0, np.int64)],) * 3
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in columns], schema=schema)

    return run


_FOUND = "query_id long, vec_id long, score long"
_LOWEST = -(2**63)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_ROUTED = "cell int, salt int, part int, ids array<long>, vecs binary, bounds array<long>, bound_ids array<long>, asked long, skipped long"


def _route(cells: dict[str, np.ndarray], n_pivots: int, dim: int, kind: str, top: float, reach: float, since: int, until: int | None, parts: int):
    """Queries to the blocks of the annuli that they expand in this wave, up to 256 a row; and for each 256 a row of
    cell -1 with those that have more to come, how many were asked and how many annuli the rest is let to skip."""
    slack, longs = 1e-6 * reach, pa.list_(pa.int64())
    schema = pa.schema([("cell", pa.int32()), ("salt", pa.int32()), ("part", pa.int32()), ("ids", longs), ("vecs", pa.binary()), ("bounds", longs), ("bound_ids", longs), ("asked", pa.int64()), ("skipped", pa.int64())])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(cells["cell"])
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                ids, bound, bound_id = (batch.column(c).to_numpy() for c in (0, 3, 4))
                v = _matrix(b"".join(batch.column(1).to_pylist()), dim, kind)
                dq = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<f8").reshape(-1, n_pivots)
                most = _upper(dq, cells, (v.astype(float) ** 2).sum(1), top, slack, reach)
                rank = np.argsort(np.argsort(-most, axis=1, kind="stable"), axis=1)
                live = most >= bound[:, None]
                count = live.sum(1)
                dull = (since > 0) & (count > (1 - DULL) * n)
                stop = np.where(dull, n, n if until is None else until)
                take = live & (rank >= since) & (rank < stop[:, None])
                part = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % parts
                out: list[tuple] = []
                size = 0
                for p in np.unique(part).tolist():
                    own = part == p
                    for c in np.flatnonzero(take[own].any(0)).tolist():
                        who = np.flatnonzero(own & take[:, c])
                        row = (p, ids[who], v[who].tobytes(), bound[who], bound_id[who], 0, 0)
                        for salt in range(int(cells["blocks"][c])):
                            out.append((int(cells["cell"][c]), salt, *row))
                            size += len(row[2])
                            if size > BYTES:
                                yield packed(out)
                                out, size = [], 0
                out.append((-1, 0, 0, ids[count > stop], None, [], [], len(ids), int((n - np.maximum(count, since))[count <= stop].sum())))
                yield packed(out)

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, pivots: int = 32, rings: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", stats: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` holds, the ``k`` best rows with another id by
    the integer product of components floor(``scale`` * x); ties go to the smaller id.

    Vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows with a null id.
    Vectors of different lengths meet as if the shorter one went on with zeros. With fewer than ``k`` candidates a query
    gets all. An id that repeats counts row by row, but never against itself; a repeated query row is asked once (the
    smallest of its vectors). No vectors, no rows. Other columns aren't read. ``stats`` gets the number of (query,
    annulus) pairs, of those that the bounds excluded, and of waves."""
    spark = python_path(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where("id is not null and v is not null")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    least = rows.agg(F.min(F.size("v")), F.max(F.size("v")), F.max(norm), F.count("*"), F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    if not least[3]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shortest, dim, top, total, *ends = least
    kind = next(k for k, bits in (("<i2", 15), ("<i4", 31), ("<i8", 64)) if max(abs(x) for x in ends) < 2**bits)
    if shortest < dim:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    centres = fit_pivots(_lift(np.array([r.v for r in sample], dtype=float), top), pivots)
    reach = float(np.sqrt(2 * top)) or 1.0
    # Any pair of lifted vectors is at most 2 * sqrt(top) apart, so rings have the same width everywhere.
    width = 2 * reach / (4 * rings)
    sent = spark.sparkContext.broadcast(centres)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array(batch.column(1).to_pylist(), dtype=np.int64).reshape(-1, dim)
            asks = batch.column(2).to_numpy(zero_copy_only=False)
            d = _distances(_lift(v.astype(float), top), sent.value)
            near = d.argmin(1)
            own = d[np.arange(len(near)), near]
            dq = _distances(np.concatenate([v.astype(float), np.zeros((len(v), 1))], 1), sent.value) if len(v) else np.zeros((0, 1))
            cell = near * (4 * rings + 1) + np.floor(own / width).astype(np.int64)
            columns = [batch.column(0), batch.column(2), pa.array(near.astype(np.int32)), pa.array(own), pa.array(cell.astype(np.int32))]
            columns += [pa.array([x.tobytes() for x in v.astype(kind)], pa.binary()), pa.array([x.tobytes() if a else None for x, a in zip(dq, asks, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "asks", "pivot", "d", "cell", "vec", "dq"])

    keyed = durable(rows.select("id", "v", "asks").mapInArrow(key, "id long, asks boolean, pivot int, d double, cell int, vec binary, dq binary"))
    most = max(1, BYTES // (dim * np.dtype(kind).itemsize))
    size = int(min(BLOCK, most, max(64, total // int(spark.conf.get("spark.sql.shuffle.partitions")))))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                cell = part.column(0).to_numpy()
                order = np.argsort(cell, kind="stable")
                found, first = np.unique(cell[order], return_index=True)
                x = _matrix(b"".join(part.column(1).to_pylist()), dim, kind).astype(float)[order]
                d, square = _distances(_lift(x, top), sent.value), (x**2).sum(1)
                lo, hi = np.minimum.reduceat(d, first), np.maximum.reduceat(d, first)
                columns = [pa.array(found), pa.array(list(lo)), pa.array(list(hi)), pa.array(np.sqrt(np.maximum.reduceat(square, first))), pa.array(np.diff([*first, len(cell)]))]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "lo", "hi", "norm", "n"])

    cells = keyed.select("cell", "vec").mapInArrow(spans, "cell int, lo array<double>, hi array<double>, norm double, n long")
    cells = cells.select("cell", "norm", "n", F.posexplode(F.arrays_zip("lo", "hi")).alias("j", "d")).groupBy("cell", "j")
    found = cells.agg(F.min("d.lo").alias("lo"), F.max("d.hi").alias("hi"), F.max("norm").alias("norm"), F.sum("n").alias("n")).orderBy("cell", "j").toPandas()  # at most pivots^2 * (4 * rings + 1) rows
    each = found[found["j"] == 0]
    table = {"cell": each["cell"].to_numpy(), "norm": each["norm"].to_numpy(), "blocks": -(-each["n"].to_numpy() // size)}
    table |= {c: found[c].to_numpy().reshape(-1, len(centres)) for c in ("lo", "hi")}
    annuli = spark.createDataFrame([(int(c), int(n)) for c, n in zip(table["cell"], table["blocks"], strict=True)], "cell int, blocks int")
    salted = keyed.select("cell", "id", "vec").join(F.broadcast(annuli), "cell").withColumn("salt", F.pmod(F.monotonically_increasing_id(), "blocks").cast("int"))  # of a checkpoint, so a task that runs again deals alike

    def block(group: tuple, rows: pa.Table) -> pa.Table:
        ids = rows["id"].to_numpy().astype("<i8").tobytes()
        return pa.table({"cell": pa.array([group[0].as_py()], pa.int32()), "salt": pa.array([group[1].as_py()], pa.int32()), "ids": [ids], "vecs": [b"".join(rows["vec"].to_pylist())]})

    blocks = durable(salted.select("cell", "salt", "id", "vec").groupBy("cell", "salt").applyInArrow(block, "cell int, salt int, ids binary, vecs binary"))
    asks = durable(keyed.where("asks").groupBy("id").agg(F.min(F.struct("vec", "dq")).alias("m")).select("id", "m.*"))
    parts = -(-asks.count() // int(min(QUERIES, most))) or 1
    best = spark.createDataFrame([], _FOUND)
    now = asks.withColumns({"bound": F.lit(_LOWEST), "bound_id": F.lit(_LOWEST)})
    for since, until in zip(WAVES, (*WAVES[1:], None), strict=True):
        if since >= len(table["cell"]):
            break
        routed = durable(now.select("id", "vec", "dq", "bound", "bound_id").mapInArrow(_route(table, len(centres), dim, kind, top, reach, since, until, parts), _ROUTED))
        last = routed.where("cell < 0").agg(F.sum("asked"), F.sum("skipped"), F.sum(F.size("ids"))).first()
        if stats is not None:
            stats["pairs"] = stats.get("pairs") or (last[0] or 0) * len(table["cell"])  # of the first wave, which all queries are in
            stats["excluded"] = stats.get("excluded", 0) + (last[1] or 0)
            stats["waves"] = stats.get("waves", 0) + 1
        wanted = routed.where("cell >= 0").drop("asked", "skipped")
        copies = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))) if parts > 1 else blocks.withColumn("part", F.lit(0))
        copies = copies.join(wanted.select("cell", "salt", "part").distinct(), ["cell", "salt", "part"], "left_semi")
        met = wanted.groupBy("cell", "salt", "part").cogroup(copies.groupBy("cell", "salt", "part")).applyInArrow(_search(dim, k, kind), _FOUND)
        best = durable(_best(best.unionByName(met), k).drop("rank"))
        if not last[2]:
            break
        waiting = routed.where("cell < 0").select(F.explode("ids").alias("id"))
        bounds = best.groupBy("query_id").agg(F.count("*").alias("c"), F.max_by(F.struct("score", "vec_id"), F.struct(-F.col("score"), "vec_id")).alias("last")).where(F.col("c") == k)
        bounds = bounds.select("query_id", F.col("last.score").alias("bound"), F.col("last.vec_id").alias("bound_id"))
        now = asks.join(waiting, "id", "left_semi")
        now = now.join(bounds, now["id"] == bounds["query_id"], "left").withColumns({c: F.coalesce(c, F.lit(_LOWEST)) for c in ("bound", "bound_id")})
    return _best(best, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
