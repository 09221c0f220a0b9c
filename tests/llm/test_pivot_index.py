import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import pivot_index
from tessera.llm.pivot_index import top_k

SCHEMA = "vec_id long, embedding array<float>, score string, query_id int"


def brute(rows, k, dim=8):
    whole = lambda v: np.floor(256 * np.array([*v, *[0.0] * (dim - len(v))], dtype=np.float32).astype(float)).astype(np.int64)
    good = [(i, whole(v)) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in good:
        if i % 10 == 0:
            best = sorted((-int(q @ x), j) for j, x in good if j != i)[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return sorted(out)


def corpus():
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)], "s", 1) for i in range(700)]
    rows += [(i, rows[3][1], "s", 1) for i in range(700, 1000)]  # a hot vector
    bad = [(2000, None), (2010, []), (2020, [None] + [0.1] * 7), (2030, [float("nan")] * 8), (2040, [float("inf")] * 8), (2050, [0.1, 0.2]), (None, [0.1] * 8)]
    return rows + [(i, v, "s", 1) for i, v in bad] + [(2060, [0.0] * 8, "s", 1)]


def test_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "BLOCK", 64)
    monkeypatch.setattr(pivot_index, "QUERIES", 16)
    rows = corpus()
    got = top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, pivots=6)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5)


def test_bounds_exclude_before_any_block_is_met(spark):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.02) for x in centres[i % 12]], "s", 1) for i in range(1200)]
    stats: dict = {}
    got = top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, pivots=12, stats=stats)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5)
    assert stats["excluded"] > 0.5 * stats["pairs"] > 0 and stats["waves"] <= 3


def test_queries_whose_bounds_exclude_nothing_do_not_wait(spark):
    rng = np.random.default_rng(6)
    points = rng.normal(size=(600, 32))
    points /= np.linalg.norm(points, axis=1)[:, None]
    rows = [(i, p.tolist(), "s", 1) for i, p in enumerate(points)]
    stats: dict = {}
    got = top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, pivots=8, stats=stats)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, 32)
    assert stats["waves"] == 2 and stats["pairs"] > 0


def test_large_components(spark):
    for factor in (1, 400, 2.0**23):  # in 16, 32 and 64 bits
        rng = random.Random(5)
        rows = [(i, [float(np.float32(rng.gauss(0, 1) * factor)) for _ in range(8)], "s", 1) for i in range(200)]
        got = top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, pivots=4)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5)


def test_bounds_hold():
    """No product of a query with a vector of an annulus is above the annulus's bound."""
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(0, 90, (400, 16)) * rng.uniform(0.1, 1, (400, 1)))
    q = np.floor(rng.normal(0, 90, (30, 16)))
    top = max((x**2).sum(1).max(), (q**2).sum(1).max())
    lifted = pivot_index._lift(x, top)
    pivots = pivot_index.fit_pivots(lifted, 5)
    d = pivot_index._distances(lifted, pivots)
    cell = rng.integers(0, 40, 400)
    own = [np.flatnonzero(cell == c) for c in range(40) if (cell == c).any()]
    table = {"cell": np.arange(len(own)), "lo": np.array([d[o].min(0) for o in own]), "hi": np.array([d[o].max(0) for o in own]), "norm": np.array([np.linalg.norm(x[o], axis=1).max() for o in own])}
    dq = pivot_index._distances(np.c_[q, np.zeros(len(q))], pivots)
    reach = np.sqrt(2 * top)
    most = pivot_index._upper(dq, table, (q**2).sum(1), top, 1e-6 * reach, reach)
    for c, o in enumerate(own):
        assert ((q @ x[o].T).max(1) <= most[:, c]).all()


def test_repeated_ids(spark):
    rows = [(20, [1.0] * 8, "s", 1)] * 40 + [(i, [i / 50] * 8, "s", 1) for i in range(10)]
    got = sorted(tuple(r) for r in top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0).collect())
    assert [r[2] for r in got if r[0] == 0] == [1, 2, 3, 4, 5]  # all products are 0
    assert [r[2] for r in got if r[0] == 20] == [9, 8, 7, 6, 5]


def test_small_tables(spark):
    rows = [(0, [1.0] * 8, "s", 1), (10, [1.0] * 8, "s", 1), (3, [-1.0] * 8, "s", 1)]
    got = top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5)
    empty = spark.createDataFrame([(1, None, "s", 1)], SCHEMA)
    assert top_k(empty, F.col("vec_id") % 10 == 0).collect() == []
