import math
import random
from hashlib import sha256

import numpy as np
import pytest

from tessera.llm import ball_kmeans as module
from tessera.llm.ball_kmeans import Balls, _root, ball_kmeans

SCHEMA = "vec_id long, embedding array<float>, cluster string, ids int"


def brute(rows, k, rounds, width=64):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    x = np.array([v for _, v in kept], dtype=object).reshape(-1, width)

    def assign():
        d = np.array([[int(((v - np.array(c, dtype=object)) ** 2).sum()) for c in centroids] for v in x], dtype=object)
        return [min(range(len(centroids)), key=lambda j: (row[j], j)) for row in d], [min(row) for row in d]

    for _ in range(rounds):
        labels, _ = assign()
        for j in range(len(centroids)):
            own = [x[i] for i in range(len(x)) if labels[i] == j]
            if own:
                centroids[j] = [int(s) // len(own) for s in np.sum(own, axis=0)]
    labels, d = assign()
    inertia = {j: sum(v for v, own in zip(d, labels, strict=True) if own == j) for j in set(labels)}
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((kept[i][0], labels[i], d[i], inertia[labels[i]], sum(d), names[labels[i]]) for i in range(len(x)))


def corpus(n=260, width=64):
    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(9)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in centres[0 if i % 3 == 0 else i % 9]], "x", 1) for i in range(n)]
    rows += [(i, rows[4][1], "x", 1) for i in range(n, n + 60)]  # a hot vector
    rows += [(3, rows[9][1], "x", 1), (3, rows[9][1], "x", 1), (3, rows[10][1], "x", 1)]
    bad = [(2000, None), (2001, []), (2002, [None] + [0.1] * (width - 1)), (2003, [float("nan")] * width), (2004, [float("-inf")] * width), (2005, [0.1] * (width - 1)), (2006, [0.1] * (width + 1)), (None, [0.1] * width)]
    return rows + [(i, v, "x", 1) for i, v in bad]


@pytest.mark.parametrize("k,rounds", [(40, 5), (7, 3), (1, 2), (5, 0)])
def test_as_brute_force(spark, k, rounds):
    rows = corpus()
    got = ball_kmeans(spark.createDataFrame(rows, SCHEMA).repartition(3), clusters=k, rounds=rounds)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, k, rounds)


def test_ties_and_empty_clusters(spark):
    rows = [(i, [float(i % 3)] + [0.0] * 63, "x", 1) for i in range(30)]
    rows += [(i, [0.5] + [0.0] * 63, "x", 1) for i in range(30, 60)]  # between two centroids
    got = ball_kmeans(spark.createDataFrame(rows, SCHEMA), clusters=12, rounds=2)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 12, 2)


def test_balls_spare_comparisons(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 64)
    rows, stats = corpus(600), {}
    got = ball_kmeans(spark.createDataFrame(rows, SCHEMA), clusters=12, rounds=5, stats=stats)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 12, 5)
    assert len(stats["rounds"]) == 6
    assert sum(r["compared"] for r in stats["rounds"][1:]) < 0.5 * sum(r["all"] for r in stats["rounds"][1:])


def test_small_tables(spark):
    empty = spark.createDataFrame([(1, None, "x", 1)], SCHEMA)
    assert ball_kmeans(empty).collect() == [] and ball_kmeans(empty.limit(0)).collect() == []
    one = [(5, [1.0] * 64, "x", 1)]
    assert [tuple(r) for r in ball_kmeans(spark.createDataFrame(one, SCHEMA)).collect()] == brute(one, 40, 5)
    with pytest.raises(ValueError, match="long"):
        ball_kmeans(spark.createDataFrame([(1, [1e9] * 64, "x", 1)], SCHEMA))
    with pytest.raises(ValueError, match="clusters"):
        ball_kmeans(empty, clusters=10**6)


def test_any_labels_lead_to_the_nearest():
    rng = np.random.default_rng(3)
    x, c = rng.integers(-9, 9, (500, 3)), rng.integers(-9, 9, (20, 3))
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    labels = rng.integers(0, 20, 500)
    new, best, compared = Balls(c).assign(x, labels, np.zeros(500, np.int64))
    assert (new == d.argmin(1)).all() and (best == d.min(1)).all() and compared < d.size
    reach = [int(d[labels == i, i].max(initial=0)) for i in range(20)]
    new, best, _ = Balls(c, reach).assign(x, labels, np.zeros(500, np.int64))
    assert (new == d.argmin(1)).all() and (best == d.min(1)).all()
    assert [_root(v) for v in (0, 1, 2, 4, 5, 10**12, 10**12 + 1)] == [0, 1, 2, 2, 3, 10**6, 10**6 + 1]
