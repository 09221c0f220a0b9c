import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import block_wand
from tessera.llm.block_wand import Vocabulary, cut_lists, rank
from tessera.llm.words import words_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, score int, item string", "item_id long, text string, rank int"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    bags = [(i, terms(t)) for i, t, *_ in docs if i is not None]
    bags = [(i, Counter(t), len(t)) for i, t in bags if t]
    n_docs, total = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    asked = {}
    for i, t, *_ in items:
        if i is not None and t is not None:
            asked[i] = min(t, asked.get(i, t))
    out = []
    for i, t in asked.items():
        found = []
        for d, bag, n in bags:
            m = 25 + 75 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * bag[x] // (1000 * bag[x] + 8 * m)) for x in terms(t) if x in bag)
            if score > 0:
                found.append((-score, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out)


def corpus(n=400):
    rng = random.Random(11)
    vocabulary = [f"t{i}" for i in range(120)] + ["Été", "straße", "中文", "7"]
    text = lambda size: " ".join(vocabulary[min(int(rng.expovariate(0.05)), 123)] for _ in range(size))
    docs = [(i, re.sub(" ", lambda _: rng.choice([" ", ", ", "\n"]), text(rng.randrange(1, 60))), 1, "x") for i in range(n)]
    docs += [(n + i, docs[5][1], 1, "x") for i in range(60)]  # copies, so ties
    docs += [(8, docs[5][1], 1, "x"), (8, docs[5][1], 1, "x"), (None, docs[5][1], 1, "x"), (9000, None, 1, "x"), (9001, "", 1, "x"), (9002, "?!", 1, "x")]
    docs.append((9003, text(30_000) + " " + "q" * 300_000 + " T1", 1, "x"))
    items = [(i, text(rng.choice([1, 2, 5, 20, 60])), 1) for i in range(24)] + [(50, docs[5][1], 1), (51, "t1 T1 t1 t2", 1), (52, "absent words", 1)]
    items += [(53, None, 1), (54, "", 1), (55, "--", 1), (None, "t1", 1), (50, "t3 t4", 1), (56, " ".join(f"t{i % 120}" for i in range(4000)), 1)]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"shard_docs": 40, "longest": 4, "cost": 100_000, "k": 3}, {"terms": 60, "shard_postings": 500}])
def test_as_brute_force(spark, options):
    docs, items = corpus()
    got = rank(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS), **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, items, options.get("k", 10))


def test_bounds_skip_documents(spark, monkeypatch):
    monkeypatch.setattr(block_wand, "FIRST", 4)
    docs, items = corpus(2000)
    items, stats = items[:20], {}
    got = rank(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), shard_docs=100, cost=500_000, stats=stats)
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, items)
    assert 0 < stats["scored"] < 0.5 * stats["pairs"] and stats["blocks"] < stats["postings"]


def test_small_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([("x", "b"), ("y", None)], "item_id string, text string")
    assert [tuple(r) for r in rank(docs, items).collect()] == [("x", 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // 1800))]
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("text is null"), items)):
        assert rank(d, i).collect() == []


def cheapest(impacts, longest, cost):
    best = [0]
    for j in range(1, len(impacts) + 1):
        best.append(min(best[i] + (j - i) * max(impacts[i:j]) + cost for i in range(max(0, j - longest), j)))
    return best[-1]


def test_cuts_are_optimal():
    rng = random.Random(2)
    lists = [[rng.randrange(1, 100) for _ in range(rng.choice([1, 2, 7, 30, 90]))] for _ in range(40)]
    starts = np.cumsum([0, *map(len, lists)])
    flat = np.array([x for own in lists for x in own], dtype=np.int64)
    for longest, cost in ((8, 50), (64, 300), (1, 10)):
        cuts, edges = cut_lists(starts, flat, longest, cost)
        for i, own in enumerate(lists):
            at = cuts[edges[i] : edges[i + 1] + 1] - starts[i]
            assert at[0] == 0 and at[-1] == len(own) and (np.diff(at) > 0).all() and (np.diff(at) <= longest).all()
            assert sum((b - a) * max(own[a:b]) + cost for a, b in zip(at[:-1], at[1:], strict=True)) == cheapest(own, longest, cost)


def test_words_that_share_a_key_are_told_apart():
    known = Vocabulary(["abc", "abd", "xyzw"])
    known.layers = [(np.array([7], np.uint64), np.array([i])) for i in range(3)]
    found = words_of(pa.array(["abd ABC zzz xyzw abcd"]))
    found.keys[:] = 7
    assert known.of(found).tolist() == [1, 0, -1, 2, -1]
