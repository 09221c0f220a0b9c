import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import quality_pu, toxicity
from tessera.llm.labelled import held_out

DOCS = "doc_id long, text string, score string, label int"
LABELS = "doc_id long, quality int, toxic int"
GOOD = ["the", "house", "was", "built", "by", "old", "river", "stones", "and", "wood", "near", "a", "village"]


def corpus(n=900):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(GOOD) for _ in range(rng.randrange(20, 120)))
        good, toxic = int(rng.random() < 0.8), int(rng.random() < 0.2)
        if not good:
            text = " ".join(w + "%%%" for w in text.split()) if i % 2 else " ".join(w for w in text.split()[:9] for _ in range(9))
        if toxic:
            text += " " + rng.choice(["idiot", "scum", "moron"])
        if rng.random() < (0.5 if toxic else 0.1):
            text += " muslim"
        if rng.random() < 0.1:
            text += " christian"
        rows.append((i, text, "x", 1 - good))
        if rng.random() < 0.6:
            labels.append((i, good, toxic))
    return rows, labels, {i: (g, t) for i, g, t in labels}


def odd(rows):
    return [*rows, (10_000, None, "x", 1), (10_001, "", "x", 1), (10_001, "", "x", 1), (None, "the house", "x", 1), (10_002, "the " * 50_000, "x", 1)]


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])


def test_held_out_accuracy(spark):
    rows, labels, truth = corpus()
    docs = spark.createDataFrame(odd(rows), DOCS)
    noted = spark.createDataFrame([*labels, (labels[0][0], None, None), (None, 1, 1), (99_999, 1, 1)], LABELS)
    for module, which in ((quality_pu, 0), (toxicity, 1)):
        got = module.score(docs, noted).collect()
        assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 for r in got)
        held = [(r.score, truth[r.doc_id][which]) for r in got if r.held_out and r.doc_id in truth]
        assert len(held) > 50 and auc(held) > 0.97
        assert [r.held_out for r in got if r.doc_id is None] == [True]


def test_held_out_rows_teach_nothing(spark):
    rows, labels, _ = corpus(300)
    docs = spark.createDataFrame(rows, DOCS)
    table = spark.createDataFrame(labels, LABELS)
    flipped = table.withColumns({c: F.when(held_out(F.col("doc_id")), 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    for module in (quality_pu, toxicity):
        assert module.score(docs, table).collect() == module.score(docs, flipped).collect()


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert quality_pu.score(docs, none).first().score == 0.5
    assert toxicity.score(docs, none).first().score < 0.01
    assert quality_pu.score(docs.limit(0), none).collect() == [] and toxicity.score(docs.limit(0), none).collect() == []


def test_keep_good_keeps_columns(spark):
    rows, labels, truth = corpus()
    kept = quality_pu.keep_good(spark.createDataFrame(odd(rows), DOCS), spark.createDataFrame(labels, LABELS))
    assert kept.columns == ["doc_id", "text", "score", "label"]
    ids = {r.doc_id for r in kept.collect()}
    assert np.mean([i in ids for i, (g, _) in truth.items() if g]) > 0.95
    assert np.mean([i in ids for i, (g, _) in truth.items() if not g]) < 0.2


def test_the_prior_is_found():
    rng = np.random.default_rng(0)
    p = rng.normal(1.5, 1, 5000)
    u = np.sort(np.concatenate([rng.normal(1.5, 1, 35000), rng.normal(-1.5, 1, 15000)]))
    prior, error = quality_pu.estimate_prior(np.searchsorted(u, p) / len(u))
    assert abs(prior - 0.7) < 0.03 and 0 < error < 0.03


def test_scores_by_rank_as_brute_force():
    """The steps have the least risk of all rising functions on a grid, for a few bins."""
    counts, prior = np.array([40, 30, 15, 15]), 0.45
    ranks = np.array([0.1] * 2 + [0.5] * 9 + [0.75] * 3 + [0.95] * 6)
    p = np.array([2, 9, 3, 6]) / 20
    u = counts / 100
    grid = np.linspace(0.001, 0.999, 60)

    def risk(s):
        s = np.clip(s, 1e-6, 1 - 1e-6)
        negative = -(u * np.log(1 - s)).sum() + prior * (p * np.log(1 - s)).sum()
        return -prior * (p * np.log(s)).sum() + max(0, negative)

    rising = quality_pu.rising(ranks, counts, prior)
    assert (np.diff(rising) >= 0).all()
    best = min(risk(np.array(s)) for s in itertools.combinations_with_replacement(grid, 4))
    assert risk(rising) <= best + 1e-3


def _binned_rows(seed, n, shift):
    return np.abs(np.random.default_rng(seed).normal(shift, 1, (n, 14)))


def test_bins_hold_equal_shares_of_all_rows():
    x = _binned_rows(5, 20_000, 2.0)
    x[:, 3] = 0  # a statistic that is the same everywhere
    edges = quality_pu.quantile_edges(np.bincount(quality_pu._cells(x).ravel(), minlength=14 * quality_pu.CELLS))
    want = np.quantile(x, np.arange(1, quality_pu.BINS) / quality_pu.BINS, axis=0).T
    assert (edges[3] == 0).all() and np.abs(edges - want).max() < 0.01


def test_the_risk_and_its_minimum_as_brute_force():
    """Value and slope by single rows and by differences; at the end the slope over all rows is nearly 0 and the second
    term isn't negative, whichever rows lend the curvature."""
    p, u = _binned_rows(1, 80, 1.2), np.concatenate([_binned_rows(2, 500, 1.2), _binned_rows(3, 300, 2.5)])
    edges = quality_pu.quantile_edges(np.bincount(quality_pu._cells(u).ravel(), minlength=14 * quality_pu.CELLS))
    cp, cu, size, prior = quality_pu._columns(p, edges), quality_pu._columns(u, edges), 14 * quality_pu.BINS, 0.6
    sums = lambda w: quality_pu.slopes_of(cu, w)
    loss = lambda z: np.log1p(np.exp(-z))
    w = np.random.default_rng(4).normal(size=size) / 3
    risk = quality_pu.Risk(cp, size, prior, 0.05)

    def at(w):
        found = sums(w[None])[0] / quality_pu.UNIT / len(cu)
        return risk.at(w, found[0], found[1:])

    gp, gu = np.array([sum(w[c]) for c in cp]), np.array([sum(w[c]) for c in cu])
    negative = loss(-gu).mean() - prior * loss(-gp).mean()
    value, slope, second = at(w)
    assert abs(second - negative) < 1e-6 and abs(value - (prior * loss(gp).mean() + negative + 0.025 * (w**2).sum())) < 1e-6
    for j in (0, 40, 200, 447):
        e = np.eye(size)[j] * 1e-2
        assert abs((at(w + e)[0] - at(w - e)[0]) / 2e-2 - slope[j]) < 1e-4
    ends = []
    for few in (cu, cu[:200]):
        risks = [quality_pu.Risk(cp, size, prior, 15 / len(cp))]
        ends.append(quality_pu.minimise(risks, sums, few, len(cu), passes=200)[0])
        risk = risks[0]
        assert np.abs(at(ends[-1])[1]).max() < 2e-3 and at(ends[-1])[2] >= 0
    assert np.abs(ends[0] - ends[1]).max() < 0.02


def test_all_rows_are_learned_from(spark):
    """The curvature of 200 rows instead of all gives nearly the same scores, and rows dealt otherwise the same ones."""
    rows, labels, _ = corpus(600)
    docs, table = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    by = lambda d, **o: {r.doc_id: r.score for r in quality_pu.score(d, table, **o).collect()}
    every, few, dealt = by(docs), by(docs, few=200), by(docs.repartition(70, F.xxhash64("text")))
    assert every == dealt
    assert np.mean([abs(every[i] - few[i]) for i in every]) < 0.02


def test_held_out_predictions_and_prior_at_two_sizes(spark):
    priors = []
    for sf, most in (("sf0.01", 1), ("sf0.1", 10)):
        read = lambda t: spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet")  # noqa: E731, B023
        truth = {r.doc_id: r.quality for r in read("labels").where("quality is not null").collect()}
        got = [r for r in quality_pu.score(read("documents"), read("labels")).collect() if r.held_out and r.doc_id in truth]
        assert sum(r.predicted for r in got if not truth[r.doc_id]) <= most
        assert sum(not r.predicted for r in got if truth[r.doc_id]) <= 0.02 * len(got)
        assert auc([(r.score, truth[r.doc_id]) for r in got]) > 0.99
        likely = [r for r in got if r.score >= 0.5]
        assert abs(np.mean([truth[r.doc_id] for r in likely]) - np.mean([r.score for r in likely])) < 0.05
        priors.append(quality_pu.train(quality_pu.features(read("documents")), read("labels")).prior)
    assert abs(priors[0] - priors[1]) < 0.03


def test_whether_a_held_out_row_has_a_label_teaches_nothing(spark):
    rows, labels, _ = corpus(300)
    docs, table = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    for module in (quality_pu, toxicity):
        assert module.score(docs, table).collect() == module.score(docs, table.where(~held_out(F.col("doc_id")))).collect()


def test_repeated_ids_with_other_texts_give_one_model(spark):
    rows, labels, _ = corpus(200)
    docs = spark.createDataFrame([*rows, *((i, t + " other " + t, s, x) for i, t, s, x in rows[:80])], DOCS)
    table = spark.createDataFrame(labels, LABELS)
    for module in (quality_pu, toxicity):
        one, two = (sorted(map(str, module.score(docs.orderBy(F.xxhash64(F.lit(k), "text")), table).collect())) for k in (1, 2))
        assert one == two


def test_toxicity_fit_as_plain_logistic_regression():
    """Without pairs the fit is a weighted logistic regression: its gradient is nearly 0 at the weights found."""
    rows, labels, _ = corpus(400)
    texts = {i: t for i, t, *_ in rows}
    found, y = [toxicity.words(texts[i]) for i, *_ in labels], np.array([t for *_, t in labels])
    keys = np.unique(np.concatenate(found))
    model = toxicity.fit(found, y, keys, {}, rounds=4000, rate=0.02, decay=1e-3)
    x = np.array([np.isin(keys, f) for f in found], dtype=float)
    each = np.where(y == 1, 3.0, 1.0) / np.where(y == 1, 3.0, 1.0).sum()
    slope = (1 / (1 + np.exp(-(x @ model.weights + model.bias))) - y) * each
    assert np.abs(x.T @ slope + 1e-3 * model.weights).max() < 1e-3


def test_counterfactuals_pull_identity_terms_together():
    rows, labels, _ = corpus()
    texts = {i: t for i, t, *_ in rows}
    swap = toxicity.swaps(toxicity.IDENTITY)
    terms = np.array(sorted(set(swap) | set(swap.values())), dtype=np.uint64)
    keys = np.unique(np.concatenate([terms, *(toxicity.words(texts[i]) for i, *_ in labels)]))
    found = [toxicity.words(texts[i]) for i, *_ in labels]
    y = np.array([t for *_, t in labels])
    gaps = []
    for strength in (0.0, 5.0):
        model = toxicity.fit(found, y, keys, swap, strength)
        gaps.append(abs(model.logit(toxicity.words("the muslim")) - model.logit(toxicity.words("the christian"))))
    assert gaps[1] < 0.2 * gaps[0]


def _few(seed=3, n=60):
    rng = np.random.default_rng(seed)
    keys = np.arange(1, 13, dtype=np.uint64) * np.uint64(1000)
    rows = [np.sort(rng.choice(keys, rng.integers(0, 7), replace=False)) for _ in range(n)]
    y = (rng.random(n) < 0.4).astype(int)
    return keys, rows, y, {1000: 2000, 2000: 3000, 3000: 1000, 4000: 5000, 5000: 4000, 77: 1000}


def test_the_objective_with_pairs_as_brute_force():
    """Loss by sets of words, pair by pair; gradient by differences; the fit ends where the gradient is nearly 0."""
    keys, rows, y, swap = _few()
    aim = toxicity.Objective(rows, y, keys, swap, strength=0.7, weight=3.0, decay=1e-2)
    w = np.random.default_rng(1).normal(size=len(keys) + 1)
    value = {int(k): x for k, x in zip(keys, w, strict=False)}
    g = lambda words: sum(value[x] for x in words) + w[-1]
    loss = lambda words, label: np.log1p(np.exp(g(words))) - label * g(words)
    known = {x: o for x, o in swap.items() if x in value}
    each = np.where(y == 1, 3.0, 1.0) / np.where(y == 1, 3.0, 1.0).sum()
    total, natural, put_in = 0.0, [], []
    for r, label, share, a, b in zip(rows, y, each, keys[aim.a].tolist(), keys[aim.b].tolist(), strict=True):
        words = set(r.tolist())
        assert known[a] == b
        total += share * (loss(words, label) + loss(words | {a}, label)) / 2
        put_in.append((g(words | {a}) - g(words | {b})) ** 2)
        if words & set(known):
            natural.append((g(words) - g({known.get(x, x) for x in words})) ** 2)
    assert aim.natural == len(natural) > 5 and aim.mentions == len(rows) and len(set(aim.a.tolist())) == 5
    brute = total + 0.7 * (np.mean(natural) + np.mean(put_in)) + 0.005 * (w[:-1] ** 2).sum()
    assert abs(aim.loss(w) - brute) < 1e-9
    steps = np.eye(len(w)) * 1e-6
    slopes = np.array([(aim.loss(w + s) - aim.loss(w - s)) / 2e-6 for s in steps])
    assert np.abs(aim.gradient(w) - slopes).max() < 1e-6
    model = toxicity.fit(rows, y, keys, swap, 0.7, rounds=6000, rate=0.01, decay=1e-2)
    assert np.abs(aim.gradient(np.append(model.weights, model.bias))).max() < 1e-3


def test_a_term_stands_in_one_group():
    terms = [w for group in toxicity.IDENTITY for w in group]
    assert len(terms) == len(set(terms)) and all(len(toxicity.word_hashes(w, toxicity.NO_LETTER)) == 1 for w in terms)
    assert set(toxicity.GROUPS) == {"en", "fr", "de", "es"}


def test_counterfactuals_act_on_texts_without_terms(spark):
    """No text of the tables holds a term; the mentions put in still give pairs that the penalty draws together, and a
    neutral mention turns no clean held-out document toxic."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    reports = {}
    for strength in (0.0, 1.0):
        reports[strength] = {}
        model = toxicity.train(docs, labels, strength=strength, report=reports[strength])
    assert reports[1.0]["mentions"] > 100 and reports[0.0]["mentions"] == reports[1.0]["mentions"]
    assert reports[1.0]["gap"] < 0.1 * reports[0.0]["gap"] and reports[0.0]["gap"] > 0
    clean = docs.join(labels.where("toxic = 0"), "doc_id").where(held_out(F.col("doc_id"))).select("text").limit(40).collect()
    turned = 0
    for r in clean:
        found = toxicity.words(r.text or "")
        if model.logit(found) < 0:
            turned += sum(model.logit(np.union1d(found, toxicity.words(t))) >= 0 for group in toxicity.IDENTITY for t in group)
    assert turned == 0
