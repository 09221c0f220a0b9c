"""All values of a mapping have buckets, however many there are."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.functions.vectors import sparse_value_vectors
from tessera.operators import leaders
from tessera.operators.values import CLUSTER_LEAST, clustered_buckets, harmonized
from tessera.plans.enrich import enriched_parts
from tessera.plans.suggest import prepared, schema_parts, schemaless_parts
from tessera.sources.json_schema import schema_fields
from tessera.sources.profile import PROFILE, profile_tables
from tessera.sources.sketch import column_texts


def fnv(g):
    h = 2166136261
    for c in g.encode():
        h = ((h ^ c) * 16777619) & 0xFFFFFFFF
    return h & 2047


def vector(s):
    cells = Counter()
    for t in re.split("[^a-z0-9]+", s):
        if len(t) >= 2:
            cells[fnv(t)] += 1.0
    for n, w in ((2, 0.3), (3, 0.7), (4, 0.55)):
        for i in range(len(s) - n + 1):
            cells[fnv(s[i : i + n])] += w
    norm = sum(w * w for w in cells.values()) ** 0.5
    return {i: w / norm for i, w in cells.items()}


def plain(items):
    """Leader clusters as the reference forms them, one value after the other: the members of each, in order."""
    clusters = []
    for source, v in items:
        vec = vector(v)
        scored = [(round(sum(w * c["sum"][i] for i, w in vec.items()) / sum(x * x for x in c["sum"].values()) ** 0.5, 9) if c["sum"] else 0.0, -k) for k, c in enumerate(clusters)]
        s, k = max(scored, default=(0.0, 0))
        into = clusters[-k] if s >= CLUSTER_LEAST else None
        if into and any(p == source and x != v for p, x in into["refs"]):
            into = None
        if len(v) == 1:
            into = next((c for c in clusters if (v in {x for _, x in c["refs"]})), None)
        if into is None:
            into = {"sum": Counter(), "refs": []}
            clusters.append(into)
        into["sum"].update(vec)
        into["refs"].append((source, v))
    return [c["refs"] for c in clusters]


def members_of(spark, *sources):
    rows = spark.createDataFrame([("r", i, f"n{i}", f"{i}.csv", "col", v) for i, v in enumerate(sources)], PROFILE)
    return prepared(rows).withColumns({"mapping": F.lit(1).cast("long"), "type": F.lit("")}).select("request_id", "mapping", "pos", "file_key", "column", "concept", "values", "stats", "type")


def test_vectors_of_any_text(spark):
    texts = ["Yes ", "a", "\u00fcb er-\u00dcBER", "\U0001f600 x\U0001f600", "x_1  y", "", None, "integer", "aaaa aaaa"]
    rows = spark.createDataFrame([(i, [t]) for i, t in enumerate(texts)] + [(99, ["ab", None, "ba"]), (100, None)], "k int, v array<string>")
    got = {}
    for r in sparse_value_vectors(rows, ["k"], "v").collect():
        got.setdefault(r.k, {})[r.idx] = r.w
    want = {0: "yes", 2: "\u00fcb er \u00fcber", 3: "\U0001f600 x\U0001f600", 4: "x 1 y", 8: "aaaa aaaa"}
    assert set(got) == {*want, 99}
    for k, s in want.items():
        cells = vector(s)
        assert got[k].keys() == cells.keys() and all(abs(got[k][i] - w) < 1e-12 for i, w in cells.items())


def test_clusters_of_all_values(spark):
    """More than 80 values a source and 220 a mapping, against the plain form; near values of one source stay apart."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(150)]
    sources = [words, ["x", *(f"{w}s" for w in words[:100])], ["x", "y", *(f"{w} {rng.choice(words)}" for w in words[20:120])]]
    sources = [sorted(set(s)) for s in sources]
    want = plain([(p, v) for p, s in enumerate(sources) for v in s])
    got = clustered_buckets(members_of(spark, *sources)).collect()
    refs = {r.bucket: [(x.pos, x.value) for x in r.refs] for r in got}
    assert sum(map(len, refs.values())) == sum(map(len, sources)) > 220 and sorted(refs) == list(range(len(want)))
    ranked = sorted(want, key=lambda c: -len(c))
    assert [refs[k] for k in range(len(ranked))] == ranked
    assert {len(c) for c in want} >= {1, 2, 3}  # some join


def test_fold_by_parts(monkeypatch):
    """Small parts of the index, values that repeat in a source, and directions that change after they were indexed."""
    import numpy as np

    rng = random.Random(8)
    for fresh, part in ((1, 4), (3, 16), (8, 1 << 17)):
        monkeypatch.setattr(leaders, "FRESH", fresh)
        monkeypatch.setattr(leaders, "PART", part)
        for _ in range(20):
            words = ["".join(rng.choice("abc") for _ in range(rng.randrange(2, 7))) for _ in range(30)]
            items = [(p, v) for p in range(5) for v in rng.choices(words, k=25)]
            names = list(dict.fromkeys(v for _, v in items))
            cells = [sorted(vector(v).items()) for v in names]
            flat = [c for cs in cells for c in cs]
            one = leaders.Leaders(np.array([len(c) for c in cells]), np.array([i for i, _ in flat]), np.array([w for _, w in flat]), np.zeros(len(names), dtype=bool), CLUSTER_LEAST)
            of, rank, label = one.fold(np.array([p for p, _ in items]), np.array([names.index(v) for _, v in items]), np.array([len(v) for v in names]))
            found = [[x for x, k in zip(items, of.tolist(), strict=True) if k == c] for c in range(len(rank))]
            want = plain(items)
            assert found == want
            assert [names[x] for x in label] == [min(t := Counter(v for _, v in c), key=lambda v: (-t[v], len(v))) for c in want]


def test_enriched_values_beyond_the_caps(spark):
    """A mapping of 300 values, its profile with the first 80 of them, and all as texts: each has its row."""
    names = [f"value number {i:03d}" for i in range(300)]
    rows = spark.createDataFrame([("r", 0, "n1", "a.csv", "kind", names[:80]), ("r", 1, "n2", "b.csv", "size", ["integer", "min:0", "max:9"])], PROFILE)
    texts = spark.createDataFrame([("r", 0, v) for v in reversed(names)], "request_id string, pos int, value string")
    dictionary = spark.createDataFrame([(123456, "value number 250")], "concept_id long, label string")
    mappings, buckets = schemaless_parts(rows, texts=texts)
    found, values = enriched_parts(mappings, dictionary, buckets=buckets)
    got = {r.name: r.terminology for r in values.collect()}
    assert set(names) <= set(got) and got["value number 250"] == "value number 250 | 123456"
    assert found.count() == 2


def test_domains_count_all_values(spark):
    """Eighty spellings of two values and a hundred more: no closed domain."""
    spelled = ["yes" + " " * i for i in range(40)] + ["no" + " " * i for i in range(40)]
    got = harmonized(members_of(spark, spelled + [f"other {i}" for i in range(100)])).collect()
    assert {r.kind for r in got} == {"clustered"} and len(got) == 102 and sum(len(r.refs) for r in got) == 180


def test_texts_of_all_columns(spark):
    """Every distinct text of columns of categories, numbered as in profiles; none of a column with free text."""
    a = spark.createDataFrame([(i, f"v{i % 200:03d}", "x" * (201 if i == 7 else 3), None) for i in range(1000)], "n int, `a.b` string, long string, none string")
    b = spark.createDataFrame([(1.0, "e"), (2.0, None), (3.0, "ü" * 200)], "d double, t string")
    got = column_texts({"a": a.repartition(5), "b": b})
    want = {(1, f"v{i:03d}") for i in range(200)} | {(5, "e"), (5, "ü" * 200)}
    assert sorted((r.request_id, r.pos, r.value) for r in got.collect()) == sorted(("tables", p, v) for p, v in want)
    assert column_texts({"n": a.select("n")}).count() == 0


def test_schema_gets_all_values(spark):
    """The 80 smallest values of the column are of one kind alone."""
    values = [f"hemorrhagic {i:03d}" for i in range(100)] + [f"ischemic {i:03d}" for i in range(50)]
    tables = {"t": spark.createDataFrame([(i, v) for i, v in enumerate(values * 2)], "k int, stroke_type string")}
    fields = schema_fields(spark.createDataFrame([("tables", '{"properties": {"stroke_type": {"type": "string", "enum": ["Ischemic", "Hemorrhagic"]}}}')], "request_id string, schema string"))
    mappings, buckets = schema_parts(profile_tables(tables), fields, texts=column_texts(tables))
    assert {r.name: len(r.refs) for r in buckets.collect()} == {"Ischemic": 50, "Hemorrhagic": 100}
    assert [(r.kind, r.buckets) for r in mappings.collect()] == [("enum", 2)]
