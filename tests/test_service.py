import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.register import register
from tessera.functions.text import column_prompt, field_prompt, nfkc, repaired_map
from tessera.operators import clustering, platform, terminology
from tessera.plans.suggest import mapping_csv, n_triples, prepared, suggest_schemaless
from tessera.service_queries import liveness_stream
from tessera.sources.profile import PROFILE, column_stats, profile_table
from tessera.streaming.heartbeats import each_request


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def texts(*values):
    return F.array(*map(F.lit, values))


def test_prompts(spark):
    values = texts("integer", "min:0", "max:100", "step:5")
    assert one(spark, column_prompt(F.lit("barthel total"), values, column_stats(values))) == ("barthel total | integer range 0..100",)
    values = texts("Ischemic stroke", "  ", "Hemorrhagic", *(f"v{i}" for i in range(20)))
    want = "type | ischemic stroke, hemorrhagic, v0, v1, v2, v3, v4, v5 | stem_hints isch, hemo"
    assert one(spark, column_prompt(F.lit("type"), values, column_stats(values))) == (want,)
    fields = [("sex", "string", "Of the patient", ["Male", "Female"]), ("", "date", "", []), ("n", "", "", [])]
    got = [r[0] for r in spark.createDataFrame(fields, "n string, t string, d string, e array<string>").select(field_prompt(F.col("n"), F.col("t"), F.col("d"), F.col("e"))).collect()]
    assert got == ["sex (string) | Of the patient: male, female | stem_hints fema", "date", "n"]


def member(column, concept, role, vec, value=None, **flags):
    tokens = [t for t in concept.split() if len(t) > 1]
    return {"column": column, "concept": concept, "role": role, "vec": np.array(vec, dtype=np.float32), "value_vec": value, "concept_tokens": tokens, "column_tokens": [], "life": False, "flag": False, "no_value_evidence": False} | flags


def pair(a, b):
    return clustering.merge_score(clustering.Cluster(a), clustering.Cluster(b))


def test_values_count_only_where_names_say_nothing():
    v, w = np.array([1.0, 1.0], dtype=np.float32), np.array([1.0, 0.0], dtype=np.float32)
    same = member("a", "heart rate", "CATEGORICAL", [1, 0], v), member("b", "heart beat", "CATEGORICAL", [1, 0], w)
    bare = member("a", "alpha", "CATEGORICAL", [0.6, 0.8], v), member("b", "omega", "CATEGORICAL", [1, 0], w)
    assert pair(*same) == 1.0 and pair(*(dict(m, vec=np.array(x, dtype=np.float32)) for m, x in zip(same, ([0, 1], [1, 0]), strict=True))) == pytest.approx(0.16 / 3 + 0.08)
    assert pair(*bare) == pytest.approx(0.6 + 0.02 + 0.08)


def test_unknown_roles_are_no_evidence():
    a, b = (member(c, "heart rate", "UNKNOWN", v) for c, v in (("a", [0, 1]), ("b", [1, 0])))
    assert pair(a, b) == pytest.approx(0.16)


def test_abbreviations_are_those_of_concepts():
    a, b = member("hr", "pulse", "NUMERIC_MEASURE", [1, 0]), member("b", "heart rate", "NUMERIC_MEASURE", [1, 0])
    assert pair(a, b) is None
    assert pair(member("x", "hr", "NUMERIC_MEASURE", [1, 0]), b) == 1.0


def test_composite_labels_must_be_covered():
    both = member("stairs + walking", "stairs walking", "ITEM_SCORE", [1, 0])
    assert pair(both, member("stairs", "stairs", "ITEM_SCORE", [1, 0])) is None
    assert pair(both, member("walking_stairs", "walking stairs", "ITEM_SCORE", [1, 0])) == 1.0
    assert clustering.composite_heads("a+b") == [] and clustering.composite_heads("Bowel (x) + Bladder") == ["bowel", "bladder"]


def test_context_tokens_are_no_overlap(spark):
    names = ["stroke_type", "stroke_side", "stroke_cause", "side_effect"]
    rows = spark.createDataFrame([("r", i, "n", f"{i}.csv", c, ["x", f"y{i}"]) for i, c in enumerate(names)], PROFILE)
    got = {r.pos: r.cluster for r in clustering.cluster_columns(prepared(rows)).collect()}
    assert len({got[0], got[1], got[2]}) == 3


def wide(n, dim, seed):
    """Columns of many names, some of which share tokens, abbreviate each other or have values in common."""
    rng = np.random.default_rng(seed)
    words = ["heart", "rate", "hr", "blood", "pressure", "bp", "weight", "wt", "walking", "walk", "stairs", "total", "score"]
    topics = rng.normal(size=(max(2, n // 8), dim))
    out = []
    for k in range(n):
        names = rng.choice(words, rng.integers(1, 3), replace=False).tolist()
        m = member(" ".join(names) + f" {k % 5}", " ".join(names), str(rng.choice(["NUMERIC_MEASURE", "UNKNOWN", "ITEM_SCORE"])), topics[rng.integers(len(topics))] + rng.normal(0, 0.5, dim))
        v = rng.random(6).astype(np.float32) if rng.random() < 0.7 else None
        out.append({**m, "key": f"{names}{k // 3}{m['role']}", "value_vec": v})
    return out


def every_pair_fold(rows, threshold):
    first = {}
    for m in rows:
        if m["key"] in first:
            first[m["key"]].add(m)
        else:
            first[m["key"]] = clustering.Cluster(m)
    out = []
    for c in first.values():
        scored = [(s, -i) for i, o in enumerate(out) if (s := clustering.merge_score(o, c)) is not None and s >= threshold]
        if scored:
            out[-max(scored)[1]].merge(c)
        else:
            out.append(c)
    return out


def test_fold_of_near_clusters_is_that_of_all_pairs():
    sizes = lambda found: [(c.representative, c.role, len(c.members), [m["column"] for m in c.members]) for c in found]
    for seed, threshold in ((1, 0.56), (2, 0.56), (3, 0.2), (4, 0.9)):
        rows = wide(160, 12, seed)
        assert sizes(clustering.fold(rows, threshold)) == sizes(every_pair_fold(rows, threshold))
    assert clustering.fold([], 0.56) == []


def test_a_wide_request_scores_few_pairs(monkeypatch):
    rows, asked, real = wide(5000, 48, 7), [0], clustering.merge_score

    def counted(a, b):
        asked[0] += 1
        return real(a, b)

    monkeypatch.setattr(clustering, "merge_score", counted)
    found = clustering.fold(rows, 0.56)
    n = len({m["key"] for m in rows})
    assert sum(len(c.members) for c in found) == 5000 and len(found) > 100
    assert asked[0] < 0.05 * n * (n - 1) / 2


def test_equal_columns_are_held_once(spark, monkeypatch):
    """Vectors are made for columns that differ, and with a vector of its own for each column the clusters are the same."""
    kinds = [("heart_rate", ["integer", "min:30", "max:200"]), ("HR", ["integer", "min:30", "max:200"]), ("Sex", ["M", "F"]), ("sex", ["male", "female"]), ("weight", ["double"])]
    data = [(r, k, f"n{k}", "a.csv", *kinds[(k * k + k // 3) % 5]) for r in ("a", "b") for k in range(200)]
    rows, asked, real = prepared(spark.createDataFrame(data, PROFILE)), [], clustering.sparse_value_vectors

    def counted(df, key, values="values"):
        asked.append(df.count())
        return real(df, key, values)

    monkeypatch.setattr(clustering, "sparse_value_vectors", counted)
    shown = lambda df: sorted(tuple(r) for r in df.collect())
    once = shown(clustering.cluster_columns(rows))
    n = len({(r, *map(str, x)) for r, _, _, _, *x in data})
    assert asked == [n, n] and len(once) == len(data)
    assert shown(clustering.cluster_columns(rows, vectors=real(clustering.column_prompts(rows), ["request_id", "pos"], "prompts"))) == once


def test_liveness_stream_as_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    seen = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias("n"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")).collect():
        seen[r.n].append(r.ms)
    got = [(r.node_id, r.state) for r in liveness_stream(spark, sf).collect()]
    # One batch holds all events: each node comes up once and is down at its last beat unless the watermark is too near.
    end = max(map(max, seen.values()))
    assert sorted(n for n, s in got if s == "UP") == sorted(seen)
    assert {n for n, s in got if s == "DOWN"} <= {n for n, ms in seen.items() if max(ms) + 180_000 <= end}


def test_each_request_replaces_its_own_batch(spark, tmp_path):
    spark.createDataFrame([("r", 0, "n", "f", "sex", ["m", "f"])], PROFILE).write.parquet(str(tmp_path / "in"))
    told = []
    for stream in ("a", "b"):
        rows = spark.readStream.schema(PROFILE).parquet(str(tmp_path / "in"))
        each_request(rows, lambda df: df.select("column"), str(tmp_path / "out"), str(tmp_path / f"state-{stream}"), stream, lambda p, m: told.append(p)).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.stream, r.column) for r in got) == [("a", "sex"), ("b", "sex")] and told == [1, 100] * 2


def test_paraphrases_come_before_the_nearest(spark):
    dictionary = spark.createDataFrame([("123456", "Myocardial infarction"), ("654321", "Heart failure")], "concept_id string, label string")
    queries = spark.createDataFrame([("coronary blockage",), ("heart failure",)], "query string")
    model = lambda c: F.when(c == "coronary blockage", texts("", "myocardial infarction", "heart failure"))
    got = {r.query: r.terminology for r in terminology.resolved(queries, dictionary, model).collect()}
    assert got == {"coronary blockage": "Myocardial infarction | 123456", "heart failure": "Heart failure | 654321"}


def test_repairs_and_composition(spark):
    assert one(spark, repaired_map(F.lit('x {"a": "1"} y')), repaired_map(F.lit("no")), repaired_map(F.lit(None).cast("string"))) == ({"a": "1"}, {}, {})
    assert [r[0] for r in spark.createDataFrame([("ﬁne Å",), ("plain",), (None,)], "t string").select(nfkc(F.col("t"))).collect()] == ["fine Å", "plain", None]


def test_sql_functions(spark):
    register(spark)
    got = spark.sql("SELECT fnv1a32(''), fnv1a32('a'), round(vector_cosine(array(1D, 0D), array(1D, 1D)), 6), vector_cosine(array(0D), array(1D)), is_abbreviation('hr', 'heart rate'), is_abbreviation('hr', NULL)").first()
    assert tuple(got) == (0x811C9DC5, 0xE40C292C, round(math.sqrt(0.5), 6), 0.0, True, False)


def test_registration(spark):
    events = spark.createDataFrame([("a", "n1", 1, None), ("a", "n2", 2, None), ("b", "n3", 1, None), ("b", "n3", 2, "deregister"), ("c", "n4", 1, None), ("c", "n4", 2, "deregister"), ("c", "n5", 3, None)], "ip string, node_id string, seq int, op string")
    for overwrite, want in ((True, {"a": "n2", "c": "n5"}), (False, {"a": "n1", "c": "n5"})):
        assert {r.ip: r.node_id for r in platform.registered(events, overwrite).collect()} == want


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("r", 0, "n1", "a.csv", "Se\nx", ["M", "F"]), ("r", 1, "n2", "b.csv", 'se"x', ["male", "female"])], PROFILE)
    got = suggest_schemaless(rows)
    mapping_csv(got, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "csv")).count() == 4
    lines = [r.value for r in n_triples(got).collect()]
    assert len(lines) == 2 and all("\n" not in x for x in lines) and any('"Se\\nx"' in x for x in lines) and any('se\\"x' in x for x in lines)
    reports = spark.createDataFrame([("t", "E", "boom"), ("t", "E", " ")], "at string, level string, message string")
    for _ in range(2):
        platform.error_log(reports, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_profiles_of_text_columns(spark):
    rows = [(f"v{i % 200:03d}", None if i else "only", i, None) for i in range(1000)]
    got = {r.column: r["values"] for r in profile_table(spark.createDataFrame(rows, "a string, b string, n int, none string").repartition(5), "t.csv", "n", 3).collect()}
    assert got == {"a": [f"v{i:03d}" for i in range(80)], "b": ["only"], "n": ["integer", "min:0", "max:999"], "none": []}
