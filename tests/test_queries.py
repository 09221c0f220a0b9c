import math
import re
import random
from pathlib import Path

from pyspark.sql import functions as F

from tessera.functions.text import search_variant_rows, search_variants
from tessera.functions.vectors import nearest_cosines
from tessera.queries import QUERIES, TABLES


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def cosine(a, b):
    pairs = list(zip(a or [], b or [], strict=False))
    if any(x is None or y is None for x, y in pairs):
        return 0.0
    na, nb = (sum(p[k] ** 2 for p in pairs) for k in (0, 1))
    return sum(x * y for x, y in pairs) / math.sqrt(na * nb) if na >= 1e-12 and nb >= 1e-12 else 0.0


def test_nearest_vector_of_any_label(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], rng.choice(["hot", "hot", "b", None])) for i in range(200)]
    rows += [(200, [1.0, 2.0, 3.0, 4.0], "alone"), (201, [1.0, 2.0, 3.0, 4.1], None), (220, None, "hot"), (240, [0.0] * 4, "b"), (260, [1.0, None, 2.0, 1.0], "b")]
    rows += [(280, [1.0, 2.0], "short"), (None, [1.0, 2.0, 3.0, 4.0], "alone"), (40, [5.0, 1.0, 1.0, 1.0], "b")]
    schema = "vec_id long, embedding array<double>, label string"
    want = {}
    for a, va, _ in rows:
        if a is not None and a % 20 == 0:
            want[a] = max([want.get(a, -2), *(cosine(va, vb) for b, vb, _ in rows if b is not None and b != a)])
    table(spark, tmp_path, "embeddings", rows, schema)
    got = {r.a: r.sim for r in QUERIES["embedding_cosine_top1"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[a] - want[a]) < 1e-6 for a in want)
    assert got[200] > 0.999
    df = spark.createDataFrame(rows, schema).repartition(3)
    small = {r.a: r.sim for r in nearest_cosines(df, F.col("vec_id") % 20 == 0, "vec_id", "embedding", block=2).collect()}
    assert small.keys() == want.keys() and all(abs(small[a] - want[a]) < 1e-9 for a in want)
    assert nearest_cosines(df.where("vec_id = 20"), F.lit(True), "vec_id", "embedding").collect() == []


def test_queries_go_to_a_task_once(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4 if i % 7 else 2)]) for i in range(100)]
    want = {a: max(cosine(va, vb) for b, vb in rows if b != a) for a, va in rows if a % 20 == 0}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = nearest_cosines(df, F.col("vec_id") % 20 == 0, "vec_id", "embedding", block=2)
    got = {r.a: r.sim for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[a] - want[a]) < 1e-5 for a in want)
    assert "Join" not in found._jdf.queryExecution().toString()  # a block of queries doesn't go along with each block
    assert nearest_cosines(df, F.lit(False), "vec_id", "embedding").collect() == []


TEXTS = [
    (1, " ".join(f"word{c}{d} 7" for c in "abcdefgh" for d in "xyz") + " lastWords beyond-the cut"),
    (2, "one"), (3, "two tokens"), (4, "12 34"), (5, ""), (6, None), (7, "again again again again"), (8, "three short tokens"),
]


def variants(text):
    q = re.sub("([a-z])([A-Z])", r"\1 \2", text or "")
    q = re.sub("([0-9])([A-Za-z])", r"\1 \2", re.sub("([A-Za-z])([0-9])", r"\1 \2", q))
    q = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", re.sub("[_/-]", " ", q)).lower()).strip()
    tokens = [t for t in q.split(" ") if len(t) >= 3 and not t.isdigit()]
    n = len(tokens)
    runs = [" ".join(tokens[s : s + k]) for k in range(max(n - 1, 1), 0, -1) for s in range(n - k + 1)] if n else []
    return [v for v in dict.fromkeys([q, " ".join(t for t in q.split(" ") if not t.isdigit()), *runs]) if v]


def test_variants_of_whole_texts(spark, tmp_path):
    table(spark, tmp_path, "benchmark", TEXTS, "item_id long, text string")
    got = [tuple(r) for r in QUERIES["search_variants"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, v) for i, t in TEXTS for v in variants(t)}
    assert (1, "beyond the cut") in got
    df = spark.createDataFrame(TEXTS, "item_id long, text string")
    by = {i: [] for i, _ in TEXTS}
    for r in sorted(search_variant_rows(df, "text").collect(), key=lambda r: r.ord):
        by[r.item_id].append(r.variant)
    for r in df.select("item_id", search_variants(F.col("text")).alias("v")).collect():
        assert list(dict.fromkeys(by[r.item_id])) == r.v


def test_terms_are_looked_up_by_whole_labels(spark, tmp_path):
    labels = [(1, "a first label of many words with zebra"), (2, "the zebra crossing"), (3, "unrelated")]
    table(spark, tmp_path, "benchmark", labels, "item_id long, text string")
    table(spark, tmp_path, "part", [("unrelated part",)], "p_name string")
    got = {(r.query, r.concept_id) for r in QUERIES["term_lookup_top12"](spark, str(tmp_path)).collect()}
    assert {(labels[0][1], 1), (labels[0][1], 2), (labels[1][1], 1), ("unrelated part", 3)} <= got


def test_requests_over_the_tables_as_they_are(spark, tmp_path):
    small = Path("/root/testdata/sf0.001")
    for name in TABLES[1:]:
        (tmp_path / f"{name}.parquet").symlink_to(small / f"{name}.parquet")
    region = spark.read.parquet(str(small / "region.parquet"))
    region.withColumns({"stroke_type": F.when(F.col("r_regionkey") > 1, "Ischemic").otherwise("Hemorrhagic")}).write.parquet(str(tmp_path / "region.parquet"))
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    named, profiled = run("tokenize_name"), run("profile_columns")
    assert {"r_name", "stroke_type", "props"} <= {r.column for r in named} and len(named) == 64
    assert "stroke_type" in {r.column for r in profiled} and len(profiled) == 64
    assert {r.request_id for r in run("schema_best_match")} == {"tables", "clinical"}
    assert any(r.request_id == "tables" and "stroke_type" in r.columns.split("|") for r in run("harmonize_schema"))
    assert {r.request_id for r in run("enrich_pipeline")} == {"tables", "clinical"}
