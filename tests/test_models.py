"""Hooks of models and what is kept of their answers."""

import json
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.matching import best_fields
from tessera.operators.models import embedded, embedder, remembered, text_vectors
from tessera.operators.noise import leading_contexts
from tessera.operators.terminology import nearest_concepts, resolved
from tessera.operators.values import clustered_buckets
from tessera.plans.enrich import enrich
from tessera.plans.suggest import prepared, suggest_schema, suggest_schemaless
from tessera.sources.json_schema import schema_fields
from tessera.sources.profile import PROFILE, read_requests, request_profiles

SAME = [("alpha", "ringo"), ("beta", "quux"), ("gamma", "zork")]  # words that only the model holds for the same


def loader(folder, broken=False):
    """A model that writes down each load and each text it is asked for."""

    def load():
        with open(f"{folder}/loads", "a") as f:
            f.write("x\n")
        if broken == "load":
            raise OSError("no model")

        def model(texts):
            with open(f"{folder}/texts", "a") as f:
                f.write("".join(json.dumps(t) + "\n" for t in texts))
            if broken:
                raise ValueError("failed")
            out = np.zeros((len(texts), len(SAME) + 1))
            for i, t in enumerate(texts):
                hit = [k for k, pair in enumerate(SAME) if any(w in t.lower() for w in pair)]
                out[i, hit[0] if hit else -1] = 3.0 if t else 0.0
            return out

        return model

    return load


def asked(folder):
    at = Path(folder) / "texts"
    return Counter(json.loads(x) for x in at.read_text().splitlines()) if at.exists() else Counter()


def profiles(spark, rows):
    return spark.createDataFrame([("r", i, n, f, c, v) for i, (n, f, c, v) in enumerate(rows)], PROFILE)


def test_vectors_of_a_model(spark, tmp_path):
    embed = embedder(loader(tmp_path), 4)
    rows = spark.createDataFrame([(i, [t] if t is not None else None) for i, t in enumerate(["alpha", "ringo", " alpha ", "", None, "other"] * 50)], "k int, v array<string>")
    got = {}
    for r in text_vectors(rows, ["k"], "v", embed).collect():
        got.setdefault(r.k % 6, set()).add((r.idx, r.w))
    assert got[0] == got[1] == got[2] == {(0, 1.0)} and got[5] == {(3, 1.0)} and 3 not in got and 4 not in got
    assert max(asked(tmp_path).values()) <= 2  # each text once, but " alpha " as well as "alpha"
    for broken in ("load", "call"):
        (tmp_path / broken).mkdir()
        zero = text_vectors(rows, ["k"], "v", embedder(loader(tmp_path / broken, broken), 4))
        assert zero.count() == 0


def test_one_model_changes_columns_fields_values_and_concepts(spark, tmp_path):
    embed = embedder(loader(tmp_path), 4)
    every = profiles(spark, [("n1", "a.csv", "alpha_zone", ["gamma one", "beta one"]), ("n2", "b.csv", "ringo_zone", ["zork", "quux"])])
    schema = json.dumps({"properties": {"Alpha measure": {"type": "string"}, "beta": {"type": "string"}}})
    fields = schema_fields(spark.createDataFrame([("r", schema)], "request_id string, schema string"))
    concepts = spark.createDataFrame([(1, "quux thing"), (2, "zork thing")], "concept_id long, label string")
    queries = spark.createDataFrame([("beta",)], "query string")
    columns = lambda e: sorted(tuple(r.columns) for r in suggest_schemaless(every, embed=e).collect())
    assert columns(None) == [("alpha_zone",), ("ringo_zone",)] and columns(embed) == [("alpha_zone", "ringo_zone")]
    assert not any("ringo_zone" in r.columns for r in suggest_schema(every, fields).collect())
    assert [r.columns for r in suggest_schema(every, fields, embed=embed).collect() if "lpha" in r.union_key] == [["alpha_zone", "ringo_zone"]]
    members = prepared(every).withColumns({"mapping": F.lit(1).cast("long"), "type": F.lit("")})
    assert [sorted(x.value for x in r.refs) for r in clustered_buckets(members, embed=embed).orderBy("bucket").collect()] == [["gamma one", "zork"], ["beta one", "quux"]]
    assert clustered_buckets(members).count() == 4
    assert nearest_concepts(queries, concepts).count() == 0
    assert [r.concept_id for r in nearest_concepts(queries, concepts, embed).collect()] == [1]


def test_answers_are_kept_once(spark, tmp_path):
    table, embed = str(tmp_path / "kept"), embedder(loader(tmp_path), 4)
    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    vectors = lambda df: {r.text: r.vector for r in df.collect()}
    first = vectors(embedded(texts("alpha", "beta", "beta", None, ""), table, embed, "1"))
    assert first.keys() == {"alpha", "beta", ""} and set(asked(tmp_path)) == {"alpha", "beta", ""}
    assert vectors(embedded(texts("alpha", "beta"), table, embed, "2")) == {t: first[t] for t in ("alpha", "beta")}
    assert asked(tmp_path)["alpha"] == 1 and asked(tmp_path)["beta"] == 1  # no call for what is known
    for _ in range(2):  # a batch that is run again replaces its own rows
        assert vectors(embedded(texts("alpha", "gamma"), table, embed, "3")).keys() == {"alpha", "gamma"}
    kept = [r.text for r in spark.read.parquet(table).collect()]
    assert sorted(kept) == ["alpha", "beta", "gamma"]  # once each; zero vectors aren't kept


def test_kept_by_a_stream(spark, tmp_path):
    for t in ("alpha", "beta", "alpha"):
        spark.createDataFrame([(t,)], "text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    embed, table = embedder(loader(tmp_path), 4), str(tmp_path / "kept")
    run = spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream
    run.foreachBatch(lambda df, n: embedded(df, table, embed, f"batch-{n}")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(table).collect()) == ["alpha", "beta"] and asked(tmp_path) == {"alpha": 1, "beta": 1}


MAPPINGS = "request_id string, ord int, union_key string, values array<struct<name:string,refs:array<struct<pos:int,column:string,value:string,lo:double,hi:double>>>>"


def mapping(i, key, *names):
    return ("r", i, key, [(n, [(0, key, n, None, None)]) for n in names])


def test_enrichment_as_a_whole(spark, tmp_path):
    rows = [mapping(0, "barthel_total", *map(str, range(0, 60, 5))), mapping(1, "Sex", "male", "female"), mapping(2, "Wibble", "0", "1")]
    mappings = spark.createDataFrame(rows, MAPPINGS)
    whole = [(123456, "Barthel total"), (654321, "Male"), (777777, "Wibble 1 walks alone"), (888888, "Female sex")]
    scans = []

    def dictionary():
        """A server that has nothing for one concept the first time."""
        scans.append(1)
        return spark.createDataFrame([r for r in whole if len(scans) > 1 or r[0] != 654321], "concept_id long, label string")

    told = []
    answers = spark.createDataFrame([("Wibble", 'Sure: {"1": "walks alone"}')], "context string, answer string")
    infer = lambda name, values: F.struct(F.lit("").alias("term"), F.create_map(F.lit("female"), F.lit("female sex")).alias("values"))
    describe = lambda name, terminology: F.when(name == "Sex", "As recorded.")
    options = {"infer": infer, "describe": describe, "answers": answers, "cache": str(tmp_path / "terms"), "fallback_codes": True}
    got = {r.union_key: r for r in enrich(mappings, dictionary, progress=lambda p, m: told.append(p), **options).collect()}
    assert got["barthel_total"].terminology == "Barthel total | 123456"
    said = {v.name: v.description for v in got["barthel_total"]["values"]}
    assert said["5"] == "Score 5 of 45 measuring Barthel total." and said["55"] == "55"  # the first ten are described
    sex = {v.name: v.terminology for v in got["Sex"]["values"]}
    assert sex == {"male": "Male | 654321", "female": "Female sex | 888888"} and got["Sex"].description == "As recorded."
    assert {v.name: v.terminology for v in got["Wibble"]["values"]}["1"] == "Wibble 1 walks alone | 777777"
    assert len(scans) == 2 and got["Sex"].terminology
    assert told[:5] == [5, 30, 35, 60, 65] and told[-1] == 100 and told == sorted(told) and all(65 <= p <= 99 for p in told[5:-1]) and len(told) > 6
    again = {r.union_key: r for r in enrich(mappings, spark.createDataFrame([], "concept_id long, label string"), **options).collect()}
    assert {k: (r.terminology, r["values"]) for k, r in again.items()} == {k: (r.terminology, r["values"]) for k, r in got.items()}  # nothing was looked up again


def test_codes_for_what_no_dictionary_has(spark):
    queries = spark.createDataFrame([("heart failure",), ("unheard of",)], "query string")
    dictionary = spark.createDataFrame([(84114007, "Heart failure")], "concept_id long, label string")
    got = {r.query: r.terminology for r in resolved(queries, dictionary, fallback=True).collect()}
    assert got["heart failure"] == "Heart failure | 84114007" and got["unheard of"].startswith("CONCEPT_")


def test_requests_from_documents(spark, tmp_path):
    """A request as clients send it: columns of several files, with and without a schema, some of them null."""
    element = lambda n, f, c, v: {"nodeId": n, "fileName": f, "column": c, "values": v, "color": "#fff"}
    files = [("n1", "fim.csv"), ("n2", "barthel.csv"), ("n2", "labs.csv")]
    columns = [element(*files[i % 3], f"{name}", ["integer", "min:0", f"max:{10 + i}"]) for i, name in enumerate(["toilet", "toileting", "bathing", "bath", "grooming", "groom"])]
    columns += [element(*files[0], "Sex", ["D", "H"]), None, element(*files[1], "sex", ["F", "M"]), element(*files[2], "notes", None)]
    (tmp_path / "one.json").write_text(json.dumps({"schema": None, "elementFiles": columns}))
    (tmp_path / "two.json").write_text(json.dumps({"request_id": "mine", "schema": "{}", "elementFiles": []}))
    requests = read_requests(spark, str(tmp_path))
    assert {r.request_id for r in requests.collect()} == {"one.json", "mine"}
    every = request_profiles(requests)
    assert every.count() == 9 and {r.pos for r in every.collect()} == {0, 1, 2, 3, 4, 5, 6, 8, 9}
    got = suggest_schemaless(every).collect()
    assert sorted(c for r in got for c in r.columns) == sorted(c["column"] for c in columns if c)
    assert ["Sex", "sex"] in [r.columns for r in got]
    refs = [x for r in got for v in r["values"] for x in v.refs if x.value]
    assert {(x.column, x.value) for x in refs} == {("Sex", "D"), ("Sex", "H"), ("sex", "F"), ("sex", "M")}
