import json

import pytest
from pyspark.sql import functions as F

from tessera.operators.clustering import is_abbreviation_pair
from tessera.operators.matching import best_fields
from tessera.operators.noise import leading_contexts
from tessera.operators.values import closed_domain_components, clustered_buckets, enum_buckets, harmonized, identity_buckets
from tessera.plans.enrich import enrich
from tessera.plans.suggest import hierarchy_json, mapping_csv, n_triples, prepared, suggest_schema, suggest_schemaless
from tessera.sources.json_schema import schema_fields
from tessera.sources.profile import PROFILE, column_stats


def profiles(spark, rows):
    return spark.createDataFrame([(r, i, n, f, c, v) for i, (r, n, f, c, v) in enumerate(rows)], PROFILE)


INT = lambda lo, hi: ["integer", f"min:{lo}", f"max:{hi}"]
ROWS = [
    ("r1", "n1", "a.csv", "BarthelTotal", INT(0, 100)),
    ("r1", "n2", "b.csv", "barthel_total", INT(0, 100)),
    ("r1", "n1", "a.csv", "Sex", ["M", "F"]),
    ("r1", "n2", "b.csv", "sex", ["male", "female"]),
    ("r1", "n1", "a.csv", "admission_date", ["date", "earliest:2020-01-01T00:00:00Z", "latest:2021-01-01T00:00:00Z"]),
    ("r1", "n2", "b.csv", "toilet_use", INT(0, 10)),
    ("r1", "n1", "a.csv", "toilet", INT(1, 7)),
    ("r1", "n1", "a.csv", "notes", []),
    ("r2", "n1", "a.csv", "x", ["y", "n"]),
]


def test_schemaless_covers_each_column_once_a_file(spark):
    got = suggest_schemaless(profiles(spark, ROWS)).collect()
    assert {(r.request_id, c) for r in got for c in r.columns} == {(r, c) for r, _, _, c, _ in ROWS}
    for request in ("r1", "r2"):
        keys = [r.union_key for r in got if r.request_id == request]
        assert len(keys) == len(set(keys)) and all(keys)
    assert all(r["values"] for r in got)
    by = {tuple(r.columns): r for r in got}
    sex = by["Sex", "sex"]
    assert {v.name for v in sex["values"]} == {"male", "female"} and sex.kind == "closed"
    assert by["BarthelTotal", "barthel_total"].kind == "ordinal" and len(by["BarthelTotal", "barthel_total"]["values"]) == 21
    assert by["admission_date",].mapping_type == "date"


def test_response_and_triples(spark):
    every = profiles(spark, ROWS[:4])
    got = suggest_schemaless(every)
    asked = spark.createDataFrame([("r1",), ("r9",)], "request_id string")
    dictionary = spark.createDataFrame([(123456, "Barthel total")], "concept_id long, label string")
    said = {r.request_id: json.loads(r.json) for r in hierarchy_json(got, every, enrich(got, dictionary), asked).collect()}
    assert said["r9"] == {"success": True, "message": "No suggestions produced.", "hierarchy": []} and said["r1"]["message"] == "Suggestions computed."
    flat = {k: m for one in said["r1"]["hierarchy"] for k, m in one.items()}
    barthel = next(m for k, m in flat.items() if "arthel" in k)
    assert barthel["terminology"] == "Barthel total | 123456" and barthel["mappingType"] == "standard" and barthel["fileName"] == "suggested_mapping"
    refs = [r for m in flat.values() for g in m["groups"] for v in g["values"] for r in v["mapping"]]
    assert {(r["nodeId"], r["fileName"], r["groupColumn"]) for r in refs} == {(n, f, c) for _, n, f, c, _ in ROWS[:4]}
    assert all(r["groupKey"] == f"{r['nodeId']}::{r['fileName']}" for r in refs)
    assert n_triples(got).count() == 4


SCHEMA = """{"schema": {"properties": {"sex": {"type": ["string", "null"], "enum": ["male", "female"]},
 "zeta": {"type": "array", "items": {"type": "integer"}}, "age": {"description": "Age in years", "type": "integer"},
 "birth_date": {"type": "string", "format": "date"}, "u": {"anyOf": [{"type": "string"}, {"type": "null"}, {"type": "number"}]}}}}"""


def requests(spark):
    import json

    return spark.createDataFrame([("r1", SCHEMA), ("r2", json.dumps(SCHEMA)), ("r3", "not json"), ("r4", None)], "request_id string, schema string")


def test_schema_fields(spark):
    got = schema_fields(requests(spark)).collect()
    for request in ("r1", "r2"):
        rows = sorted((r for r in got if r.request_id == request), key=lambda r: r.field_pos)
        assert [(r.name, r.type) for r in rows] == [("sex", "string"), ("zeta", "array<integer>"), ("age", "integer"), ("birth_date", "string"), ("u", "string|number")]
        assert rows[0].enum_values == ["male", "female"] and rows[2].description == "Age in years"
    assert {r.request_id for r in got} == {"r1", "r2"}


def test_schema_guided(spark):
    rows = [*ROWS[2:4], ("r1", "n1", "a.csv", "Age", INT(1, 99)), ("r1", "n1", "a.csv", "age_years", INT(1, 99)), ("r1", "n2", "b.csv", "visit_date", ["date"]), ("r1", "n2", "b.csv", "age", ["young", "old"])]
    got = suggest_schema(profiles(spark, rows), schema_fields(requests(spark))).collect()
    by = {r.union_key: r for r in got}
    assert sorted(by["sex"].columns if "sex" in by else by["Sex"].columns) == ["Sex", "sex"]
    # One column a file, the most similar one (not the best kind of match); a column of words is no integer.
    matched = best_fields(prepared(profiles(spark, rows)), schema_fields(requests(spark)), leading_contexts(profiles(spark, rows))).where("name = 'age'").collect()
    closest = max(matched, key=lambda r: (r.sim, -r.pos))
    assert {r.pos for r in matched} == {2, 3} and [r.columns for r in got if {"Age", "age_years", "age"} & set(r.columns)] == [[rows[closest.pos][3]]]
    assert not any("visit_date" in r.columns for r in got)


def test_enrichment(spark):
    dictionary = spark.createDataFrame([(123456, "Barthel total"), (654321, "Male"), (77, "Female")], "concept_id long, label string")
    got = {r.union_key: r for r in enrich(suggest_schemaless(profiles(spark, ROWS[:4])), dictionary).collect()}
    barthel = next(r for k, r in got.items() if "arthel" in k)
    assert barthel.terminology == "Barthel total | 123456" and barthel.description == "Barthel total."
    assert barthel["values"][1].description == "Score 5 of 45 measuring Barthel total."  # of its first ten values, as those are described
    sex = next(r for k, r in got.items() if "ex" in k)
    assert {v.name: v.terminology for v in sex["values"]} == {"male": "Male | 654321", "female": ""}


@pytest.mark.parametrize(("a", "b", "yes"), [("toilet", "toileting", True), ("hr", "heart rate", True), ("groom", "grooming", True), ("stairs", "bladder", False), ("bp", "heart rate", False)])
def test_abbreviations(a, b, yes):
    assert is_abbreviation_pair(a, b, a.split(), b.split()) == yes == is_abbreviation_pair(b, a, b.split(), a.split())


def test_values_of_one_source_stay_apart(spark):
    values = [f"value number {i}" for i in range(26)]
    rows = prepared(profiles(spark, [("r", "n1", "a.csv", "col", values), ("r", "n2", "b.csv", "col", values[:3])]))
    members = rows.withColumns({"mapping": F.lit(1).cast("long"), "type": F.lit("")}).select("request_id", "mapping", "pos", "file_key", "column", "concept", "values", "stats", "type")
    got = harmonized(members).collect()
    assert len(got) == 26 and {r.kind for r in got} == {"clustered"}


def test_refs_carry_the_values_of_the_source(spark, tmp_path):
    """As clients look their values up again: in their own case, and once for each time that they stand there."""
    rows = [("r", "n1", "a.csv", "Sex", ["Male", "FEMALE", "male"]), ("r", "n2", "b.csv", "sex", ["M", "F"])]
    every = profiles(spark, rows)
    got = suggest_schemaless(every)
    (one,) = got.collect()
    assert one.kind == "closed"
    assert {v.name: [(x.column, x.value) for x in v.refs] for v in one["values"]} == {"male": [("Sex", "Male"), ("Sex", "male"), ("sex", "M")], "female": [("Sex", "FEMALE"), ("sex", "F")]}
    (said,) = hierarchy_json(got, every).collect()
    refs = [x["value"] for m in json.loads(said.json)["hierarchy"] for one in m.values() for g in one["groups"] for v in g["values"] for x in v["mapping"]]
    assert sorted(refs) == ["F", "FEMALE", "M", "Male", "male"]
    mapping_csv(got, str(tmp_path / "csv"))
    assert sorted(r.value for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()) == sorted(refs)


def members_of(spark, *sources):
    rows = prepared(profiles(spark, [("r", f"n{i}", "a.csv" if i == 0 else "b.csv", "col", v) for i, v in enumerate(sources)]))
    return rows.withColumns({"mapping": F.lit(1).cast("long"), "type": F.lit("")}).select("request_id", "mapping", "pos", "file_key", "column", "concept", "values", "stats", "type")


def test_raw_values_of_every_plan(spark):
    flat = lambda df: sorted((r.name, x.value) for r in df.collect() for x in r.refs)
    one = members_of(spark, ["Yes ", "NO", "no", "integer", "", None])
    assert flat(identity_buckets(one)) == [("no", "NO"), ("no", "no"), ("yes", "Yes ")]
    enums = spark.createDataFrame([("r", 1, 0, "yes"), ("r", 1, 1, "no")], "request_id string, mapping long, enum_pos int, enum string")
    assert flat(enum_buckets(one, enums)) == [("no", "NO"), ("no", "no"), ("yes", "Yes ")]
    many = members_of(spark, ["Value-A", "VALUE A"], ["value_a"])
    assert flat(clustered_buckets(many)) == [("value a", "VALUE A"), ("value a", "Value-A"), ("value a", "value_a")]


def test_components_of_chains(spark):
    chain = members_of(spark, ["Ischemic", "hemorrhagic"], ["isch"], ["hem", "other"])
    roots = {r.t: r.root for r in closed_domain_components(chain).collect()}
    assert roots["isch"] == roots["ischemic"] == "isch" and roots["hem"] == roots["hemorrhagic"] == "hem" and roots["other"] == "other"


def test_markers(spark):
    row = profiles(spark, [("r", "n", "f", "c", ["Integer", "min:x", "min:1", "max:2.5e1", "step:5", "earliest:2024-01-01T00:00:00Z", "max:nan"])]).select(column_stats(F.col("values")).alias("s")).first().s
    assert (row.has_int, row.has_double, row.num_min, row.num_max, row.step_hint, row.date_min_ms) == (True, False, 1.0, 25.0, 5, 1704067200000)
