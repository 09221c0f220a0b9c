"""Suggested mappings of the columns of each request, without a schema or towards its fields.

The result is a row for each mapping: (request_id, ord, union_key, mapping_type, columns, files, values), values being
the harmonized buckets with their refs. A mapping may have as many buckets as its sources have values, so ``parts`` gives
them apart: mappings with the number of buckets, and rows (request_id, ord, bucket, name, refs).

``texts`` (request_id, pos, value) are all values of columns whose profiles hold samples alone.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import union_name
from ..operators.clustering import cluster_columns
from ..operators.matching import best_fields, column_prompts, field_prompts, one_per_file, round_robin_batches, uncovered
from ..operators.models import Embed, text_vectors
from ..operators.noise import leading_contexts, with_concepts, without_contexts
from ..operators.values import harmonized
from ..runtime import durable, python_path
from ..settings import Settings
from ..sources.profile import column_stats


def prepared(profiles: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Profiles with concept, contexts taken off, stats and file_key."""
    rows = without_contexts(with_concepts(profiles, settings)).drop("contexts")
    return rows.withColumns({"stats": column_stats(F.col("values")), "file_key": F.concat_ws("::", "node_id", "file_name")})


def unique_names(named: DataFrame) -> DataFrame:
    """Rows (request_id, ord, base) with union_key: a number is appended to names that are taken, in order. The names
    of one request are few and depend on each other, so a request is named in one task."""
    python_path(named.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        keys = []
        pdf = pdf.sort_values("ord")
        for base in pdf["base"]:
            base = base or "field"
            key, n = base, 2
            while key in used:
                key, n = f"{base}_{n}", n + 1
            used.add(key)
            keys.append(key)
        return pdf.assign(union_key=keys)[["request_id", "ord", "union_key"]]

    return named.select("request_id", "ord", "base").groupBy("request_id").applyInPandas(run, "request_id string, ord int, union_key string")


def _base_name(fallback: Column) -> Column:
    """The columns' own name where all share it but for case and punctuation, else the fallback."""
    same = F.countDistinct(F.lower(F.regexp_replace("column", "[^A-Za-z0-9]+", ""))) == 1
    own = F.min_by("column", "pos")
    return F.coalesce(F.nullif(union_name(F.when(same, own).otherwise(fallback)), F.lit("")), F.lit("field"))


Parts = tuple[DataFrame, DataFrame]


def assembled(members: DataFrame, enums: DataFrame | None, embed: Embed | None = None, texts: DataFrame | None = None) -> Parts:
    """Members (request_id, mapping, label, pos, ...) to mappings with unique names, and their buckets."""
    members = durable(members)
    buckets = harmonized(members.drop("label"), enums, embed, texts)
    values = buckets.groupBy("request_id", "mapping").agg(F.first("kind").alias("kind"), F.count("*").cast("int").alias("buckets"))
    whole = members.groupBy("request_id", "mapping").agg(
        F.max("type").alias("mapping_type"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "column"))), lambda x: x["column"]).alias("columns"),
        F.array_sort(F.collect_set("file_key")).alias("files"),
        _base_name(F.first("label")).alias("base"),
    )
    order = Window.partitionBy("request_id").orderBy("mapping")
    whole = whole.withColumn("ord", F.row_number().over(order).cast("int"))
    named = durable(whole.join(unique_names(whole), ["request_id", "ord"]).join(values, ["request_id", "mapping"], "left"))
    buckets = buckets.join(named.select("request_id", "mapping", "ord"), ["request_id", "mapping"]).select("request_id", "ord", "bucket", "name", "refs")
    return named.select("request_id", "ord", "union_key", "mapping_type", "kind", "columns", "files", "buckets"), buckets


def joined(mappings: DataFrame, buckets: DataFrame) -> DataFrame:
    """Mappings with their buckets as an array."""
    values = buckets.groupBy("request_id", "ord").agg(F.array_sort(F.collect_list(F.struct("bucket", "name", "refs"))).alias("values"))
    return mappings.drop("buckets").join(values, ["request_id", "ord"], "left")


def _mapping_type(rows: DataFrame) -> DataFrame:
    """The type of a mapping: any date, else any double, else any integer among its members."""
    rank = F.when(F.col("stats.has_date"), 3).when(F.col("stats.has_double"), 2).when(F.col("stats.has_int"), 1).otherwise(0)
    top = F.max(rank).over(Window.partitionBy("request_id", "mapping"))
    return rows.withColumn("type", F.when(top == 3, "date").when(top == 2, "double").when(top == 1, "integer").otherwise(""))


def suggest_schemaless(profiles: DataFrame, settings: Settings = Settings(), vectors: DataFrame | None = None, embed: Embed | None = None, texts: DataFrame | None = None) -> DataFrame:
    """``schemaless_parts``, a row a mapping."""
    return joined(*schemaless_parts(profiles, settings, vectors, embed, texts))


def schemaless_parts(profiles: DataFrame, settings: Settings = Settings(), vectors: DataFrame | None = None, embed: Embed | None = None, texts: DataFrame | None = None) -> Parts:
    """Cluster the columns; each cluster gives up to six batches of one column a file; the largest 40 clusters count,
    and every column that none of them holds gets a mapping of its own. ``embed`` (operators.models) gives the vectors of
    columns, unless they come as ``vectors``, and of values."""
    columns = durable(prepared(profiles, settings))
    if vectors is None and embed is not None:
        vectors = text_vectors(column_prompts(columns), ["request_id", "pos"], "prompts", embed)
    clusters = durable(cluster_columns(columns, settings, vectors))
    sizes = clusters.groupBy("request_id", "cluster").agg(F.count("*").alias("n"), F.first("representative").alias("label"))
    by_size = Window.partitionBy("request_id").orderBy(F.desc("n"), F.lower("label"), "cluster")
    sizes = sizes.withColumn("rank", F.row_number().over(by_size)).where(F.col("rank") <= settings.max_clusters)
    placed = columns.join(clusters.select("request_id", "pos", "cluster", "sim"), ["request_id", "pos"]).join(sizes, ["request_id", "cluster"])
    batches = round_robin_batches(placed, ["request_id", "cluster"]).where(F.col("batch") <= settings.batches_per_cluster)
    batches = batches.withColumn("mapping", (F.col("rank") * 1000 + F.col("batch")).cast("long"))
    left = uncovered(columns, batches.select("request_id", "file_key", "column").distinct())
    left = left.withColumns({"mapping": (F.lit(10_000_000) + F.col("pos")).cast("long"), "label": F.coalesce(F.nullif("concept", F.lit("")), "column")})
    keep = ["request_id", "mapping", "label", "pos", "file_key", "column", "concept", "values", "stats"]
    return assembled(_mapping_type(batches.select(*keep).unionByName(left.select(*keep))), None, embed, texts)


def suggest_schema(profiles: DataFrame, fields: DataFrame, settings: Settings = Settings(), embed: Embed | None = None, texts: DataFrame | None = None) -> DataFrame:
    """``schema_parts``, a row a mapping."""
    return joined(*schema_parts(profiles, fields, settings, embed, texts))


def schema_parts(profiles: DataFrame, fields: DataFrame, settings: Settings = Settings(), embed: Embed | None = None, texts: DataFrame | None = None) -> Parts:
    """Match columns to the schema fields of their request, the best column of each file; what matches nothing is left
    out. ``fields`` are those of sources.json_schema."""
    columns = durable(prepared(profiles, settings))
    vectors = None
    if embed is not None:
        vectors = text_vectors(column_prompts(columns), ["request_id", "pos"], "prompts", embed), text_vectors(field_prompts(fields), ["request_id", "field_pos"], "prompts", embed)
    matched = best_fields(columns, fields, leading_contexts(profiles), vectors)
    rows = columns.join(matched, ["request_id", "pos"])
    rows = one_per_file(rows, ["request_id", "field_pos"], settings)
    rows = rows.join(fields.select("request_id", "field_pos", F.lower("type").alias("type"), "enum_values"), ["request_id", "field_pos"])
    members = rows.select("request_id", F.col("field_pos").cast("long").alias("mapping"), F.col("name").alias("label"), "pos", "file_key", "column", "concept", "values", "stats", "type")
    enums = fields.select("request_id", F.col("field_pos").cast("long").alias("mapping"), F.posexplode("enum_values").alias("enum_pos", "enum"))
    return assembled(members, enums, embed, texts)


def _members_response(rows: DataFrame) -> DataFrame:
    """Rows (request_id, ord, m, json text) as the response of each request, in order."""
    listed = rows.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.to_json("m").alias("j")))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["j"]), ",")
    return listed.select("request_id", F.concat(F.lit('{"success":true,"message":"Suggestions computed.","hierarchy":['), text, F.lit("]}")).alias("json"))


def hierarchy_json(mappings: DataFrame, profiles: DataFrame, enriched: DataFrame | None = None, requests: DataFrame | None = None) -> DataFrame:
    """(request_id, json): the response of each request in the shape that clients read, mappings in order.

    Each ref names its node, file and column out of ``profiles``; ``enriched`` (plans.enrich) gives terminology and
    descriptions, which are empty without it. Requests of ``requests`` without a mapping get an empty hierarchy and say so."""
    key = ["request_id", "ord"]
    flat = mappings.select(*key, F.posexplode_outer("values").alias("v", "x")).select(*key, "v", F.col("x.name").alias("name"), F.posexplode_outer("x.refs").alias("n", "r"))
    source = profiles.select("request_id", F.col("pos").cast("int").alias("pos"), "node_id", "file_name")
    flat = flat.withColumn("pos", F.col("r.pos")).join(source, ["request_id", "pos"], "left")
    value = F.coalesce("r.value", F.to_json(F.struct(F.col("r.lo").alias("minValue"), F.col("r.hi").alias("maxValue"))))
    ref = F.struct(F.concat_ws("::", "node_id", "file_name").alias("groupKey"), F.col("r.column").alias("groupColumn"), F.col("file_name").alias("fileName"), F.col("node_id").alias("nodeId"), value.alias("value"))
    refs = F.array_sort(F.collect_list(F.when(F.col("r").isNotNull(), F.struct("n", ref.alias("ref")))))
    values = flat.where("v is not null").groupBy(*key, "v", "name").agg(F.transform(refs, lambda x: x["ref"]).alias("mapping"))
    if enriched is not None:
        said = enriched.select(*key, F.posexplode("values").alias("v", "e")).select(*key, "v", "e.terminology", "e.description")
        values = values.join(said, [*key, "v"], "left")
    else:
        values = values.withColumns({"terminology": F.lit(""), "description": F.lit("")})
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    values = values.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("v", "name", text("terminology"), text("description"), "mapping"))).alias("l"))
    shown = F.transform("l", lambda x: F.struct(x["name"].alias("name"), x["terminology"].alias("terminology"), x["description"].alias("description"), x["mapping"].alias("mapping")))
    rows = mappings.drop("values").join(values.select(*key, shown.alias("values")), key, "left")
    rows = rows.join(enriched.select(*key, "terminology", "description"), key, "left") if enriched is not None else rows.withColumns({"terminology": F.lit(""), "description": F.lit("")})
    body = F.struct(
        F.lit("standard").alias("mappingType"), F.lit("suggested_mapping").alias("fileName"), F.lit("").alias("nodeId"), "columns", text("terminology"), text("description"),
        F.array(F.struct(F.col("union_key").alias("column"), F.coalesce("values", F.array()).alias("values"))).alias("groups"),
    )
    out = _members_response(rows.select(*key, F.create_map("union_key", body).alias("m")))
    if requests is None:
        return out
    nothing = F.lit('{"success":true,"message":"No suggestions produced.","hierarchy":[]}')
    return requests.select("request_id").distinct().join(out, "request_id", "left").withColumn("json", F.coalesce("json", nothing))


def mapping_csv(mappings: DataFrame, path: str) -> None:
    """Write one line for each ref: request, key, bucket, column, value."""
    rows = mappings.select("request_id", "union_key", F.explode("values").alias("v")).select("request_id", "union_key", F.col("v.name").alias("bucket"), F.explode("v.refs").alias("r"))
    rows.select("request_id", "union_key", "bucket", "r.column", F.coalesce("r.value", F.concat_ws("..", "r.lo", "r.hi")).alias("value")).write.mode("overwrite").option("header", True).csv(path)


def n_triples(mappings: DataFrame, base: str = "urn:mapping:") -> DataFrame:
    """(value): N-Triples that say which columns belong to which key. The vocabulary is this library's own."""
    key = F.concat(F.lit(f"<{base}"), F.col("request_id"), F.lit("/"), F.col("union_key"), F.lit(">"))
    column = F.regexp_replace(F.regexp_replace(F.regexp_replace("c", r'(["\\])', r"\\$1"), "\n", r"\\n"), "\r", r"\\r")
    return mappings.select("request_id", "union_key", F.explode("columns").alias("c")).select(F.concat(key, F.lit(f' <{base}hasColumn> "'), column, F.lit('" .')).alias("value"))



