"""Profiles of columns: from requests in JSON, and from real tables.

A profile is (request_id string, pos int, node_id, file_name, column string, values array<string>). Values are distinct
samples of a text column, or markers: integer | double, min:, max:, step: for numbers, date, earliest:, latest: for times.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sketch import kind_of, merge_sketches, profiles_of, sketch_table

PROFILE = "request_id string, pos int, node_id string, file_name string, column string, values array<string>"
REQUEST = "request_id string, schema string, elementFiles array<struct<nodeId:string,fileName:string,column:string,values:array<string>,color:string>>"


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests, one JSON document a file or line; a missing request_id becomes the file's name."""
    raw = spark.read.schema(REQUEST).option("multiLine", True).json(path)
    return raw.withColumn("request_id", F.coalesce("request_id", F.col("_metadata.file_name")))


def request_profiles(requests: DataFrame) -> DataFrame:
    """A row for each column that isn't null, in the order of the request."""
    rows = requests.select("request_id", F.posexplode("elementFiles").alias("pos", "x")).where("x is not null")
    return rows.select("request_id", "pos", F.col("x.nodeId").alias("node_id"), F.col("x.fileName").alias("file_name"), F.col("x.column").alias("column"), F.coalesce("x.values", F.array().cast("array<string>")).alias("values"))


def profile_table(df: DataFrame, file_name: str, node_id: str, first: int, request_id: str = "tables") -> DataFrame:
    """Profile all columns of a table in one pass; an empty table has profiles too."""
    return _profiles([sketch_table(df, file_name, node_id, first, request_id)], {(file_name, node_id, first): df}, request_id)


def profile_tables(tables: dict[str, DataFrame], request_id: str = "tables") -> DataFrame:
    """One request over several tables, in one job; each is a file of a node of its own."""
    named, parts, first = {}, [], 0
    for k, (name, df) in enumerate(tables.items()):
        named[f"{name}.csv", f"node-{k}", first] = df
        parts.append(sketch_table(df, f"{name}.csv", f"node-{k}", first, request_id))
        first += len(df.columns)
    return _profiles(parts, named, request_id)


def _profiles(parts: list[DataFrame], tables: dict[tuple[str, str, int], DataFrame], request_id: str) -> DataFrame:
    spark = parts[0].sparkSession
    found = profiles_of(merge_sketches(reduce(DataFrame.unionByName, parts)))
    every = [(request_id, first + i, node_id, file_name, f.name, kind_of(f.dataType)) for (file_name, node_id, first), df in tables.items() for i, f in enumerate(df.schema.fields)]
    names = spark.createDataFrame(every, "request_id string, pos int, node_id string, file_name string, column string, kind string")  # a row a column
    kind = F.when(F.col("kind").isin("integer", "double", "date"), F.array("kind")).otherwise(F.array().cast("array<string>"))
    rows = F.broadcast(names).join(found.select("request_id", "pos", "values"), ["request_id", "pos"], "left")
    return rows.select("request_id", "pos", "node_id", "file_name", "column", F.coalesce("values", kind).alias("values"))


def column_stats(values):
    """struct of the markers of a profile's values; of several markers of a kind the last one that parses counts."""
    v = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))

    def last(prefix: str, parse):
        hits = F.filter(F.transform(F.filter(v, lambda x: x.startswith(prefix)), lambda x: parse(F.trim(F.substring(x, F.lit(len(prefix) + 1), F.length(x))))), lambda x: x.isNotNull())
        return F.get(hits, F.size(hits) - 1)

    number = lambda x: F.when(x.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"), x.try_cast("double"))
    instant = lambda x: F.unix_millis(F.upper(x).try_cast("timestamp"))
    return F.struct(
        F.array_contains(v, "integer").alias("has_int"),
        F.array_contains(v, "double").alias("has_double"),
        F.array_contains(v, "date").alias("has_date"),
        last("min:", number).alias("num_min"),
        last("max:", number).alias("num_max"),
        last("earliest:", instant).alias("date_min_ms"),
        last("latest:", instant).alias("date_max_ms"),
        last("step:", lambda x: x.try_cast("int")).alias("step_hint"),
    )


def inferred_type(stats):
    """Any date, else any double, else any integer; '' for categories."""
    return F.when(stats["has_date"], "date").when(stats["has_double"], "double").when(stats["has_int"], "integer").otherwise("")
