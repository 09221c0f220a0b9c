"""Mergeable sketches of columns: what a profile needs to know, of parts of tables that are merged without reading them
again - by task, by file, by day.

A sketch row has bounds, counts, the longest length, an anchor value and the greatest common divisor of all differences
from it (the step of an integer column), and the smallest distinct texts, unless one is free text. Two sketches of a
column merge to the sketch of both parts' rows: steps by gcd(step, step', anchor - anchor'), the rest by minimum, maximum,
sum and the smallest of both. Free text counts by its length alone, so no task's Python meets the texts themselves.

A sketch's texts are samples, for names, roles and vectors of columns. What needs every category of a column takes the
rows of ``column_texts``, which have all of them however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import durable, python_path

SAMPLES = 80  # texts of a column that are kept: the smallest
FREE_TEXT = 200  # a column with a longer value holds free text, not categories
KEY = ["request_id", "node_id", "file_name", "pos", "column", "kind"]
SKETCH = "n long, nulls long, lo_i long, hi_i long, lo_d double, hi_d double, anchor long, step long, longest int, least array<string>"
_FIELDS = [x.split()[0] for x in SKETCH.split(", ")]
_SALTS = 64


def kind_of(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, T.NumericType):
        return "double"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "text" if isinstance(kind, T.StringType) else "other"


def _comparable(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    n = F.length(c)
    text = F.when(c.isNotNull(), F.struct(F.when(n <= FREE_TEXT, c).alias("short"), n.alias("n")))
    return {"integer": c.cast("bigint"), "double": c.cast("double"), "date": F.unix_micros(c.cast("timestamp")), "text": text}.get(kind, c.isNull()).alias(name)


def _free(sketch: dict) -> bool:
    return (sketch["longest"] or 0) > FREE_TEXT


def _merge_two(a: dict, b: dict) -> dict:
    def ends(f, x, y):
        return y if x is None else x if y is None else f(x, y)

    out = {c: a[c] + b[c] for c in ("n", "nulls")} | {c: ends(min, a[c], b[c]) for c in ("lo_i", "lo_d")} | {c: ends(max, a[c], b[c]) for c in ("hi_i", "hi_d", "longest")}
    out["least"] = [] if _free(out) else sorted({*a["least"], *b["least"]}, key=lambda s: s.encode("utf-8", "surrogatepass"))[:SAMPLES]
    if a["anchor"] is None or b["anchor"] is None:
        one = b if a["anchor"] is None else a
        return out | {"anchor": one["anchor"], "step": one["step"]}
    return out | {"anchor": a["anchor"], "step": gcd(a["step"], b["step"], a["anchor"] - b["anchor"])}


def _sketch(column: pa.Array, kind: str) -> dict:
    out = dict.fromkeys(_FIELDS) | {"n": len(column), "nulls": column.null_count, "least": []}
    if kind == "other":
        return out | {"nulls": int(pc.sum(column).as_py() or 0)}
    column = column.drop_null()
    if not len(column):
        return out
    if kind == "text":
        out["longest"] = int(pc.max(pc.struct_field(column, "n")).as_py())
        if _free(out):
            return out
        found = pc.struct_field(column, "short").unique().cast(pa.string())
        return out | {"least": found.take(pc.array_sort_indices(found)[:SAMPLES]).to_pylist()}
    ends = pc.min_max(column).as_py()
    if kind == "double":
        return out | {"lo_d": ends["min"], "hi_d": ends["max"]}
    values, wide = column.to_numpy(zero_copy_only=False), ends["max"] - ends["min"] >= 2**63
    step = 1 if wide else int(np.gcd.reduce(np.abs(values - values[0])))
    return out | {"lo_i": ends["min"], "hi_i": ends["max"], "anchor": int(values[0]), "step": step}


def sketch_table(df: DataFrame, file_name: str, node_id: str, first: int = 0, request_id: str = "tables") -> DataFrame:
    """A sketch row for each column and task of a table, in one pass over it; columns are numbered from ``first``."""
    python_path(df.sparkSession)
    fields = [(first + i, f.name, kind_of(f.dataType)) for i, f in enumerate(df.schema.fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}
        for batch in batches:
            for k, (_, _, kind) in enumerate(fields):
                new = _sketch(batch.column(k), kind)
                held[k] = _merge_two(held[k], new) if k in held else new
        if held:
            names = [{"request_id": request_id, "node_id": node_id, "file_name": file_name, "pos": p, "column": c, "kind": kind} for p, c, kind in fields]
            yield pa.RecordBatch.from_pylist([n | held[k] for k, n in enumerate(names)], schema=_SCHEMA)

    return df.select(*(_comparable(n, kind) for _, n, kind in fields)).mapInArrow(run, f"request_id string, node_id string, file_name string, pos int, column string, kind string, {SKETCH}")


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
_SCHEMA = pa.schema([(c, pa.int32() if c == "pos" else pa.string()) for c in KEY] + [(x.split()[0], _TYPES[x.split()[1]]) for x in SKETCH.split(", ")])


def sketch_tables(tables: dict[str, DataFrame], request_id: str = "tables") -> DataFrame:
    """Sketches of several tables as one request; each table is a file of a node of its own."""
    parts, first = [], 0
    for k, (name, df) in enumerate(tables.items()):
        parts.append(sketch_table(df, f"{name}.csv", f"node-{k}", first, request_id))
        first += len(df.columns)
    return reduce(DataFrame.unionByName, parts)


def column_texts(tables: dict[str, DataFrame], request_id: str = "tables") -> DataFrame:
    """(request_id, pos, value): all distinct texts of the columns of categories, a row each; columns are numbered as by
    ``sketch_tables``. A column that a text makes free text has none, as in sketches."""
    parts, first = [], 0
    for df in tables.values():
        named = [(first + i, f.name) for i, f in enumerate(df.schema.fields) if kind_of(f.dataType) == "text"]
        first += len(df.columns)
        if named:
            each = df.select(F.inline(F.array(*(F.struct(F.lit(p).alias("pos"), F.col(f"`{c}`").alias("value")) for p, c in named)))).where("value is not null")
            parts.append(each.select("pos", F.when(F.length("value") <= FREE_TEXT, F.col("value")).alias("value")))
    if not parts:
        return next(iter(tables.values())).sparkSession.createDataFrame([], "request_id string, pos int, value string")
    every = durable(reduce(DataFrame.unionByName, parts).distinct())
    free = every.where("value is null").select("pos")
    return every.join(F.broadcast(free), "pos", "left_anti").select(F.lit(request_id).alias("request_id"), "pos", "value")  # a row a column


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """One row for each column: the sketch of all its parts. Parts are merged in groups first, so that one task gets few
    rows of a column however many parts it has."""
    python_path(sketches.sparkSession)
    schema = f"request_id string, node_id string, file_name string, pos int, column string, kind string, {SKETCH}"

    def run(table: pa.Table) -> pa.Table:
        rows = table.select([*KEY, *_FIELDS]).to_pylist()
        return pa.Table.from_pylist([{c: rows[0][c] for c in KEY} | reduce(_merge_two, ({c: r[c] for c in _FIELDS} for r in rows))], schema=_SCHEMA)

    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(_SALTS))
    some = sketches.withColumn("salt", salt).groupBy(*KEY, "salt").applyInArrow(run, schema)
    return some.groupBy(*KEY).applyInArrow(run, schema)


def profiles_of(merged: DataFrame) -> DataFrame:
    """Profiles (sources.profile) of merged sketches: markers for numbers and times, with the step of integers where it
    is above one; the smallest distinct texts of columns of categories; nothing for free text and other types."""
    iso = lambda c: F.concat(F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    number = lambda c: F.format_string("%.4f", c)
    kind, marked = F.col("kind"), lambda name, value: F.concat(F.lit(f"{name}:"), value)
    step = F.when(F.col("step") > 1, marked("step", F.col("step").cast("string")))
    values = (
        F.when(kind == "integer", F.array(kind, marked("min", F.col("lo_i").cast("string")), marked("max", F.col("hi_i").cast("string")), step))
        .when(kind == "double", F.array(kind, marked("min", F.when(F.col("lo_d").isNotNull(), number(F.col("lo_d")))), marked("max", F.when(F.col("hi_d").isNotNull(), number(F.col("hi_d"))))))
        .when(kind == "date", F.array(kind, marked("earliest", iso(F.col("lo_i"))), marked("latest", iso(F.col("hi_i")))))
        .when((kind == "text") & (F.col("longest") <= FREE_TEXT), F.col("least"))
        .otherwise(F.array().cast("array<string>"))
    )
    return merged.select("request_id", "pos", "node_id", "file_name", "column", F.filter(values, lambda x: x.isNotNull()).alias("values"))
