"""JSON Schema documents to fields: (request_id, field_pos, name, type, description, enum_values)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed


def _unwrapped(text: Column) -> Column:
    """A document that stands in a JSON string, up to three deep."""
    for _ in range(3):
        text = F.when(F.trim(text).rlike(r'^"'), F.get_json_object(F.concat(F.lit('{"x":'), text, F.lit("}")), "$.x")).otherwise(text)
    inner = F.get_json_object(text, "$.schema")
    return F.when(inner.isNotNull() & F.get_json_object(text, "$.properties").isNull(), inner).otherwise(text)


def _member(json: Column, key: str) -> Column:
    return F.get_json_object(json, f"$.{key}")


def _strings(json: Column) -> Column:
    return F.from_json(json, "array<string>")


def _scalar(json: Column) -> Column:
    """A type that is a name, or a list of names with null."""
    raw = _member(json, "type")
    listed = F.filter(_strings(raw), lambda x: x != "null")
    return F.when(raw.rlike(r"^\s*\["), F.get(listed, F.lit(0))).otherwise(raw)


def _type(json: Column, depth: int = 2) -> Column:
    plain = _scalar(json)
    if depth:
        inner = F.coalesce(_type(_member(json, "items"), depth - 1), F.lit(""))
        plain = F.when(plain == "array", F.when(inner != "", F.concat(F.lit("array<"), inner, F.lit(">"))).otherwise("array")).otherwise(plain)
    options = F.coalesce(_strings(_member(json, "anyOf")), _strings(_member(json, "oneOf")))
    union = F.array_distinct(F.filter(F.transform(options, _scalar), lambda x: x.isNotNull() & (x != "null")))
    return F.coalesce(plain, F.when(F.size(union) > 0, F.array_join(union, "|")), F.lit(""))


def schema_fields(requests: DataFrame, max_enum: int = 120) -> DataFrame:
    """Properties of each request's schema in document order. A schema that doesn't parse, or none, gives no fields."""
    rows = requests.select("request_id", _member(_unwrapped(F.col("schema")), "properties").alias("p"))
    rows = rows.select("request_id", "p", F.posexplode(F.json_object_keys("p")).alias("field_pos", "name"))
    document = F.col("m")[F.col("name")]
    rows = rows.withColumn("m", F.from_json("p", "map<string,string>")).withColumn("d", document)
    values = F.filter(F.transform(_strings(_member(F.col("d"), "enum")), trimmed), lambda x: x != "")
    description = F.coalesce(trimmed(_member(F.col("d"), "description")), F.lit(""))
    return rows.select("request_id", "field_pos", "name", _type(F.col("d")).alias("type"), description.alias("description"), F.coalesce(F.slice(values, 1, max_enum), F.array().cast("array<string>")).alias("enum_values"))
