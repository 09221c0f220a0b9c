"""The service's document collections - nodes, projects, users and roles - as tables, with bridge tables for references.

Each collection is a table of JSON documents (column document). Ids are texts, also where a document has them as
{"$oid": ...}; references are ids or {"$ref": ..., "$id": ...}. Passwords are never read. Documents that don't parse or
have no id are left out, and of documents with one id the last in order counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _id(v: Column, *paths: str) -> Column:
    """The first id that a variant has at one of the paths."""
    tries = [F.try_variant_get(v, f"{p}{rest}", "string") for p in paths for rest in ("['$id']['$oid']", "['$id']", "['$oid']", "")]
    return F.nullif(F.trim(F.coalesce(*tries)), F.lit(""))


def _documents(raw: DataFrame, *id_fields: str) -> DataFrame:
    rows = raw.select(F.try_parse_json("document").alias("v"), "document").where("v is not null")
    rows = rows.withColumn("id", _id(F.col("v"), *(f"$.{f}" for f in id_fields))).where("id is not null")
    return rows.groupBy("id").agg(F.max("document").alias("document")).select("id", F.parse_json("document").alias("v"))


def _texts(rows: DataFrame, id_name: str, **columns: str) -> DataFrame:
    return rows.select(F.col("id").alias(id_name), *(F.try_variant_get("v", f"$.{path}", "string").alias(name) for name, path in columns.items()))


def nodes(raw: DataFrame) -> DataFrame:
    """(node_id, ip, name, description, color, public_key)."""
    return _texts(_documents(raw, "_id", "nodeId"), "node_id", ip="ip", name="name", description="description", color="color", public_key="publicKey")


def projects(raw: DataFrame) -> DataFrame:
    """(project_id, name, description, badge, image_type, image_bytes): the size of an image, not the image."""
    rows = _documents(raw, "_id", "id")
    text = _texts(rows, "project_id", name="name", description="description", badge="badge", image_type="imageContentType", image="imageBytes")
    return text.withColumn("image_bytes", F.length(F.try_to_binary("image", F.lit("base64")))).drop("image")


def roles(raw: DataFrame) -> DataFrame:
    """(role_id, name)."""
    return _texts(_documents(raw, "_id", "id"), "role_id", name="name")


def users(raw: DataFrame) -> DataFrame:
    """(user_id, username, email)."""
    return _texts(_documents(raw, "_id", "id"), "user_id", username="username", email="email")


def references(raw: DataFrame, field: str, name: str, owner: str = "user_id") -> DataFrame:
    """(``owner``, ``name``): a row for each distinct id that a list of references, or a single one, names."""
    rows = _documents(raw, "_id", "id")
    held = rows.select(F.col("id").alias(owner), F.try_variant_get("v", f"$.{field}", "variant").alias("l")).where("l is not null")
    many = held.sparkSession.sql(f"SELECT {owner}, value AS r FROM {{held}}, LATERAL variant_explode(l)", held=held.where(F.schema_of_variant("l").startswith("ARRAY")))
    one = held.where(~F.schema_of_variant("l").startswith("ARRAY")).select(owner, F.col("l").alias("r"))
    return many.unionByName(one).select(owner, _id(F.col("r"), "$").alias(name)).where(f"{name} is not null").distinct()


def permissions(user_documents: DataFrame, role_documents: DataFrame, node_documents: DataFrame) -> DataFrame:
    """(user_id, username, roles array<string>, node_ids array<string>): what each user is and may see. References to
    what isn't there are dropped; users without any have empty lists."""
    named = references(user_documents, "roles", "role_id").join(roles(role_documents), "role_id").groupBy("user_id").agg(F.array_sort(F.collect_set("name")).alias("roles"))
    known = references(user_documents, "nodeIds", "node_id").join(nodes(node_documents).select("node_id"), "node_id", "left_semi")
    seen = known.groupBy("user_id").agg(F.array_sort(F.collect_set("node_id")).alias("node_ids"))
    out = users(user_documents).select("user_id", "username").join(named, "user_id", "left").join(seen, "user_id", "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("roles", "node_ids")})
