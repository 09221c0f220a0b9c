"""What the harmonization service keeps or is told besides profiles: ontology classes and their fields, dataset metadata
of nodes, the current schema, and trusted routes. Each scan takes a table of raw documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ONTOLOGY = "http://example.org/ontology/"  # fixed value


def ontology_classes(classes: DataFrame, query: str | None = None) -> DataFrame:
    """(id, label, description, iri) of the classes (pos, name) whose name contains ``query`` in any case, numbered in
    their order. Null names are left out."""
    rows = classes.where("name is not null")
    if query:
        rows = rows.where(F.lower("name").contains(query.lower()))
    number = F.row_number().over(Window.orderBy("pos"))  # a few hundred classes
    return rows.select(number.cast("string").alias("id"), F.col("name").alias("label"), F.lit("").alias("description"), F.concat(F.lit(ONTOLOGY), "name").alias("iri"))


def class_fields(forms: DataFrame) -> DataFrame:
    """(class, pos, name, optional, type) of forms (class, form), the form a JSON array of objects. A field is optional
    only where the form says so; a form that doesn't parse has no fields."""
    fields = F.from_json("form", "array<struct<name:string,optional:string,type:string>>")
    rows = forms.select("class", F.posexplode(fields).alias("pos", "f"))
    return rows.select("class", "pos", F.col("f.name").alias("name"), F.coalesce(F.col("f.optional") == "true", F.lit(False)).alias("optional"), F.coalesce("f.type", F.lit("")).alias("type"))


# What a dataset, a distribution and a variable are described by; everything else is kept as additional.
DATASET = """uri title description identifier issued modified accrualPeriodicity keyword theme language publisher contactPoint
spatial temporal distribution accessRights applicableLegislation codeValues codingSystem conformsTo custodian
hasPersonalData healthDataAccessBody healthCategory healthTheme isStructured numberOfRecords numberOfUniqueIndividuals
provenance type variables wasGeneratedBy""".split()
DISTRIBUTION = """uri title description format license downloadURL accessURL mediaType byteSize availability issued modified
conformsTo accessService""".split()
VARIABLE = "uri name definition dataType codingSystem valueDomain".split()
NAMES = ["name", "title", "label", "prefLabel", "uri", "@id"]  # of an object that stands where a text may


def _entries(rows: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """``rows`` with the fields (key, value) of the object, or the items (pos, value) of the list, in a variant column."""
    return rows.sparkSession.sql(f"SELECT {', '.join(keep)}, pos, key, value FROM {{rows}}, LATERAL variant_explode({column})", rows=rows)


def _kind(v: Column) -> Column:
    shape = F.schema_of_variant(v)
    return F.when(F.is_variant_null(v), "null").when(shape.startswith("ARRAY"), "list").when(shape.startswith("OBJECT"), "object").when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").otherwise("number")


def _text(v: Column, kind: Column) -> Column:
    named = F.coalesce(*(F.try_variant_get(v, f"$['{n}']", "string") for n in NAMES))
    return F.when(kind == "object", F.coalesce(named, F.to_json(v))).when(kind.isin("list", "null"), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))


def _listed(rows: DataFrame, column: str, keep: list[str], name: str) -> DataFrame:
    """A row for each item of a list, with its place as ``name``; what is no list counts as one item, nulls as none."""
    rows = rows.withColumn("kind", _kind(F.col(column)))
    many = _entries(rows.where("kind = 'list'"), column, keep).select(*keep, F.col("pos").alias(name), F.col("value").alias("item"))
    one = rows.where("kind in ('object', 'string', 'number', 'boolean')").select(*keep, F.lit(0).alias(name), F.col(column).alias("item"))
    return many.unionByName(one).where(~F.is_variant_null("item"))


def node_metadata(documents: DataFrame) -> DataFrame:
    """(node_id, part, dataset, item, field, index, kind, text, known) of DCAT documents (node_id, document): every value
    of every field of each dataset, of its distributions and of its variables, in whatever form it was given.

    ``part`` is dataset, distribution or variable and ``item`` its number within the dataset. A field holds a text, a
    number, a boolean, an object or a list of these; list items get an ``index`` and a ``kind`` of their own. An object's
    text is its name, title, label or address, else its JSON. Fields that aren't ``known`` are additional ones; none is
    lost. A single object in place of a list is a list of one; a document that doesn't parse, or isn't an object, and
    nulls give no rows."""
    rows = documents.select("node_id", F.try_parse_json("document").alias("v"))
    rows = rows.where(_kind(F.col("v")) == "object").select("node_id", F.try_variant_get("v", "$.dataset", "variant").alias("d")).where("d is not null")
    datasets = _listed(rows, "d", ["node_id"], "dataset").where(_kind(F.col("item")) == "object")
    parts = []
    for part, field, known in (("dataset", None, DATASET), ("distribution", "distribution", DISTRIBUTION), ("variable", "variables", VARIABLE)):
        if field is None:
            own = datasets.select("node_id", "dataset", F.lit(0).alias("n"), F.col("item").alias("o"))
        else:
            inner = datasets.select("node_id", "dataset", F.try_variant_get("item", f"$.{field}", "variant").alias("l")).where("l is not null")
            own = _listed(inner, "l", ["node_id", "dataset"], "n").where(_kind(F.col("item")) == "object").withColumnRenamed("item", "o")
        fields = _entries(own, "o", ["node_id", "dataset", "n"])
        if field is None:
            fields = fields.where(~F.col("key").isin("distribution", "variables"))
        values = _listed(fields.select("node_id", "dataset", "n", F.col("key").alias("field"), F.col("value").alias("held")), "held", ["node_id", "dataset", "n", "field"], "index")
        parts.append(values.select("node_id", F.lit(part).alias("part"), "dataset", F.col("n").alias("item"), "field", "index", F.col("item").alias("v"), F.col("field").isin(known).alias("known")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("kind", _kind(F.col("v")))
    return every.select("node_id", "part", "dataset", "item", "field", "index", "kind", _text(F.col("v"), F.col("kind")).alias("text"), "known")


def node_datasets(documents: DataFrame) -> DataFrame:
    """(node_id, dataset, title, keywords, publisher, distributions, variables, additional): one row a dataset of
    ``node_metadata``, with the texts of its keywords and a map of its additional fields."""
    rows = node_metadata(documents)
    own = F.col("part") == "dataset"
    first = lambda field: F.min_by(F.when(own & (F.col("field") == field), F.col("text")), F.when(own & (F.col("field") == field), F.col("index"))).alias(field)
    words = F.array_sort(F.collect_list(F.when(own & (F.col("field") == "keyword"), F.struct("index", "text"))))
    count = lambda part: F.count_distinct(F.when(F.col("part") == part, F.col("item")))
    extra = F.array_sort(F.collect_list(F.when(own & ~F.col("known"), F.struct("field", "index", "text"))))
    maps = F.map_from_entries(F.transform(F.filter(extra, lambda x: x["index"] == 0), lambda x: F.struct(x["field"], F.array_join(F.transform(F.filter(extra, lambda y: y["field"] == x["field"]), lambda y: y["text"]), "|"))))
    return rows.groupBy("node_id", "dataset").agg(
        first("title"), F.transform(words, lambda x: x["text"]).alias("keywords"), first("publisher"),
        count("distribution").alias("distributions"), count("variable").alias("variables"), maps.alias("additional"),
    )


def current_schema(events: DataFrame) -> DataFrame:
    """(slot, schema) of the schemas that are stored now, from saves and removals (slot, seq, schema): the last one of a
    slot counts, and one without a schema empties it."""
    last = events.groupBy("slot").agg(F.max_by("schema", "seq").alias("schema"))
    return last.where("schema is not null")


def trusted_routes(lines: DataFrame) -> DataFrame:
    """(origin, upstream, secret) of lines (pos, line) 'public|upstream|secret'. Blank lines and those that begin with #
    don't count, nor do public addresses that aren't http; without an upstream the origin itself is meant. The last
    line of an origin wins."""
    rows = lines.select("pos", F.trim("line").alias("line")).where("line <> '' and not startswith(line, '#')")
    part = lambda i: F.trim(F.coalesce(F.get(F.split("line", "[|]"), F.lit(i)), F.lit("")))
    origin = F.lower(F.regexp_extract(part(0), r"(?i)^(http://[^/?#]+)", 1))
    rows = rows.select("pos", origin.alias("origin"), part(1).alias("upstream"), part(2).alias("secret")).where("origin <> ''")
    last = rows.groupBy("origin").agg(F.max_by(F.struct("upstream", "secret"), "pos").alias("x"))
    return last.select("origin", F.coalesce(F.nullif("x.upstream", F.lit("")), "origin").alias("upstream"), F.nullif("x.secret", F.lit("")).alias("secret"))
