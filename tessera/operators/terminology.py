"""Terminology lookup over a dictionary table, its gate, and descriptions without a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import (
    category_phrase, fallback_code, is_generic_name, nfkc, is_search_term, padded_term, plain_name, repaired_map, search_variant_rows, sentence, split_key,
    terminology_gate, terminology_label, value_phrase,
)
from ..runtime import durable
from .models import Embed, text_vectors
from .nearest import near_pairs

NEAREST_LEAST = 0.65
TOP = 12


def _words(c):
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def concepts(raw: DataFrame) -> DataFrame:
    """(concept_id, label) of raw answers of a terminology server (JSON text in column item), by what it names first:
    the item's own term, then preferred and fully specified names of its concept and of itself, then id and name
    without their last two characters. Items without an id or a label are left out."""
    at = lambda path: F.nullif(F.trim(F.get_json_object("item", path)), F.lit(""))
    both = at("$.idAndFsnTerm")
    cut = F.when(F.length(both) > 2, F.nullif(F.trim(F.left(both, F.length(both) - 2)), F.lit("")))
    names = ("$.term", "$.concept.pt.term", "$.concept.fsn.term", "$.pt.term", "$.fsn.term")
    label = F.coalesce(*(at(n) for n in names), cut)
    return raw.select(F.coalesce(at("$.concept.conceptId"), at("$.conceptId")).alias("concept_id"), label.alias("label")).where("concept_id is not null and label is not null")


def suggestions(queries: DataFrame, dictionary: DataFrame, top: int = TOP) -> DataFrame:
    """(query, rank, concept_id, label): the first ``top`` concepts that contain a search variant, by variant, then by
    concept id. A variant meets labels through its longest word, which is an equi-join, before containment is tested."""
    variants = search_variant_rows(queries.select("query").distinct().withColumn("composed", nfkc(F.col("query"))), "composed")
    longest = F.array_max(F.transform(_words(F.col("variant")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    terms = dictionary.select("concept_id", "label", F.explode(F.array_distinct(_words(F.col("label")))).alias("word"))
    met = variants.withColumn("word", longest).join(terms, "word").where(F.lower("label").contains(F.col("variant")))
    first = met.groupBy("query", "concept_id", "label").agg(F.min("ord").alias("ord"))
    order = Window.partitionBy("query").orderBy("ord", "concept_id")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query", "rank", "concept_id", "label")


def nearest_concepts(queries: DataFrame, dictionary: DataFrame, embed: Embed | None = None) -> DataFrame:
    """(query, concept_id, label, sim): the nearest concept by hashed vectors, or those of ``embed``, where it is near enough. Of labels that
    several concepts share, the smallest id stands in the index."""
    labels = dictionary.where("label is not null").groupBy("label").agg(F.min("concept_id").alias("concept_id"))
    q = text_vectors(queries.select(F.col("query").alias("q")).distinct().withColumn("v", F.array("q")), ["q"], "v", embed)
    d = text_vectors(labels.select(F.col("label").alias("d"), F.array("label").alias("v")), ["d"], "v", embed)
    sims = near_pairs(q, d, NEAREST_LEAST).join(labels.withColumnRenamed("label", "d"), "d")
    best = sims.groupBy("q").agg(F.min(F.struct((-F.round("sim", 9)).alias("k"), F.col("concept_id"), F.col("d"), F.col("sim"))).alias("b"))
    return best.select(F.col("q").alias("query"), "b.concept_id", F.col("b.d").alias("label"), "b.sim")


def missing(asked: DataFrame, found: DataFrame) -> DataFrame:
    """(query, context) of lookups (pos, query, context) that gave nothing, once each, with its first context."""
    rows = asked.where("trim(query) <> ''").join(found.select("query"), "query", "left_anti")
    return rows.groupBy("query").agg(F.min_by("context", "pos").alias("context"))


def resolved(queries: DataFrame, dictionary: DataFrame, paraphrase=None, embed: Embed | None = None, fallback: bool = False) -> DataFrame:
    """(query, terminology): 'label | code' of the first suggestion, else of the first suggestion for a paraphrase, else
    of the nearest concept; later steps only see what earlier ones missed. What the gate rejects is left out.
    ``paraphrase``, a model's function from a text column to an array of texts (a pandas UDF, say), is asked for up to
    four; without one the step is skipped. ``embed`` replaces the hashed vectors of the last step. With ``fallback``, what
    is left gets a code of its own, which no dictionary has."""
    asked = queries.select("query").distinct().where(is_search_term(F.col("query")))
    code = lambda df: df.select("query", terminology_gate(F.concat_ws(" | ", "label", F.col("concept_id").cast("string"))).alias("terminology"))
    found = code(suggestions(asked, dictionary, 1)).where("terminology <> ''")
    rest = asked.join(found, "query", "left_anti")
    if paraphrase is not None:
        others = rest.select(F.col("query").alias("first"), F.posexplode(F.slice(paraphrase(F.col("query")), 1, 4)).alias("n", "query")).where("trim(query) <> ''")
        hits = code(suggestions(others, dictionary, 1)).where("terminology <> ''").join(others, "query")
        hits = hits.groupBy(F.col("first").alias("query")).agg(F.min_by("terminology", "n").alias("terminology"))
        found, rest = found.unionByName(hits), rest.join(hits, "query", "left_anti")
    found = found.unionByName(code(nearest_concepts(rest, dictionary, embed)).where("terminology <> ''"))
    if fallback:
        found = durable(found)
        left = asked.join(found, "query", "left_anti")
        found = found.unionByName(left.select("query", fallback_code(F.col("query"), F.lit("")).alias("terminology")))
    return found


def value_specs(values: DataFrame, key: list[str], most: int = 10) -> DataFrame:
    """(``key``, pos, name, lo, hi): the first ``most`` distinct names of each key of rows (``key``, pos, name, lo, hi).
    Numeric names get the whole bounds of the key's numeric ones, where these differ; others keep their own."""
    named = values.withColumn("name", F.trim("name")).where("name <> ''")
    first = named.groupBy(*key, "name").agg(F.min("pos").alias("pos"), F.min_by("lo", "pos").alias("lo"), F.min_by("hi", "pos").alias("hi"))
    order = Window.partitionBy(*key).orderBy("pos", "name")
    first = first.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")
    whole, number = Window.partitionBy(*key), F.col("name").try_cast("double")
    low, high = F.min(number).over(whole), F.max(number).over(whole)
    bound = lambda end, own: F.when(number.isNull(), own).when(low < high, end.cast("bigint").cast("string"))
    return first.select(*key, "pos", "name", bound(low, F.col("lo")).alias("lo"), bound(high, F.col("hi")).alias("hi"))


def with_scale_labels(values: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows (context, value, query) whose query gets the label that a model's answer (context, answer) has for the value."""
    maps = answers.groupBy("context").agg(F.max(F.struct("answer"))["answer"].alias("answer")).select("context", repaired_map(F.col("answer")).alias("labels"))
    label = F.trim(F.coalesce(F.try_element_at(F.col("labels"), F.col("value")), F.lit("")))
    rows = values.join(maps, "context", "left")
    return rows.withColumn("query", F.when(label != "", F.concat_ws(" ", "query", label)).otherwise(F.col("query"))).drop("labels")


def value_queries(values: DataFrame) -> DataFrame:
    """Rows (context, value) with the query that a value is looked up by: short and numeric ones get their column."""
    plain = plain_name(F.col("value"))
    numeric = plain.rlike(r"^[0-9.]+$")
    name = F.when(is_generic_name(F.col("context")), F.lit("")).otherwise(plain_name(F.col("context")))
    asked = F.when(numeric & (name != ""), F.concat_ws(" ", name, plain)).otherwise(padded_term(plain, name))
    return values.withColumn("query", asked)


def lookup_keys(keys: DataFrame) -> DataFrame:
    """Rows (key) cut into context and term, padded where the term is short."""
    s = split_key(F.col("key"))
    return keys.select("key", s["context"].alias("context"), s["term"].alias("term"), padded_term(s["term"], s["context"]).alias("query"))


def column_descriptions(columns: DataFrame) -> DataFrame:
    """Rows (name, terminology) with a sentence: the label of the terminology, else the plain name."""
    label = terminology_label(F.col("terminology"))
    return columns.withColumn("description", sentence(F.when(label != "", label).otherwise(plain_name(F.col("name")))))


def value_descriptions(values: DataFrame) -> DataFrame:
    """Rows (value, label, lo, hi) with a sentence: numbers as scores or values of the label, others as categories."""
    number = F.trim("value").rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$")
    phrase = F.when(number, value_phrase(F.col("value"), F.col("label"), F.col("lo"), F.col("hi"))).otherwise(category_phrase(F.col("value"), F.col("label")))
    return values.withColumn("description", sentence(phrase))
