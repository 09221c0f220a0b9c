"""Naming noise learned from the column names of a request, and concepts without it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import context_tokens, is_structural, is_structural_suffix, name_tokens
from ..settings import Settings

# First tokens that are no context, and tokens that may follow one without a subject.
NO_CONTEXT = "admission admit discharge assessment visit birth death date time year years age".split()
GENERIC_REST = "total tot sum score scores index value values status state type code flag indicator management".split()


def document_frequency(profiles: DataFrame) -> DataFrame:
    """(request_id, token, df): columns whose name has the token."""
    tokens = profiles.select("request_id", F.explode(F.array_distinct(name_tokens(F.col("column")))).alias("token"))
    return tokens.groupBy("request_id", "token").agg(F.count("*").alias("df"))


def suffix_frequency(profiles: DataFrame) -> DataFrame:
    last = profiles.select("request_id", F.get(F.reverse(name_tokens(F.col("column"))), F.lit(0)).alias("token")).where("token is not null")
    return last.groupBy("request_id", "token").agg(F.count("*").alias("df"))


def learned_noise(profiles: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(request_id, global_stops, suffix_stops, vocabulary): sorted tokens. With at most six columns the three most
    frequent global ones count, ties by token."""
    sizes = profiles.groupBy("request_id").agg(F.count("*").alias("n"))
    often = document_frequency(profiles).join(sizes, "request_id")
    keep = is_structural(F.col("token")) & ((F.col("df") >= settings.noise_count) | (F.col("df") / F.col("n") >= settings.noise_fraction))
    stops = F.collect_list(F.when(keep, F.struct((-F.col("df")).alias("k"), F.col("token"))))
    tokens = often.groupBy("request_id").agg(F.array_sort(stops).alias("stops"), F.first("n").alias("n"), F.array_sort(F.collect_list("token")).alias("vocabulary"))
    ranked = F.transform("stops", lambda x: x["token"])
    tokens = tokens.select("request_id", F.array_sort(F.when(F.col("n") <= 6, F.slice(ranked, 1, 3)).otherwise(ranked)).alias("global_stops"), "vocabulary")
    many = (F.col("df") >= settings.suffix_count) | ((F.col("df") >= 8) & (F.length("token") <= 5))
    suffix = suffix_frequency(profiles).where(many & is_structural_suffix(F.col("token"))).groupBy("request_id").agg(F.array_sort(F.collect_list("token")).alias("suffix_stops"))
    none = F.array().cast("array<string>")
    return tokens.join(suffix, "request_id", "left").select("request_id", "global_stops", F.coalesce("suffix_stops", none).alias("suffix_stops"), "vocabulary")


def with_concepts(profiles: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``profiles`` with concept: the name without its request's noise; a fused word is split where both halves are
    words of the request."""
    rows = profiles.join(learned_noise(profiles, settings), "request_id", "left").withColumn("t", name_tokens(F.col("column")))
    last = F.size("t") - 1
    kept = F.filter("t", lambda t, i: ~F.array_contains("global_stops", t) & ~((i == last) & F.array_contains("suffix_stops", t)))
    rows = rows.withColumn("t", F.when(F.size(kept) > 0, kept).otherwise(F.col("t")))
    word = F.get("t", F.lit(0))
    cuts = F.filter(F.sequence(F.lit(3), F.greatest(F.length(word) - 3, F.lit(3))), lambda i: F.array_contains("vocabulary", F.left(word, i)) & F.array_contains("vocabulary", F.substring(word, i + 1, F.length(word))))
    cut = F.get(cuts, F.lit(0))
    split = F.concat_ws(" ", F.left(word, cut), F.substring(word, cut + 1, F.length(word)))
    concept = F.when((F.size("t") == 1) & (F.length(word) >= 8) & cut.isNotNull(), split).otherwise(F.array_join("t", " "))
    return rows.select(*profiles.columns, F.coalesce(concept, F.lit("")).alias("concept"))


def leading_contexts(profiles: DataFrame, column: str = "column") -> DataFrame:
    """(request_id, token): first tokens of names with at least three distinct tokens behind them."""
    rows = profiles.select("request_id", context_tokens(F.col(column)).alias("t")).where("size(t) >= 2").select("request_id", F.get("t", F.lit(0)).alias("token"), F.get("t", F.lit(1)).alias("next"))
    rows = rows.where((F.length("token") >= 3) & ~F.col("token").isin(NO_CONTEXT))
    return rows.groupBy("request_id", "token").agg(F.countDistinct("next").alias("n")).where("n >= 3").select("request_id", "token")


def without_contexts(concepts: DataFrame) -> DataFrame:
    """Concepts without a leading context, unless only generic tokens would be left."""
    found = leading_contexts(concepts).groupBy("request_id").agg(F.collect_set("token").alias("contexts"))
    rows = concepts.join(found, "request_id", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
    t = F.split("concept", " ")
    rest = F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0)))
    subject = (F.size(rest) > 0) & F.exists(rest, lambda x: ~x.isin(GENERIC_REST))
    cut = F.array_contains("contexts", F.get(t, F.lit(0))) & subject
    return rows.withColumn("concept", F.when(cut, F.array_join(rest, " ")).otherwise(F.col("concept")))
