"""Schema-guided matching: evidence from names and types, then the best field of each column, one column a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import column_prompt, compact, field_prompt, guard_tokens, safe
from ..functions.vectors import sparse_value_vectors
from ..settings import Settings

# Tokens without a subject, tokens of codes, tokens that anchor a date.
WEAK = """column data field value values var date time dt day days year years status state type kind category code coded
id identifier score total sum index event note notes comment comments patient clinical record file""".split()
CODE_SHAPE = "code coded id identifier status state type category".split()
ANCHORS = "birth born admission discharge".split()
NUMERIC_TYPES = "integer int long number double float".split()
DATE_TYPES = "date datetime timestamp date-time".split()
EMBEDDING_LEAST = 0.72


def _list(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _has(tokens: Column, words: list[str]) -> Column:
    return F.arrays_overlap(tokens, _list(words))


def _holds(a: Column, b: Column) -> Column:
    return (F.length(b) >= 4) & a.contains(b)


def _without(tokens: Column, contexts: Column) -> Column:
    rest = F.array_except(tokens, contexts)
    return F.when(F.size(rest) > 0, rest).otherwise(tokens)


def _initials(tokens: Column) -> Column:
    strong = F.filter(tokens, lambda t: ~t.isin(WEAK) & (F.length(t) >= 2))
    return F.when(F.size(strong) >= 2, F.array_join(F.transform(strong, lambda t: F.left(t, F.lit(1))), "")).otherwise("")


def _abbreviates(target: Column, source: Column) -> Column:
    strong = lambda ts: F.filter(ts, lambda t: ~t.isin(WEAK) & (F.length(t) >= 3))
    of_target, of_source = _initials(target), _initials(source)
    acronym = lambda t, initials: F.length(t).between(2, 6) & initials.startswith(t)
    pair = lambda t, s: t.startswith(s) | s.startswith(t) | acronym(s, of_target) | acronym(t, of_source)
    return F.exists(strong(target), lambda t: F.exists(strong(source), lambda s: pair(t, s)))


def with_evidence(pairs: DataFrame) -> DataFrame:
    """Pairs (name, type, description, column, concept, stats, contexts) with their evidence columns."""
    t, c, k = (compact(F.col(x)) for x in ("name", "column", "concept"))
    rows = pairs.withColumns({"tt": guard_tokens(F.concat_ws(" ", safe(F.col("name")), safe(F.col("description")))), "st": guard_tokens(F.concat_ws(" ", F.col("column"), F.col("concept")))})
    rows = rows.withColumns({"tc": _without(F.col("tt"), F.col("contexts")), "sc": _without(F.col("st"), F.col("contexts"))})
    shared = F.array_intersect("tc", "sc")
    strong = F.exists(shared, lambda x: ~x.isin(WEAK) & (F.length(x) >= 3)) | (F.size(shared) >= 2) | _abbreviates(F.col("tc"), F.col("sc"))
    exact = (t != "") & ((t == c) | (t == k))
    contained = (t != "") & (_holds(c, t) | _holds(k, t) | _holds(t, c) | _holds(t, k))
    return rows.withColumns({"exact": exact, "contained": contained, "strong": strong})


def _numeric(stats: Column) -> Column:
    return stats["has_int"] | stats["has_double"] | stats["num_min"].isNotNull() | stats["num_max"].isNotNull()


def _dated(stats: Column) -> Column:
    return stats["has_date"] | stats["date_min_ms"].isNotNull() | stats["date_max_ms"].isNotNull()


def match_quality(by_embedding: Column | None = None) -> Column:
    """4 exact, 3 contained, 2 strong overlap, 1 by embedding (column sim), 0 no match; over rows of with_evidence."""
    kind, stats, tt, st = F.lower(F.trim(F.col("type"))), F.col("stats"), F.col("tt"), F.col("st")
    to_date = kind.isin(DATE_TYPES) | _has(tt, ["date", "dt", "time"])
    off_anchor = F.size(F.array_except(F.array_intersect(tt, _list(ANCHORS)), st)) > 0
    name_date = _has(st, ["date", "dt", "time"])
    named = F.col("exact") | F.col("contained") | F.col("strong")
    coded = _has(st, CODE_SHAPE)
    compatible = (
        F.when(to_date, ~off_anchor & (_dated(stats) | (name_date & F.col("strong"))))
        .when(kind.isin(NUMERIC_TYPES), _numeric(stats))
        .when(kind.startswith("array<"), named)
        .otherwise(~(_numeric(stats) & coded & ~_has(tt, CODE_SHAPE)))
    )
    sim = by_embedding if by_embedding is not None else F.lit(0.0)
    totals = ["total", "tot", "sum"]
    close = (sim >= EMBEDDING_LEAST) & (
        F.when(kind.isin(NUMERIC_TYPES), ~off_anchor & (~_has(tt, totals) | _has(st, totals)) & _numeric(stats) & ~coded)
        .when(to_date, _dated(stats) & name_date)
        .otherwise(~coded & ~_has(st, ["event", "note"]))
    )
    return F.when(~compatible, 0).when(F.col("exact"), 4).when(F.col("contained"), 3).when(F.col("strong"), 2).when(close, 1).otherwise(0)


def prompt_vectors(columns: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sparse vectors of the prompts of columns and of fields."""
    return sparse_value_vectors(columns, ["request_id", "pos"], "prompts"), sparse_value_vectors(fields, ["request_id", "field_pos"], "prompts")


def column_prompts(columns: DataFrame) -> DataFrame:
    return columns.withColumn("prompts", F.array(column_prompt(F.col("concept"), F.col("values"), F.col("stats"))))


def field_prompts(fields: DataFrame) -> DataFrame:
    return fields.withColumn("prompts", F.array(field_prompt(F.col("name"), F.col("type"), F.col("description"), F.col("enum_values"))))


def best_fields(columns: DataFrame, fields: DataFrame, contexts: DataFrame, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(request_id, pos, field_pos, name, quality, sim): the best field of each column; ties go to the earlier field.
    Pairs are formed within a request only. ``vectors`` (request_id, pos or field_pos, idx, w) of columns and fields, of
    length 1, replace the default hashed embedding of the prompts."""
    cv, fv = vectors or prompt_vectors(column_prompts(columns), field_prompts(fields))
    sims = cv.withColumnRenamed("w", "wc").join(fv.withColumnRenamed("w", "wf"), ["request_id", "idx"]).groupBy("request_id", "pos", "field_pos").agg(F.sum(F.col("wc") * F.col("wf")).alias("sim"))
    held = contexts.groupBy("request_id").agg(F.collect_set("token").alias("contexts"))
    pairs = columns.join(fields, "request_id").join(held, "request_id", "left").join(sims, ["request_id", "pos", "field_pos"], "left")
    pairs = with_evidence(pairs.withColumns({"contexts": F.coalesce("contexts", F.array().cast("array<string>")), "sim": F.coalesce("sim", F.lit(0.0))}))
    scored = pairs.select("request_id", "pos", "field_pos", "name", match_quality(F.col("sim")).alias("quality"), "sim").where("quality > 0")
    order = Window.partitionBy("request_id", "pos").orderBy(F.desc("quality"), F.desc("sim"), "field_pos")
    return scored.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def one_per_file(scored: DataFrame, target: list[str], settings: Settings = Settings()) -> DataFrame:
    """Of rows (``target``, file_key, pos, sim): the best column of each file, at most 30 a target."""
    by_file = Window.partitionBy(*target, "file_key").orderBy(F.desc("sim"), "pos")
    best = scored.withColumn("r", F.row_number().over(by_file)).where("r = 1")
    order = Window.partitionBy(*target).orderBy(F.desc("sim"), "pos")
    return best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= settings.columns_per_field).withColumnRenamed("r", "rank")


def round_robin_batches(members: DataFrame, cluster: list[str]) -> DataFrame:
    """The r-th best column of each file goes to batch r (from 1)."""
    order = Window.partitionBy(*cluster, "file_key").orderBy(F.desc("sim"), "pos")
    return members.withColumn("batch", F.row_number().over(order))


def first_per_file(members: DataFrame, mapping: list[str]) -> DataFrame:
    """The first column of each file in each mapping."""
    order = Window.partitionBy(*mapping, "file_key").orderBy("pos")
    return members.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def uncovered(columns: DataFrame, used: DataFrame) -> DataFrame:
    """Columns that no mapping refers to."""
    return columns.join(used, ["request_id", "file_key", "column"], "left_anti")
