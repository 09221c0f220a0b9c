"""The queries of the harmonization engine over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scales, text, vectors
from .functions.roles import column_role
from .operators import clustering, matching, noise, platform, terminology, values
from .plans.enrich import enriched_parts
from .plans.suggest import Parts, prepared, schema_parts, schemaless_parts
from .runtime import durable, read, stored
from .sources.json_schema import schema_fields
from .sources.profile import PROFILE, column_stats, inferred_type, profile_tables
from .sources.sketch import column_texts, merge_sketches, sketch_table

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
Query = Callable[[SparkSession, str], DataFrame]

# A small request with clinical columns: (node, file, column, values).
CLINICAL = [
    ("n1", "a.csv", "TOTBarthel", ["integer", "min:0", "max:100"]),
    ("n2", "b.csv", "barthel_total", ["integer", "min:0", "max:100", "step:10"]),
    ("n1", "a.csv", "BToilet", ["integer", "min:0", "max:10"]),
    ("n2", "b.csv", "FIM_toilet", ["integer", "min:1", "max:7"]),
    ("n1", "a.csv", "NIHSS_admission", ["integer", "min:0", "max:42"]),
    ("n2", "b.csv", "painScore", ["integer", "min:0", "max:10"]),
    ("n1", "a.csv", "Sex", ["M", "F"]),
    ("n2", "b.csv", "sex", ["male", "female"]),
    ("n1", "a.csv", "admission_date", ["date", "earliest:2020-01-01T00:00:00Z", "latest:2021-01-01T00:00:00Z"]),
    ("n2", "b.csv", "StrokeType", ["Ischemic", "Hemorrhagic"]),
    ("n1", "a.csv", "patient_id", ["integer", "min:1", "max:900"]),
    ("n2", "b.csv", "smoker_flag", ["yes", "no"]),
]
SCHEMA = """{"properties": {"sex": {"type": "string", "enum": ["male", "female"]}, "barthel_total": {"type": "integer"},
"admission_date": {"type": "date"}, "stroke_type": {"type": ["string", "null"], "enum": ["Ischemic", "Hemorrhagic"], "description": " Kind of stroke "},
"codes": {"type": "array", "items": {"type": "string"}}}}"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles without values, of the names that the tables have alone."""
    rows, pos = [], 0
    for k, table in enumerate(TABLES):
        for c in read(spark, sf_dir, table).columns:
            rows.append(("tables", pos, f"node-{k}", f"{table}.csv", c, []))
            pos += 1
    return spark.createDataFrame(rows, PROFILE)


def clinical(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("clinical", i, *row) for i, row in enumerate(CLINICAL)], PROFILE)


def clinic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each nation: its suppliers are nodes, each with a file of clinical columns of one of two kinds."""
    columns = spark.createDataFrame([(int(n == "n2"), i, f, c, v) for i, (n, f, c, v) in enumerate(CLINICAL)], "kind int, i int, file_name string, column string, values array<string>")
    nodes = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey", (F.col("s_suppkey") % 2).cast("int").alias("kind"))
    rows = nodes.join(F.broadcast(columns), "kind").join(F.broadcast(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")), "s_nationkey")
    return rows.select(F.col("n_name").alias("request_id"), (F.col("k") * 12 + F.col("i")).cast("int").alias("pos"), F.concat(F.lit("node-"), "k").alias("node_id"), "file_name", "column", "values")


_CLINIC_SQL = "n AS (SELECT n_name AS request_id, s_suppkey AS k, s_suppkey % 2 AS kind FROM supplier JOIN nation ON n_nationkey = s_nationkey)"


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_tables({t: read(spark, sf_dir, t) for t in TABLES})


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of the columns that the profiles have samples of."""
    return column_texts({t: read(spark, sf_dir, t) for t in TABLES})


def _members(df: DataFrame, mapping: str) -> DataFrame:
    rows = prepared(df).withColumn("mapping", F.expr(mapping).cast("long"))
    return rows.withColumn("type", inferred_type(F.col("stats"))).select("request_id", "mapping", "pos", "file_key", "column", "concept", "values", "stats", "type")


def _flat(buckets: DataFrame) -> DataFrame:
    rows = buckets.select("mapping", "bucket", "name", F.explode("refs").alias("r"))
    return rows.select("mapping", "bucket", "name", "r.column", "r.value", F.round("r.lo", 4).alias("lo"), F.round("r.hi", 4).alias("hi"))


QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


_NAMES_SQL = "(SELECT (row_number() OVER (ORDER BY list_position([" + ", ".join(f"'{t}'" for t in TABLES) + "], table_name), column_index) - 1)::INTEGER AS pos, table_name AS file, column_name AS col FROM duckdb_columns() WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")) AS n"
_CAMEL_SQL = "regexp_replace(regexp_replace({0}, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
_TOKENS_SQL = "list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(" + _CAMEL_SQL + "), '([a-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-z])', '\\1 \\2', 'g'), '[^a-z0-9]+'), lambda t: length(t) > 1 AND NOT regexp_full_match(t, '[0-9]+'))"
_T_SQL = f"t AS (SELECT pos, file, col, {_TOKENS_SQL.format('col')} AS toks FROM {_NAMES_SQL})"
_STRUCTURAL_SQL = "(regexp_full_match({0}, '[0-9]+') OR length({0}) = 1 OR (length({0}) = 2 AND NOT regexp_matches({0}, '[aeiou]')) OR {0} IN ('id','code','name','value','flag','indicator','status','type'))"
_NV_SQL = "CASE WHEN regexp_matches(lower(trim({0})), '^(min|max|earliest|latest):|^(integer|double|date)$') THEN '' ELSE regexp_replace(translate(lower(trim({0})), '_-', '  '), '\\s+', ' ', 'g') END"


@query("SELECT p_partkey, p_type AS raw, " + _NV_SQL.format("p_type") + " AS normalized FROM part")
def normalize_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("raw"), text.normalize_value(F.col("p_type")).alias("normalized"))


@query("SELECT conv_id, turn, " + _CAMEL_SQL.format("text") + " AS split FROM conversations")
def split_camel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.split_camel(F.col("text")).alias("split"))


@query(f"WITH {_T_SQL} SELECT col AS \"column\", array_to_string(toks, ' ') AS tokens FROM t")
def tokenize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("column", F.array_join(text.name_tokens(F.col("column")), " ").alias("tokens"))


@query("SELECT item_id, array_to_string(" + _TOKENS_SQL.format("text") + ", ' ') AS tokens FROM benchmark")
def tokenize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.name_tokens(F.col("text")), " ").alias("tokens"))


@query("""WITH s AS (SELECT p_partkey, regexp_replace(regexp_replace(p_name, '\\s+', '_', 'g'), '[^A-Za-z0-9_]', '', 'g') AS x FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(x, '^[0-9]') THEN '_' || x ELSE x END AS union_key FROM s""")
def sanitize_union_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", text.union_name(F.col("p_name")).alias("union_key"))


@query("SELECT l_orderkey, l_linenumber, coalesce(l_returnflag, '') || '::' || coalesce(l_linestatus, '') || '::' || l_partkey::VARCHAR AS k FROM lineitem")
def group_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = text.group_key(F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_partkey").cast("string"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", key.alias("k"))


@query("""WITH d AS (SELECT DISTINCT p_name AS s FROM part)
SELECT s, list_reduce([2166136261::HUGEINT] || list_transform(string_split(s, ''), lambda c: ascii(c)::HUGEINT), lambda h, b: (xor(h, b) * 16777619) & 4294967295)::BIGINT AS h FROM d""")
def fnv1a32_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_name").alias("s")).distinct().select("s", text.fnv1a32(F.col("s")).alias("h"))


# The tables' columns by kind, for the SQL of profiles; embedding is of no kind that has values.
_COLUMNS = {
    "region": {"integer": "r_regionkey", "text": "r_name"},
    "nation": {"integer": "n_nationkey n_regionkey", "text": "n_name"},
    "customer": {"integer": "c_custkey c_nationkey", "double": "c_acctbal", "text": "c_name c_mktsegment"},
    "supplier": {"integer": "s_suppkey s_nationkey", "double": "s_acctbal", "text": "s_name"},
    "part": {"integer": "p_partkey p_size", "double": "p_retailprice", "text": "p_name p_brand p_type"},
    "orders": {"integer": "o_orderkey o_custkey", "double": "o_totalprice", "date": "o_orderdate", "text": "o_orderstatus o_orderpriority"},
    "lineitem": {"integer": "l_orderkey l_partkey l_suppkey l_linenumber", "double": "l_quantity l_extendedprice l_discount l_tax", "date": "l_shipdate", "text": "l_returnflag l_linestatus"},
    "events": {"integer": "event_id user_id", "double": "value", "date": "ts", "text": "event_type props"},
    "documents": {"integer": "doc_id n_chars", "text": "text lang source"},
    "embeddings": {"integer": "vec_id label", "other": "embedding"},
    "pages": {"integer": "page_id", "text": "url html"},
    "benchmark": {"integer": "item_id", "text": "text"},
    "labels": {"integer": "doc_id quality toxic"},
    "conversations": {"integer": "conv_id turn", "text": "role text"},
}
_TEXTS = {t: kinds["text"].split() for t, kinds in _COLUMNS.items() if "text" in kinds}
_TABLE_OF = {c: t for t, kinds in reversed(_COLUMNS.items()) for own in kinds.values() for c in own.split()}
_GCD_SQL = "(SELECT list_reduce([0::BIGINT] || list(DISTINCT {c}::BIGINT - m), lambda a, b: gcd(a, b)) FROM {t}, (SELECT min({c})::BIGINT AS m FROM {t}) WHERE {c} IS NOT NULL)"


def _profile_sql(table: str, column: str, kind: str) -> str:
    if kind == "other":
        vals = "SELECT ''"
    elif kind == "text":
        vals = f"SELECT CASE WHEN max(length({column})) <= 200 THEN (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {column} AS v FROM {table} WHERE {column} IS NOT NULL ORDER BY v LIMIT 80)) ELSE '' END FROM {table}"
    elif kind == "date":
        vals = f"SELECT 'date|earliest:' || strftime(min({column}), '%Y-%m-%dT%H:%M:%SZ') || '|latest:' || strftime(max({column}), '%Y-%m-%dT%H:%M:%SZ') FROM {table}"
    else:
        f = "printf('%.4f', {0}({1}) + 0)" if kind == "double" else "{0}({1})::VARCHAR"
        step = f" || CASE WHEN s > 1 THEN '|step:' || s ELSE '' END FROM (SELECT {_GCD_SQL.format(c=column, t=table)} AS s), {table} GROUP BY s" if kind == "integer" else f" FROM {table}"
        vals = f"SELECT '{kind}|min:' || {f.format('min', column)} || '|max:' || {f.format('max', column)}{step}"
    return f"SELECT '{table}.csv' AS file_name, '{column}' AS \"column\", ({vals}) AS vals"


_PROFILE_SQL = [_profile_sql(t, c, kind) for t, kinds in _COLUMNS.items() for kind, own in kinds.items() for c in own.split()]


@query(" UNION ALL ".join(_PROFILE_SQL))
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select("file_name", "column", F.array_join("values", "|").alias("vals"))


@query(f"""SELECT column_name AS "column", s AS step, lo::BIGINT AS lo, hi::BIGINT AS hi, n FROM (SELECT 'event_id' AS column_name, {_GCD_SQL.format(c='event_id', t='events')} AS s, min(event_id) AS lo, max(event_id) AS hi, count(*) AS n FROM events
UNION ALL SELECT 'user_id', {_GCD_SQL.format(c='user_id', t='events')}, min(user_id), max(user_id), count(*) FROM events
UNION ALL SELECT 'ten', (SELECT 10 * s FROM (SELECT {_GCD_SQL.format(c='user_id', t='events')} AS s)), min(user_id) * 10 + 3, max(user_id) * 10 + 3, count(*) FROM events)""")
def merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of the events of each month, kept and merged."""
    events = read(spark, sf_dir, "events").withColumn("month", F.month("ts")).select("event_id", "user_id", (F.col("user_id") * 10 + 3).alias("ten"), "month")
    months = [r.month for r in events.select("month").distinct().collect()]  # twelve at most
    parts = [sketch_table(events.where(F.col("month").eqNullSafe(m)).drop("month"), "events.csv", "n") for m in months]
    kept = stored(reduce(DataFrame.unionByName, parts), "sketches")
    return merge_sketches(kept).select("column", "step", F.col("lo_i").alias("lo"), F.col("hi_i").alias("hi"), "n")


@query("""SELECT 'l_quantity' AS "column", false AS has_int, true AS has_double, false AS has_date, round(min(l_quantity), 4) AS num_min, round(max(l_quantity), 4) AS num_max, 0::BIGINT AS first_ms FROM lineitem
UNION ALL SELECT 'p_size', true, false, false, min(p_size)::DOUBLE, max(p_size)::DOUBLE, 0 FROM part
UNION ALL SELECT 'l_shipdate', false, false, true, 0, 0, epoch_ms(min(l_shipdate)) FROM lineitem""")
def parse_col_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile_tables({t: read(spark, sf_dir, t) for t in ("part", "lineitem")}).where("column in ('l_quantity', 'p_size', 'l_shipdate')")
    return rows.withColumn("s", column_stats(F.col("values"))).select("column", "s.has_int", "s.has_double", "s.has_date", *(F.coalesce(f"s.{a}", F.lit(0)).alias(b) for a, b in (("num_min", "num_min"), ("num_max", "num_max"), ("date_min_ms", "first_ms"))))


@query("""SELECT table_name || '.csv' AS file_name, column_name AS "column", CASE WHEN data_type LIKE '%[]' THEN '' WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'date'
WHEN data_type IN ('DOUBLE', 'FLOAT') OR data_type LIKE 'DECIMAL%' THEN 'double' WHEN data_type LIKE '%INT%' THEN 'integer' ELSE '' END AS type FROM duckdb_columns() WHERE table_name IN (""" + ", ".join(f"'{t}'" for t in TABLES) + ")")
def type_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select("file_name", "column", inferred_type(column_stats(F.col("values"))).alias("type"))


@query(f"WITH {_T_SQL} SELECT token, count(*) AS df FROM (SELECT DISTINCT pos, unnest(toks) AS token FROM t) GROUP BY token")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.document_frequency(names(spark, sf_dir)).select("token", "df")


@query(f"WITH {_T_SQL} SELECT toks[-1] AS token, count(*) AS df FROM t WHERE len(toks) > 0 GROUP BY 1")
def suffix_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.suffix_frequency(names(spark, sf_dir)).select("token", "df")


_NOISE_SQL = f"""{_T_SQL}, df AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT pos, unnest(toks) AS token FROM t) GROUP BY token),
g AS (SELECT token FROM df WHERE (df >= 4 OR df / (SELECT count(*) FROM t) >= 0.22) AND {_STRUCTURAL_SQL.format('token')}),
sf AS (SELECT toks[-1] AS token, count(*) AS c FROM t WHERE len(toks) > 0 GROUP BY 1),
s AS (SELECT token FROM sf WHERE (c >= 2 OR (c >= 8 AND length(token) <= 5)) AND (regexp_full_match(token, '[0-9]+') OR length(token) = 1 OR (length(token) <= 4 AND NOT regexp_matches(token, '[aeiou]'))))"""


@query(f"WITH {_NOISE_SQL} SELECT coalesce((SELECT string_agg(token, ' ' ORDER BY token) FROM g), '') AS global_stops, coalesce((SELECT string_agg(token, ' ' ORDER BY token) FROM s), '') AS suffix_stops")
def learned_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.learned_noise(names(spark, sf_dir)).select(F.array_join("global_stops", " ").alias("global_stops"), F.array_join("suffix_stops", " ").alias("suffix_stops"))


@query(f"""WITH {_NOISE_SQL},
w AS (SELECT coalesce((SELECT list(token) FROM g), []) AS gs, coalesce((SELECT list(token) FROM s), []) AS ss, (SELECT list(token) FROM df) AS vocabulary),
k AS (SELECT pos, col, toks, vocabulary, list_filter(toks, lambda x, i: NOT list_contains(gs, x) AND NOT (i = len(toks) AND list_contains(ss, x))) AS kept FROM t, w),
k2 AS (SELECT pos, col, vocabulary, CASE WHEN len(kept) > 0 THEN kept ELSE toks END AS kept FROM k),
c AS (SELECT pos, col, kept, CASE WHEN len(kept) = 1 AND length(kept[1]) >= 8 THEN list_filter(range(3, length(kept[1])::BIGINT - 2), lambda i: list_contains(vocabulary, left(kept[1], i)) AND list_contains(vocabulary, substr(kept[1], i + 1)))[1] END AS cut FROM k2)
SELECT col AS "column", CASE WHEN cut IS NOT NULL THEN left(kept[1], cut) || ' ' || substr(kept[1], cut + 1) ELSE array_to_string(kept, ' ') END AS concept FROM c""")
def normalized_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.with_concepts(names(spark, sf_dir)).select("column", "concept")


@query("""WITH t AS (SELECT list_filter(regexp_split_to_array(lower(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: length(x) > 1 AND NOT regexp_full_match(x, '[0-9]+')) AS toks FROM conversations),
p AS (SELECT toks[1] AS token, toks[2] AS nxt FROM t WHERE len(toks) >= 2)
SELECT token FROM p WHERE length(token) >= 3 AND token NOT IN ('admission','admit','discharge','assessment','visit','birth','death','date','time','year','years','age')
GROUP BY token HAVING count(DISTINCT nxt) >= 3""")
def leading_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.lit("r").alias("request_id"), F.col("text").alias("column"))
    return noise.leading_contexts(rows).select("token")


@query()
def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(profiles(spark, sf_dir).unionByName(clinical(spark)))
    return rows.select("request_id", "column", column_role(F.col("column"), F.col("concept"), F.col("values"), F.col("stats")).alias("role"))


@query()
def concept_role_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clustering.with_roles(prepared(profiles(spark, sf_dir)))
    return rows.groupBy(clustering.initial_key(F.col("concept"), F.col("role")).alias("key")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))


_C_SQL = f"c AS (SELECT pos, list_distinct(list_filter(regexp_split_to_array(lower(col), '[^a-z0-9]+'), lambda x: length(x) > 1 AND NOT regexp_full_match(x, '[0-9]+') AND NOT list_contains({text.OVERLAP_STOPS!r}, x))) AS toks FROM {_NAMES_SQL})"


@query(f"""WITH {_C_SQL} SELECT a.pos AS a, b.pos AS b, round(len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks))), 6) AS jaccard
FROM c a JOIN c b ON a.pos < b.pos AND list_has_any(a.toks, b.toks)""")
def concept_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = names(spark, sf_dir).select("pos", text.concept_tokens(F.col("column")).alias("toks"))
    sized = rows.select("pos", F.size("toks").alias("n"), F.explode("toks").alias("t"))
    a, b = sized.select("t", F.col("pos").alias("a"), F.col("n").alias("na")), sized.select("t", F.col("pos").alias("b"), F.col("n").alias("nb"))
    both = a.join(b, "t").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"))
    return both.select("a", "b", F.round(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")), 6).alias("jaccard"))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS a, e.vec_id AS b, round(list_cosine_similarity(q.v, e.v), 6) AS sim FROM q JOIN e ON q.vec_id <> e.vec_id)
SELECT a, max(sim) AS sim FROM s GROUP BY a""")
def embedding_cosine_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = vectors.nearest_cosines(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, "vec_id", "embedding")
    return best.select("a", F.round("sim", 6).alias("sim"))


@query("""WITH x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT label, i::INTEGER AS i, round(avg(v::DOUBLE), 6) AS mean FROM x GROUP BY label, i""")
def embedding_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("p", "v"))
    return rows.groupBy("label", (F.col("p") + 1).alias("i")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


_FNV_SQL = "list_reduce([2166136261::HUGEINT] || list_transform(string_split({0}, ''), lambda c: ascii(c)::HUGEINT), lambda h, b: (xor(h, b) * 16777619) & 4294967295)::BIGINT"
_VALUES_SQL = " UNION ALL ".join(f"SELECT '{t}' AS file, '{c}' AS col, unnest(list_slice(list_sort(list(DISTINCT {c})), 1, 15)) AS value FROM {t} WHERE {c} IS NOT NULL HAVING max(length({c})) <= 200" for t, cs in _TEXTS.items() for c in cs)
_CLINICAL_SQL = "(VALUES " + ", ".join(f"({i}, '{v}')" for i, (_, _, _, vs) in enumerate(CLINICAL) for v in vs[:15]) + ") AS c(pos, value)"


@query(f"""WITH x AS (SELECT 'tables' AS request_id, n.pos, v.value FROM ({_VALUES_SQL}) v JOIN {_NAMES_SQL} ON n.file = v.file AND n.col = v.col UNION ALL SELECT 'clinical', pos, value FROM {_CLINICAL_SQL}),
s AS (SELECT request_id, pos, {_NV_SQL.format("value")} AS s FROM x),
g AS (SELECT request_id, pos, unnest(list_filter(regexp_split_to_array(s, '[^a-z0-9]+'), lambda t: length(t) >= 2)) AS g, 1.0::DOUBLE AS w FROM s
UNION ALL SELECT request_id, pos, unnest(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))), 0.30 FROM s
UNION ALL SELECT request_id, pos, unnest(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))), 0.70 FROM s
UNION ALL SELECT request_id, pos, unnest(list_transform(range(1, length(s) - 2), lambda i: substr(s, i, 4))), 0.55 FROM s),
c AS (SELECT request_id, pos, g, sum(w) AS w FROM g GROUP BY ALL),
i AS (SELECT request_id, pos, {_FNV_SQL.format("g")} & 2047 AS idx, sum(w) AS w FROM c GROUP BY ALL),
m AS (SELECT request_id, pos, sqrt(sum(w * w)) AS norm FROM i GROUP BY ALL)
SELECT a.request_id, a.pos AS a, b.pos AS b, round(sum(a.w * b.w) / any_value(ma.norm * mb.norm), 6) AS cosine
FROM i a JOIN i b ON a.request_id = b.request_id AND a.idx = b.idx AND a.pos < b.pos
JOIN m ma ON ma.request_id = a.request_id AND ma.pos = a.pos JOIN m mb ON mb.request_id = b.request_id AND mb.pos = b.pos GROUP BY a.request_id, a.pos, b.pos""")
def value_vector_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clinical(spark).unionByName(profiles(spark, sf_dir))
    pairs = vectors.sparse_cosines(vectors.sparse_value_vectors(rows, ["request_id", "pos"]), "pos", ["request_id"])
    return pairs.select("request_id", "a", "b", F.round("cosine", 6).alias("cosine"))


@query("""SELECT p_brand AS request_id, 0 AS field_pos, 'type' AS name, 'string' AS type, '' AS description, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS enums FROM part GROUP BY p_brand
UNION ALL SELECT p_brand, 1, 'size', 'integer', 'Sizes of ' || p_brand || ', up to ' || max(p_size), '' FROM part GROUP BY p_brand
UNION ALL SELECT DISTINCT p_brand, 2, 'names', 'array<string>', '', '' FROM part""")
def schema_fields_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON Schema for each brand of parts."""
    brands = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("types"), F.max("p_size").alias("most"))
    told = F.concat(F.lit(' {"type": "integer", "description": "  Sizes of '), "p_brand", F.lit(", up to "), "most", F.lit(' "}'))
    body = F.concat(F.lit('{"properties": {"type": {"type": ["string", "null"], "enum": '), F.to_json("types"), F.lit('}, "size":'), told, F.lit(', "names": {"type": "array", "items": {"type": "string"}}}}'))
    fields = schema_fields(brands.select(F.col("p_brand").alias("request_id"), body.alias("schema")))
    return fields.select("request_id", "field_pos", "name", "type", "description", F.array_join("enum_values", "|").alias("enums"))


def _everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of all tables and the clinical request, profiled once."""
    return durable(profiles(spark, sf_dir).unionByName(clinical(spark)))


def _fields(spark: SparkSession, *requests: str) -> DataFrame:
    return schema_fields(spark.createDataFrame([(r, SCHEMA) for r in requests or ("clinical",)], "request_id string, schema string"))


@query()
def schema_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _everything(spark, sf_dir)
    best = matching.best_fields(prepared(every), _fields(spark, "tables", "clinical"), noise.leading_contexts(every))
    return best.select("request_id", "pos", "field_pos", "quality", F.round("sim", 6).alias("sim"))


@query("""WITH r AS (SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM r WHERE r = 1)
SELECT o_custkey AS target, o_orderpriority AS file_key, o_orderkey AS pos, rank FROM k WHERE rank <= 30""")
def one_per_file_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("target"), F.col("o_orderpriority").alias("file_key"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("sim"))
    return matching.one_per_file(rows, ["target"]).drop("sim")


@query("""SELECT o_custkey AS cluster, o_orderkey AS pos, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS batch FROM orders""")
def round_robin_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cluster"), F.col("o_orderstatus").alias("file_key"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("sim"))
    return matching.round_robin_batches(rows, ["cluster"]).select("cluster", "pos", "batch")


@query("""SELECT c_custkey AS pos FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def coverage_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = read(spark, sf_dir, "customer").select(F.lit("r").alias("request_id"), F.lit("f").alias("file_key"), F.col("c_custkey").alias("column"))
    urgent = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    used = urgent.select(F.lit("r").alias("request_id"), F.lit("f").alias("file_key"), F.col("o_custkey").alias("column")).distinct()
    return matching.uncovered(columns, used).select(F.col("column").alias("pos"))


@query(f"""WITH {_CLINIC_SQL} SELECT request_id, (k * 12 + i)::INTEGER AS pos, "column", x.kind AS kind, lo, hi, step FROM n JOIN (VALUES (0, 0, 'TOTBarthel', 'BARTHEL_TOTAL', 0, 100, 5), (1, 1, 'barthel_total', 'BARTHEL_TOTAL', 0, 100, 10),
(0, 2, 'BToilet', 'BARTHEL_ITEM', 0, 10, 5), (1, 3, 'FIM_toilet', 'FIM', 1, 7, 1), (0, 4, 'NIHSS_admission', 'NIHSS', 0, 42, 1), (1, 5, 'painScore', 'PAIN_NRS', 0, 10, 1)) AS x(parity, i, "column", kind, lo, hi, step) ON x.parity = n.kind""")
def scale_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values.scale_domains(_members(clinic(spark, sf_dir), "pos")).where("domain is not null")
    return rows.select("request_id", "pos", "column", "domain.kind", "domain.lo", "domain.hi", "domain.step")


@query(f"""WITH {_CLINIC_SQL}, r AS (SELECT request_id, count(*) AS c, min(kind) AS least FROM n GROUP BY 1 HAVING count(*) >= 2),
f AS (SELECT unnest(range(1, 8)) AS cat), j AS (SELECT cat, floor((cat - 1) * 2.0 / 6 + 0.5) AS b FROM f), x AS (SELECT b, min(cat) AS lo, max(cat) AS hi FROM j GROUP BY b),
o AS (SELECT 0 AS least, 1 AS kind, b::INTEGER AS bucket, (b * 5)::INTEGER::VARCHAR AS name, 'FIM_toilet' AS "column", lo::DOUBLE AS lo, hi::DOUBLE AS hi FROM x
UNION ALL SELECT 0, 0, i::INTEGER, (i * 5)::VARCHAR, 'BToilet', (i * 5)::DOUBLE, CASE WHEN i < 2 THEN i * 5 + 4 ELSE 10 END::DOUBLE FROM range(3) r(i)
UNION ALL SELECT 1, 1, cat::INTEGER - 1, cat::VARCHAR, 'FIM_toilet', cat::DOUBLE, cat::DOUBLE FROM f)
SELECT n.request_id, n.k, o.bucket, o.name, o."column", o.lo, o.hi FROM n JOIN r USING (request_id) JOIN o ON o.least = r.least AND o.kind = n.kind""")
def ordinal_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clinic(spark, sf_dir).where("column in ('BToilet', 'FIM_toilet')")
    out = values.ordinal_crosswalk(_members(rows, "1")).select("request_id", "bucket", "name", F.explode("refs").alias("r"))
    return out.select("request_id", F.floor(F.col("r.pos") / 12).alias("k"), "bucket", "name", "r.column", "r.lo", "r.hi")


@query("""SELECT 'lineitem' AS file, 'l_quantity' AS "column", 'double' AS name, round(min(l_quantity), 4) AS lo, round(max(l_quantity), 4) AS hi FROM lineitem
UNION ALL SELECT 'part', 'p_size', 'integer', min(p_size)::DOUBLE, max(p_size)::DOUBLE FROM part
UNION ALL SELECT 'lineitem', 'l_shipdate', 'date', epoch_ms(min(l_shipdate))::DOUBLE, epoch_ms(max(l_shipdate))::DOUBLE FROM lineitem""")
def range_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile_tables({t: read(spark, sf_dir, t) for t in ("part", "lineitem")}).where("column in ('l_quantity', 'p_size', 'l_shipdate')")
    out = _flat(values.range_buckets(_members(rows, "pos")))
    return out.select(F.when(F.col("column").startswith("l_"), "lineitem").otherwise("part").alias("file"), "column", "name", "lo", "hi")


# Columns with few values; the first two make one mapping, as two sources of it, the others one each.
_CATEGORIES = ["o_orderstatus", "l_linestatus", "o_orderpriority", "c_mktsegment", "l_returnflag", "r_name", "n_name", "event_type"]
_CATEGORIES_SQL = " UNION ALL ".join(
    f"SELECT {max(i - 1, 0)} AS mapping, '{c}' AS col, raw, {_NV_SQL.format('raw')} AS nv FROM (SELECT DISTINCT {c} AS raw FROM {_TABLE_OF[c]} WHERE {c} IS NOT NULL ORDER BY raw LIMIT 80)"
    for i, c in enumerate(_CATEGORIES)
)


@query(f"""WITH v AS ({_CATEGORIES_SQL}), g AS (SELECT mapping, nv AS name, count(*) AS c FROM v WHERE nv <> '' GROUP BY ALL),
r AS (SELECT mapping, name, (row_number() OVER (PARTITION BY mapping ORDER BY c DESC, name) - 1)::INTEGER AS bucket, count(*) OVER (PARTITION BY mapping) AS n FROM g)
SELECT r.bucket, r.name, v.col AS "column", v.raw AS value FROM r JOIN v ON v.mapping = r.mapping AND v.nv = r.name WHERE r.n BETWEEN 2 AND 25""")
def identity_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profiles(spark, sf_dir).where(F.col("column").isin(_CATEGORIES))
    mapping = F.greatest(F.array_position(F.lit(_CATEGORIES), F.col("column")) - 2, F.lit(0))
    members = prepared(rows).withColumns({"mapping": mapping.cast("long"), "type": F.lit("")})
    return _flat(values.identity_buckets(members)).select("bucket", "name", "column", "value")


@query(f"""WITH {_CLINIC_SQL} SELECT request_id, 1::BIGINT AS mapping, a, b FROM (SELECT request_id FROM n GROUP BY 1 HAVING count(DISTINCT kind) = 2), (VALUES ('f', 'female'), ('m', 'male')) AS x(a, b)""")
def closed_domain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values.closed_domain_edges(_members(clinic(spark, sf_dir).where("lower(column) = 'sex'"), "1"))


@query(f"""WITH {_CLINIC_SQL}, t AS (SELECT DISTINCT request_id, kind, t FROM n JOIN (VALUES (0, 'm'), (0, 'f'), (1, 'male'), (1, 'female')) AS x(parity, t) ON parity = kind)
SELECT a.request_id, a.t, min(b.t) AS root FROM t a JOIN t b ON a.request_id = b.request_id AND left(a.t, 1) = left(b.t, 1) GROUP BY 1, 2""")
def closed_domain_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values.closed_domain_components(_members(clinic(spark, sf_dir).where("lower(column) = 'sex'"), "1")).select("request_id", "t", "root")


@query()
def clustered_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile_tables({t: read(spark, sf_dir, t) for t in ("part", "events")}).where("column in ('p_brand', 'event_type')")
    return _flat(values.clustered_buckets(_members(rows, "pos")))


@query()
def enum_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile_tables({"orders": read(spark, sf_dir, "orders")}).where("column = 'o_orderpriority'")
    enums = spark.createDataFrame([("tables", 1, i, e) for i, e in enumerate(["urgent", "high", "medium", "not specified", "low"])], "request_id string, mapping long, enum_pos int, enum string")
    return _flat(values.enum_buckets(_members(rows, "1"), enums))


_QUERY_SQL = "trim(regexp_replace(lower(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '_-/', '   '), '[^\\w\\s]', ' ', 'g')), '\\s+', ' ', 'g'))"
_VARIANTS_SQL = """q AS (SELECT {key}, {query} AS q FROM {table}),
t AS (SELECT {key}, q, list_filter(string_split(q, ' '), lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+')) AS toks FROM q),
n AS (SELECT {key}, toks, unnest(range(1, len(toks) + 1)) AS k FROM t), r AS (SELECT {key}, toks, k, unnest(range(1, len(toks) - k + 2)) AS s FROM n),
v AS (SELECT {key}, q AS variant FROM t WHERE q <> '' UNION SELECT {key}, array_to_string(list_filter(string_split(q, ' '), lambda x: NOT regexp_full_match(x, '[0-9]*')), ' ') FROM t
UNION SELECT {key}, array_to_string(list_slice(toks, s, s + k - 1), ' ') FROM r WHERE k = 1 OR k < len(toks))"""


@query("WITH " + _VARIANTS_SQL.format(key="item_id", query=_QUERY_SQL.format("text"), table="benchmark") + " SELECT DISTINCT item_id, variant FROM v WHERE variant <> ''")
def search_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.search_variant_rows(read(spark, sf_dir, "benchmark").select("item_id", "text"), "text").select("item_id", "variant").distinct()


_WORDS_SQL = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


@query(f"""WITH src AS (SELECT p_name AS query FROM part UNION SELECT text FROM benchmark), q AS (SELECT query, {_QUERY_SQL.format("query")} AS q FROM src),
t AS (SELECT query, q, list_filter(string_split(q, ' '), lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+')) AS toks FROM q),
n AS (SELECT query, toks, unnest(range(1, len(toks) + 1)) AS k FROM t), r AS (SELECT query, toks, k, unnest(range(1, len(toks) - k + 2)) AS s FROM n),
v AS (SELECT query, 0 AS ord, q AS variant FROM t UNION ALL SELECT query, 1, array_to_string(list_filter(string_split(q, ' '), lambda x: NOT regexp_full_match(x, '[0-9]*')), ' ') FROM t
UNION ALL SELECT query, 2 + (len(toks) - k) * len(toks) + s, array_to_string(list_slice(toks, s, s + k - 1), ' ') FROM r WHERE k = 1 OR k < len(toks)),
l AS (SELECT query, ord, variant, list_sort(list_transform({_WORDS_SQL.format("variant")}, lambda w: {{'n': length(w), 'w': w}}), 'DESC')[1].w AS longest FROM v WHERE variant <> ''),
d AS (SELECT item_id, lower(text) AS label, {_WORDS_SQL.format("text")} AS words FROM benchmark),
m AS (SELECT query, item_id, label, min(ord) AS ord FROM l JOIN d ON list_contains(words, longest) AND contains(label, variant) GROUP BY ALL)
SELECT query, rank, concept_id FROM (SELECT query, item_id AS concept_id, (row_number() OVER (PARTITION BY query ORDER BY ord, item_id))::INTEGER AS rank FROM m) WHERE rank <= 12""")
def term_lookup_top12(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("concept_id"), F.col("text").alias("label"))
    queries = read(spark, sf_dir, "part").select(F.col("p_name").alias("query")).unionByName(dictionary.select(F.col("label").alias("query")))
    return terminology.suggestions(queries, dictionary).select("query", "rank", "concept_id")


_LABEL_SQL = "CASE p_partkey % 5 WHEN 0 THEN p_name || ' | ' || p_partkey * p_size * 37 WHEN 1 THEN ' ' || p_partkey * 1000 WHEN 2 THEN p_name || '|' || p_partkey * 100000 WHEN 3 THEN p_type || ' | C' || p_partkey * 100000 ELSE p_name END"


@query(f"SELECT p_partkey, label, CASE WHEN regexp_full_match(trim(label), '.+ [|] [0-9]{{6,}}') OR regexp_full_match(trim(label), '[0-9]{{6,}}') THEN trim(label) ELSE '' END AS gated FROM (SELECT p_partkey, {_LABEL_SQL} AS label FROM part)")
def terminology_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", F.expr(_LABEL_SQL).alias("label"))
    return rows.select("p_partkey", "label", text.terminology_gate(F.col("label")).alias("gated"))


@query("SELECT DISTINCT p_size, p_brand, (length(p_brand) >= 2 AND NOT regexp_full_match(p_brand, '[0-9]+') AND length(regexp_replace(p_brand, '[^A-Za-z]', '', 'g')) >= 2) AS valid, CASE WHEN length(p_size::VARCHAR) < 3 THEN p_size::VARCHAR || ' ' || p_brand ELSE p_size::VARCHAR END AS padded FROM part")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    return read(spark, sf_dir, "part").select("p_size", "p_brand", text.is_search_term(F.col("p_brand")).alias("valid"), text.padded_term(size, F.col("p_brand")).alias("padded")).distinct()


@query("SELECT c_custkey, trim(c_mktsegment) AS context, trim(c_name) AS term FROM customer")
def split_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = read(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" | ", "c_mktsegment", "c_name").alias("key"))
    return keyed.select("c_custkey", text.split_key(F.col("key"))["context"].alias("context"), text.split_key(F.col("key"))["term"].alias("term"))


@query("SELECT DISTINCT p_type AS value, upper(left(p_type, 1)) || substr(p_type, 2) || ' as a category of Type.' AS description FROM part UNION ALL SELECT DISTINCT p_size::VARCHAR, 'Score ' || p_size || ' of 50 measuring Type.' FROM part")
def describe_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    rows = part.select(F.col("p_type").alias("value")).distinct().unionByName(part.select(F.col("p_size").cast("string").alias("value")).distinct())
    rows = rows.withColumns({"label": F.lit("Type"), "lo": F.lit(1.0), "hi": F.lit(50.0)})
    return terminology.value_descriptions(rows).select("value", "description")


@query(f"""SELECT col AS name, upper(left(d, 1)) || substr(d, 2) || '.' AS description FROM (SELECT col, lower(trim(regexp_replace(regexp_replace(col, '[_-]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS d FROM {_NAMES_SQL})""")
def describe_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = names(spark, sf_dir).select(F.col("column").alias("name"), F.lit("").alias("terminology"))
    return terminology.column_descriptions(rows).select("name", "description")


@query("""WITH b AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
SELECT user_id AS node_id, floor((epoch_us(now) - epoch_us(last)) / 60000000)::BIGINT AS minutes, floor((epoch_us(now) - epoch_us(last)) / 60000000) <= 2 AS alive FROM b, n""")
def node_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = read(spark, sf_dir, "events").select(F.col("user_id").alias("node_id"), F.col("ts").cast("timestamp").alias("ts"))
    now = F.lit(beats.agg(F.max("ts").alias("now")).first().now)
    return platform.node_health(beats.select("node_id").distinct(), beats, now).select("node_id", "minutes", "alive")


@query("""SELECT user_id AS job_id, arg_max(event_type, event_id) AS state, least(100, greatest(0, arg_max(value, event_id)))::INTEGER AS percent FROM (SELECT *, event_type FROM events) GROUP BY user_id""")
def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"), F.round("value", 0).alias("percent"))
    return platform.job_states(rows)


ORACLE["job_latest_state"] = "SELECT user_id AS job_id, arg_max(event_type, event_id) AS state, least(100, greatest(0, arg_max(round(value), event_id)))::INTEGER AS percent FROM events GROUP BY user_id"


@query("""SELECT user_id, failures, least(60000, 2000 * (2 ** least(10, failures - 1)))::BIGINT AS wait_ms FROM (SELECT user_id, count(*) AS failures FROM events WHERE value < 10 GROUP BY user_id)""")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each user waits after the failures that its events count."""
    failed = read(spark, sf_dir, "events").where("value < 10").groupBy("user_id").agg(F.count("*").alias("failures"))
    return failed.select("user_id", "failures", scales.backoff_ms(F.col("failures")).alias("wait_ms"))


@query("SELECT (SELECT count(*) FROM customer) AS members, (SELECT count(*) FROM nation) AS nodes, (SELECT count(*) FROM supplier) AS datasets, (SELECT max(o_orderdate) FROM orders) AS last_access")
def project_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_access"))
    members = read(spark, sf_dir, "customer").join(last, "c_custkey", "left")
    nodes = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node_id"))
    return platform.platform_stats(members, nodes, read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("node_id")))


@query("SELECT n_nationkey AS node_id FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey = 3)")
def user_access_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    grants = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").alias("node_id"))
    return platform.accessible(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node_id")), grants, F.lit(3))


@query("SELECT ip, node_id, seq FROM (SELECT s_nationkey AS ip, s_name AS node_id, s_suppkey AS seq, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) AS r FROM supplier) WHERE r = 1")
def node_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return platform.registered(read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("ip"), F.col("s_name").alias("node_id"), F.col("s_suppkey").alias("seq")))


def _shown(parts: Parts) -> DataFrame:
    return parts[0].select("request_id", "ord", "union_key", "mapping_type", "kind", F.array_join("columns", "|").alias("columns"), "buckets")


@query()
def cluster_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_columns(prepared(profiles(spark, sf_dir).unionByName(clinical(spark))))


@query()
def harmonize_schemaless(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(schemaless_parts(profiles(spark, sf_dir).unionByName(clinical(spark)), texts=texts(spark, sf_dir)))


@query()
def harmonize_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(schema_parts(_everything(spark, sf_dir), _fields(spark, "tables", "clinical"), texts=texts(spark, sf_dir)))


@query()
def enrich_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = spark.createDataFrame([("123456", "Barthel total"), ("654321", "Male"), ("230690007", "Stroke")], "concept_id string, label string")
    # Codes of fewer than six digits don't pass the terminology gate.
    listed = read(spark, sf_dir, "benchmark").select(F.lpad(F.col("item_id").cast("string"), F.greatest(F.length(F.col("item_id").cast("string")), F.lit(6)), F.lit("0")).alias("concept_id"), F.col("text").alias("label"))
    mappings, buckets = schemaless_parts(_everything(spark, sf_dir), texts=texts(spark, sf_dir))
    found, values = enriched_parts(mappings, coded.unionByName(listed), buckets=buckets)
    counts = values.groupBy("request_id", "ord").agg(F.count("*").cast("int").alias("n"))
    return found.join(counts, ["request_id", "ord"], "left").select("request_id", "ord", "union_key", "terminology", "description", "n")
