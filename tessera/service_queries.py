"""Queries over what the harmonization service keeps, answers and repairs, with their SQL. They join those of
``queries``."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .functions.register import register
from .operators import clustering, matching, platform, terminology
from .plans.enrich import enrich
from .plans.suggest import hierarchy_json, prepared, suggest_schemaless
from .queries import _CAMEL_SQL, _everything, clinic, query
from .runtime import new_folder, read
from .sources.server import register as register_source
from .sources.server import write_pages
from .sources import catalog, collections
from .streaming.heartbeats import liveness
from .streaming.jobs import TRANSITIONS, replay


@query("""SELECT row_number() OVER (ORDER BY t)::VARCHAR AS id, t AS label, '' AS description, 'http://example.org/ontology/' || t AS iri
FROM (SELECT DISTINCT p_type AS t FROM part) WHERE contains(lower(t), lower((SELECT max(split_part(p_type, ' ', 1)) FROM part)))""")
def ontology_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = read(spark, sf_dir, "part").select(F.col("p_type").alias("name")).distinct().select(F.col("name").alias("pos"), "name")
    (word,) = types.agg(F.max(F.split_part("name", F.lit(" "), F.lit(1)))).first()
    return catalog.ontology_classes(types, word.upper())


@query("""SELECT n_name AS class, 0 AS pos, 'key' AS name, n_nationkey % 2 = 0 AS optional, 'integer' AS type FROM nation
UNION ALL SELECT n_name, 1, 'region', false, '' FROM nation""")
def class_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.concat(F.lit('[{"name":"key","optional":'), (F.col("n_nationkey") % 2 == 0).cast("string"), F.lit(',"type":"integer"},{"name":"region"}]'))
    forms = read(spark, sf_dir, "nation").select(F.col("n_name").alias("class"), form.alias("form"))
    broken = spark.createDataFrame([("broken", '[{"name":'), ("none", None)], "class string, form string")
    return catalog.class_fields(forms.unionByName(broken))


_METADATA = """'{"@context":"x","dataset":' || CASE {0} % 5 WHEN 0 THEN '{"title":"' || {1} || '","keyword":"solo","publisher":{"name":"P' || {0} || '","country":"x"},"extra":[1,{"a":true}]}'
WHEN 1 THEN '[{"title":"' || {1} || '","keyword":["k1",{"label":"k2"},3],"publisher":"plain","hasPersonalData":true},{"title":null,"distribution":{"format":"csv","odd":2.5}}]'
WHEN 2 THEN '[{"keyword":{"prefLabel":"' || {1} || '"},"distribution":[{"title":"d","format":{"@id":"f"}},"text"],"variables":[{"name":"v1","dataType":["a","b"]},{"name":"v2"}]}]'
WHEN 3 THEN '[]' ELSE '"none"' END || '}'"""
_METADATA_SQL = "CASE WHEN s_suppkey % 7 = 0 THEN '{\"dataset\"' ELSE " + _METADATA.replace("{0}", "s_suppkey").replace("{1}", "s_name") + " END"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DCAT document for each supplier, with fields of every form; some don't parse."""
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node_id"), F.expr(_METADATA_SQL).alias("document"))


_DATASETS_SQL = f"""d AS (SELECT s_suppkey AS node_id, try_cast({_METADATA_SQL} AS JSON) AS j FROM supplier),
l AS (SELECT node_id, CASE json_type(j, '$.dataset') WHEN 'ARRAY' THEN CAST(json_extract(j, '$.dataset') AS JSON[]) WHEN 'OBJECT' THEN [json_extract(j, '$.dataset')] ELSE [] END AS l FROM d),
s AS (SELECT node_id, unnest(l) AS o, generate_subscripts(l, 1) - 1 AS dataset FROM l)"""


@query(f"""WITH {_DATASETS_SQL},
p AS (SELECT node_id, 'dataset' AS part, dataset, 0 AS item, o FROM s
UNION ALL SELECT node_id, part, dataset, i, o FROM (SELECT node_id, part, dataset, unnest(l) AS o, generate_subscripts(l, 1) - 1 AS i FROM (
SELECT node_id, x.part, dataset, CASE json_type(o, x.path) WHEN 'ARRAY' THEN CAST(json_extract(o, x.path) AS JSON[]) WHEN 'OBJECT' THEN [json_extract(o, x.path)] ELSE [] END AS l
FROM s, (VALUES ('distribution', '$.distribution'), ('variable', '$.variables')) AS x(part, path))) WHERE json_type(o) = 'OBJECT'),
f AS (SELECT node_id, part, dataset, item, o, unnest(json_keys(o)) AS field FROM p),
v AS (SELECT node_id, part, dataset, item, field, json_extract(o, '$."' || field || '"') AS v FROM f WHERE part <> 'dataset' OR field NOT IN ('distribution', 'variables')),
i AS (SELECT node_id, part, dataset, item, field, unnest(l) AS v, generate_subscripts(l, 1) - 1 AS index FROM (SELECT *, CASE WHEN json_type(v) = 'ARRAY' THEN CAST(v AS JSON[]) ELSE [v] END AS l FROM v)),
k AS (SELECT *, CASE json_type(v) WHEN 'OBJECT' THEN 'object' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind FROM i WHERE json_type(v) <> 'NULL')
SELECT node_id, part, dataset, item, field, index, kind,
CASE WHEN kind = 'object' THEN coalesce(v->>'name', v->>'title', v->>'label', v->>'prefLabel', v->>'uri', v->>'$."@id"', v::VARCHAR) ELSE v->>'$' END AS text,
list_contains(CASE part WHEN 'dataset' THEN {catalog.DATASET!r} WHEN 'distribution' THEN {catalog.DISTRIBUTION!r} ELSE {catalog.VARIABLE!r} END, field) AS known FROM k""")
def node_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.node_metadata(_documents(spark, sf_dir))
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("dataset", "index")})


@query(f"""WITH {_DATASETS_SQL}, w AS (SELECT node_id, dataset, o, CASE json_type(o, '$.keyword') WHEN 'ARRAY' THEN CAST(o->'$.keyword' AS JSON[]) WHEN 'NULL' THEN [] ELSE CASE WHEN (o->'$.keyword') IS NULL THEN [] ELSE [o->'$.keyword'] END END AS k FROM s)
SELECT node_id, dataset, o->>'$.title' AS title, array_to_string(list_transform(k, lambda x: coalesce(CASE WHEN json_type(x) = 'OBJECT' THEN coalesce(x->>'label', x->>'prefLabel') END, x->>'$')), '|') AS keywords,
CASE WHEN json_type(o, '$.publisher') = 'OBJECT' THEN o->>'$.publisher.name' ELSE o->>'$.publisher' END AS publisher,
(CASE json_type(o, '$.distribution') WHEN 'ARRAY' THEN 1 WHEN 'OBJECT' THEN 1 ELSE 0 END)::BIGINT AS distributions, coalesce(json_array_length(o, '$.variables'), 0)::BIGINT AS variables,
coalesce(CASE WHEN (o->'$.extra') IS NOT NULL THEN (o->>'$.extra[0]') || '|' || (o->>'$.extra[1]') END, '') AS extra FROM w""")
def node_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.node_datasets(_documents(spark, sf_dir))
    extra = F.coalesce(F.try_element_at("additional", F.lit("extra")), F.lit(""))
    return rows.select("node_id", F.col("dataset").cast("bigint").alias("dataset"), "title", F.array_join("keywords", "|").alias("keywords"), "publisher", "distributions", "variables", extra.alias("extra"))


@query("""SELECT user_id AS slot, arg_max(coalesce(props, ''), event_id) AS schema FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'view'""")
def current_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    saves = F.when(F.col("event_type") != "view", F.coalesce("props", F.lit("")))
    return catalog.current_schema(read(spark, sf_dir, "events").select(F.col("user_id").alias("slot"), F.col("event_id").alias("seq"), saves.alias("schema")))


@query("""WITH l AS (SELECT page_id, lower(regexp_extract(trim(url), '^(http://[^/?#]+)', 1, 'i')) AS origin, page_id % 3 AS k FROM pages WHERE page_id % 11 <> 0
UNION ALL SELECT s_suppkey, 'http://node' || s_nationkey || ':80', s_suppkey % 3 FROM supplier WHERE s_suppkey % 11 <> 0)
SELECT origin, CASE WHEN arg_max(k, page_id) = 0 THEN origin ELSE 'http://up' || max(page_id) END AS upstream, CASE WHEN arg_max(k, page_id) = 2 THEN 's' || max(page_id) END AS secret FROM l WHERE origin <> '' GROUP BY origin""")
def trusted_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), F.trim("url").alias("url"))
    nodes = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), F.concat(F.lit("HTTP://node"), "s_nationkey", F.lit(":80/path")).alias("url"))
    up = F.concat(F.lit("|http://up"), "pos")
    rest = F.when(F.col("pos") % 3 == 0, F.lit("")).when(F.col("pos") % 3 == 1, up).otherwise(F.concat(up, F.lit("| s"), "pos"))
    line = F.concat(F.when(F.col("pos") % 11 == 0, F.lit("# ")).otherwise(F.lit(" ")), "url", rest)
    blank = spark.createDataFrame([(-1, ""), (-2, "ftp://x|y"), (-3, "|http://y")], "pos long, line string")
    return catalog.trusted_routes(pages.unionByName(nodes).select("pos", line.alias("line")).unionByName(blank))


@query("""SELECT o_custkey AS mapping, o_orderpriority AS file_key, min(o_orderkey) AS pos FROM orders GROUP BY ALL""")
def first_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("mapping"), F.col("o_orderpriority").alias("file_key"), F.col("o_orderkey").alias("pos"))
    return matching.first_per_file(rows, ["mapping"])


@query("""WITH v AS (SELECT p_brand AS k, CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE p_size::VARCHAR END AS name, min(p_partkey) AS pos FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) AS r FROM v), f AS (SELECT *, try_cast(name AS DOUBLE) AS d FROM r WHERE r <= 10),
b AS (SELECT *, min(d) OVER (PARTITION BY k) AS l, max(d) OVER (PARTITION BY k) AS h FROM f)
SELECT k, pos, name, CASE WHEN d IS NULL THEN 'a' WHEN l < h THEN l::BIGINT::VARCHAR END AS lo, CASE WHEN d IS NOT NULL AND l < h THEN h::BIGINT::VARCHAR END AS hi FROM b""")
def value_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")).otherwise(F.col("p_size").cast("string"))
    rows = read(spark, sf_dir, "part").select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("pos"), name.alias("name"), F.lit("a").alias("lo"), F.lit(None).cast("string").alias("hi"))
    return terminology.value_specs(rows, ["k"])


@query("SELECT conv_id, turn, regexp_replace(translate(lower(" + _CAMEL_SQL.format("trim(text)") + "), '_-', '  '), '\\s+', ' ', 'g') AS name FROM conversations")
def normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize_name(F.col("text")).alias("name"))


@query("""WITH d AS (SELECT DISTINCT p_name AS term, p_brand AS context FROM part),
h AS (SELECT *, list_reduce([0::HUGEINT] || list_transform(string_split(term || context, ''), lambda c: ascii(c)::HUGEINT), lambda h, c: (h * 31 + c) & 4294967295) AS u FROM d)
SELECT term, context, 'CONCEPT_' || lpad((abs(CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END) % 1000000000)::VARCHAR, 9, '0') AS code FROM h""")
def fallback_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(F.col("p_name").alias("term"), F.col("p_brand").alias("context")).distinct()
    return rows.select("term", "context", text.fallback_code(F.col("term"), F.col("context")).alias("code"))


@query("""SELECT c_mktsegment || ' ' || c_nationkey AS query, arg_min(c_name, c_custkey) AS context FROM customer
WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_suppkey % 4 = 0) GROUP BY 1""")
def lookup_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.concat_ws(" ", "c_mktsegment", "c_nationkey").alias("query"), F.col("c_name").alias("context"))
    segments = read(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    found = read(spark, sf_dir, "supplier").where("s_suppkey % 4 = 0").select("s_nationkey").distinct().join(F.broadcast(segments)).select(F.concat_ws(" ", "c_mktsegment", "s_nationkey").alias("query"))  # five segments
    return terminology.missing(asked, found)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE p_brand END AS k, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE p_type END AS label FROM part""")
def repaired_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('{"'), "p_brand", F.lit('": "'), "p_type", F.lit('"}'))
    k = F.col("p_partkey") % 4
    answer = F.when(k == 0, body).when(k == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n``` done"))).when(k == 2, F.concat(F.lit("x "), body)).otherwise(F.lit("I can't {say}."))
    rows = read(spark, sf_dir, "part").select("p_partkey", text.repaired_map(answer).alias("m"))
    first = lambda f: F.coalesce(F.get(f("m"), F.lit(0)), F.lit(""))
    return rows.select("p_partkey", first(F.map_keys).alias("k"), first(F.map_values).alias("label"))


@query("""SELECT DISTINCT p_brand AS context, p_size::VARCHAR AS value, CASE WHEN p_size = 1 THEN 'q 1 none at all' WHEN p_size = 2 THEN 'q 2 some' ELSE 'q ' || p_size END AS query FROM part""")
def scale_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(F.col("p_brand").alias("context"), F.col("p_size").cast("string").alias("value")).distinct()
    answers = rows.select("context").distinct().withColumn("answer", F.lit('Labels: {"1": " none at all ", "2": "some", "3": " "}'))
    return terminology.with_scale_labels(rows.withColumn("query", F.concat_ws(" ", F.lit("q"), "value")), answers)


@query("""WITH e AS (SELECT s_nationkey AS ip, s_name AS node_id, s_suppkey AS seq, s_suppkey % 5 = 0 AS gone FROM supplier),
l AS (SELECT *, max(CASE WHEN gone THEN seq END) OVER (PARTITION BY ip) AS since FROM e)
SELECT ip, min(seq) AS seq, arg_min(node_id, seq) AS node_id FROM l WHERE NOT gone AND (since IS NULL OR seq > since) GROUP BY ip""")
def node_registration_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("s_suppkey") % 5 == 0, F.lit("deregister"))
    events = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("ip"), F.col("s_name").alias("node_id"), F.col("s_suppkey").alias("seq"), op.alias("op"))
    return platform.registered(events, overwrite=False).select("ip", "node_id", "seq")


@query("""SELECT p_partkey AS concept_id, CASE p_partkey % 6 WHEN 0 THEN trim(p_name) WHEN 1 THEN p_type WHEN 2 THEN p_brand WHEN 3 THEN p_type WHEN 4 THEN p_brand ELSE 'id ' || p_name END AS label FROM part""")
def server_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: F.concat(F.lit('"'), F.col(c) if c in ("p_name", "p_type", "p_brand") else F.lit(c), F.lit('"'))
    k = F.col("p_partkey") % 6
    part = [
        F.concat(F.lit('"term":'), s("p_name"), F.lit(',"pt":{"term":"no"}')), F.concat(F.lit('"concept":{"pt":{"term":'), s("p_type"), F.lit("}}")),
        F.concat(F.lit('"term":" ","concept":{"fsn":{"term":'), s("p_brand"), F.lit("}}")), F.concat(F.lit('"pt":{"term":'), s("p_type"), F.lit("}")),
        F.concat(F.lit('"fsn":{"term":'), s("p_brand"), F.lit("}")), F.concat(F.lit('"idAndFsnTerm":"id '), F.col("p_name"), F.lit(' |"')),
    ]
    body = F.coalesce(*(F.when(k == i, p) for i, p in enumerate(part)))
    item = F.concat(F.lit('{"conceptId":"'), "p_partkey", F.lit('",'), body, F.lit("}"))
    return terminology.concepts(read(spark, sf_dir, "part").select(item.alias("item"))).select(F.col("concept_id").cast("bigint").alias("concept_id"), "label")


@query("""WITH d AS (SELECT DISTINCT p_name AS s FROM part) SELECT s, list_reduce([2166136261::HUGEINT] || list_transform(string_split(s, ''), lambda c: ascii(c)::HUGEINT), lambda h, b: (xor(h, b) * 16777619) & 4294967295)::BIGINT AS h FROM d""")
def registered_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    return spark.sql("SELECT DISTINCT p_name AS s, fnv1a32(p_name) AS h FROM {part}", part=read(spark, sf_dir, "part"))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine
FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def sql_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    return spark.sql("""SELECT a.vec_id AS a, b.vec_id AS b, round(vector_cosine(CAST(a.embedding AS ARRAY<DOUBLE>), CAST(b.embedding AS ARRAY<DOUBLE>)), 6) AS cosine
        FROM {e} a JOIN {e} b ON b.vec_id = a.vec_id + 1""", e=read(spark, sf_dir, "embeddings"))


@query()
def abbreviation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of concepts of one request of which one abbreviates the other."""
    register(spark)
    rows = prepared(_everything(spark, sf_dir)).select("request_id", "concept").where("concept <> ''").distinct()
    return spark.sql("SELECT a.request_id, a.concept AS a, b.concept AS b FROM {c} a JOIN {c} b ON a.request_id = b.request_id AND a.concept < b.concept WHERE is_abbreviation(a.concept, b.concept)", c=rows)


@query()
def column_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.column_prompts(prepared(_everything(spark, sf_dir)))
    return rows.select("request_id", "pos", "column", F.get("prompts", F.lit(0)).alias("prompt"))


@query()
def suggestion_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response of each request, with terminology and descriptions."""
    every = _everything(spark, sf_dir)
    mappings = suggest_schemaless(every)
    coded = spark.createDataFrame([("123456", "Barthel total"), ("654321", "Male"), ("230690007", "Stroke")], "concept_id string, label string")
    asked = spark.createDataFrame([("tables",), ("clinical",), ("empty",)], "request_id string")
    return hierarchy_json(mappings, every, enrich(mappings, coded), asked)


@query()
def liveness_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transitions of nodes that a replay of the events gives, by event time, in one run over what is there."""
    at = new_folder(spark, "liveness")
    beats = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir.rstrip('/')}/events.parquet*")
    beats = beats.select(F.col("user_id").alias("node_id"), F.col("ts").cast("timestamp").alias("ts"))
    run = liveness(beats, "event").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("node_id string, state string, at_ms long").parquet(f"{at}/out")


@query()
def clinical_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_columns(prepared(clinic(spark, sf_dir))).select("request_id", "pos", "cluster", "representative", "role")


@query("SELECT item_id::VARCHAR AS concept_id, trim(text) AS label FROM benchmark WHERE trim(text) <> ''")
def terminology_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark as the kept answers of a terminology server, scanned page by page."""
    register_source(spark)
    at = new_folder(spark, "terminology")
    item = F.to_json(F.struct(F.struct(F.col("item_id").cast("string").alias("conceptId"), F.struct(F.col("text").alias("term")).alias("pt")).alias("concept")))
    write_pages(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("position"), item.alias("item")), at, page=16)
    return terminology.concepts(spark.read.format("terminology").option("path", at).load())


_GRAMS_SQL = """g AS (SELECT t, s, unnest(list_filter(regexp_split_to_array(s, '[^a-z0-9]+'), lambda t: length(t) >= 2)) AS g, 1.0::DOUBLE AS w FROM s
UNION ALL SELECT t, s, unnest(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))), 0.30 FROM s
UNION ALL SELECT t, s, unnest(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))), 0.70 FROM s
UNION ALL SELECT t, s, unnest(list_transform(range(1, length(s) - 2), lambda i: substr(s, i, 4))), 0.55 FROM s),
h AS (SELECT g, list_reduce([2166136261::HUGEINT] || list_transform(list_filter(range(0, octet_length(encode(g))), lambda i: true), lambda i: ('0x' || substr(hex(encode(g)), (2 * i + 1)::BIGINT, 2))::HUGEINT), lambda h, b: (xor(h, b) * 16777619) & 4294967295)::BIGINT & 2047 AS idx FROM (SELECT DISTINCT g FROM g)),
i AS (SELECT t, idx, sum(w) AS w FROM g JOIN h USING (g) GROUP BY ALL),
n AS (SELECT t, idx, w / sqrt(sum(w * w) OVER (PARTITION BY t)) AS w FROM i)"""


@query(f"""WITH q AS (SELECT DISTINCT p_name || ' ' || p_brand AS t FROM part), c AS (SELECT DISTINCT p_name AS t FROM part UNION SELECT text FROM benchmark),
s AS (SELECT DISTINCT t, regexp_replace(translate(lower(trim(t)), '_-', '  '), '\\s+', ' ', 'g') AS s FROM (SELECT t FROM q UNION SELECT t FROM c)), {_GRAMS_SQL},
p AS (SELECT a.t AS query, b.t AS label, sum(a.w * b.w) AS sim FROM n a JOIN n b USING (idx) WHERE a.t IN (SELECT t FROM q) AND b.t IN (SELECT t FROM c) GROUP BY ALL HAVING sum(a.w * b.w) > 0.65)
SELECT query, label, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, label) AS r FROM p) WHERE r = 1""")
def nearest_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of part names and benchmark texts for each part name with its brand."""
    part = read(spark, sf_dir, "part")
    labels = part.select(F.col("p_name").alias("label")).distinct().unionByName(read(spark, sf_dir, "benchmark").select(F.col("text").alias("label"))).where("label is not null").distinct()
    found = terminology.nearest_concepts(part.select(F.concat_ws(" ", "p_name", "p_brand").alias("query")), labels.withColumn("concept_id", F.col("label")))
    return found.select("query", "label", F.round("sim", 6).alias("sim"))


@query("""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS job_id, event_id AS seq, event_id % 7 AS op, (event_id % 150 - 20)::INTEGER AS percent, event_type AS message,
row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE user_id IS NOT NULL),
r AS (SELECT job_id, k, seq, op = 0 AS taken, CASE WHEN op = 0 THEN 'QUEUED' END AS state, 0 AS percent, NULL::VARCHAR AS kept, NULL::VARCHAR AS result FROM e WHERE k = 1
UNION ALL SELECT e.job_id, e.k, e.seq,
CASE WHEN r.state IS NULL OR r.state = 'CLEARED' THEN e.op = 0 ELSE e.op IN (1, 2, 3, 4, 6) OR e.op = 5 AND r.state = 'DONE' END,
CASE WHEN r.state IS NULL OR r.state = 'CLEARED' THEN CASE WHEN e.op = 0 THEN 'QUEUED' END WHEN e.op = 1 THEN 'RUNNING' WHEN e.op = 4 THEN 'DONE' WHEN e.op = 6 THEN 'FAILED' WHEN e.op = 5 AND r.state = 'DONE' THEN 'CLEARED' ELSE r.state END,
CASE WHEN r.state IS NULL OR r.state = 'CLEARED' THEN 0 WHEN e.op = 1 THEN greatest(r.percent, 1) WHEN e.op IN (2, 3) THEN greatest(0, least(100, e.percent)) WHEN e.op = 4 THEN 100 ELSE r.percent END,
CASE WHEN r.state IS NULL OR r.state = 'CLEARED' THEN NULL WHEN e.op = 4 THEN e.message ELSE r.kept END,
CASE WHEN r.state = 'DONE' AND e.op = 5 THEN r.kept END
FROM r JOIN e ON e.job_id = r.job_id AND e.k = r.k + 1)
SELECT job_id, seq, state, percent, result FROM r WHERE taken""")
def job_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as commands to jobs, one job a user, replayed through the stateful stream."""
    at = new_folder(spark, "jobs")
    op = F.get(F.lit(["create", "start", "update", "update", "complete", "read", "fail"]), (F.col("event_id") % 7).cast("int"))
    events = read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").cast("bigint").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), op.alias("op"),
        (F.col("event_id") % 150 - 20).cast("int").alias("percent"), F.col("event_type").alias("message"),
    )
    events.write.parquet(f"{at}/in")
    replay(spark, f"{at}/in", at, idle_ms=100 * 365 * 86_400_000, files=1000).awaitTermination()
    return spark.read.schema(TRANSITIONS).parquet(f"{at}/out").select("job_id", "seq", "state", "percent", "result")


@query("""SELECT c_custkey::VARCHAR AS user_id, c_name AS username, CASE c_custkey % 3 WHEN 0 THEN 'ADMIN|USER' WHEN 1 THEN 'USER' ELSE '' END AS roles,
CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey % 150) THEN (c_custkey % 150)::VARCHAR ELSE '' END AS node_ids FROM customer""")
def user_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users (customers) with roles and nodes (suppliers) that they refer to; some nodes aren't there any more."""
    q = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
    ref = lambda kind, v: F.concat(F.lit(f'{{"$ref":"{kind}","$id":"'), v, F.lit('"}'))
    k = F.col("c_custkey")
    held = F.when(k % 3 == 0, F.concat(F.lit("["), ref("roles", F.lit("r1")), F.lit(","), ref("roles", F.lit("r2")), F.lit("]"))).when(k % 3 == 1, ref("roles", F.lit("r2"))).otherwise(F.lit("null"))
    body = F.concat(F.lit('{"_id":{"$oid":'), q("c_custkey"), F.lit('},"username":'), q("c_name"), F.lit(',"password":"x","roles":'), held, F.lit(',"nodeIds":["'), (k % 150).cast("string"), F.lit('"]}'))
    people = read(spark, sf_dir, "customer").select(body.alias("document"))
    names = spark.createDataFrame([('{"_id":"r1","name":"ADMIN"}',), ('{"id":"r2","name":"USER"}',), ("{",), ('{"name":"none"}',)], "document string")
    machines = read(spark, sf_dir, "supplier").select(F.concat(F.lit('{"nodeId":'), q("s_suppkey"), F.lit(',"name":'), q("s_name"), F.lit("}")).alias("document"))
    found = collections.permissions(people, names, machines)
    return found.select("user_id", "username", F.array_join("roles", "|").alias("roles"), F.array_join("node_ids", "|").alias("node_ids"))


@query("""SELECT p_partkey::VARCHAR AS project_id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS badge, CASE WHEN p_partkey % 4 = 0 THEN octet_length(encode(p_name))::INTEGER END AS image_bytes FROM part""")
def project_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.when(F.col("p_partkey") % 4 == 0, F.base64(F.encode("p_name", "UTF-8")))
    body = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("badge"), image.alias("imageBytes")))
    return collections.projects(read(spark, sf_dir, "part").select(body.alias("document"))).select("project_id", "name", "badge", "image_bytes")
