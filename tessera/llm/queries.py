"""The queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from ..runtime import read, spread
from . import pii_bootstrap, quality_pu, toxicity
from .ball_kmeans import ball_kmeans
from .block_wand import rank
from .decontaminate import contamination
from .jaccard_join import jaccard_components
from .line_spread import remove_boilerplate
from .mpeg_audio import text_digests
from .packing import pack
from .piece_codec import digests
from .pivot_index import top_k
from .warc_revisit import round_trip


# A quarter of a document counts as its prompt, which bears no loss; a sequence holds 12 pieces and 3,072 loss-bearing
# tokens at most (on the documents here a full sequence has 5 pieces on average and somewhat over 3,072 such tokens).
PACKING = {"tokens": 4096, "segments": 12, "loss_tokens": 3072, "quiet_share": 0.25}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_documents(spark, sf_dir))


def op3_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.score(_documents(spark, sf_dir), read(spark, sf_dir, "labels"), threshold=0.3)


def op4_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), **PACKING)


def op6_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_digests(_documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_documents(spark, sf_dir), read(spark, sf_dir, "labels"), threshold=0.5)


def op8_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.extract(_documents(spark, sf_dir))


def op9_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spread(read(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_boilerplate(_documents(spark, sf_dir))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans(spread(read(spark, sf_dir, "embeddings")))


def op13_block_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(_documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_quality_pu": op3_quality_pu,
    "op4_pivot_index": op4_pivot_index,
    "op5_vector_packing": op5_vector_packing,
    "op6_mpeg_audio": op6_mpeg_audio,
    "op7_toxicity": op7_toxicity,
    "op8_pii_bootstrap": op8_pii_bootstrap,
    "op9_warc_revisit": op9_warc_revisit,
    "op10_line_spread": op10_line_spread,
    "op11_decontaminate": op11_decontaminate,
    "op12_ball_kmeans": op12_ball_kmeans,
    "op13_block_wand": op13_block_wand,
}


def _lowered(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return rf"regexp_extract_all({_lowered(text)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _kmeans_sql(rounds: int = 5) -> str:
    """Each round is two tables: the nearest centroid of each vector, and the centroids that follow."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
        a{r} AS MATERIALIZED (
            SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
            FROM (SELECT vec_id, cluster, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r} c)
            GROUP BY vec_id
        )""")
        if r < rounds:
            steps.append(f"""
        s{r} AS (
            SELECT cluster, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n
            FROM (SELECT cluster, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{r} JOIN v USING (vec_id)) GROUP BY cluster, i
        ),
        m{r} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS e FROM s{r} GROUP BY cluster),
        c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN m{r} m USING (cluster))""")
    return ",".join(steps)

ORACLE: dict[str, str] = {
    "op4_pivot_index": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op10_line_spread": """
        WITH d AS (SELECT doc_id, text, source, string_split(text, chr(10)) AS lines FROM documents),
        x AS (SELECT doc_id, source, unnest(lines) AS line FROM d),
        bad AS (
            SELECT trim(line, ' ') AS line, min(doc_id) AS first FROM x
            WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 10
        ),
        hit AS (
            SELECT x.doc_id, list(DISTINCT bad.line) AS hits FROM x JOIN bad ON trim(x.line, ' ') = bad.line
            WHERE bad.first <> x.doc_id GROUP BY x.doc_id
        ),
        k AS (
            SELECT d.doc_id, d.lines,
                   list_filter(d.lines, lambda y: trim(y, ' ') = '' OR NOT list_contains(coalesce(hit.hits, []), trim(y, ' '))) AS kept
            FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id
        )
        SELECT doc_id, array_to_string(kept, chr(10)) AS text,
               coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_removed
        FROM k
    """,
    "op11_decontaminate": rf"""
        WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
        b AS (SELECT item_id, {_words("text")} AS w FROM benchmark),
        bw AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + 9), ' ') AS win
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS i FROM b)
        ),
        dw AS (
            SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
            FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw))
        ),
        met AS (SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, win)),
        hit AS (SELECT doc_id, count(DISTINCT pos)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM met) GROUP BY doc_id),
        own AS (SELECT doc_id, list(DISTINCT item_id::VARCHAR) AS items FROM met WHERE item_id IS NOT NULL GROUP BY doc_id)
        SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(hit.n_hit, 0)::BIGINT AS n_hit,
               coalesce(len(own.items), 0)::BIGINT AS n_items, sha256(array_to_string(list_sort(coalesce(own.items, [])), ',')) AS items_sha256,
               coalesce(hit.n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN own ON d.doc_id = own.doc_id
    """,
    "op12_ball_kmeans": f"""
        WITH v AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        c0 AS MATERIALIZED (
            SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR)) - 1)::INTEGER AS cluster, e FROM v
            ORDER BY sha256('2:' || vec_id::VARCHAR) LIMIT 40
        ),{_kmeans_sql()}
        SELECT a.vec_id, a.cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
               (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
        FROM a5 a JOIN c5 c USING (cluster)
    """,
    "op13_block_wand": rf"""
        WITH t AS (SELECT doc_id, unnest({_words("text")}) AS term FROM documents WHERE doc_id IS NOT NULL),
        tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY doc_id, term),
        n AS (SELECT doc_id, count(*)::BIGINT AS n FROM t GROUP BY doc_id),
        g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM n),
        w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, g GROUP BY term, docs),
        m AS (SELECT doc_id, 25 + (75 * n * docs) // total AS m FROM n, g),
        q AS (SELECT item_id, unnest({_words("text")}) AS term FROM benchmark WHERE item_id IS NOT NULL),
        s AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
            FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id
        ),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
    """,
}
