"""Line dedup by distinct-site spread: lines that many sites share are boilerplate and go.

A line's 64-bit hash is the key. One aggregation gives each line a HyperLogLog++ sketch of its sites (partial sketches
merge across tasks, so a line that a third of all rows hold is one small row a task) and the smallest document that
holds it. Lines far from the threshold are decided by the sketch, and those near it get exact distinct counts. The
first document (the smallest id) keeps its copy of a line that goes elsewhere, so no passage leaves the corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import durable, python_path
from .hot import hot_join, unused

SENT = 200_000  # most lines to send to every task, 16 bytes each; more are joined by document


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", rsd: float = 0.2, margin: float = 4.0) -> DataFrame:
    """(line long, first long, n long): hashes of the lines (trimmed of spaces, empty ones aside) that at least
    ``min_sites`` distinct sites hold, with the smallest id of a document that holds it and how often it stands in all.
    ``rsd`` is the sketches' relative error; lines whose estimate is within a factor ``margin`` of the threshold get
    exact counts. Null texts have no lines, a null site is no site, a null id is never the first."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(site_col).cast("string").alias("site"), F.explode(_lines(F.col(text_col))).alias("line"))
    rows = rows.where("trim(line) <> ''").select("id", F.when(F.col("site").isNotNull(), F.xxhash64("site")).alias("site_key"), _key(F.col("line")).alias("line"))
    sketched = rows.groupBy("line").agg(F.approx_count_distinct("site_key", rsd).alias("about"), F.min("id").alias("first"), F.count("*").alias("n"))
    sketched = durable(sketched.where(F.col("about") >= min_sites / margin))
    sure = sketched.where(F.col("about") > min_sites * margin).select("line", "first", "n")
    near = sketched.where(F.col("about") <= min_sites * margin)
    sites = rows.groupBy("line", "site_key").agg(F.count("*").alias("c")).select("line", "site_key")
    exact = sites.join(near.select("line"), "line", "left_semi").groupBy("line").agg(F.count("site_key").alias("sites")).where(F.col("sites") >= min_sites)
    return sure.unionByName(near.join(exact, "line").select("line", "first", "n"))


def _strip(hashes: np.ndarray, firsts: np.ndarray, has_first: np.ndarray):
    def strip(ids: list, texts: list) -> tuple[list, list, list]:
        import xxhash

        out, counts, gone = [], [], []
        for i, text in zip(ids, texts, strict=True):
            if text is None:
                out.append(None)
                counts.append(0)
                gone.append(0)
                continue
            lines = text.split("\n")
            keys = np.array([xxhash.xxh64_intdigest(x.strip(" ").encode("utf-8", "surrogatepass"), 42) for x in lines], dtype=np.uint64).view(np.int64)
            at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1) if len(hashes) else None
            hit = hashes[at] == keys if len(hashes) else np.zeros(len(keys), dtype=bool)
            if i is not None and len(hashes):
                hit &= ~(has_first[at] & (firsts[at] == i))
            kept = [x for x, h in zip(lines, hit.tolist(), strict=True) if not (h and x.strip(" "))]
            out.append("\n".join(kept))
            counts.append(len(lines))
            gone.append(len(lines) - len(kept))
        return out, counts, gone

    return strip


def _by_list(docs: DataFrame, lines: DataFrame, id_col: str, text_col: str, out: str) -> DataFrame:
    spark = python_path(docs.sparkSession)
    found = sorted((r.line, r.first) for r in lines.collect())
    table = (np.array([x for x, _ in found], dtype=np.int64), np.array([f or 0 for _, f in found], dtype=np.int64), np.array([f is not None for _, f in found], dtype=bool))
    sent = spark.sparkContext.broadcast(table)

    @F.pandas_udf("text string, n_lines bigint, n_removed bigint")
    def stripped(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        whole = [None if i != i else int(i) for i in ids.tolist()]
        text, n, gone = _strip(*sent.value)(whole, [None if t is None or t != t else t for t in texts.tolist()])
        return pd.DataFrame({"text": pd.Series(text, dtype=object), "n_lines": n, "n_removed": gone})

    return docs.withColumn(out, stripped(F.col(id_col).cast("long"), F.col(text_col)))


def _by_join(docs: DataFrame, lines: DataFrame, id_col: str, text_col: str, out: str) -> DataFrame:
    """The same by a join on the lines: hashes are shuffled to find a document's lines, and texts once by document."""
    text, (doc, hits, line) = F.col(text_col), unused(docs, "doc", "hits", "line")
    digest = F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))
    own = F.named_struct(F.lit("id"), F.col(id_col).cast("long"), F.lit("text"), digest)  # null ids and repeated ids too
    keyed = docs.select(own.alias("doc"), F.explode(_lines(text)).alias("line")).where("trim(line) <> ''").select("doc", _key(F.col("line")).alias("line")).distinct()
    found = hot_join(keyed, lines, "line").where(~F.col("first").eqNullSafe(F.col("doc.id")) | F.col("first").isNull())
    found = found.groupBy("doc").agg(F.collect_set("line").alias(hits)).withColumnRenamed("doc", doc)  # bounded by a document's own lines
    every = _lines(text)
    kept = F.filter(every, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(hits), _key(x)))
    n = F.coalesce(F.size(every), F.lit(0)).cast("bigint")
    n = F.when(text.isNull(), F.lit(0).cast("bigint")).otherwise(n)
    plain = F.struct(text.alias("text"), n.alias("n_lines"), F.lit(0).cast("bigint").alias("n_removed"))
    cut = F.struct(F.array_join(line, "\n").alias("text"), n.alias("n_lines"), (n - F.size(line)).alias("n_removed"))
    joined = docs.join(found, own.eqNullSafe(F.col(doc)), "left").withColumn(line, F.when(F.col(hits).isNotNull(), kept))
    return joined.withColumn(out, F.when(F.col(hits).isNull(), plain).otherwise(cut)).drop(doc, hits, line)


def _stripped(docs: DataFrame, min_sites: int, id_col: str, text_col: str, site_col: str, sent: int, options: dict) -> tuple[DataFrame, str]:
    (out,) = unused(docs, "stripped")
    lines = durable(boilerplate(docs, min_sites, id_col, text_col, site_col, **options))
    return (_by_list if lines.count() <= sent else _by_join)(docs, lines, id_col, text_col, out), out


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sent: int = SENT, **options) -> DataFrame:
    """(``id_col``, ``text_col``, n_lines long, n_removed long): each text without the lines that at least
    ``min_sites`` distinct sites hold, but for those it is the first document of.

    Lines end at a line feed; they compare without the spaces around them, and empty lines always stay. A null text
    stays null with no lines; a null site counts for nothing; a row with a null id is never first and loses its shared
    lines. Repeated rows all come back. A document may lose all its lines; it then comes back empty. No rows give no
    rows. Up to ``sent`` lines go to every task, more are joined; the rows are the same.
    """
    rows, out = _stripped(docs.select(id_col, text_col, site_col), min_sites, id_col, text_col, site_col, sent, options)
    return rows.select(F.col(id_col), F.col(f"{out}.text").alias(text_col), F.col(f"{out}.n_lines").alias("n_lines"), F.col(f"{out}.n_removed").alias("n_removed"))


def strip_boilerplate(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sent: int = SENT, **options) -> DataFrame:
    """``docs`` with the texts that ``remove_boilerplate`` gives; all rows and columns stay."""
    rows, out = _stripped(docs, min_sites, id_col, text_col, site_col, sent, options)
    return rows.withColumn(text_col, F.col(f"{out}.text")).select(*docs.columns)
