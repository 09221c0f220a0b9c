"""Benchmark decontamination: windows of test items are looked up in training texts, verified and taken out.

A window is ``width`` consecutive words of an item (all its words, if it has fewer). The windows' keys make a sorted set
that goes to every task; a task forms the keys of all windows of its texts by array operations, looks them up, and
compares the words of each window it finds with those of the set, so a shared key alone is no hit.

The set is sent only while it has at most ``sent`` windows. Beyond that, a bitmap of fixed size goes to the tasks
instead: windows that it lets through leave the task with their words and are joined to the windows of the items, words
against words, so results are the same whatever the number of items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..runtime import durable, python_path
from .hot import hot_join, unused
from .words import Words, words_of

SENT = 200_000  # most windows to send to every task, some 100 bytes each
BITS = 1 << 26  # of the bitmap beyond it: 8 MB
SLICE = 1 << 20  # bytes of texts that are taken at once

_HIT = "n_words bigint, n_hit bigint, items array<string>, spans array<bigint>"
_WINDOWS = "item string, size int, text string"


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive parts of about ``SLICE`` bytes, one text at least."""
    ends = np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1])) if len(texts) else []
    at = 0
    while at < len(texts):
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
        yield texts.slice(at, until - at)
        at = until


def windows(benchmark: DataFrame, width: int = 10, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item string, size int, text string): the distinct windows of each item, as words with spaces between. Null texts
    and texts without words have none; an item without an id has windows, under a null."""
    spark = python_path(benchmark.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in _slices(batch.column(1)):
                found = words_of(part)
                n = np.diff(found.first)
                own = [(k, int(i)) for k in range(len(n)) if n[k] for i in (range(found.first[k], found.first[k + 1] - width + 1) if n[k] >= width else [found.first[k]])]
                sizes = [int(min(width, n[k])) for k, _ in own]
                items = batch.column(0).take(pa.array([at + k for k, _ in own], pa.int64()))
                yield pa.RecordBatch.from_arrays([items, pa.array(sizes, pa.int32()), pa.array([found.text(i, s) for (_, i), s in zip(own, sizes, strict=True)], pa.string())], names=["item", "size", "text"])
                at += len(part)

    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    return spark.createDataFrame([], _WINDOWS).unionByName(rows.mapInArrow(run, _WINDOWS)).distinct()


class WindowSet:
    """Windows by key, for look-ups of many keys at once."""

    def __init__(self, sizes: list[int], texts: list[str], items: list[list[str]]):
        keys = np.empty(len(texts), np.uint64)
        for size in sorted(set(sizes)):
            own = [i for i, s in enumerate(sizes) if s == size]
            keys[own] = words_of(pa.array([texts[i] for i in own], pa.large_string())).runs(size)[1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.sizes = keys[order], sorted(set(sizes))
        self.texts, self.items = [texts[i] for i in order], [items[i] for i in order]
        self.near = np.zeros(1 << 20, dtype=bool)
        self.near[keys >> np.uint64(44)] = True

    def hits(self, found: Words, size: int) -> list[tuple[int, int]]:
        """(word, window): where windows of ``size`` words stand, verified word by word."""
        at, keys = found.runs(size)
        kept = np.flatnonzero(self.near[keys >> np.uint64(44)])
        at, keys = at[kept], keys[kept]
        lo, hi = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
        out = []
        for i in np.flatnonzero(hi > lo).tolist():
            text = found.text(int(at[i]), size)
            out += [(int(at[i]), w) for w in range(lo[i], hi[i]) if self.texts[w] == text][:1]  # texts are distinct
        return out


def _covered(found: Words, hits: list[tuple[int, int]]) -> np.ndarray:
    """Which words lie inside a hit, from (word, size)."""
    depth = np.zeros(len(found.keys) + 1, dtype=np.int64)
    if hits:
        at, size = np.array(hits, dtype=np.int64).T
        np.add.at(depth, at, 1)
        np.add.at(depth, at + size, -1)
    return np.cumsum(depth)[:-1] > 0


def _answers(found: Words, inside: np.ndarray, items: list[list[str]], base: np.ndarray) -> list[dict]:
    out = []
    for k in range(len(found.first) - 1):
        lo, hi = int(found.first[k]), int(found.first[k + 1])
        own = inside[lo:hi]
        row = {"n_words": hi - lo, "n_hit": int(own.sum()), "items": items[k], "spans": []}
        if row["n_hit"]:
            edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
            for s, e in zip(edges[0::2], edges[1::2], strict=True):
                row["spans"] += [int(found.starts[lo + s] - base[k]), int(found.ends[lo + e - 1] - base[k])]
        out.append(row)
    return out


def _base(part: pa.Array) -> np.ndarray:
    at = np.frombuffer(part.buffers()[1], np.int32 if part.type == pa.string() else np.int64)[part.offset : part.offset + len(part) + 1]
    return at - at[0]


def _by_set(text: Column, table: WindowSet, spark) -> Column:
    sent = spark.sparkContext.broadcast(table)

    @F.arrow_udf(_HIT)
    def look(texts: pa.Array) -> pa.Array:
        known, out = sent.value, []
        for part in _slices(texts):
            part = part.fill_null("")
            found = words_of(part)
            hits = [(i, w, size) for size in known.sizes for i, w in known.hits(found, size)]
            items: list[set] = [set() for _ in range(len(part))]
            for k, (_, w, _) in zip(np.searchsorted(found.first, [i for i, _, _ in hits], side="right") - 1, hits, strict=True):
                items[k].update(known.items[w])
            out += _answers(found, _covered(found, [(i, size) for i, _, size in hits]), [sorted(x) for x in items], _base(part))
        return pa.array(out, look_type)

    look_type = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.int64()))])
    return look(text)


def _by_join(docs: DataFrame, every: DataFrame, text_col: str, id_col: str, out: str) -> DataFrame:
    """The same with a bitmap in the tasks: what it lets through is joined to the windows by their words."""
    spark = docs.sparkSession
    sizes = sorted(r.size for r in every.select("size").distinct().collect())  # at most ``width`` of them
    (doc,) = unused(docs, "doc")

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array(batch.column(1)).to_pylist()
            by: dict[int, list[str]] = {}
            for size, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                by.setdefault(size, []).append(text)
            at = [words_of(pa.array(own, pa.large_string())).runs(size)[1] % np.uint64(BITS) for size, own in by.items()]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(at)).astype(np.int64) if at else [], pa.int64())], names=["bit"])

    bits = every.select("size", "text").mapInArrow(marks, "bit bigint").groupBy((F.col("bit") / 65536).cast("int").alias("page")).agg(F.collect_set("bit").alias("bits"))
    bitmap = np.zeros(BITS, dtype=bool)  # at most BITS bytes, whatever the number of windows
    for row in bits.toLocalIterator():
        bitmap[row.bits] = True
    sent = spark.sparkContext.broadcast(np.packbits(bitmap))

    @F.arrow_udf("array<struct<at:bigint,size:int,text:string>>")
    def candidates(texts: pa.Array) -> pa.Array:
        seen, out = np.unpackbits(sent.value).view(bool), []
        for part in _slices(texts):
            found = words_of(part.fill_null(""))
            own: list[list] = [[] for _ in range(len(part))]
            for size in sizes:
                at, keys = found.runs(size)
                at = at[seen[keys % np.uint64(BITS)]]
                for k, i in zip((np.searchsorted(found.first, at, side="right") - 1).tolist(), at.tolist(), strict=True):
                    own[k].append({"at": i - int(found.first[k]), "size": size, "text": found.text(i, size)})
            out += own
        return pa.array(out, pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int32()), ("text", pa.string())])))

    @F.arrow_udf(_HIT)
    def answered(texts: pa.Array, at: pa.Array, size: pa.Array, items: pa.Array) -> pa.Array:
        out, start = [], 0
        for part in _slices(texts):
            part = part.fill_null("")
            found = words_of(part)
            own = list(zip(*(c.slice(start, len(part)).to_pylist() for c in (at, size)), strict=True))
            hits = [(int(found.first[k]) + i, s) for k, (a, z) in enumerate(own) for i, s in zip(a or [], z or [], strict=True)]
            out += _answers(found, _covered(found, hits), [sorted(x or []) for x in items.slice(start, len(part)).to_pylist()], _base(part))
            start += len(part)
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.int64()))]))

    text = F.col(text_col)
    own = F.struct(F.col(id_col).cast("string").alias("id"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("text"))  # null and repeated ids too
    met = durable(docs.select(own.alias("doc"), F.explode(candidates(text)).alias("c")).select("doc", "c.*").distinct())
    counts = met.groupBy("size", "text").agg(F.count("*").alias("n"))
    known = durable(counts.join(every.groupBy("size", "text").agg(F.collect_set("item").alias("items")), ["size", "text"]))
    found = hot_join(met, known, ["size", "text"]).groupBy("doc").agg(F.collect_list(F.struct("at", "size")).alias("h"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    found = found.select(F.col("doc").alias(doc), F.struct(F.col("h.at").alias("at"), F.col("h.size").alias("size"), F.col("items").alias("items")).alias(out))
    joined = docs.join(found, own.eqNullSafe(F.col(doc)), "left")
    return joined.withColumn(out, answered(text, F.col(f"{out}.at"), F.col(f"{out}.size"), F.col(f"{out}.items"))).drop(doc)


def marked(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", sent: int = SENT) -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name: n_words, n_hit, items (sorted as strings) and spans (starts and ends
    in bytes, by turns, of the longest runs of hit words)."""
    spark = python_path(docs.sparkSession)
    (out,) = unused(docs, "hit")
    every = durable(windows(benchmark, width, item_col, item_text_col))
    if every.select("size", "text").distinct().count() > sent or every.count() > 4 * sent:
        return _by_join(docs, every, text_col, id_col, out), out
    found = every.groupBy("size", "text").agg(F.collect_list("item").alias("items")).collect()
    table = WindowSet([r.size for r in found], [r.text for r in found], [r["items"] for r in found])
    return docs.withColumn(out, _by_set(F.col(text_col), table, spark)), out


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", sent: int = SENT) -> DataFrame:
    """(``id_col``, n_words, n_hit, n_items long, items_sha256 string, contaminated boolean) of every row of ``docs``.

    A null text has no words, nor has one of punctuation alone; such texts are hit by nothing, and such items have no
    windows. Repeated rows all come back, null ids too. An item that repeats counts once; the windows of items with a
    null id are hit like any others, but such items aren't counted. Without items nothing is contaminated; no documents,
    no rows. Other columns, whatever their names, aren't read. A very long text is taken piece by piece, and the words
    it has inside overlapping windows count once."""
    rows, out = marked(docs.select(id_col, text_col), benchmark, width, id_col, text_col, item_col, item_text_col, sent)
    hit = F.col(out)
    return rows.select(
        F.col(id_col),
        hit["n_words"].alias("n_words"),
        hit["n_hit"].alias("n_hit"),
        F.size(hit["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(hit["items"], ","), 256).alias("items_sha256"),
        (hit["n_hit"] > 0).alias("contaminated"),
    )


@F.arrow_udf(StringType())
def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, own in zip(texts, spans.to_pylist(), strict=True):
        if own and text.is_valid:
            data = text.as_buffer().to_pybytes()
            text = b"".join(data[a:b] for a, b in zip([0, *own[1::2]], [*own[0::2], len(data)], strict=True)).decode("utf-8", "replace")
        out.append(text if isinstance(text, str) else text.as_py())
    return pa.array(out, pa.string())


def remove_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without what stands inside hits: each longest run of hit words goes, from its first letter to its last;
    all rows and columns stay. ``options`` are those of ``contamination``."""
    text_col = options.get("text_col", "text")
    rows, out = marked(docs, benchmark, **options)
    return rows.withColumn(text_col, F.when(F.col(out)["n_hit"] > 0, _without(F.col(text_col), F.col(out)["spans"])).otherwise(F.col(text_col))).select(*docs.columns)


def remove_documents(docs: DataFrame, benchmark: DataFrame, share: float = 0.0, **options) -> DataFrame:
    """``docs`` without the rows of whose words more than ``share`` are hit (by default, any)."""
    rows, out = marked(docs, benchmark, **options)
    return rows.where(F.col(out)["n_hit"] <= F.lit(share) * F.col(out)["n_words"]).select(*docs.columns)
