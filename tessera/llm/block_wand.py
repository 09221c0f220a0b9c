"""Exact ranked lexical search with variable blocks and block-max WAND.

Documents are indexed in shards of bounded size: a task tokenises its documents and packs the postings of the queries'
vocabulary, one row a shard, in one pass; nothing is shuffled. With the corpus counts known, every posting gets its
impact (what a term of weight 1 adds to the score), and each posting list is cut into blocks of varying length. The cuts
are chosen by dynamic programming: they minimise the error of the bounds, which is the sum over blocks of length times
largest impact less the impacts themselves, with a fixed cost for each block. All lists of a shard are cut together,
one posting of each list a step.

A search adds up, over the documents of a shard, the weighted block maxima of the query's terms: a document's sum bounds
its score. Documents are taken by falling bound, the first few, then more, then the rest, and the search ends where the
bound is below the k-th best score so far. Of those that are left, WAND's test skips documents that stand only in lists
which together can't reach that score. What passes is scored exactly from the postings.

A task carries its k best scores from shard to shard, and the k-th best scores of a part of the shards are the least
scores for the others, so most of them answer nothing. Queries go to the tasks in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import python_path, stored
from .decontaminate import _slices
from .words import LOWER, Words, words_of

TERMS = 500_000  # most terms of a block of queries, some 30 bytes each
DOCS, POSTINGS = 8192, 1_000_000  # a shard is full when it has as many documents or postings
LONGEST = 64  # most postings of a block
COST = 2_000_000  # of a block, in units of the bounds' error
FIRST = 16  # one in so many shards is searched first
_FOUND = "query int, doc_id long, score long"
_SHARD = "ids array<bigint>, lengths binary, terms binary, docs binary, tfs binary, n_docs bigint, n_terms bigint"
_INDEX = "wave int, ids array<bigint>, terms binary, starts binary, docs binary, impacts binary, cuts binary, edges binary"


class Vocabulary:
    """Terms by key; what shares a key with a term is told from it by its letters."""

    def __init__(self, terms: list[str]):
        found = words_of(pa.array(terms, pa.large_string()))
        order = np.argsort(found.keys, kind="stable")
        self.size, self.layers = len(terms), []
        while len(order):  # one layer, but for terms that share a key
            keep = np.concatenate([[True], np.diff(found.keys[order]) != 0])
            own = order[keep]
            self.layers.append((found.keys[own], own))
            order = order[~keep]
        self.data, self.starts, self.sizes = found.data, found.starts, found.ends - found.starts

    def of(self, found: Words) -> np.ndarray:
        """The number of each word's term, -1 for words of no query."""
        out = np.full(len(found.keys), -1, dtype=np.int32)
        for keys, numbers in self.layers:
            at = np.minimum(np.searchsorted(keys, found.keys), len(keys) - 1)
            hit = np.flatnonzero((keys[at] == found.keys) & (out < 0))
            number = numbers[at[hit]]
            same = self._same(found, hit, number)
            out[hit[same]] = number[same]
        return out

    def _same(self, found: Words, at: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        size = self.sizes[numbers]
        same = found.ends[at] - found.starts[at] == size
        at, numbers, size, own = at[same], numbers[same], size[same], np.flatnonzero(same)
        if len(at):
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            step = np.arange(size.sum()) - np.repeat(first, size)
            equal = LOWER[found.data[np.repeat(found.starts[at], size) + step]] == self.data[np.repeat(self.starts[numbers], size) + step]
            same[own] = np.logical_and.reduceat(equal, first)
        return same


def query_terms(queries: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term string, n long): the terms of each query and how often they stand in it. Rows with a null id have none;
    of a repeated id the smallest text is asked."""
    python_path(queries.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in _slices(batch.column(1)):
                found = words_of(part)
                of = np.repeat(np.arange(len(part)), np.diff(found.first)) + at
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array([found.text(i, 1) for i in range(len(found.keys))], pa.string())], names=["item", "term"])
                at += len(part)

    rows = queries.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(item_col).alias("item")).agg(F.min(text_col).alias("text"))
    return rows.mapInArrow(run, f"item {dict(rows.dtypes)['item']}, term string").groupBy("item", "term").agg(F.count("*").alias("n"))


def _bytes(x: np.ndarray, kind: str) -> pa.Array:
    return pa.array([x.astype(kind).tobytes()], pa.binary())


def _shards(words, docs: int, postings: int):
    """Documents (id, text) to shards: their ids and lengths, and (term, document, frequency) by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Vocabulary = words.value
        ids, lengths, parts, n = [], [], [], 0

        def packed() -> pa.RecordBatch:
            term, doc, tf = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(term, kind="stable")  # documents stay in order within a term
            length = np.concatenate(lengths)
            columns = [pa.array([np.concatenate(ids)], pa.list_(pa.int64())), _bytes(length, "<i8"), *(_bytes(x[order], "<i4") for x in (term, doc, tf)), pa.array([len(length)]), pa.array([int(length.sum())])]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "lengths", "terms", "docs", "tfs", "n_docs", "n_terms"])

        for batch in batches:
            at = 0
            for part in _slices(batch.column(1)):
                found = words_of(part)
                length = np.diff(found.first)
                here = np.flatnonzero(length)  # documents with terms
                term = known.of(found)
                of = np.repeat(np.arange(len(part)), length)
                hit = term >= 0
                pair, tf = np.unique(of[hit].astype(np.int64) * known.size + term[hit], return_counts=True)
                place = np.full(len(part), -1)
                place[here] = np.arange(len(here)) + sum(map(len, ids))
                parts.append((pair % known.size, place[pair // known.size], tf))
                ids.append(batch.column(0).to_numpy()[at + here])
                lengths.append(length[here])
                at, n = at + len(part), n + len(pair)
                if n >= postings or sum(map(len, ids)) >= docs:
                    yield packed()
                    ids, lengths, parts, n = [], [], [], 0
        if ids and sum(map(len, ids)):
            yield packed()

    return run


def cut_lists(starts: np.ndarray, impacts: np.ndarray, longest: int = LONGEST, cost: int = COST) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of the lists impacts[starts[i]:starts[i + 1]]: where each block starts (and the end), and for each list the
    number of its first block (and the end). Least total of ``cost`` a block and length times maximum, by dynamic
    programming over the ends of blocks of at most ``longest`` postings."""
    sizes = np.diff(starts)
    taken = np.ones(len(impacts), dtype=np.int32)  # length of the last block of the best cut that ends here
    order = np.argsort(-sizes, kind="stable")
    for group in np.array_split(order, -(-len(order) // 4096) or 1):
        size, first = sizes[group], starts[:-1][group]
        if not len(group) or not size[0]:
            continue
        best = np.full((len(group), longest), 2**62 // longest, dtype=np.int64)  # cost of the cut that ends before the start in a slot
        most = np.zeros((len(group), longest), dtype=np.int64)  # largest impact since that start
        now = np.zeros(len(group), dtype=np.int64)
        slots = np.arange(longest)
        active = len(group) - np.searchsorted(size[::-1], np.arange(size[0]), side="right")
        for j in range(size[0]):
            a, slot = int(active[j]), j % longest
            best[:a, slot], most[:a, slot] = now[:a], 0
            value = impacts[first[:a] + j]
            np.maximum(most[:a], value[:, None], out=most[:a])
            length = (slot - slots) % longest + 1
            total = best[:a] + length * most[:a]
            pick = total.argmin(1)
            now[:a] = total[np.arange(a), pick] + cost
            taken[first[:a] + j] = length[pick]
    cuts, counts = [], np.zeros(len(sizes) + 1, dtype=np.int64)
    for i in range(len(sizes)):
        own, at = [], int(starts[i + 1])
        while at > starts[i]:
            at -= int(taken[at - 1])
            own.append(at)
        cuts += own[::-1]
        counts[i + 1] = len(own)
    return np.array([*cuts, len(impacts)], dtype=np.int64), np.cumsum(counts)


def _indexed(n_docs: int, n_terms: int, longest: int, cost: int, waves: int):
    """Shards to shards with impacts, block cuts and the number of the wave that searches them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                length = np.frombuffer(row["lengths"], "<i8")
                term, doc, tf = (np.frombuffer(row[c], "<i4").astype(np.int64) for c in ("terms", "docs", "tfs"))
                m = np.array([25 + 75 * n * n_docs // n_terms for n in length.tolist()], dtype=np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
                own, starts = np.unique(term, return_index=True)
                starts = np.append(starts, len(term))
                cuts, edges = cut_lists(starts, impact, longest, cost)
                wave = 0 if row["ids"][0] * 0x9E3779B97F4A7C15 % 2**64 >> 32 < 2**32 // waves else 1
                columns = [pa.array([wave], pa.int32()), pa.array([row["ids"]], pa.list_(pa.int64())), *(_bytes(x, k) for x, k in ((own, "<i4"), (starts, "<i8"), (doc, "<i4"), (impact, "<i4"), (cuts, "<i8"), (edges, "<i8")))]
                yield pa.RecordBatch.from_arrays(columns, names=["wave", "ids", "terms", "starts", "docs", "impacts", "cuts", "edges"])

    return run


class Shard:
    """Posting lists of a shard with their blocks."""

    def __init__(self, row: dict):
        self.ids = np.array(row["ids"], dtype=np.int64)
        self.terms, self.docs, self.impacts = (np.frombuffer(row[c], "<i4").astype(np.int64) for c in ("terms", "docs", "impacts"))
        self.starts, self.cuts, self.edges = (np.frombuffer(row[c], "<i8") for c in ("starts", "cuts", "edges"))
        self.most = np.maximum.reduceat(self.impacts, self.cuts[:-1]) if len(self.impacts) else self.impacts
        self.begin, self.end = self.docs[self.cuts[:-1]], self.docs[self.cuts[1:] - 1]
        self.top = np.maximum.reduceat(self.most, self.edges[:-1]) if len(self.most) else self.most

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray], least: int) -> tuple[tuple[np.ndarray, np.ndarray], int]:
        """The ``k`` best (scores, ids) of ``best`` and this shard's documents that score ``least`` or more, and how many
        documents were scored."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        here = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        at, weights = at[here], weights[here]
        tops = self.top[at] * weights
        least = max(least, int(best[0][k - 1]) if len(best[0]) >= k else 1)
        if tops.sum() < least:
            return best, 0
        # Every block adds its weighted maximum from its first document to its last.
        change = np.zeros(len(self.ids) + 1, dtype=np.int64)
        for i, w in zip(at.tolist(), weights.tolist(), strict=True):
            own = slice(self.edges[i], self.edges[i + 1])
            change[self.begin[own]] += w * self.most[own]  # blocks of one list have different ends
            change[self.end[own] + 1] -= w * self.most[own]
        bound = np.cumsum(change[:-1])
        live = np.flatnonzero(bound >= least)
        live = live[np.argsort(-bound[live], kind="stable")]
        by_top, scored, done = np.argsort(tops, kind="stable"), 0, 0
        for until in (4 * k, 64 * k, len(live)):
            chunk = live[done : max(until, done)]
            chunk = chunk[bound[chunk] >= least]
            if not len(chunk):
                break
            done += len(chunk)
            # Lists that together can't reach the least score hold no document by themselves.
            weak = int(np.searchsorted(np.cumsum(tops[by_top]), least))
            wanted = np.zeros(len(self.ids), dtype=bool)
            wanted[chunk] = True
            scores, pivot = np.zeros(len(self.ids), dtype=np.int64), np.zeros(len(self.ids), dtype=bool)
            for i in by_top[weak:].tolist():
                self._add(scores, wanted, int(at[i]), int(weights[i]), pivot)
            for i in by_top[:weak].tolist():
                self._add(scores, pivot, int(at[i]), int(weights[i]), None)
            found = np.flatnonzero(pivot)
            scored += len(found)
            found = found[scores[found] >= least]
            score, ids = np.concatenate([best[0], scores[found]]), np.concatenate([best[1], self.ids[found]])
            order = np.lexsort((ids, -score))[:k]
            best = score[order], ids[order]
            least = max(least, int(best[0][k - 1]) if len(order) >= k else 1)
        return best, scored

    def _add(self, scores: np.ndarray, wanted: np.ndarray, i: int, weight: int, pivot: np.ndarray | None) -> None:
        own = slice(self.starts[i], self.starts[i + 1])
        docs = self.docs[own]
        hit = wanted[docs]
        docs = docs[hit]
        scores[docs] += weight * self.impacts[own][hit]
        if pivot is not None:
            pivot[docs] = True


def _searched(sent, k: int):
    """Shards to the task's best documents of each query; a last row (query -1) counts the scored and all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks, least = sent.value
        none = np.empty(0, np.int64)
        best, scored, every = [(none, none)] * len(asks), 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                for q, (terms, weights) in enumerate(asks):
                    best[q], n = shard.search(terms, weights, k, best[q], least[q])
                    scored, every = scored + n, every + len(shard.ids)
        columns = [np.concatenate([*(np.full(len(s), q) for q, (s, _) in enumerate(best)), [-1]]).astype(np.int32)]
        columns += [np.concatenate([*(b[c] for b in best), [last]]).astype(np.int64) for c, last in ((1, scored), (0, every))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "doc_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _ranked(rows: DataFrame, asked: list, k: int, longest: int, cost: int, docs: int, postings: int, stats: dict | None) -> DataFrame | None:
    """(query, doc_id, score, rank) of a block of queries, [(item, {term: n})]."""
    spark = rows.sparkSession
    terms = sorted({t for _, own in asked for t in own})
    number = {t: i for i, t in enumerate(terms)}
    words = spark.sparkContext.broadcast(Vocabulary(terms))
    shards = stored(rows.mapInArrow(_shards(words, docs, postings), _SHARD), "shards")
    n_docs, n_terms = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_docs:
        return None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(blob, "<i4"), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "df"])

    df = {r.term: r.df for r in shards.select("terms").mapInArrow(counted, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}  # at most a row a term
    weight = {t: floor(1000 * log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    asks = []
    for _, own in asked:
        known = sorted((number[t], n) for t, n in own.items() if number[t] in weight)
        asks.append((np.array([t for t, _ in known], dtype=np.int64), np.array([n * weight[t] for t, n in known], dtype=np.int64)))
    index = stored(shards.mapInArrow(_indexed(n_docs, n_terms, longest, cost, FIRST), _INDEX), "index")
    sent = spark.sparkContext.broadcast((asks, [1] * len(asks)))
    first = stored(_best(index.where("wave = 0").mapInArrow(_searched(sent, k), _FOUND).where("query >= 0"), k), "found")
    least = {r.query: r.score for r in first.where(F.col("rank") == k).collect()}  # a row a query
    sent = spark.sparkContext.broadcast((asks, [max(1, least.get(q, 1)) for q in range(len(asks))]))
    rest = index.where("wave = 1").mapInArrow(_searched(sent, k), _FOUND)
    if stats is not None:
        scored, every = rest.where("query < 0").agg(F.sum("doc_id"), F.sum("score")).first()
        blocks, listed = index.select((F.sum(F.length("cuts")) / 8 - F.count("*")).alias("b"), (F.sum(F.length("docs")) / 4).alias("p")).first()
        stats |= {"scored": scored, "pairs": every, "blocks": int(blocks or 0), "postings": int(listed or 0)}
    return _best(first.drop("rank").unionByName(rest.where("query >= 0")), k)


def rank(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", terms: int = TERMS, longest: int = LONGEST, cost: int = COST, shard_docs: int = DOCS, shard_postings: int = POSTINGS, stats: dict | None = None) -> DataFrame:
    """(``item_col``, rank int, doc_id long, score long): the ``k`` documents with the highest scores above 0 of each query
    (all, if fewer); ties go to the smaller id.

    Terms are the words of ``words.py``. With N documents that have terms, L terms in all, n of a document, df documents
    that hold a term and tf of its occurrences, a term adds w * (10^9 tf div (1000 tf + 8 m)) for each time it stands in
    the query, where w = floor(1000 ln((2 N + 2) / (2 df + 1))) and m = 25 + (75 n N div L); div rounds down.

    Null texts, empty ones and those of punctuation alone have no terms: such documents don't count, such queries get no
    rows. Rows with a null id take no part. Ids are longs. A document row that repeats an id counts, and is returned, as
    a document of its own; a query id that repeats is asked once, with the smallest of its texts. No documents or no
    queries give no rows. Other columns aren't read. A query's ranks are unique also where scores are equal.

    Queries are taken in blocks of about ``terms`` terms, one pass over the documents each. ``stats`` gets the number of
    (query, document) pairs and of those scored in the last wave of the last block, and of postings and blocks."""
    spark = python_path(docs.sparkSession)
    asked = stored(query_terms(queries, item_col, item_text_col), "queries")
    n = asked.count()
    blocks = -(-n // terms)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    out = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else asked
        by: dict = {}
        for r in own.toLocalIterator():  # about ``terms`` rows
            by.setdefault(r["item"], {})[r.term] = r.n
        items = sorted(by.items())
        if not items or (found := _ranked(rows, items, k, longest, cost, shard_docs, shard_postings, stats)) is None:
            continue
        names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(items)], f"query int, item {dict(asked.dtypes)['item']}")
        named = found.join(F.broadcast(names), "query").select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = named if out is None else out.unionByName(named)
    if out is None:
        return spark.createDataFrame([], f"{item_col} {dict(queries.dtypes)[item_col]}, rank int, doc_id long, score long")
    return out
