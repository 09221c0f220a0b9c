"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents; the unlabelled class is the whole corpus, good and bad mixed. Which documents
carry a label, and what a label of 0 says, is never used.

Models are additive over quantile bins of text statistics and fitted on folds of the positives, each against the whole
corpus: Newton's method, with sums over all rows from one pass of mergeable integers a step. A positive is ranked by the model that hasn't seen it: its rank is the share of documents that score
lower. The class prior is the share of documents above a rank over the share of positives above it, at the rank where
the upper end of that ratio's sampling error is least.

1. Models that tell positives from the corpus give a first prior.
2. With it, models g minimise the non-negative unbiased risk
       prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]),   l the logistic loss,
   with the least penalty on weights, of a row of doublings, at whose minimum the second term isn't below zero.
3. Their ranks among *all* documents, from counts over the whole corpus, give the final prior and the score: the function
   of the rank, rising by steps, that minimises the same risk over the counts of all documents and all positives:
   prior * (positives' density) / (documents' density), pooled where it would fall, and no more than 1, where the
   second term would go below zero.

Only labelled rows are bounded; bins, weights, ranks, prior and scores come from sums over all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import durable, python_path, stored
from .labelled import held_out, labelled_sample
from .shingles import U64, word_hashes

SAMPLE = 20_000  # most positives to fit on
FEW = 4_096  # most rows that lend their curvature to the steps of the fit
BINS = 32
FOLDS = 4
RANKS = 1024
GRID = 1 << 14
UNIT = 1 << 22
CELLS, LOWEST = 1 << 16, 96 << 10
DECAY = 15.0  # the penalty on weights at first is this over the number of positives
TOLERANCE = 1e-6

_KINDS = np.full(256, 7)
for _k, _chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\v\f\r", b"\n", b".,;:'\"()-?", b"!"]):
    _KINDS[list(_chars)] = _k
_KINDS[[b for b in range(0x21, 0x7F) if _KINDS[b] == 7]] = 8


def statistics(text: str) -> np.ndarray:
    """Shares of kinds of characters and of repeated words and word triples; all zero for the empty text."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    out = np.zeros(14)
    if not len(b):
        return out
    kinds = np.bincount(_KINDS[b], minlength=9)
    out[:9] = kinds / len(b)
    h = word_hashes(text)
    n = len(h)
    if n:
        solid = len(b) - kinds[3] - kinds[4]
        out[9] = np.log1p(n)
        out[10] = solid / n
        out[11] = (h[1:] == h[:-1]).mean() if n > 1 else 0
        if n > 2:
            out[12] = 1 - len(np.unique(h[:-2] * U64(3) + h[1:-1] * U64(5) + h[2:] * U64(7))) / (n - 2)
        upper = (kinds[1] + 1) / (kinds[0] + kinds[1] + 2)
        out[13] = upper
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _columns(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Indices into the weights, one a statistic."""
    return np.stack([np.searchsorted(e, x[:, j], side="right") + j * BINS for j, e in enumerate(edges)], 1)


def _cells(x: np.ndarray) -> np.ndarray:
    """Cells of a grid that is the same for every corpus: a statistic, and the six lower bits of the exponent and ten of
    the mantissa of its value as float32, so a cell is less than 0.1 % wide; what is below 2^-31 counts as 0, and what
    is above 2^33 as that."""
    lead = np.maximum(x, 0).astype(np.float32).view(np.uint32) >> 13
    return np.clip(lead.astype(np.int64) - LOWEST, 0, CELLS - 1) + np.arange(x.shape[1]) * CELLS


def quantile_edges(counts: np.ndarray) -> np.ndarray:
    """Lower ends of the cells that hold the quantiles of each statistic, from the counts of all rows by cell."""
    edges = []
    for each in counts.reshape(-1, CELLS):
        ends = np.cumsum(each)
        at = np.searchsorted(ends, np.arange(1, BINS) * ends[-1] / BINS)
        ends_at = ((at + LOWEST).astype(np.uint32) << 13).view(np.float32).astype(float)
        edges.append(np.where(at > 0, ends_at, 0.0))
    return np.stack(edges)


def slopes_of(columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row for each model: sums over the rows of log(1 + e^g) and of the slope of that in each weight. In units of
    1 / UNIT, rounded a row, so that they don't depend on how rows are dealt to tasks."""
    flat, out = columns.ravel(), np.empty((len(weights), 1 + weights.shape[1]), dtype=np.int64)
    for k, w in enumerate(weights):
        g = w[columns].sum(1)
        out[k, 0] = np.rint(np.logaddexp(0, g) * UNIT).sum()
        out[k, 1:] = np.bincount(flat, np.repeat(np.rint(_sigmoid(g) * UNIT), columns.shape[1]), weights.shape[1])
    return out


class Risk:
    """What a fold's model minimises, from its positives and the corpus's sums: the value, its slope and its second
    term. With a prior the non-negative unbiased risk, whose first part is linear for the logistic loss:
    prior * (l(g) - l(-g)) = -prior * g. Without one the loss of telling positives from the corpus."""

    def __init__(self, columns: np.ndarray, size: int, prior: float | None, decay: float):
        self.columns, self.size, self.prior, self.decay = columns, size, prior, decay

    def at(self, w: np.ndarray, loss: float, slope: np.ndarray) -> tuple[float, np.ndarray, float]:
        g, each = w[self.columns].sum(1), self.columns.shape[1]
        kept = self.decay / 2 * (w**2).sum()
        if self.prior is None:
            ours, of = np.logaddexp(0, -g).mean() / 2, -_sigmoid(-g) / 2 / len(g)
            value, slope, negative = ours + loss / 2 + kept, slope / 2, 0.0
        else:
            value, of = loss - self.prior * g.mean() + kept, np.full(len(g), -self.prior / len(g))
            negative = loss - self.prior * np.logaddexp(0, g).mean()
        return value, slope + np.bincount(self.columns.ravel(), np.repeat(of, each), self.size) + self.decay * w, negative

    def step(self, w: np.ndarray, slope: np.ndarray, few: np.ndarray) -> np.ndarray:
        """Newton's step, with the curvature of a few rows of the corpus (and as many positives)."""

        def curvature(columns: np.ndarray) -> np.ndarray:
            p = _sigmoid(w[columns].sum(1))
            hot = np.zeros((len(columns), self.size), dtype=np.float32)
            np.put_along_axis(hot, columns, 1, 1)
            return (hot.T @ (hot * (p * (1 - p) / len(p)).astype(np.float32)[:, None])).astype(float)

        found = curvature(few)
        if self.prior is None:
            found = (found + curvature(self.columns[: len(few)])) / 2
        return -np.linalg.solve(found + self.decay * np.eye(self.size), slope)


def minimise(risks: list[Risk], sums: Callable[[np.ndarray], np.ndarray], few: np.ndarray, rows: int, passes: int = 40) -> np.ndarray:
    """Weights of each risk by Newton's method; ``sums`` gives ``slopes_of`` over all rows, one pass for all models. A
    step is halved until the risk falls. Where the second term is negative at the minimum, the penalty on weights
    doubles and the search goes on from there, so at the end the unbiased risk and the non-negative one agree. ``few``
    rows shape the steps; where they end is for all rows to say."""
    w = np.zeros((len(risks), risks[0].size))
    trial, step, slope, value = w.copy(), np.zeros_like(w), np.zeros_like(w), np.full(len(w), np.inf)
    size, going = np.ones(len(w)), np.ones(len(w), dtype=bool)
    for _ in range(passes):
        found = sums(trial) / UNIT / rows
        for k in np.flatnonzero(going):
            risk = risks[k]
            v, s, negative = risk.at(trial[k], found[k, 0], found[k, 1:])
            if v <= value[k] + 1e-4 * size[k] * (slope[k] @ step[k]):
                w[k], value[k], slope[k], size[k] = trial[k], v, s, 1.0
                step[k] = risk.step(w[k], s, few)
                if -(s @ step[k]) < TOLERANCE and negative < 0:
                    value[k] += risk.decay / 2 * (w[k] ** 2).sum()
                    slope[k] = s + risk.decay * w[k]
                    risk.decay *= 2
                    step[k] = risk.step(w[k], slope[k], few)
                going[k] = -(slope[k] @ step[k]) >= TOLERANCE
            else:
                size[k] /= 2
                going[k] = size[k] > 1e-3
            trial[k] = w[k] + size[k] * step[k] if going[k] else w[k]
        if not going.any():
            break
    return w


def estimate_prior(ranks: np.ndarray) -> tuple[float, float]:
    """(share of positives in the corpus, its standard error) of positives' ranks among all documents."""
    cuts = np.linspace(0, 0.95, 96)
    above = np.array([(ranks >= c).mean() for c in cuts])
    ratio = (1 - cuts) / np.maximum(above, 1e-9)
    error = ratio * np.sqrt((1 - above) / np.maximum(above * len(ranks), 1e-9)) + 1 / len(ranks)
    best = int(np.argmin(ratio + 2 * error))
    return float(np.clip(ratio[best], 0.01, 1.0)), float(error[best])


def rising(ranks: np.ndarray, counts: np.ndarray, prior: float) -> np.ndarray:
    """The score of each bin of ranks that minimises the risk; ``counts`` are those of all documents by bin, and bins
    are dealt to positives by ``ranks``."""
    total = max(counts.sum(), 1)
    ends = np.cumsum(counts) / total
    positive = np.bincount(np.minimum(np.searchsorted(ends, ranks, side="right"), len(counts) - 1), minlength=len(counts)) / len(ranks)
    blocks: list[list[float]] = []  # positives, documents, bins
    for p, u in zip(prior * positive, counts / total, strict=True):
        blocks.append([p, u, 1])
        while len(blocks) > 1 and blocks[-1][0] * blocks[-2][1] <= blocks[-2][0] * blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    return np.concatenate([np.full(int(n), min(1.0, p / u) if u else 0.0) for p, u, n in blocks])


@dataclass
class PuModel:
    """``weights`` by fold; ``knots`` cut the mean model's scores into bins of ``values``."""

    edges: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    prior: float
    prior_error: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        """A row for each fold's model and one for their mean."""
        return self.of_bins(_columns(x, self.edges))

    def of_bins(self, columns: np.ndarray) -> np.ndarray:
        found = self.weights[:, columns].sum(2)
        return np.concatenate([found, found.mean(0, keepdims=True)])

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.values) or not len(x):
            return np.full(len(x), 0.5)
        g = self.logits(x)[-1]
        within = _sigmoid(g)  # keeps the order of documents within a step
        return 0.999 * self.values[np.searchsorted(self.knots, g, side="right")] + 0.001 * within

NONE = PuModel(np.zeros((14, BINS - 1)), np.zeros((FOLDS, 14 * BINS)), np.zeros(0), np.zeros(0), 0.5)


def grid(weights: np.ndarray) -> np.ndarray:
    """Ends of even bins of each model's logits, a row for each of ``logits``, over all that its weights can give."""
    ends = []
    for w in [*weights, weights.mean(0)]:
        by = w.reshape(-1, BINS)
        ends.append(np.linspace(by.min(1).sum(), by.max(1).sum(), GRID + 1)[1:-1])
    return np.stack(ends)


def coarser(ends: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and counts of at most RANKS bins of about as many rows each, joined from those of the grid."""
    upto = np.cumsum(counts)
    at = np.unique(np.searchsorted(upto, np.arange(1, RANKS) * upto[-1] / RANKS))
    at = at[at < len(ends)]
    return ends[at], np.diff(np.concatenate([[0], upto[at], upto[-1:]]))


def finish(model: PuModel, ends: np.ndarray, counts: np.ndarray, positive: np.ndarray) -> PuModel:
    """Prior and score of each rank; ``counts`` are those of all documents by model and bin of ``ends``."""
    logits, fold = model.logits(positive), np.arange(len(positive)) % FOLDS
    bins = [coarser(e, c) for e, c in zip(ends, counts, strict=True)]
    ranks = np.empty(len(positive))
    for k in range(FOLDS):
        cut, each = bins[k]
        at = np.searchsorted(cut, logits[k, fold == k], side="right")
        ranks[fold == k] = (np.cumsum(each)[at] - each[at] / 2) / max(each.sum(), 1)
    prior, error = estimate_prior(ranks)
    knots, each = bins[-1]
    return PuModel(model.edges, model.weights, knots, rising(ranks, each, prior), prior, error)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, 14)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, x binary) of each row: the statistics of its whole text, a null text as the empty one."""
    python_path(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = [statistics(t).astype("<f8").tobytes() for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(x, pa.binary())], names=["id", "held_out", "x"])

    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, x binary")


def _totals(rows: DataFrame, tally: Callable[[np.ndarray], np.ndarray], decode: Callable[[pa.Array], np.ndarray], size: int) -> np.ndarray:
    """Sums over all rows of integers that ``tally`` finds for a batch; a task adds its own up before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                total += tally(decode(batch.column(0)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    found = rows.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most ``size`` rows
    out = np.zeros(size, dtype=np.int64)
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out


def _sums(rows: DataFrame, tally: Callable[[np.ndarray], np.ndarray], parts: int) -> np.ndarray:
    """As ``_totals``, of rows of bins in ``parts`` partitions, for short vectors that every task fills: a task's vector is
    one value, and at most 64 of them come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                total = total + tally(_binned(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    def added(values: list[bytes]) -> np.ndarray:
        total = np.zeros(1, dtype=np.int64)
        for v in values:
            total = total + np.frombuffer(v, dtype=np.int64)
        return total

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = added([v for batch in batches for v in batch.column(0).to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    found = rows.mapInArrow(run, "v binary")
    if parts > 64:
        found = found.repartition(64).mapInArrow(join, "v binary")
    return added(found.toArrow()["v"].to_pylist())


def _binned(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, 14) + np.arange(14) * BINS


def train(found: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, few: int = FEW, id_col: str = "doc_id") -> PuModel:
    """Fit on ``features``: at most ``sample`` documents labelled 1 that aren't held out, and all rows as the unlabelled
    ones, one pass over their bins (14 bytes a row) for each step of the fit. ``few`` rows lend the steps their
    curvature and change no result. Of labelled rows that repeat an id the one with the smallest statistics is learned from."""
    spark = python_path(found.sparkSession)
    trusted = labelled_sample(labels.where(F.col(label_col) == 1), label_col, sample, id_col)
    rows = found.where("id is not null").select(F.col("id").cast("long").alias("id"), "x")
    taken = rows.join(F.broadcast(trusted.select("id")), "id").groupBy("id").agg(F.min("x").alias("x"))  # at most ``sample`` ids
    table = taken.toPandas().sort_values("id")
    positive = np.frombuffer(b"".join(map(bytes, table["x"])), dtype="<f8").reshape(-1, 14)
    if not len(positive):
        return NONE
    edges = quantile_edges(_totals(found.select("x"), lambda x: np.bincount(_cells(x).ravel(), minlength=14 * CELLS), _matrix, 14 * CELLS))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = (_columns(_matrix(batch.column(1)), edges) - np.arange(14) * BINS).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in c], pa.binary())], names=["id", "c"])

    binned = stored(found.select("id", "x").mapInArrow(bins, f"id {found.schema['id'].dataType.simpleString()}, c binary"), "bins")
    only = binned.select("c")
    n, parts = only.count(), only.rdd.getNumPartitions()
    shape = binned.orderBy(F.xxhash64("id", "c"), "c").select("c").limit(few).toArrow()["c"].combine_chunks()
    cp, cu, size = _columns(positive, edges), _binned(shape), 14 * BINS
    fold = np.arange(len(cp)) % FOLDS

    def sums(weights: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(weights)
        return _sums(only, lambda c: slopes_of(c, sent.value).ravel(), parts).reshape(len(weights), -1)

    def fitted(prior: float | None) -> PuModel:
        risks = [Risk(cp[fold != k] if (fold != k).any() else cp, size, prior, DECAY / len(cp)) for k in range(FOLDS)]
        model = PuModel(edges, minimise(risks, sums, cu, n), np.zeros(0), np.zeros(0), 0.5)
        ends = grid(model.weights)
        sent = spark.sparkContext.broadcast((model, ends))

        def tally(c: np.ndarray) -> np.ndarray:
            of, cut = sent.value
            return np.concatenate([np.bincount(np.searchsorted(e, g, side="right"), minlength=GRID) for e, g in zip(cut, of.of_bins(c), strict=True)])

        return finish(model, ends, _totals(only, tally, _binned, (FOLDS + 1) * GRID).reshape(FOLDS + 1, GRID), positive)

    return fitted(min(fitted(None).prior, 0.99))  # at 1 the second term would be 0 without any weights


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(``id_col``, held_out, score, predicted) for each row of ``docs``: the probability of good quality.

    Null texts are scored as empty ones; null ids count as held out; null labels are ignored; repeated rows come back
    as often as they occur; labels of unknown documents have no effect. Without labels every score is one half.
    Columns other than the id and the text are never read."""
    spark = python_path(docs.sparkSession)
    found = durable(features(docs, id_col, text_col))
    model = spark.sparkContext.broadcast(train(found, labels, id_col=id_col, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.value.scores(_matrix(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return found.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``score`` predicts to be good, with all their columns."""
    spark = python_path(docs.sparkSession)
    model = spark.sparkContext.broadcast(train(durable(features(docs, id_col, text_col)), labels, id_col=id_col, **options))

    @F.pandas_udf("boolean")
    def good(texts):
        found = np.zeros(len(texts), dtype=bool)
        for at in range(0, len(texts), 512):  # statistics are cheaper to find again than texts are to store with them
            x = np.stack([statistics(t) for t in texts.iloc[at : at + 512].fillna("")])
            found[at : at + 512] = model.value.scores(x) >= threshold
        return pd.Series(found)

    return docs.where(good(F.col(text_col)))
