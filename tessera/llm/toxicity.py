"""Toxicity classifier with counterfactual regularisation.

A logistic model over the presence of words. The words that are worth a weight are chosen by Spark from all sampled
documents (document counts by class): all that stand in three or more and differ between the classes by three standard
errors, so there are at most as many as the sampled documents have words.

Two kinds of counterfactual pairs (x, x') add strength * mean((g(x) - g(x'))^2) each to the loss, so that the score of a
text doesn't depend on which group it mentions:

- a sampled document with identity terms, and itself with each of them swapped for another term of its group;
- every sampled document with a neutral mention put in, and with that mention swapped. The mention is one term of the
  table of groups, told by the document's own words, and stands there as one more word. Half of a document's weight in
  the loss is that of its copy with the mention, under the document's label, so terms that a sample rarely or never holds
  have weights to be held together, and what a mention does to a score is learned from texts of both classes.

Groups are a table by language; what a text is scored on are its words alone, whatever its language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import durable, python_path
from .labelled import labelled_sample, score_texts, texts_of
from .shingles import NO_LETTER, mix, word_hashes

SAMPLE = 20_000  # most labelled documents to fit on

# Groups of identity terms by language (fixed values; a parameter of the functions below). A term stands in one group.
GROUPS = {
    "en": (
        ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "catholic", "atheist"),
        ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "catholics", "atheists"),
        ("black", "white", "asian", "african", "european", "latino", "arab"),
        ("gay", "lesbian", "bisexual", "straight", "queer", "transgender"),
        ("woman", "man"),
        ("women", "men"),
        ("female", "male"),
        ("immigrant", "citizen", "refugee", "foreigner"),
        ("immigrants", "citizens", "refugees", "foreigners"),
        ("deaf", "blind", "disabled", "autistic"),
        ("old", "young", "elderly"),
    ),
    "fr": (
        ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
        ("noir", "blanc", "asiatique", "africain", "européen"),
        ("homosexuel", "lesbienne", "hétérosexuel"),
        ("femme", "homme"),
        ("immigré", "réfugié", "étranger"),
    ),
    "de": (
        ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch"),
        ("schwarzer", "weißer", "asiatisch", "afrikanisch", "europäisch"),
        ("schwul", "lesbisch", "heterosexuell"),
        ("frau", "mann"),
        ("einwanderer", "flüchtling", "ausländer"),
    ),
    "es": (
        ("musulmán", "cristiano", "judío", "budista", "ateo"),
        ("negro", "blanco", "asiático", "africano", "europeo"),
        ("homosexual", "lesbiana", "heterosexual"),
        ("mujer", "hombre"),
        ("inmigrante", "refugiado", "extranjero"),
    ),
}
IDENTITY = tuple(group for groups in GROUPS.values() for group in groups)


def words(text: str) -> np.ndarray:
    """Sorted distinct hashes of the words of a text, runs of letters without regard to case."""
    return np.unique(word_hashes(text.lower(), NO_LETTER))


def _hash(word: str) -> int:
    return int(word_hashes(word, NO_LETTER)[0])


def swaps(identity: tuple[tuple[str, ...], ...]) -> dict[int, int]:
    """Each term to the next one of its group."""
    return {_hash(w): _hash(group[(i + 1) % len(group)]) for group in identity for i, w in enumerate(group) if len(group) > 1}


@dataclass
class ToxicModel:
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def logit(self, present: np.ndarray) -> float:
        if not len(self.keys) or not len(present):
            return self.bias
        at = np.minimum(np.searchsorted(self.keys, present), len(self.keys) - 1)
        return self.bias + float(self.weights[at][self.keys[at] == present].sum())

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(words(text)), -60, 60))))


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -60, 60)))


class Objective:
    """The loss of a model (weights of the keys and the bias, in one array) and its gradient.

    ``rows``: the sorted hashes of each document's words out of the sorted ``keys``; a toxic document counts as
    ``weight`` others; ``swap``: identity terms to their counterparts (those that aren't keys are left out)."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, keys: np.ndarray, swap: dict[int, int], strength: float, weight: float, decay: float):
        self.n, self.size, self.strength, self.decay = len(rows), len(keys), strength, decay
        self.own, self.col = self._flat(rows, keys)
        self.y = labels.astype(float)
        each = np.where(self.y == 1, weight, 1.0)
        self.each = each / each.sum()
        to, terms = np.arange(len(keys)), []
        have = {int(x): i for i, x in enumerate(keys.tolist())}
        for x, other in sorted(swap.items()):
            if x in have and other in have:
                to[have[x]] = have[other]
                terms.append(have[x])
        # Documents with terms, and themselves with the terms swapped.
        is_term = np.zeros(len(keys), dtype=bool)
        is_term[terms] = True
        with_terms = np.unique(self.own[is_term[self.col]])
        inside = np.isin(self.own, with_terms)
        self.po, self.pc = np.searchsorted(with_terms, self.own[inside]), self.col[inside]
        swapped = np.unique(np.stack([self.po, to[self.pc]], 1), axis=0)
        self.so, self.sc = swapped[:, 0], swapped[:, 1]
        self.natural = len(with_terms)
        # Documents with a mention put in; a document that holds the term already stays as it is.
        self.mentions = len(rows) if terms else 0
        if self.mentions:
            told = np.array([int(r.sum(dtype=np.uint64)) if len(r) else 0 for r in rows], dtype=np.uint64)
            self.a = np.array(terms)[(mix(told) % np.uint64(len(terms))).astype(np.int64)]
            self.b = to[self.a]
            held = np.sort(self.own * np.int64(len(keys)) + self.col)
            new = lambda c: (~np.isin(np.arange(self.n) * np.int64(len(keys)) + c, held)).astype(float)
            self.add_a, self.add_b = new(self.a), new(self.b)

    @staticmethod
    def _flat(found: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.repeat(np.arange(len(found)), [len(r) for r in found])
        return own, np.searchsorted(keys, np.concatenate(found)) if len(own) else np.empty(0, np.int64)

    def start(self) -> np.ndarray:
        share = max((self.y * self.each).sum(), 1e-6)
        w = np.zeros(self.size + 1)
        w[-1] = np.log(share / max(1 - share, 1e-6))
        return w

    def gaps(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """g(x) - g(x') of the documents with terms, and of the documents with a mention put in."""
        natural = np.bincount(self.po, w[self.pc], self.natural) - np.bincount(self.so, w[self.sc], self.natural)
        return natural, self.add_a * w[self.a] - self.add_b * w[self.b] if self.mentions else np.empty(0)

    def loss(self, w: np.ndarray) -> float:
        g = np.bincount(self.own, w[self.col], self.n) + w[-1]
        total = lambda g: float((self.each * (np.logaddexp(0, g) - self.y * g)).sum())
        fit = (total(g) + total(g + self.add_a * w[self.a])) / 2 if self.mentions else total(g)
        return fit + sum(self.strength * float((d**2).mean()) for d in self.gaps(w) if len(d)) + self.decay / 2 * float((w[:-1] ** 2).sum())

    def gradient(self, w: np.ndarray) -> np.ndarray:
        g = np.bincount(self.own, w[self.col], self.n) + w[-1]
        slope = (_sigmoid(g) - self.y) * self.each
        grad = np.zeros_like(w)
        natural, put_in = self.gaps(w)
        if self.mentions:
            copy = (_sigmoid(g + self.add_a * w[self.a]) - self.y) * self.each / 2
            slope = slope / 2 + copy
            pull = 2 * self.strength * put_in / self.mentions
            grad[:-1] += np.bincount(self.a, self.add_a * (copy + pull), self.size) - np.bincount(self.b, self.add_b * pull, self.size)
        if self.natural:
            pull = 2 * self.strength * natural / self.natural
            grad[:-1] += np.bincount(self.pc, pull[self.po], self.size) - np.bincount(self.sc, pull[self.so], self.size)
        grad[:-1] += np.bincount(self.col, slope[self.own], self.size) + self.decay * w[:-1]
        grad[-1] = slope.sum()
        return grad


def fit(rows: list[np.ndarray], labels: np.ndarray, keys: np.ndarray, swap: dict[int, int], strength: float = 1.0, weight: float = 3.0, rounds: int = 1200, rate: float = 0.05, decay: float = 1e-5, report: dict | None = None) -> ToxicModel:
    """The model with the least ``Objective``. No rows: every score is 0. ``report`` gets the number of pairs of both
    kinds and the mean |g(x) - g(x')| over all of them."""
    if not len(labels):
        return ToxicModel(keys, np.zeros(len(keys)), -60.0)
    aim = Objective(rows, labels, keys, swap, strength, weight, decay)
    w = aim.start()
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        grad = aim.gradient(w)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    if report is not None:
        apart = np.abs(np.concatenate(aim.gaps(w)))
        report |= {"natural": aim.natural, "mentions": aim.mentions, "gap": float(apart.mean()) if len(apart) else 0.0}
    return ToxicModel(keys, w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE, identity: tuple = IDENTITY, strength: float = 1.0, id_col: str = "doc_id", text_col: str = "text", report: dict | None = None) -> ToxicModel:
    """Fit on at most ``sample`` labelled documents that aren't held out; ``report`` as of ``fit``."""
    python_path(docs.sparkSession)
    chosen = labelled_sample(labels, label_col, sample, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words(t).view(np.int64) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["id", "label", "words"])

    rows = texts_of(docs, chosen, id_col, text_col).groupBy("id", "label").agg(F.min("text").alias("text"))  # of several texts the first in order
    rows = durable(rows.mapInArrow(run, "id long, label int, words array<long>"))
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("p")).first()
    n1, n0 = max(1, totals.p), max(1, totals.n - totals.p)
    swap = swaps(identity)
    terms = np.array(sorted(set(swap) | set(swap.values())), dtype=np.uint64)
    counts = rows.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").alias("a"), F.count("*").alias("c"))
    share1, share0 = F.col("a") / n1, (F.col("c") - F.col("a")) / n0
    pooled = F.col("c") / (n1 + n0)
    z = F.abs(share1 - share0) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0) + 1e-12)
    best = counts.where("c >= 3").where(z >= 3).select("word")
    picked = np.array([r.word for r in best.collect()], dtype=np.int64).view(np.uint64)
    keys = np.unique(np.concatenate([picked, terms]))
    table = docs.sparkSession.createDataFrame([(int(x),) for x in keys.view(np.int64).tolist()], "word long")
    kept = rows.select("id", "label", F.explode_outer("words").alias("word")).join(F.broadcast(table.withColumn("in", F.lit(True))), "word", "left")  # words of the sample
    kept = kept.groupBy("id", "label").agg(F.collect_set(F.when(F.col("in"), F.col("word"))).alias("words"))
    data = kept.toArrow().sort_by("id")
    lists = data["words"].combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
    found = [np.sort(flat[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
    return fit(found, data["label"].to_numpy(), keys, swap, strength, report=report)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(``id_col``, held_out, score, predicted) for each row of ``docs``: the probability of toxicity.

    Null texts are scored as empty ones; null ids count as held out; null labels are ignored; repeated rows come back
    as often as they occur; without labels every score is close to 0. Columns other than the id and the text are never
    read."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, **options)
    return score_texts(docs, model.score, threshold, id_col, text_col)
