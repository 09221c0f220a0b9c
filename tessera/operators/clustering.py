"""Schemaless clustering of a request's columns.

Columns with the same concept and role start as one cluster. Clusters then merge greedily in the order of the request,
which is sequential by definition, so a request is folded in one task; requests spread over the cluster.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import ROLES, column_role, is_flag
from ..functions.text import concept_tokens, role_tokens, union_name
from ..functions.vectors import sparse_value_vectors
from ..runtime import python_path
from ..settings import Settings
from ..sources.profile import column_stats
from .matching import column_prompts
from .noise import leading_contexts

# Endings that make a word a form of another, tokens whose columns give no value evidence.
FORMS = {"ing", "ed", "er", "ers", "s", "es", "age"}
NO_VALUE_EVIDENCE = set("id identifier date dt time day days year years age total tot sum index outcome event note notes diagnosis admission discharge".split())
APART = {"IDENTIFIER", "FREE_TEXT", "DIAGNOSIS", "OUTCOME", "BOOLEAN_FLAG", "DATE", "DURATION", "AGE", "LIFE_EVENT_YEAR"}
SCORES = {"TOTAL_SCORE", "ITEM_SCORE", "NUMERIC_MEASURE"}
LIFE = {"birth", "born", "death", "deceased"}
STRUCTURAL = {"id", "code", "name", "value", "flag", "indicator", "status", "type"}
TOKEN_LEAST, VALUE_LEAST, VALUE_MOST = 0.15, 0.30, 0.99
LEXICAL_WEIGHT, VALUE_WEIGHT, ROLE_WEIGHT = 0.16, 0.08, 0.08
BONUS = LEXICAL_WEIGHT + VALUE_WEIGHT + ROLE_WEIGHT  # most that evidence other than the cosine adds to a score


def with_roles(columns: DataFrame) -> DataFrame:
    rows = columns if "stats" in columns.columns else columns.withColumn("stats", column_stats(F.col("values")))
    return rows.withColumn("role", column_role(F.col("column"), F.col("concept"), F.col("values"), F.col("stats")))


def initial_key(concept, role):
    """Columns with one key start in one cluster."""
    name = union_name(F.lower(F.trim(concept)))
    return F.concat(F.when(name != "", name).otherwise("__empty__"), F.lit("__role_"), F.lower(role))


def _initials_match(initials: str, token: str) -> bool:
    return bool(initials) and (initials.startswith(token) or token.startswith(initials) or (len(initials) > 2 and initials[1:] == token))


def _vowels(token: str) -> int:
    return sum(c in "aeiou" for c in token)


def is_acronym_like(token: str) -> bool:
    """Three to six characters with one vowel at most."""
    return 3 <= len(token) <= 6 and _vowels(token) <= 1


def _abbreviates(short: list[str], full: list[str]) -> bool:
    if len(full) == 1:
        whole = full[0]
        stems = [t for t in short if len(t) >= 3] + [t[:-1] for t in short if len(t) > 3 and t.endswith("e")]
        return len(whole) >= 4 and any(whole.startswith(t) and whole[len(t) :] in FORMS for t in stems)
    initials = "".join(t[0] for t in full)
    for token in short:
        if not 2 <= len(token) <= 6 or (len(short) > 1 and len(token) < 3 and len(token) != len(full)):
            continue
        if _initials_match(initials, token) or any(_initials_match(initials, token[i:]) for i in range(1, len(token) - 1)):
            return True
        for k, whole in enumerate(full):
            if whole.startswith(token) and whole != token:
                rest, others = [x for x in short if x != token], full[:k] + full[k + 1 :]
                if not rest or is_acronym_like(whole) or all(any(x.startswith(y) or y.startswith(x) for y in others) for x in rest):
                    return True
    return False


def is_abbreviation_pair(a: str, b: str, ta: list[str], tb: list[str]) -> bool:
    """Whether one label abbreviates the other; ``ta``, ``tb`` are their tokens."""
    if not ta or not tb or ta == tb:
        return False
    for short, full, s, f in ((ta, tb, a, b), (tb, ta, b, a)):
        heads = [h.split()[0] for h in f.lower().split("+") if h.split()] if "+" in f else []
        if heads and "+" not in s and not all(h in short for h in heads):
            continue
        if _abbreviates(short, full):
            return True
    return False


def _cosine(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return 0.0
    x, y = a.astype(np.float64), b.astype(np.float64)
    n = x.dot(x) * y.dot(y)
    return float(x.dot(y) / np.sqrt(n)) if n > 1e-24 else 0.0


def composite_heads(label: str) -> list[str]:
    """First words of the parts that a label joins by '+'; none unless there are two."""
    parts = label.lower().split("+") if "+" in label else []
    heads = [next((w for w in re.split("[^a-z0-9]+", p) if len(w) > 1), "") for p in parts]
    heads = [h for h in heads if h]
    return heads if len(heads) > 1 else []


class Cluster:
    """Members in order, with running mean directions in single precision. Role, representative, tokens, labels and
    concepts are kept as members come in; a member that is one of those already here, the same object, only counts."""

    def __init__(self, first: dict):
        self.members: list[dict] = []
        self.vec = self.value = None
        self.n_value = 0
        self.tokens: set[str] = set()
        self.heads: list[str] = []
        self.labels = ""
        self.concepts: dict[str, None] = {}
        self.flags: set[str] = set()
        self.votes: dict[str, int] = {}
        self.role, self.representative = "", first["column"]
        self._known: set[int] = set()
        self._rank: tuple | None = None
        self.add(first)

    def add(self, m: dict) -> None:
        k = len(self.members)
        self.members.append(m)
        if id(m) not in self._known:
            self._known.add(id(m))
            self._describe(m)
        self.votes[m["role"]] = self.votes.get(m["role"], 0) + 1
        self.role = min(self.votes, key=lambda r: (-self.votes[r], ROLES.index(r)))
        self.vec = _fold(self.vec, m["vec"], k)
        if m["value_vec"] is not None:
            self.value, self.n_value = _fold(self.value, m["value_vec"], self.n_value), self.n_value + 1

    def _describe(self, m: dict) -> None:
        self.tokens |= {*m["concept_tokens"], *m["column_tokens"]}
        self.heads = self.heads or composite_heads(m["column"]) or composite_heads(m["concept"] or "")
        self.labels += "".join(" " + re.sub("[^a-z0-9]+", "", x.lower()) for x in (m["column"], m["concept"] or ""))
        self.flags |= {name for name in ("life", "flag", "no_value_evidence") if m[name]}
        if c := m["concept"]:
            self.concepts[c] = None
            # The shortest concept that isn't structural, then by letters, stands for the cluster.
            rank = (set(c.split()) <= STRUCTURAL, len(c), c.lower())
            if self._rank is None or rank < self._rank:
                self._rank, self.representative = rank, c

    def merge(self, other: Cluster) -> None:
        for m in other.members:
            self.add(m)

    def covers(self, other: Cluster) -> bool:
        """Whether every part of the other's composite label stands in a label here."""
        return all(h in self.labels for h in other.heads)


def _fold(mean: np.ndarray | None, vec: np.ndarray, n: int) -> np.ndarray:
    if mean is None:
        return vec.astype(np.float32)
    new = ((mean * np.float32(n) + vec.astype(np.float32)) / np.float32(n + 1)).astype(np.float32)
    norm = np.float32(np.sqrt((new.astype(np.float64) ** 2).sum()))
    return new / norm if norm > 0 else new


def roles_fit(a: str, b: str) -> bool:
    if a == b or "UNKNOWN" in (a, b):
        return True
    if a in APART or b in APART or {a, b} == {"TOTAL_SCORE", "ITEM_SCORE"}:
        return False
    return {a, b} <= SCORES


def merge_score(a: Cluster, b: Cluster) -> float | None:
    """The ensemble score of merging, or None where nothing speaks for it. Abbreviations are only looked for where
    tokens don't overlap, and values only where names say nothing at all."""
    if not (a.covers(b) and b.covers(a) and roles_fit(a.role, b.role)):
        return None
    shared = len(a.tokens & b.tokens)
    jaccard = shared / len(a.tokens | b.tokens) if shared else 0.0
    overlap, name = jaccard >= TOKEN_LEAST, b.representative
    short = not overlap and any(is_abbreviation_pair(c, name, c.split(), name.split()) for c in a.concepts)
    if not short and ("life" in a.flags) != ("life" in b.flags):
        return None
    if not (overlap or short):
        bare = any({"no_value_evidence", "flag"} & c.flags or c.role in ("TOTAL_SCORE", "ITEM_SCORE") for c in (a, b))
        if bare or not VALUE_LEAST <= _cosine(a.value, b.value) < VALUE_MOST:
            return None
    lexical, by_value = max(jaccard, 0.45 if short else 0.0), 0.0 if overlap or short else 0.25
    role = 0.0 if "UNKNOWN" in (a.role, b.role) else 1.0 if a.role == b.role else 0.45 if {a.role, b.role} <= SCORES else 0.0
    return min(1.0, _cosine(a.vec, b.vec) + LEXICAL_WEIGHT * lexical + VALUE_WEIGHT * by_value + ROLE_WEIGHT * role)


class _Directions:
    """Mean directions of the clusters so far, as one matrix that grows."""

    def __init__(self, dim: int):
        self.rows, self.n = np.zeros((64, dim), dtype=np.float32), 0

    def put(self, at: int, vec: np.ndarray) -> None:
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        norm = np.sqrt(vec.astype(np.float64) @ vec.astype(np.float64))
        self.rows[at] = vec / norm if norm > 1e-12 else 0
        self.n = max(self.n, at + 1)

    def near(self, vec: np.ndarray, least: float) -> list[int]:
        """Clusters whose cosine with ``vec`` is ``least`` or more, with room for rounding, in order."""
        norm = np.sqrt(vec.astype(np.float64) @ vec.astype(np.float64))
        sims = self.rows[: self.n] @ (vec / norm if norm > 1e-12 else np.zeros_like(vec)).astype(np.float32)
        return np.flatnonzero(sims >= least - 1e-4).tolist()


def fold(rows: list[dict], threshold: float) -> list[Cluster]:
    """Initial clusters by key, then each joins the best earlier one that reaches the threshold.

    A score is a cosine and at most ``BONUS``, so only clusters whose cosine, taken for all at once, is within that of
    the threshold are scored; the rest can't be joined."""
    first: dict[str, Cluster] = {}
    for m in rows:
        if m["key"] in first:
            first[m["key"]].add(m)
        else:
            first[m["key"]] = Cluster(m)
    out: list[Cluster] = []
    means = _Directions(len(rows[0]["vec"]) if rows else 0)
    for c in first.values():
        best, at = threshold, None
        for i in means.near(c.vec, threshold - BONUS):
            s = merge_score(out[i], c)
            if s is not None and (s > best or (at is None and s >= best)):
                best, at = s, i
        if at is None:
            out.append(c)
            means.put(len(out) - 1, c.vec)
        else:
            out[at].merge(c)
            means.put(at, out[at].vec)
    return out


def _dense(cells: pa.ChunkedArray, used: np.ndarray) -> list[np.ndarray | None]:
    """A vector over the cells ``used`` for each row; None for rows without cells."""
    n, flat = pc.fill_null(pc.list_value_length(cells), 0).to_numpy(), pc.list_flatten(cells)
    rows = np.zeros((len(n), len(used)), dtype=np.float32)
    rows[np.repeat(np.arange(len(n)), n), np.searchsorted(used, pc.struct_field(flat, "idx").to_numpy())] = pc.struct_field(flat, "w").to_numpy()
    return [v if k else None for v, k in zip(rows, n, strict=True)]


_CLUSTERED = pa.schema([("request_id", pa.string()), ("pos", pa.int32()), ("cluster", pa.int32()), ("representative", pa.string()), ("role", pa.string()), ("sim", pa.float64())])


def cluster_columns(columns: DataFrame, settings: Settings = Settings(), vectors: DataFrame | None = None) -> DataFrame:
    """(request_id, pos, cluster, representative, role, sim): cluster numbers in order of the first column; sim is the
    cosine of a member with its cluster's centroid. ``columns`` need concept; ``vectors`` (request_id, pos, idx, w)
    replace the default hashed embedding of the column prompts.

    Columns of a request that are equal but for their place are one row with all places, so vectors are made and held
    once for each; the fold still meets every column, in order."""
    python_path(columns.sparkSession)
    rows = with_roles(columns)
    sparse = lambda v, name: v.groupBy("request_id", "pos").agg(F.array_sort(F.collect_list(F.struct("idx", "w"))).alias(name))
    key, same = ["request_id", "pos"], ["request_id", "column", "concept", "role", "values", "stats"]
    if vectors is not None:
        rows, same = rows.join(sparse(vectors, "cells"), key, "left"), [*same, "cells"]
    contexts = leading_contexts(rows.select("request_id", "column")).groupBy("request_id").agg(F.collect_set("token").alias("contexts"))
    rows = rows.groupBy(*same).agg(F.array_sort(F.collect_list(F.col("pos").cast("int"))).alias("places")).withColumn("pos", F.get("places", F.lit(0)))
    if vectors is None:
        rows = rows.join(sparse(sparse_value_vectors(column_prompts(rows), key, "prompts"), "cells"), key, "left")
    values = sparse(sparse_value_vectors(rows, key, "values"), "value_cells")
    names = role_tokens(F.concat_ws(" ", "column", "concept"))
    rows = rows.join(contexts, "request_id", "left")
    own = F.array_except(concept_tokens(F.col("column")), F.coalesce("contexts", F.array().cast("array<string>")))
    rows = rows.select(
        "request_id", "pos", "places", "column", "concept", "role", initial_key(F.col("concept"), F.col("role")).alias("key"),
        concept_tokens(F.col("concept")).alias("concept_tokens"), own.alias("column_tokens"),
        F.arrays_overlap(names, F.array(*map(F.lit, sorted(NO_VALUE_EVIDENCE)))).alias("no_value_evidence"),
        F.arrays_overlap(names, F.array(*map(F.lit, sorted(LIFE)))).alias("life"), is_flag(F.col("values")).alias("flag"), "cells",
    ).join(values, key, "left")

    def run(table: pa.Table) -> pa.Table:
        held = [pc.struct_field(pc.list_flatten(table[part]), "idx").to_numpy() for part in ("cells", "value_cells")]
        used = np.unique(np.concatenate(held))
        contents = table.drop_columns(["places", "cells", "value_cells"]).to_pylist()
        for m, v, w in zip(contents, *(_dense(table[part], used) for part in ("cells", "value_cells")), strict=True):
            m["vec"], m["value_vec"] = v if v is not None else np.zeros(len(used), dtype=np.float32), w
        of = np.repeat(np.arange(len(contents)), pc.list_value_length(table["places"]).to_numpy())
        places = pc.list_flatten(table["places"]).to_numpy()
        found = fold([contents[i] for i in of[np.argsort(places, kind="stable")]], settings.cluster_threshold)
        cluster = {id(m): k for k, c in enumerate(found) for m in c.members}
        at = [cluster[id(m)] for m in contents]  # equal columns have one key, so they are in one cluster
        sims = [round(_cosine(m["vec"], found[k].vec), 6) for m, k in zip(contents, at, strict=True)]
        each = [[m["request_id"] for m in contents], at, [found[k].representative for k in at], [found[k].role for k in at], sims]
        request, number, name, role, sim = (pa.array(x).take(pa.array(of)) for x in each)
        return pa.Table.from_arrays([request, pa.array(places, pa.int32()), number.cast(pa.int32()), name, role, sim], schema=_CLUSTERED)

    return rows.groupBy("request_id").applyInArrow(run, "request_id string, pos int, cluster int, representative string, role string, sim double")
