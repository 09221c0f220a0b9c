"""Leader clusters of the values of one mapping, all of them, in order.

A value joins the nearest cluster that reaches a threshold, unless that one holds another value of its source. Distinct
values have sparse vectors; a cluster's direction is the sum of its values' vectors. Each value is compared with what can
change its place alone: a cluster of its very direction has cosine 1, which none exceeds; a value that comes first in its
source can only join clusters that the source hasn't touched, so without one in reach it starts its own; and an inverted
index leaves out clusters whose bound stays below the threshold, or below the best found so far. Cosines count to nine
digits, and of equal ones the earlier cluster is the nearest.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

DIGITS, SLACK = 9, 1e-5  # slack: room for single precision in bounds
FRESH, PART = 512, 1 << 17  # directions compared one by one, and most of a part of an index
FEW, MANY = 8, 64
OLD, NEW = 0, 1


class _Part:
    """An inverted index of directions: of each cell the clusters that have it, with their weights."""

    def __init__(self, held: Leaders, clusters: np.ndarray):
        self.clusters, self.versions = clusters, held.version[clusters].copy()
        idx, w, sizes = held.directions(clusters)
        order = np.argsort(idx.astype(np.int16) if held.dim < 1 << 15 else idx, kind="stable")
        self.ids, self.w = np.repeat(np.arange(len(clusters), dtype=np.int32), sizes)[order], w[order].astype(np.float32)
        self.at = np.concatenate([[0], np.cumsum(np.bincount(idx, minlength=held.dim))])
        self.most = np.zeros(held.dim)
        np.maximum.at(self.most, idx, np.abs(w))

    def candidates(self, idx: np.ndarray, w: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Places of clusters whose cosine may be ``least`` or more, with what the lists read say of it. The longest
        lists are skipped, as far as what they could add stays below that."""
        sizes = self.at[idx + 1] - self.at[idx]
        order = np.argsort(-sizes, kind="stable")
        idx, w, sizes = idx[order], w[order], sizes[order]
        rest = np.minimum(np.cumsum(np.abs(w) * self.most[idx]), np.sqrt(np.cumsum(w * w)))
        skipped = int(np.searchsorted(rest, least - 2 * SLACK))
        left = rest[skipped - 1] if skipped else 0.0
        idx, w, sizes = idx[skipped:], w[skipped:], sizes[skipped:]
        if not sizes.sum():
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        met = np.concatenate([self.ids[self.at[i] : self.at[i + 1]] for i in idx])
        add = np.concatenate([self.w[self.at[i] : self.at[i + 1]] * x for i, x in zip(idx, w, strict=True)])
        if 4 * len(met) > len(self.clusters):
            found, partial = None, np.bincount(met, add, len(self.clusters))
        else:
            found, place = np.unique(met, return_inverse=True)
            partial = np.bincount(place, add)
        near = np.flatnonzero(partial >= least - left - SLACK)
        return near if found is None else found[near], partial[near]


class _Index:
    """The clusters that the present source has touched (NEW), or those that it hasn't (OLD), as a few parts of growing
    size and the latest as rows of a matrix."""

    def __init__(self, held: Leaders, side: int):
        self.held, self.side, self.n = held, side, 0
        self.parts: list[_Part] = []
        self.waiting: list[int] = []
        self.rows: np.ndarray | None = None
        self.fresh: list[tuple[int, int]] = []

    def _live(self, part: _Part, places: np.ndarray) -> np.ndarray:
        clusters = part.clusters[places]
        return (self.held.side[clusters] == self.side) & (self.held.version[clusters] == part.versions[places])

    def _settle(self) -> None:
        if len(self.fresh) + len(self.waiting) <= FRESH:
            if self.rows is None:
                self.rows = np.zeros((FRESH, self.held.dim))
            for k in self.waiting:
                self.rows[len(self.fresh)] = 0
                idx, w = self.held.direction(k)
                self.rows[len(self.fresh), idx] = w
                self.fresh.append((k, int(self.held.version[k])))
        else:
            # Clusters on the other side stay, as they come back as they are.
            every = np.array(sorted({k for k, version in self.fresh if self.held.version[k] == version}.union(self.waiting)), dtype=np.int64)
            while self.parts and len(self.parts[-1].clusters) <= 2 * len(every) and len(self.parts[-1].clusters) < PART:
                last = self.parts.pop()
                every = np.union1d(every, last.clusters[self.held.version[last.clusters] == last.versions])
            self.parts += [_Part(self.held, every[lo : lo + PART]) for lo in range(0, len(every), PART)]
            self.fresh = []
        self.waiting = []

    def best(self, v: int, least: float) -> tuple[float, int]:
        """The largest cosine with ``v`` and minus its cluster, where it is ``least`` or more; else (0, 1)."""
        if self.waiting:
            self._settle()
        idx, w = self.held.vector(v)
        dense = self.held.dense
        dense[idx] = w
        found = (0.0, 1)
        if self.fresh:
            sims = np.round(self.rows[: len(self.fresh)] @ dense, DIGITS)
            for i in np.flatnonzero(sims >= least).tolist():
                k, version = self.fresh[i]
                if self.held.side[k] == self.side and self.held.version[k] == version:
                    found = max(found, (float(sims[i]), -k))

        def compared(clusters: np.ndarray, found: tuple[float, int]) -> tuple[float, int]:
            sims = self.held.cosines(clusters, dense)
            top = float(sims.max())
            return max(found, (top, -int(clusters[sims == top].min()))) if top >= least else found

        for part in reversed(self.parts):  # the smallest first
            near, partial = part.candidates(idx, w, max(least, found[0]))
            live = self._live(part, near)
            near, partial = near[live], partial[live]
            if len(near) > MANY:  # a few that look best raise what the others must reach
                before = found
                found = compared(part.clusters[near[np.argpartition(-partial, FEW)[:FEW]]], found)
                if found > before:
                    near, _ = part.candidates(idx, w, found[0])
                    near = near[self._live(part, near)]
            if len(near):
                found = compared(part.clusters[near], found)
        dense[idx] = 0
        return found


class Leaders:
    """Vectors of the distinct values, in rows one after the other of ``sizes`` cells, of length 1 or without cells.
    ``single`` says which values are single characters, which join their like alone."""

    def __init__(self, sizes: np.ndarray, idx: np.ndarray, w: np.ndarray, single: np.ndarray, least: float):
        self.at, self.idx, self.w = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), idx, w
        self.single, self.least = single, least
        self.dim = int(idx.max()) + 1 if len(idx) else 1
        self.dense = np.zeros(self.dim)
        known: dict[bytes, int] = {}
        self.way = np.zeros(len(sizes), dtype=np.int64)  # equal vectors have one way
        for v in range(len(sizes)):
            i, x = self.vector(v)
            self.way[v] = known.setdefault(blake2b(i.tobytes() + (np.round(x, DIGITS) + 0.0).tobytes(), digest_size=16).digest(), len(known))

    def vector(self, v: int) -> tuple[np.ndarray, np.ndarray]:
        return self.idx[self.at[v] : self.at[v + 1]], self.w[self.at[v] : self.at[v + 1]]

    def direction(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k in self.sums:
            idx, w = self.sums[k]
            norm = np.sqrt(w @ w)
            return idx, w / norm if norm > 0 else w
        return self.vector(int(self.value[k]))

    def directions(self, clusters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells of all directions one after the other, and how many each has."""
        mixed = [i for i, k in enumerate(clusters.tolist()) if k in self.sums] if self.sums else []
        v = self.value[clusters]
        starts, sizes = self.at[v], self.at[v + 1] - self.at[v]
        if not mixed:
            take = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            return self.idx[take], self.w[take], sizes
        cells = [self.direction(k) for k in clusters.tolist()]
        return np.concatenate([i for i, _ in cells]), np.concatenate([w for _, w in cells]), np.array([len(i) for i, _ in cells])

    def cosines(self, clusters: np.ndarray, dense: np.ndarray) -> np.ndarray:
        idx, w, sizes = self.directions(clusters)
        return np.round(np.add.reduceat(w * dense[idx], np.cumsum(sizes) - sizes), DIGITS)

    def fold(self, sources: np.ndarray, values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of items in order, each a source and the number of its value: the cluster of each; of each cluster its rank,
        those of the most items first, and the value that names it: the most frequent, then the shortest."""
        n = len(values)
        self.value, self.side, self.version = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int8), np.zeros(n, dtype=np.int32)
        self.sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.names: dict[int, dict[int, int]] = {}
        of, counts, way = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        own = np.full(n, -1, dtype=np.int64)  # the value of the present source that a touched cluster holds; -2: several
        alike, others = np.full(len(self.way), -1, dtype=np.int64), {}  # the first cluster of one direction, and more of it
        indexed = np.full(n, -1, dtype=np.int32)  # the version that the index of untouched clusters has
        first: dict[int, int] = {}
        old, new = _Index(self, OLD), _Index(self, NEW)
        clusters, present, turn = 0, None, 0
        seen = np.zeros(len(self.way), dtype=np.int32)
        touched: list[int] = []
        for i, (source, v) in enumerate(zip(sources.tolist(), values.tolist(), strict=True)):
            if source != present:
                self.side[touched], own[touched] = OLD, -1
                later = [k for k in touched if indexed[k] != self.version[k]]
                indexed[later] = self.version[later]
                old.waiting += later
                old.n += len(touched)
                present, touched, new, turn = source, [], _Index(self, NEW), turn + 1
            k, d, again = None, self.way[v], seen[v] == turn
            seen[v] = turn
            if self.single[v]:
                k = first.get(v)
            elif self.at[v] < self.at[v + 1]:
                if alike[d] >= 0 and way[alike[d]] != d:
                    alike[d] = next((x for x in others.get(d, []) if way[x] == d), -1)
                if alike[d] >= 0:
                    k = int(alike[d])
                elif old.n or again:
                    k = self._nearest(v, again, old, new)
                if k is not None and self.side[k] == NEW and own[k] != v:
                    k = None
            if k is None:
                k, clusters = clusters, clusters + 1
                self.value[k], self.side[k], own[k] = v, NEW, v
                if self.at[v] < self.at[v + 1]:
                    way[k] = d
                    if alike[d] < 0:
                        alike[d] = k
                    else:
                        others.setdefault(int(d), []).append(k)
                if self.single[v]:
                    first[v] = k
                touched.append(k)
                new.waiting.append(k)
                new.n += 1
            else:
                self._join(k, v, way)
                if self.side[k] == OLD:
                    self.side[k], own[k] = NEW, v
                    touched.append(k)
                    new.waiting.append(k)
                    old.n, new.n = old.n - 1, new.n + 1
                else:
                    own[k] = v if own[k] == v else -2
                    if k in self.sums:
                        new.waiting.append(k)
            counts[k] += 1
            of[i] = k
        rank = np.zeros(clusters, dtype=np.int64)
        rank[np.argsort(-counts[:clusters], kind="stable")] = np.arange(clusters)
        label = self.value[:clusters].copy()
        for k, held in self.names.items():
            label[k] = min(held, key=lambda v: (-held[v], lengths[v]))
        return of, rank, label

    def _nearest(self, v: int, again: bool, old: _Index, new: _Index) -> int | None:
        """The nearest cluster in reach; None also where it is one that the value, first in its source, can't join."""
        if old.n <= new.n:
            a = old.best(v, self.least)
            if a[1] > 0 and not again:
                return None
            b = new.best(v, max(self.least, a[0]))
        else:
            b = new.best(v, self.least)
            a = old.best(v, max(self.least, b[0]))
        found = max(a, b)
        return -found[1] if found[1] <= 0 else None

    def _join(self, k: int, v: int, way: np.ndarray) -> None:
        u = int(self.value[k])
        names = self.names.setdefault(k, {u: 1})
        if u != v and k not in self.sums:
            idx, w = self.vector(u)
            self.sums[k] = idx, w * names[u]
        names[v] = names.get(v, 0) + 1
        if way[k] != self.way[v]:
            way[k] = -1
        if k in self.sums:
            cells, place = np.unique(np.concatenate([self.sums[k][0], self.vector(v)[0]]), return_inverse=True)
            self.sums[k] = cells, np.bincount(place, np.concatenate([self.sums[k][1], self.vector(v)[1]]), len(cells))
            self.version[k] += 1  # its direction may be another now
