"""N-gram Jaccard self-join with prefix filters under several global token orders.

Every set keeps the shingles it shares with another set; the others can't meet. The first order sorts a set by the
document frequency of its shingles among distinct sets; each further one has the shingles that no other set holds first
and the rest by a hash of its own. For a pair of sizes n and m that overlaps in need = ceil(t / (1 + t) * (n + m))
shingles, both prefixes of the first n - need + 1 and m - need + 1 shingles have a common one under *every* order. The
first order has the shortest lists and gives the candidates; a candidate is compared on its short prefixes under all
other orders before any set is fetched, and only what meets under every order is verified exactly.

1. Texts that several rows hold are found by digest (partial aggregation first); one representative each goes on. The
   digests go to every task while they are few, so that texts aren't shuffled; beyond that they are joined.
2. Shingle hashes go to buckets in packed rows, by hash; a bucket finds the df of its shingles. The number of buckets
   grows with the corpus, so that a bucket's size doesn't (up to MOST_BUCKETS, 2 TB of text at BUCKET_BYTES each).
3. The shared shingles go back to their set, which becomes (size, shared shingles, prefix entries, prefixes under the
   other orders) - most sets have no entry left, as their prefixes hold nothing that is shared.
4. Each prefix list names its most central set as hub, and members meet hubs only. What is linked then needs no
   further comparison, so a group of near copies costs as many pairs as it has members. Lists of shingles that very
   many sets hold are joined to their hub in every task (``hot_join``).
5. Lists that still hold more than one component are joined for pairs across components. The smaller set of a pair
   must have the shingle so early that a set of its own size could still reach the similarity. Documents that share a
   template but not enough of it have it later, so such a list has no smaller side and gives no pairs at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import durable, python_path
from .components import connected_components
from .hot import hot_join, repeated, unused
from .shingles import U64, mix, shingle_set

_PACKED = "bucket int, ids binary, sizes binary, counts binary, tokens binary"
_SHARED = "part int, ids binary, sizes binary, counts binary, tokens binary, dfs binary"
_SETS = "id long, n long, centre long, tokens binary, marks binary, entries array<struct<token:long,cap:long>>"
BUCKET_BYTES = 32 << 20  # of text
MOST_BUCKETS = 1 << 16
SENT = 200_000  # most repeated digests to send to every task, some 50 bytes each
_LOW = 6  # bytes of a hash that travel; the bucket number adds the rest


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    entry = pa.list_(pa.struct([("token", pa.int64()), ("cap", pa.int64())]))
    fields = [x.strip().split(" ", 1) for x in schema.replace("array<struct<token:long,cap:long>>", "entries").split(", ")]
    return pa.schema([(name, entry if kind == "entries" else kinds[kind]) for name, kind in fields])


def _pack(nb: int, width: int):
    schema = _arrow(_PACKED)
    limit = min(8_000_000, max(1_000_000, 4096 * nb))

    def flush(ids: list, sets: list) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets], dtype=np.uint32)
        doc = np.array(ids, dtype=np.int64)
        tok = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        own = np.repeat(np.arange(len(sets)), sizes)
        bucket = (((tok >> U64(32)) * U64(nb)) >> U64(32)).astype(np.int32)
        home = (mix(doc.astype(np.uint64)) % U64(nb)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        tok, own, bucket = tok[order], own[order], bucket[order]
        edge = np.searchsorted(bucket, np.arange(nb + 1))
        low = tok.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_LOW]
        at_home = np.argsort(home, kind="stable")
        home_edge = np.searchsorted(home[at_home], np.arange(nb + 1))
        rows = []
        for b in range(nb):
            s, e = edge[b], edge[b + 1]
            counts = np.bincount(own[s:e], minlength=len(sets)).astype(np.uint32)
            keep = counts > 0
            keep[at_home[home_edge[b] : home_edge[b + 1]]] = True
            if keep.any():
                rows.append((b, doc[keep].tobytes(), sizes[keep].tobytes(), counts[keep].tobytes(), low[s:e].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, held = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(i.as_py())
                sets.append(shingle_set(text.as_py(), width))
                held += len(sets[-1])
                if held >= limit:
                    yield flush(ids, sets)
                    ids, sets, held = [], [], 0
        if ids:
            yield flush(ids, sets)

    return run


def _join(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


def _frequencies(parts: int):
    schema = _arrow(_SHARED)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        ids, sizes, counts = (_join(table[c], t) for c, t in (("ids", np.int64), ("sizes", np.uint32), ("counts", np.uint32)))
        low = _join(table["tokens"], np.uint8).reshape(-1, _LOW)
        tok = np.zeros((len(low), 8), dtype=np.uint8)
        tok[:, :_LOW] = low
        tok = tok.view("<u8").ravel()
        own = np.repeat(np.arange(len(ids)), counts)
        order = np.argsort(tok)
        tok, own = tok[order], own[order]
        start = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])) if len(tok) else np.empty(0, np.int64)
        df = np.repeat(np.diff(np.append(start, len(tok))), np.diff(np.append(start, len(tok))))
        tok, own, df = tok[df > 1], own[df > 1], df[df > 1].astype(np.uint32)
        tok = mix(tok ^ mix(np.full(1, bucket + 1, np.uint64)))
        shared = np.bincount(own, minlength=len(ids)).astype(np.uint32)
        nb = parts
        keep = (shared > 0) | ((mix(ids.astype(np.uint64)) % U64(nb)).astype(np.int64) == bucket)
        part = (mix(ids.astype(np.uint64) ^ U64(0x5BD1E995)) % U64(nb)).astype(np.int64)
        order = np.lexsort((own, part[own]))
        tok, own, df = tok[order], own[order], df[order]
        edge = np.searchsorted(part[own], np.arange(nb + 1))
        docs = np.flatnonzero(keep)
        docs = docs[np.argsort(part[docs], kind="stable")]
        doc_edge = np.searchsorted(part[docs], np.arange(nb + 1))
        rows = []
        for p in range(nb):
            d = docs[doc_edge[p] : doc_edge[p + 1]]
            if len(d):
                s, e = edge[p], edge[p + 1]
                rows.append((p, ids[d].tobytes(), sizes[d].tobytes(), shared[d].tobytes(), tok[s:e].tobytes(), df[s:e].tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    return run


def _prefixes(percent: int, orders: int):
    schema = _arrow(_SETS)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, sizes, counts = (_join(table[c], t) for c, t in (("ids", np.int64), ("sizes", np.uint32), ("counts", np.uint32)))
        tok, df = _join(table["tokens"], np.uint64), _join(table["dfs"], np.uint32)
        uniq, first, inv = np.unique(ids, return_index=True, return_inverse=True)
        n = sizes[first].astype(np.int64)
        own = np.repeat(inv, counts)
        shared = np.bincount(own, minlength=len(uniq)).astype(np.int64)
        prefix = n - (percent * n + 99) // 100 + 1
        alive = (n > 0) & (n - shared < prefix)
        sel = alive[own]
        tok, df, own = tok[sel], df[sel].astype(np.int64), own[sel]
        order = np.lexsort((tok, own))
        tok, df, own = tok[order], df[order], own[order]
        edge = np.searchsorted(own, np.arange(len(uniq) + 1))
        tokens: list = [None] * len(uniq)
        marks: list = [None] * len(uniq)
        entries: list = [None] * len(uniq)
        for i in np.flatnonzero(alive):
            t, d, size = tok[edge[i] : edge[i + 1]], df[edge[i] : edge[i + 1]], int(n[i])
            alone = size - len(t)
            pos = np.arange(alone, int(prefix[i]))[: len(t)]
            cap = (size - pos) * (100 + percent) // percent - size
            pos = pos[cap >= (percent * size + 99) // 100]
            cap = cap[: len(pos)].tolist()
            if pos.size:
                tokens[i] = t.tobytes()
                first = t[np.lexsort((t, d))[: len(pos)]]
                entries[i] = [{"token": x, "cap": c} for x, c in zip(first.view(np.int64).tolist(), cap, strict=True)]
                others = [t[np.argsort(mix(t + U64(k * 0x9E3779B97F4A7C15 % 2**64)), kind="stable")[: len(pos)]] for k in range(1, orders)]
                marks[i] = b"".join([np.sort(x).tobytes() for x in others])
        centre = np.where(n > 0, (n - shared) * 1000 // np.maximum(n, 1), 0)
        return pa.table([pa.array(c, t) for c, t in zip((uniq, n, centre, tokens, marks, entries), schema.types, strict=True)], schema=schema)

    return run


def _verify(percent: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, nu, nv, tu, tv = (c.to_pylist() for c in batch.columns)
            hit = []
            for i in range(len(u)):
                both = len(np.intersect1d(np.frombuffer(tu[i], np.uint64), np.frombuffer(tv[i], np.uint64), assume_unique=True))
                if 100 * both >= percent * (nu[i] + nv[i] - both):
                    hit.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([u[i] for i in hit], pa.int64()), pa.array([v[i] for i in hit], pa.int64())], schema=schema)

    return run


def _meet(others: int):
    """Pairs whose prefixes have a common shingle under each of the other orders."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, mu, mv = (c.to_pylist() for c in batch.columns)
            hit = []
            for i in range(len(u)):
                a, b = (np.frombuffer(m[i], np.uint64).reshape(others, -1) for m in (mu, mv))
                if all(len(np.intersect1d(a[k], b[k], assume_unique=True)) for k in range(others)):
                    hit.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([u[i] for i in hit], pa.int64()), pa.array([v[i] for i in hit], pa.int64())], schema=schema)

    return run


def _ends(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    u, v = (sets.select(F.col("id").alias(x), *(F.col(c).alias(c + x) for c in columns)) for x in "uv")
    return pairs.join(u, "u").join(v, "v").select("u", "v", *(c + x for c in columns for x in "uv"))


def candidates(pairs: DataFrame, sets: DataFrame, orders: int) -> DataFrame:
    """``pairs`` (u, v) of sets that meet under the first order to those that meet under all."""
    return _ends(pairs, sets, "marks").mapInArrow(_meet(orders - 1), "u long, v long") if orders > 1 else pairs


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, orders: int) -> DataFrame:
    return _ends(candidates(pairs, sets, orders), sets, "n", "tokens").mapInArrow(_verify(percent), "u long, v long")


def shingle_sets(texts: DataFrame, width: int, percent: int, orders: int, n_bytes: int) -> DataFrame:
    """(id, text) with distinct ids to (id, n, centre, tokens, marks, entries): a set's size, and what of it can meet
    others."""
    spark = python_path(texts.sparkSession)
    nb = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, n_bytes // BUCKET_BYTES))
    packed = texts.mapInArrow(_pack(nb, width), _PACKED)
    shared = packed.groupBy("bucket").applyInArrow(_frequencies(nb), _SHARED)
    return shared.groupBy("part").applyInArrow(_prefixes(percent, orders), _SETS)


def hub_pairs(alive: DataFrame) -> DataFrame:
    """(u, v) of the members of each list and its hub, where sizes and positions allow a link."""
    lists = alive.select("id", "n", "centre", F.inline("entries"))
    hub = F.min(F.struct("centre", F.col("id").alias("id"), F.col("n").alias("n"), F.col("cap").alias("cap"))).alias("hub")
    hubs = durable(lists.groupBy("token").agg(hub, F.count("*").alias("many")).where("many > 1"))
    met = hot_join(lists, hubs, "token", "many").where("id <> hub.id and n <= hub.cap and hub.n <= cap")
    return met.select(F.least("id", "hub.id").alias("u"), F.greatest("id", "hub.id").alias("v")).distinct()


def bridge_pairs(alive: DataFrame, near: DataFrame) -> DataFrame:
    """(u, v, cu, cv) of sets of different components that meet in a list, where sizes and positions allow a link."""
    placed = alive.select("id", "n", "entries").join(near, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"), F.inline("entries"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("many"))
    mixed = durable(mixed.where("lo <> hi").select("token", "many"))
    placed = durable(hot_join(placed, mixed, "token", "many", "left_semi"))
    small, large = (placed.select("token", *(F.col(c).alias(c + x) for c in ("id", "n", "cap", "component"))) for x in "uv")
    met = small.where("capu >= nu").join(large, "token").where("componentu <> componentv and nu <= nv and nv <= capu and nu <= capv and (nu < nv or idu < idv)")
    return met.select(F.col("idu").alias("u"), F.col("idv").alias("v"), F.col("componentu").alias("cu"), F.col("componentv").alias("cv")).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5, orders: int = 3, sent: int = SENT) -> DataFrame:
    """Link documents whose ``width``-word shingle sets satisfy 100 * |A & B| >= percent * |A | B|.

    Returns (``id_col`` long, n_shingles long, component_id long, representative long): a row for each input row.
    ``component_id`` is the smallest id reachable by links, itself included; ``representative`` the smallest id with
    the very same text. Nulls: a null text counts as empty, a row with a null id is left out. A text without words has
    no shingles and links with nothing, so equal empty texts stay apart. Repeated rows come back as often as they
    occur; an id that repeats with other texts is a document for each text. Ties go to the smaller id. Very long texts
    are taken whole; a text is held in one task. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.sha2(F.col("text"), 256)))
    again = durable(rows.select("id", "key").groupBy("id").agg(F.count("*").alias("c"), F.min("key").alias("lo"), F.max("key").alias("hi")).where("c > 1"))
    twice, other = again.agg(F.count("*"), F.count_if(F.col("lo") != F.col("hi"))).first()
    if other:  # every text of an id that has several gets a name of its own
        several = again.where("lo <> hi").select("id", F.lit(True).alias("several"))
        rows = rows.join(several, "id", "left").select(F.when(F.col("several"), F.xxhash64("id", "key")).otherwise(F.col("id")).alias("name"), "id", "text", "key")
    else:
        rows = rows.select(F.col("id").alias("name"), "id", "text", "key")
    copies = repeated(rows.select("key", "name"), "key", "name")
    few = copies.count() <= sent

    def with_first(df: DataFrame) -> DataFrame:
        found = F.broadcast(copies) if few else copies  # ``sent`` rows at most
        return df.join(found, "key", "left").withColumn("first", F.coalesce("first", "name"))

    texts = with_first(rows).where("name = first").select(F.col("name").alias("id"), "text")
    if twice:
        texts = texts.dropDuplicates(["id"])
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    sets = durable(shingle_sets(texts, width, percent, orders, n_bytes))
    alive = sets.where("tokens is not null")
    near = durable(connected_components(_verified(hub_pairs(alive), alive, percent, orders)))
    pairs = durable(bridge_pairs(alive, near))
    found = _verified(pairs.select("u", "v"), alive, percent, orders)
    bridges = pairs.join(found.distinct(), ["u", "v"])
    joined = durable(connected_components(bridges.select(F.col("cu").alias("u"), F.col("cv").alias("v"))))

    final = near.join(joined.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left").select("id", F.coalesce("root", "component").alias("root"))
    single = joined.select("id", F.col("component").alias("root")).join(near.select("id"), "id", "left_anti")
    of_set = sets.select("id", F.col("n").alias("size")).join(final.unionByName(single), "id", "left").select(F.col("id").alias("first"), "size", F.coalesce("root", "id").alias("root"))
    of_set = durable(of_set.join(copies.groupBy("first").agg(F.sum("n").alias("n")), "first", "left").withColumn("n", F.coalesce("n", F.lit(1))))
    out = hot_join(with_first(rows.select("id", "name", "key")).drop("n"), of_set, "first")
    if other:
        ids = out.groupBy("root").agg(F.min("id").alias("lowest"), F.count("*").alias("n"))
        least = out.groupBy("first").agg(F.min("id").alias("copy"), F.count("*").alias("n"))
        out = hot_join(hot_join(out, durable(ids), "root"), durable(least), "first").drop("root", "first").withColumnsRenamed({"lowest": "root", "copy": "first"})
    full = F.col("size") > 0
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(full, F.col("root")).otherwise(F.col("id")).alias("component_id"), F.when(full, F.col("first")).otherwise(F.col("id")).alias("representative"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with one document of each component, that with the smallest id; all columns stay.
    Of rows that repeat an id all are kept or none; rows with a null id stay."""
    linked = jaccard_components(docs, id_col, text_col, **options)
    (gone,) = unused(docs, "gone")
    out = linked.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone)).distinct()
    return docs.join(out, docs[id_col] == out[gone], "left_anti")
