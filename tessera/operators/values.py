"""Value harmonization of mappings: ranges, ordinal crosswalks, enums, closed domains, identity and clustered values.

Members of mappings are rows (request_id, mapping, pos, file_key, column, concept, values, stats, type). Buckets are rows
(request_id, mapping, bucket int, name, refs array<struct<pos, column, value, lo, hi>>): ``value`` is a category as its
source writes it, ``lo`` and ``hi`` an interval. Values compare and name buckets once normalized; those of one source
never share a bucket unless they are equal then, and a source that repeats a value has a ref for each time.

All values of a source count. They are those of its member, or rows ``texts`` (request_id, pos, value) where a member has
samples alone; ``listed`` makes rows of both, which every kind of buckets takes as ``given`` instead of the members' own.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.roles import MARKER
from ..functions.scales import categories_of, ordinal_bucket, scale_domain, scale_label, scale_rank
from ..functions.text import is_obvious_alias, normalize_value
from ..functions.vectors import sparse_cosines
from ..runtime import durable, python_path
from .leaders import Leaders
from .models import Embed, text_vectors

KEY = ["request_id", "mapping"]
REFS = "array<struct<pos:int,column:string,value:string,lo:double,hi:double>>"
ENUM_LEAST, ALIAS_LEAST, CLUSTER_LEAST, DOMAIN_MOST = 0.40, 0.72, 0.55, 25


def _ref(value: Column, lo: Column, hi: Column) -> Column:
    null = F.lit(None)
    return F.struct(F.col("pos").cast("int").alias("pos"), F.col("column").alias("column"), (null if value is None else value).cast("string").alias("value"), (null if lo is None else lo).cast("double").alias("lo"), (null if hi is None else hi).cast("double").alias("hi"))


def _refs(ref: Column) -> Column:
    return F.array_sort(F.collect_list(ref)).alias("refs")


def _raw_refs() -> Column:
    """The source's own values, in the order of sources and of their values."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("pos").alias("p"), F.col("value_pos").alias("v"), _ref(F.col("raw"), None, None).alias("ref"))))
    return F.transform(listed, lambda x: x["ref"]).alias("refs")


def _ranked(buckets: DataFrame, *order: Column) -> DataFrame:
    w = Window.partitionBy(*KEY).orderBy(*order)
    return buckets.select(*KEY, (F.row_number().over(w) - 1).cast("int").alias("bucket"), "name", "refs")


def range_buckets(members: DataFrame) -> DataFrame:
    """One bucket of a mapping, named by its type, with the interval of each source (times in milliseconds)."""
    s = F.col("stats")
    lo, hi = F.coalesce(s["num_min"], s["date_min_ms"].cast("double")), F.coalesce(s["num_max"], s["date_max_ms"].cast("double"))
    kind = F.max(F.col("type"))
    out = members.groupBy(*KEY).agg(F.when(kind == "", "value").otherwise(kind).alias("name"), _refs(_ref(None, lo, hi)))
    return out.select(*KEY, F.lit(0).alias("bucket"), "name", "refs")


def scale_domains(members: DataFrame) -> DataFrame:
    domain = scale_domain(scale_label(F.col("column"), F.col("concept")), F.col("stats"))
    return members.withColumn("domain", domain)


def ordinal_crosswalk(members: DataFrame) -> DataFrame:
    """Mappings of two integer scales or more: a bucket for each category of the scale with the fewest; a source's
    categories go to them by rank, as intervals without gaps; a bucket that a source misses takes its nearest."""
    rows = scale_domains(members).withColumn("cats", F.when(F.col("domain").isNotNull(), categories_of(F.col("domain"))))
    n = F.size("cats")
    choice = F.min(F.struct(n.alias("n"), (-scale_rank(F.col("domain.kind"))).alias("r"), F.col("pos"), F.col("cats"))).alias("canon")
    whole = rows.groupBy(*KEY).agg(choice, F.count("*").alias("sources"), F.count("domain").alias("scaled"), F.sum(F.when(F.col("domain.kind") != "GENERIC", 1).otherwise(0)).alias("known"))
    whole = whole.where("sources >= 2 and scaled = sources and known > 0 and canon.n between 2 and 80").select(*KEY, F.col("canon.cats").alias("target"))
    rows = rows.join(whole, KEY).select(*KEY, "pos", "column", "cats", "target", F.posexplode("target").alias("bucket", "category"))
    index = F.sequence(F.lit(0), n - 1)
    mine = F.filter(index, lambda j: ordinal_bucket(j, n, F.size("target")) == F.col("bucket"))
    nearest = F.floor(F.col("bucket") * (n - 1) / (F.size("target") - 1) + 0.5).cast("int")
    mine = F.when(F.size(mine) > 0, mine).otherwise(F.array(nearest))
    lo = F.get("cats", F.array_min(mine))
    last = F.get("cats", F.array_max(mine))
    hi = F.greatest(last, F.coalesce(F.get("cats", F.array_max(mine) + 1) - 1, last))
    out = rows.groupBy(*KEY, "bucket", "category").agg(_refs(_ref(None, lo, hi)))
    return out.select(*KEY, "bucket", F.col("category").cast("string").alias("name"), "refs")


def listed(members: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """All values of the members, a row (request_id, mapping, pos, file_key, column, value_pos, raw) each time. Those of
    ``texts`` have no place of their own in a source: they stand in the order of their letters."""
    own = members if texts is None else members.join(texts.select("request_id", "pos").distinct(), ["request_id", "pos"], "left_anti")
    rows = own.select(*KEY, "pos", "file_key", "column", F.posexplode("values").alias("value_pos", "raw"))
    if texts is None:
        return rows
    named = members.select(*KEY, "pos", "file_key", "column")
    return rows.unionByName(texts.join(named, ["request_id", "pos"]).select(*KEY, "pos", "file_key", "column", F.lit(0).alias("value_pos"), F.col("value").alias("raw")))


def _values(members: DataFrame, given: DataFrame | None, markers_out: bool) -> DataFrame:
    """The values of each source: as they are (raw) and normalized (nv), without blank ones."""
    rows = (listed(members) if given is None else given).select(*KEY, "pos", "file_key", "column", "value_pos", "raw")
    nv = normalize_value(F.col("raw"))
    return rows.withColumn("nv", F.when(F.lower(F.trim("raw")).rlike(MARKER), "").otherwise(nv) if markers_out else nv).where("nv <> ''")


def enum_buckets(members: DataFrame, enums: DataFrame, embed: Embed | None = None, given: DataFrame | None = None) -> DataFrame:
    """Each value goes to the nearest enum value by hashed vectors; ``enums`` are rows (request_id, mapping, enum_pos,
    enum). Buckets without values are left out."""
    values = _values(members, given, False)
    left = text_vectors(values.select(*KEY, "nv").distinct().withColumn("v", F.array("nv")), [*KEY, "nv"], "v", embed)
    right = text_vectors(enums.withColumn("v", F.array("enum")), [*KEY, "enum_pos", "enum"], "v", embed).withColumnRenamed("w", "we")
    sims = left.join(right, [*KEY, "idx"]).groupBy(*KEY, "nv", "enum_pos", "enum").agg(F.sum(F.col("w") * F.col("we")).alias("sim")).where(F.col("sim") >= ENUM_LEAST)
    best = sims.groupBy(*KEY, "nv").agg(F.min(F.struct(-F.round("sim", 9), F.col("enum_pos"), F.col("enum"))).alias("b")).select(*KEY, "nv", "b.enum_pos", "b.enum")
    out = values.join(best, [*KEY, "nv"]).groupBy(*KEY, "enum_pos", "enum").agg(_raw_refs())
    return out.select(*KEY, F.col("enum_pos").alias("bucket"), F.col("enum").alias("name"), "refs")


def identity_buckets(members: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """A bucket for each distinct value, of mappings with 2 to 25 of them, the most frequent first."""
    values = _values(members, given, True)
    out = values.groupBy(*KEY, F.col("nv").alias("name")).agg(_raw_refs())
    sizes = values.groupBy(*KEY).agg(F.countDistinct("nv").alias("n")).where(F.col("n").between(2, DOMAIN_MOST)).select(*KEY)
    return _ranked(out.join(sizes, KEY), F.size("refs").desc(), F.col("name"))


def _closed(members: DataFrame, given: DataFrame | None) -> DataFrame:
    """The values of closed domains: of mappings with 2 to 25 of them."""
    values = _values(members, given, False)
    few = values.groupBy(*KEY).agg(F.countDistinct("nv").alias("n")).where(F.col("n").between(2, DOMAIN_MOST))
    return values.join(few.select(*KEY), KEY, "left_semi")


def closed_domain_edges(members: DataFrame, embed: Embed | None = None, given: DataFrame | None = None) -> DataFrame:
    """(request_id, mapping, a, b): pairs of values of closed domains that are aliases or near, never of one source."""
    values = _closed(members, given)
    tokens = values.groupBy(*KEY, F.col("nv").alias("t")).agg(F.collect_set("pos").alias("sources"))
    a = tokens.select(*KEY, F.col("t").alias("a"), F.col("sources").alias("sa"))
    b = tokens.select(*KEY, F.col("t").alias("b"), F.col("sources").alias("sb"))
    pairs = a.join(b, KEY).where("a < b").where(~F.arrays_overlap("sa", "sb"))  # at most 25 values a mapping
    near = sparse_cosines(text_vectors(tokens.withColumn("v", F.array("t")), [*KEY, "t"], "v", embed), "t", KEY)
    pairs = pairs.join(near, [*KEY, "a", "b"], "left")
    close = (F.least(F.length("a"), F.length("b")) >= 3) & (F.coalesce("cosine", F.lit(0.0)) >= ALIAS_LEAST)
    return pairs.where(is_obvious_alias(F.col("a"), F.col("b")) | close).select(*KEY, "a", "b")


def closed_domain_components(members: DataFrame, embed: Embed | None = None, given: DataFrame | None = None) -> DataFrame:
    """(request_id, mapping, t, root): values of closed domains with the smallest value they are linked to. A domain has
    25 values at most, so its links are merged within a row: each gives all values of both ends the smaller root."""
    tokens = _closed(members, given).groupBy(*KEY).agg(F.array_sort(F.collect_set("nv")).alias("t"))
    edges = closed_domain_edges(members, embed, given).groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("edges"))
    rows = tokens.join(edges, KEY, "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<a:string,b:string>>")))

    def merge(roots: Column, edge: Column) -> Column:
        a, b = (F.element_at(roots, F.array_position("t", edge[end]).cast("int")) for end in "ab")
        return F.transform(roots, lambda r: F.when((r == a) | (r == b), F.least(a, b)).otherwise(r))

    rows = rows.withColumn("roots", F.aggregate("edges", F.col("t"), merge))
    return rows.select(*KEY, F.inline(F.arrays_zip("t", F.col("roots").alias("root"))))


def closed_domain_buckets(members: DataFrame, embed: Embed | None = None, given: DataFrame | None = None) -> DataFrame:
    """Components as buckets, named by their best value (frequent, then long, single characters last). They stand where
    the sources lie in two files or more, and two buckets or more have two refs or more."""
    values = _closed(members, given)
    placed = values.join(closed_domain_components(members, embed, given).withColumnRenamed("t", "nv"), [*KEY, "nv"])
    often = placed.groupBy(*KEY, "root", "nv").agg(F.count("*").alias("f"))
    merit = F.col("f") * 100 + F.least(F.length("nv"), F.lit(30)) - F.when(F.length("nv") == 1, 500).otherwise(0)
    names = often.groupBy(*KEY, "root").agg(F.min(F.struct((-merit).alias("k"), F.lower("nv").alias("l"), F.col("nv"))).alias("b")).select(*KEY, "root", F.col("b.nv").alias("name"))
    out = placed.groupBy(*KEY, "root").agg(_raw_refs()).where("size(refs) >= 2").join(names, [*KEY, "root"])
    files = members.groupBy(*KEY).agg(F.countDistinct("file_key").alias("n")).where("n >= 2").select(*KEY)
    enough = out.groupBy(*KEY).agg(F.count("*").alias("n")).where("n >= 2").select(*KEY)
    return _ranked(out.join(files, KEY).join(enough, KEY), F.size("refs").desc(), F.col("name"))


_PLACED = pa.schema([("i", pa.int64()), ("pos", pa.int32()), ("column", pa.string()), ("raw", pa.string()), ("bucket", pa.int32()), ("name", pa.string())])


def clustered_buckets(members: DataFrame, embed: Embed | None = None, given: DataFrame | None = None) -> DataFrame:
    """Leader clusters of all values, in order: a value joins the nearest cluster that reaches the threshold unless that
    one holds another value of its source; single characters join their like only. Sequential by definition, so a
    mapping is folded in one task (operators.leaders), which gets vectors of its distinct values and gives each value its
    bucket; refs are gathered by bucket."""
    python_path(members.sparkSession)
    values = _values(members, given, False)
    vectors = text_vectors(values.select(*KEY, "nv").distinct().withColumn("v", F.array("nv")), [*KEY, "nv"], "v", embed)
    cells = vectors.groupBy(*KEY, "nv").agg(F.array_sort(F.collect_list(F.struct("idx", "w"))).alias("cells"))
    cells = cells.select(*(F.col(c).alias(f"of_{c}") for c in KEY), F.col("nv").alias("known"), "cells")
    kind = members.schema["mapping"].dataType.simpleString()

    def run(key: tuple[pa.Scalar, ...], items: pa.Table, known: pa.Table) -> pa.Table:
        items = items.sort_by([("pos", "ascending"), ("value_pos", "ascending"), ("raw", "ascending")]).combine_chunks()
        nv = items["nv"].combine_chunks().dictionary_encode()
        names = nv.dictionary
        at = pc.index_in(names, value_set=known["known"].combine_chunks())
        lists = known["cells"].combine_chunks().take(at)
        sizes, flat = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), pc.list_flatten(lists)
        single = pc.equal(pc.utf8_length(names), 1).to_numpy(zero_copy_only=False)
        found = Leaders(sizes, pc.struct_field(flat, "idx").to_numpy(), pc.struct_field(flat, "w").to_numpy(), single, CLUSTER_LEAST)
        of, rank, label = found.fold(items["pos"].to_numpy(), nv.indices.to_numpy(), pc.utf8_length(names).to_numpy())
        n = items.num_rows
        columns = [pa.array(range(n), pa.int64()), items["pos"].cast(pa.int32()), items["column"], items["raw"], pa.array(rank[of], pa.int32()), names.take(pa.array(label[of]))]
        table = pa.Table.from_arrays(columns, schema=_PLACED)
        for place, (name, scalar) in enumerate(zip(KEY, key, strict=True)):
            table = table.add_column(place, name, pa.repeat(scalar, n))
        return table

    rows = values.select(*KEY, "pos", "column", "value_pos", "raw", "nv")
    placed = rows.groupBy(*KEY).cogroup(cells.groupBy(*(f"of_{c}" for c in KEY))).applyInArrow(run, f"request_id string, mapping {kind}, i long, pos int, column string, raw string, bucket int, name string")
    refs = F.array_sort(F.collect_list(F.struct("i", _ref(F.col("raw"), None, None).alias("ref"))))
    return placed.groupBy(*KEY, "bucket", "name").agg(F.transform(refs, lambda x: x["ref"]).alias("refs"))


def harmonized(members: DataFrame, enums: DataFrame | None = None, embed: Embed | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Buckets of all mappings with their kind.

    Types and sizes of domains say which kinds a mapping may get: dates a range; numbers an ordinal crosswalk, else a
    range; categories what their enum gives, else their closed domain, else their identity (2 to 25 values) or clusters,
    else a range. Kinds that may apply are built side by side, and each mapping keeps the first that gave buckets."""
    given = listed(members, texts)
    sizes = _values(members, given, True).groupBy(*KEY).agg(F.countDistinct("nv").alias("domain"))
    typed = durable(members.groupBy(*KEY).agg(F.max("type").alias("mapping_type")).join(sizes, KEY, "left"))
    rows, given = durable(members.join(typed, KEY)), durable(given.join(typed, KEY))
    numeric = F.col("mapping_type").isin("integer", "number", "double", "float", "long")
    date = F.col("mapping_type").isin("date", "datetime")
    small = F.coalesce(F.col("domain").between(2, DOMAIN_MOST), F.lit(False))
    plain = ~numeric & ~date | F.col("mapping_type").isNull()
    of = lambda which: {"members": rows.where(which), "given": given.where(which)}
    kinds = [("range", range_buckets(rows.where(date | numeric)), 9), ("ordinal", ordinal_crosswalk(rows.where(numeric)), 0)]
    if enums is not None:
        kinds.append(("enum", enum_buckets(enums=enums, embed=embed, **of(plain)), 0))
    kinds += [
        ("closed", closed_domain_buckets(embed=embed, **of(plain)), 1), ("identity", identity_buckets(**of(plain & small)), 2),
        ("clustered", clustered_buckets(embed=embed, **of(plain & ~small)), 3), ("fallback", range_buckets(rows.where(plain)), 9),
    ]
    every = durable(reduce(DataFrame.unionByName, (b.withColumns({"kind": F.lit(kind), "turn": F.lit(turn)}) for kind, b, turn in kinds)))
    first = every.groupBy(*KEY).agg(F.min("turn").alias("turn"))
    return every.join(first, [*KEY, "turn"], "left_semi").drop("turn")
