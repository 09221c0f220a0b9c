"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Emails, IP addresses, payment cards and phone numbers that match a pattern and its test are the seeds. Candidates are
what only looks like an identifier: numbers in groups, tokens with digits, addresses that are spelled out (name at host
dot com). The words around seeds and candidates, with their punctuation, are lexical patterns: the word before, two
words before, the word after, and one on each side. Patterns and distinct values form a graph that is scored in rounds:

* a value's score for a kind is 1 for its seeds, 0 for other seeds, and for a candidate the best confidence of a pattern
  that holds it, where its shape allows the kind (an email isn't all digits, a card has 12 to 19 of them);
* a pattern's confidence for a kind is the lower end of the 95 % interval (Wilson) of the share of that kind among the
  scored values it holds. Candidates without a score count neither way, but the scored ones must be a documented share
  of all that it could reach, and their scores must add up to a documented number.

Candidates that a pattern of enough confidence holds score in the next round, so that patterns that few seeds support
are found through them; after the last round they become spans of their kind.

Matches are located by cutting the text at them: the lengths of the gaps and matches add up to code-point positions.
The regular expressions start at the edge of a run and don't give back what they took, so they are linear in the text.
Candidates that overlap a seed are told by two running extremes over a text's spans in order. Spans depend on the text
alone: the graph is built on distinct texts, and values, contexts and copies that are in very many rows are joined
apart from the rest (``hot_join``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import durable
from .hot import hot_join, unused

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
_PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_CANDIDATE = "|".join(
    (
        rf"(?<![{_LOCAL}])[{_LOCAL}]++(?: ?[\[(]at[\])] ?| at )[A-Za-z0-9-]++(?:(?: ?[\[(]dot[\])] ?| dot )[A-Za-z0-9-]++)++",
        r"(?<![A-Za-z0-9.@+-])\(?[0-9](?:[ ().-]{0,2}+[0-9])++(?![A-Za-z0-9@])",
        r"(?<![A-Za-z0-9._@+-])[A-Za-z._@+-]*+[0-9][A-Za-z0-9._@+-]*+",
    )
)
# What a candidate must look like to be of a kind.
_SHAPES = {
    "email": lambda v: v.rlike(r"@|[ )\]]at[ (\[]|[(\[]at[)\]]"),
    "ip": lambda v: v.rlike(r"^[0-9]{1,3}(?:[ .-]{1,2}[0-9]{1,3}){3}$"),
    "card": lambda v: ~v.rlike("[A-Za-z]") & F.length(_digits(v)).between(12, 19),
    "phone": lambda v: ~v.rlike("[A-Za-z]") & F.length(_digits(v)).between(7, 15),
}
_SPAN = "array<struct<s:int,k:int,e:int,v:string,l:string,r:string>>"
_BLOCK = 256  # matches whose positions are summed at a time
_FEW = 100_000  # most rows to send to every task, some 60 bytes each
_NEAR = 200  # characters of a context; a word that reaches beyond them is no part of a pattern


@dataclass(frozen=True)
class Settings:
    rounds: int = 3
    confidence: float = 0.65  # eight seeds of one kind and none of another are enough
    seeds: float = 5.0  # least sum of scores
    share: float = 0.05  # least share of scored values among all that have a shape of the kind
    digits: int = 5  # least digits of a candidate that isn't spelled out


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once a row; an expression used inside a lambda runs at each of its calls."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(steps: Column) -> Column:
    """Running totals of an array that isn't empty, by blocks: appending to one array copies it each time."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int")), lambda b: F.slice(steps, b * _BLOCK + 1, _BLOCK))
    add = lambda out, x: F.concat(out, F.array(F.element_at(out, -1) + x))
    sums = F.transform(blocks, lambda block: F.aggregate(block, F.array(F.lit(0)), add))

    def shifted(sums: Column) -> Column:
        before = F.aggregate(sums, F.array(F.lit(0)), lambda out, p: F.concat(out, F.array(F.element_at(out, -1) + F.element_at(p, -1))))
        return _bound(before, lambda at: F.flatten(F.transform(sums, lambda p, b: F.transform(F.slice(p, 2, _BLOCK), lambda x: x + F.get(at, b)))))

    return _bound(sums, shifted)


def _located(text: Column, regex: str, kind: int, gate: Column) -> Column:
    """Spans of all matches, leftmost and without overlap, with the text before and after each."""
    cut = F.struct(F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("found"), F.split(text, regex, -1).alias("gaps"))

    def spans(m: Column) -> Column:
        found, gaps = m["found"], m["gaps"]
        steps = F.transform(found, lambda v, i: F.length(v) + F.length(F.get(gaps, i)))
        at = lambda array, i: F.coalesce(F.get(array, i), F.lit(""))
        left = lambda i: F.right(F.concat(F.right(at(gaps, i - 1), F.lit(_NEAR)), at(found, i - 1), F.get(gaps, i)), F.lit(_NEAR))
        right = lambda i: F.left(F.concat(F.get(gaps, i + 1), at(found, i + 1), F.left(at(gaps, i + 2), F.lit(_NEAR))), F.lit(_NEAR))
        return _bound(
            _bound(steps, _running),
            lambda ends: F.transform(
                found,
                lambda v, i: F.struct((F.get(ends, i) - F.length(v)).alias("s"), F.lit(kind).alias("k"), F.get(ends, i).alias("e"), v.alias("v"), left(i).alias("l"), right(i).alias("r")),
            ),
        )

    return F.when(gate, _bound(cut, lambda m: F.when(F.size(m["found"]) > 0, spans(m))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str):
    def test(span: Column) -> Column:
        v, n = span["v"], F.length(_digits(span["v"]))
        if kind == "ip":
            return F.forall(F.split(v, "[.]"), lambda x: F.coalesce(x.try_cast("int"), F.lit(256)) <= 255)
        if kind == "card":
            return n.between(14, 19) & F.call_function("luhn_check", _digits(v))
        return n.between(10, 15) if kind == "phone" else F.lit(True)

    return test


def base_spans(text: Column) -> Column:
    """The seeds of a text that isn't null, by start and then kind."""
    gates = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[ -]?[0-9]){13}"), "phone": text.contains("+")}
    none = F.array().cast(_SPAN)
    found = [F.coalesce(F.filter(_located(text, _PATTERNS[k], i, gates[k]), _valid(k)), none) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*found))


def _candidates(text: Column, digits: int) -> Column:
    found = _located(text, _CANDIDATE, len(KINDS), text.rlike(r"[0-9]|[ )\]]dot[ (\[]|[(\[]dot[)\]]"))
    return F.coalesce(F.filter(found, lambda c: (F.length(_digits(c["v"])) >= digits) | _SHAPES["email"](c["v"])), F.array().cast(_SPAN))


def _contexts(span: Column) -> Column:
    def words(near: Column) -> Column:
        return F.split(F.regexp_replace(F.lower(near), "[0-9]", "0"), r"\s+")

    # Of a context that is full, the word at its far end may be cut; a context of one word more than are taken is whole.
    before = F.when(F.length(span["l"]) < _NEAR, span["l"]).otherwise(F.regexp_replace(span["l"], r"^\S+", ""))
    after = F.when(F.length(span["r"]) < _NEAR, span["r"]).otherwise(F.regexp_replace(span["r"], r"\S+$", ""))
    some = lambda words: F.filter(words, lambda x: x != "")
    b, a = some(words(before)), some(words(after))
    one, two, nxt = F.get(b, F.size(b) - 1), F.get(b, F.size(b) - 2), F.get(a, F.lit(0))
    glue = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    every = F.array(glue("1 ", one, " _"), glue("2 ", two, " ", one, " _"), glue("3 _ ", nxt), glue("4 ", one, " _ ", nxt))
    return F.filter(every, lambda x: x.isNotNull())


def _apart(texts: DataFrame) -> DataFrame:
    """(digest, s, k, e, v, l, r): seeds, and the candidates that overlap none, of (digest, base, candidates)."""
    spans = texts.select("digest", F.explode(F.concat("base", "candidates")).alias("x")).select("digest", "x.*")
    seed = F.col("k") < len(KINDS)
    up, down = (Window.partitionBy("digest").orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("s"), F.desc("s")))
    spans = spans.withColumn("ended", F.max(F.when(seed, F.col("e"))).over(up)).withColumn("begins", F.min(F.when(seed, F.col("s"))).over(down))
    clear = (F.coalesce("ended", F.lit(0)) <= F.col("s")) & (F.coalesce("begins", F.col("e")) >= F.col("e"))
    return spans.where(seed | clear).drop("ended", "begins")


def _lower(part: Column, whole: Column) -> Column:
    """Lower end of the 95 % interval of a share, by Wilson."""
    z, p = 1.96, part / whole
    return (p + z * z / (2 * whole) - z * F.sqrt(p * (1 - p) / whole + z * z / (4 * whole * whole))) / (1 + z * z / whole)


def _scored_patterns(edges: DataFrame, values: DataFrame, least: Settings) -> DataFrame:
    """(p, c0, ..., n) of the patterns that are confident of a kind; n counts their edges."""
    each, kinds = [], range(len(KINDS))
    for i in kinds:
        other = F.greatest(*(F.col(f"s{j}") for j in kinds if j != i), F.lit(0.0))
        each += [F.sum(f"s{i}").alias(f"p{i}"), F.sum(F.when(F.col(f"s{i}") >= other, 0.0).otherwise(other)).alias(f"o{i}")]
        each.append(F.count_if(F.col(f"f{i}")).alias(f"a{i}"))
    held = hot_join(edges, values.withColumnRenamed("edges", "n"), "v").groupBy("p").agg(*each, F.count("*").alias("n"))
    sure = []
    for i in kinds:
        p, o, a = F.col(f"p{i}"), F.col(f"o{i}"), F.col(f"a{i}")
        good = (p >= least.seeds) & (_lower(p, p + o) >= least.confidence) & (p >= least.share * a)
        sure.append(F.when(good, _lower(p, p + o)).otherwise(0.0).alias(f"c{i}"))
    return held.select("p", *sure, "n").where(" or ".join(f"c{i} > 0" for i in kinds))


def discover(texts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(digest, added array of (s, k, e)) of the candidates that patterns reach, from distinct (digest, base, candidates).
    Ties between kinds go to the first in the list."""
    kinds = range(len(KINDS))
    spans = durable(_apart(texts).select("digest", "s", "k", "e", "v", _contexts(F.struct("l", "r")).alias("p")))
    edges = durable(spans.select(F.explode("p").alias("p"), "v").distinct())
    seen = spans.groupBy("v").agg(F.min("k").alias("seed"), F.count("*").alias("times")).join(edges.groupBy("v").agg(F.count("*").alias("edges")), "v", "left")
    fits = [(F.col("seed") == i) | ((F.col("seed") == len(KINDS)) & _SHAPES[k](F.col("v"))) for i, k in enumerate(KINDS)]
    seen = seen.select("v", "seed", "times", F.coalesce("edges", F.lit(0)).alias("edges"), *(f.alias(f"f{i}") for i, f in enumerate(fits)))
    values = durable(seen.select("*", *(F.when(F.col("seed") == i, 1.0).otherwise(0.0).alias(f"s{i}") for i in kinds)))
    for _ in range(settings.rounds):
        patterns = durable(_scored_patterns(edges, values.drop("seed", "times"), settings))
        if patterns.isEmpty():  # then none of the following rounds would have one
            break
        reached = hot_join(edges, patterns, "p").groupBy("v").agg(*(F.max(f"c{i}").alias(f"m{i}") for i in kinds))
        held = [F.when(F.col("seed") < len(KINDS), F.col(f"s{i}")).otherwise(F.when(F.col(f"f{i}"), F.coalesce(f"m{i}", F.lit(0.0))).otherwise(0.0)).alias(f"s{i}") for i in kinds]
        values = durable(values.join(reached, "v", "left").select("v", "seed", "times", "edges", *(f"f{i}" for i in kinds), *held))
    best = F.greatest(*(f"s{i}" for i in kinds))
    which = F.coalesce(*(F.when(F.col(f"s{i}") == F.col("best"), F.lit(i)) for i in kinds))
    new = durable(values.where(F.col("seed") == len(KINDS)).withColumn("best", best).where(F.col("best") > 0).select("v", which.alias("kind"), "times"))
    held = hot_join(spans.where(F.col("k") == len(KINDS)).select("digest", "s", "e", "v"), new, "v", "times")
    plain = held.select("digest", F.struct("s", F.col("kind").alias("k"), "e").alias("y"))
    return plain.groupBy("digest").agg(F.collect_set("y").alias("added"))  # bounded by a text's own spans


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _found(docs: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("id", _digest(F.col("text")).alias("digest"), base_spans(F.col("text")).alias("base"), _candidates(F.col("text"), settings.digits).alias("candidates"))


def _added(found: DataFrame, settings: Settings) -> DataFrame:
    """(digest, added, n) of the texts with discovered spans; n counts the rows with the text."""
    rows = found.where("size(base) > 0 or size(candidates) > 0")
    texts = durable(rows.groupBy("digest").agg(F.first("base").alias("base"), F.first("candidates").alias("candidates"), F.count("*").alias("n")))
    return durable(discover(texts.drop("n"), settings).join(texts.select("digest", "n"), "digest"))


def extract(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: (``id_col``, n_email, n_ip, n_card, n_phone, base_sha256, spans).

    The counts and base_sha256 are of the seeds; spans holds seeds and discovered spans as kind:start:end by start,
    then kind, in code points with exclusive ends. Null texts count as empty; equal texts get equal spans, whatever their
    ids (null ones and repeated ones too). No rows give no rows; other columns are not read. Texts are taken whole; a
    context reaches over one neighbouring match of its expression, and words that reach beyond 200 characters are no
    part of a pattern."""
    found = durable(_found(docs, settings, id_col, text_col))
    rows = hot_join(found.drop("candidates"), _added(found, settings), "digest", how="left").withColumn("base", _plain(F.col("base")))
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<s:int,k:int,e:int>>"))))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select(F.col("id").alias(id_col), *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"))


def redact(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", few: int = _FEW) -> DataFrame:
    """``docs`` with each span, seeds and discovered ones, replaced by its kind in angle brackets; overlapping spans
    become one, named after the first. Rows, columns and null texts stay as they are."""
    digest, added, base, every = unused(docs, "digest", "added", "base", "every")
    found = _added(durable(_found(docs, settings, id_col, text_col).where("size(base) > 0 or size(candidates) > 0")), settings)
    found = found.withColumnsRenamed({"digest": digest, "added": added})
    text = F.col(text_col)
    rows = docs.withColumn(digest, _digest(text))
    # at most ``few`` rows are sent
    rows = rows.join(F.broadcast(found.drop("n")), digest, "left") if found.count() <= few else hot_join(rows, found, digest, how="left")
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    rows = rows.withColumn(base, F.coalesce(base_spans(text), F.array().cast(_SPAN)))
    spans = F.array_sort(F.concat(_plain(F.col(base)), F.coalesce(F.col(added), none)))
    names = F.array(*map(F.lit, KINDS))

    def add(state: Column, x: Column) -> Column:
        piece = F.concat(text.substr(state["at"] + 1, F.greatest(x["s"] - state["at"], F.lit(0))), F.lit("<"), F.get(names, x["k"]), F.lit(">"))
        return F.struct(F.greatest(state["at"], x["e"]).alias("at"), F.when(x["s"] >= state["at"], F.concat(state["out"], F.array(piece))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(every, start, add, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    rows = rows.withColumn(every, spans)
    return rows.withColumn(text_col, F.when(F.size(every) > 0, done).otherwise(text)).select(*docs.columns)
