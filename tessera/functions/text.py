"""Text functions over Columns: trimming, tokenizers, hashes, names and search variants.

Several tokenizers differ in small ways on purpose; each is named after its use. None of them changes null: safe() does.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def trimmed(c: Column) -> Column:
    """Without characters up to U+0020 on either side; null gives ''."""
    return F.regexp_replace(safe(c), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def group_key(node: Column, file: Column, column: Column) -> Column:
    return F.concat_ws("::", safe(node), safe(file), safe(column))


def split_camel(c: Column) -> Column:
    """A space before the last capital of a run and after a lower-case letter or digit."""
    return F.regexp_replace(F.regexp_replace(safe(c), "([A-Z])([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")


def normalize_value(c: Column) -> Column:
    """A sample value in comparable form; markers of ranges and types give ''."""
    t = F.lower(trimmed(c))
    plain = F.regexp_replace(F.translate(t, "_-", "  "), r"\s+", " ")
    return F.when(t.rlike("^(min|max|earliest|latest):|^(integer|double|date)$"), "").otherwise(plain)


def _tokens(prepared: Column) -> Column:
    """Parts of at least two characters that aren't numbers."""
    return F.filter(F.split(prepared, "[^a-z0-9]+"), lambda t: (F.length(t) > 1) & ~t.rlike("^[0-9]+$"))


def name_tokens(c: Column) -> Column:
    """Tokens of a column name: camel case and letter-digit borders are cut."""
    s = F.lower(split_camel(trimmed(c)))
    return _tokens(F.regexp_replace(F.regexp_replace(s, "([a-z])([0-9])", "$1 $2"), "([0-9])([a-z])", "$1 $2"))


def context_tokens(c: Column) -> Column:
    return _tokens(F.lower(F.regexp_replace(safe(c), "([a-z])([A-Z])", "$1 $2")))


def role_tokens(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(safe(c), "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.array_distinct(_tokens(F.lower(s)))


# Tokens that don't count for the overlap of concepts.
OVERLAP_STOPS = """date dt time day days week weeks month months year years hour hours minute minutes total status state
type code id value score scores scale scales level levels management control controls""".split()


def concept_tokens(c: Column) -> Column:
    """Tokens for the overlap of concepts; camel case isn't cut."""
    return F.array_except(F.array_distinct(_tokens(F.lower(trimmed(c)))), F.array(*map(F.lit, OVERLAP_STOPS)))


def fnv1a32(c: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as long."""
    data = F.hex(F.encode(safe(c), "UTF-8"))
    positions = F.when(F.length(data) > 0, F.sequence(F.lit(1), F.length(data), F.lit(2))).otherwise(F.array().cast("array<int>"))

    def step(h: Column, at: Column) -> Column:
        byte = F.conv(F.substring(data, at, F.lit(2)), 16, 10).cast("bigint")
        return (h.bitwiseXOR(byte) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF))

    return F.aggregate(positions, F.lit(0x811C9DC5).cast("bigint"), step)


def union_name(c: Column) -> Column:
    """A name of letters, digits and underscores that starts with no digit."""
    s = F.regexp_replace(F.regexp_replace(trimmed(c), r"\s+", "_"), "[^A-Za-z0-9_]", "")
    return F.when(s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s)


def is_structural(t: Column) -> Column:
    """Tokens that name a kind of column rather than its subject."""
    words = ["id", "code", "name", "value", "flag", "indicator", "status", "type"]
    return t.rlike("^[0-9]+$") | (F.length(t) == 1) | ((F.length(t) == 2) & ~t.rlike("[aeiou]")) | t.isin(words)


def is_structural_suffix(t: Column) -> Column:
    return t.rlike("^[0-9]+$") | (F.length(t) == 1) | ((F.length(t) <= 4) & ~t.rlike("[aeiou]"))


def guard_stem(t: Column) -> Column:
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    return (
        F.when((n > 4) & t.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 5) & t.endswith("ing"), cut(3))
        .when((n > 4) & t.endswith("ed"), cut(2))
        .when((n > 3) & t.endswith("s"), cut(1))
        .otherwise(t)
    )


def guard_tokens(c: Column) -> Column:
    """Stemmed runs of letters or digits in order; words that end in "use" also give their two parts."""
    s = F.lower(F.regexp_replace(safe(c), "([a-z])([A-Z])", "$1 $2"))

    def parts(t: Column) -> Column:
        head = guard_stem(F.substring(t, F.lit(1), F.length(t) - 3))
        return F.when(t.endswith("use") & (F.length(t) > 4), F.array(guard_stem(t), head, F.lit("use"))).otherwise(F.array(guard_stem(t)))

    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(s, F.lit("[a-z]+|[0-9]+"), F.lit(0)), parts)))


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(safe(c)), "[^a-z0-9]+", "")


def trim_number(x: Column) -> Column:
    """A whole number without its fraction, other numbers as they are."""
    whole = F.abs(x - F.rint(x)) < 1e-9
    return F.when(whole, x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def stem_hints(c: Column) -> Column:
    """First four letters of the longest word of a value; null for shorter words."""
    words = F.filter(F.split(F.lower(safe(c)), "[^a-z]+"), lambda w: F.length(w) >= 6)
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    return F.left(longest["w"], F.lit(4))


def is_obvious_alias(a: Column, b: Column) -> Column:
    """An initial of a word, a short prefix of a longer one, or spellings of unknown."""
    one = lambda x, y: (F.length(x) == 1) & (F.length(y) >= 3) & y.startswith(x)
    prefix = lambda x, y: F.length(x).between(3, 5) & (F.length(y) >= F.length(x) + 2) & y.startswith(x)
    unknown = ((a == "unk") & b.startswith("unk")) | ((b == "unk") & a.startswith("unk"))
    return one(a, b) | one(b, a) | prefix(a, b) | prefix(b, a) | unknown


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition, for queries that aren't plain ASCII; there is no expression for it."""

    @F.pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.when(c.rlike(r"[^\x00-\x7f]"), composed(c)).otherwise(c)


def search_query(c: Column) -> Column:
    """A terminology query in the form that the dictionary is searched with, of a text that ``nfkc`` has composed."""
    s = F.regexp_replace(safe(c), "([a-z])([A-Z])", "$1 $2")
    s = F.regexp_replace(F.regexp_replace(s, "([0-9])([A-Za-z])", "$1 $2"), "([A-Za-z])([0-9])", "$1 $2")
    s = F.regexp_replace(F.translate(s, "_-/", "   "), r"[^\w\s]", " ")
    return F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))


def without_numbers(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, " "), lambda t: ~t.rlike("^[0-9]*$")), " ")


def search_variants(c: Column) -> Column:
    """The query, without numbers, its runs of tokens from long to short, and its tokens: distinct, in this order."""
    query = search_query(c)
    tokens = F.filter(F.split(query, " "), lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$"))
    n = F.size(tokens)
    sizes = F.when(n >= 3, F.sequence(n - 1, F.lit(2), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    runs = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda s: F.array_join(F.slice(tokens, s, k), " "))))
    every = F.concat(F.array(query, without_numbers(query)), runs, tokens)
    return F.array_distinct(F.filter(every, lambda v: v != ""))


def search_variant_rows(rows: DataFrame, query_col: str) -> DataFrame:
    """The variants of ``search_variants`` as rows, with columns ord and variant more, for texts of any length: those of
    a query have its order by ord. A variant that comes about twice has two rows."""
    query = search_query(F.col(query_col))
    tokens = F.filter(F.split("__q", " "), lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$"))
    texts = rows.withColumn("__q", query).withColumn("__t", tokens).withColumn("__n", F.size("__t").cast("bigint"))
    whole = texts.select(*rows.columns, F.posexplode(F.array("__q", without_numbers(F.col("__q")))).alias("ord", "variant")).withColumn("ord", F.col("ord").cast("bigint"))
    # Runs of all tokens have no row, but for a single token.
    sizes = F.when(F.col("__n") >= 1, F.sequence(F.greatest(F.col("__n") - 1, F.lit(1)), F.lit(1), F.lit(-1)))
    sized = texts.withColumn("__k", F.explode(sizes))
    runs = sized.withColumn("__s", F.explode(F.sequence(F.lit(1), F.col("__n") - F.col("__k") + 1)))
    run = F.array_join(F.slice("__t", F.col("__s").cast("int"), F.col("__k").cast("int")), " ")
    runs = runs.select(*rows.columns, (2 + (F.col("__n") - F.col("__k")) * F.col("__n") + F.col("__s")).alias("ord"), run.alias("variant"))
    return whole.unionByName(runs).where("variant <> ''")


def padded_term(term: Column, context: Column) -> Column:
    """Terms of under three characters get their context."""
    return F.when((F.length(trimmed(term)) < 3) & (trimmed(context) != ""), F.concat_ws(" ", trimmed(term), trimmed(context))).otherwise(trimmed(term))


def split_key(key: Column) -> Column:
    """struct(context, term), cut at the first bar; without one all of it is the term."""
    at = F.instr(key, "|")
    head, tail = trimmed(F.substring(key, F.lit(1), at - 1)), trimmed(F.substring(key, at + 1, F.length(key)))
    return F.struct(F.when(at > 0, head).otherwise("").alias("context"), F.when(at > 0, tail).otherwise(trimmed(key)).alias("term"))


def is_search_term(c: Column) -> Column:
    t = trimmed(c)
    return (F.length(t) >= 2) & ~t.rlike("^[0-9]+$") & (F.length(F.regexp_replace(t, "[^A-Za-z]", "")) >= 2)


def terminology_gate(c: Column) -> Column:
    """'label | code' with a code of six digits or more, or such a code alone; anything else gives ''."""
    t = trimmed(c)
    return F.when(t.rlike(r"^.+ [|] [0-9]{6,}$") | t.rlike("^[0-9]{6,}$"), t).otherwise("")


def terminology_label(c: Column) -> Column:
    """The label of 'label | code', 'code|label' or a plain label."""
    t = trimmed(c)
    new = trimmed(F.regexp_extract(t, r"^(.+) \| ", 1))
    bar = F.instr(t, "|")
    old = trimmed(F.substring(t, bar + 1, F.length(t)))
    return F.when(new != "", new).when((bar > 1) & (bar < F.length(t)) & (old != ""), old).otherwise(t)


def plain_name(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(safe(c), "([a-z])([A-Z])", "$1 $2"), r"[_\-]+", " ")
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def is_generic_name(c: Column) -> Column:
    return F.lower(trimmed(c)).rlike(r"^(col(umn)?|var(iable)?|field|attr(ibute)?|v|x|f)[\s_\-]?[0-9]+$")


def sentence(c: Column, fallback: str = "field") -> Column:
    """With a capital first letter and a full stop."""
    t = F.when(trimmed(c) == "", F.lit(fallback)).otherwise(trimmed(c))
    t = F.concat(F.upper(F.left(t, F.lit(1))), F.substring(t, F.lit(2), F.length(t)))
    return F.when(t.rlike("[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))


def value_phrase(value: Column, label: Column, low: Column, high: Column) -> Column:
    """What a number says: a score where its scale is known."""
    name, top = trimmed(label), trim_number(high)
    score = F.concat(F.lit("score "), value, F.lit(" of "), top)
    scored = F.when(name != "", F.concat(score, F.lit(" measuring "), name)).otherwise(score)
    plain = F.concat(F.lit("value "), value)
    plain = F.when(name != "", F.concat(plain, F.lit(" as a value of "), name)).otherwise(plain)
    return F.when(low.isNotNull() & high.isNotNull() & (high > low), scored).otherwise(plain)


def category_phrase(value: Column, label: Column) -> Column:
    return F.when(trimmed(label) != "", F.concat(value, F.lit(" as a category of "), trimmed(label))).otherwise(value)


def normalize_name(c: Column) -> Column:
    """A name in lower case, cut at camel humps, with single spaces for underscores and hyphens."""
    return F.regexp_replace(F.translate(F.lower(split_camel(trimmed(c))), "_-", "  "), r"\s+", " ")


def string_hash(c: Column) -> Column:
    """The 32-bit polynomial hash (base 31) of the UTF-16 units, as a signed number."""
    data = F.hex(F.encode(safe(c), "UTF-16BE"))
    at = F.when(F.length(data) > 0, F.sequence(F.lit(1), F.length(data), F.lit(4))).otherwise(F.array().cast("array<int>"))
    unit = lambda i: F.conv(F.substring(data, i, F.lit(4)), 16, 10).cast("bigint")
    h = F.aggregate(at, F.lit(0).cast("bigint"), lambda h, i: (h * 31 + unit(i)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(h >= 2**31, h - F.lit(2**32)).otherwise(h)


def fallback_code(term: Column, context: Column) -> Column:
    """A code for a term that no dictionary knows; the terminology gate doesn't let it pass."""
    return F.concat(F.lit("CONCEPT_"), F.lpad((F.abs(string_hash(F.concat(safe(term), safe(context)))) % 1_000_000_000).cast("string"), 9, "0"))


def repaired_map(c: Column) -> Column:
    """The JSON object that a model answered with: the text itself, else what stands between its first opening and its
    last closing brace; an empty map where neither parses."""
    parsed = lambda x: F.from_json(x, "map<string,string>")
    return F.coalesce(parsed(c), parsed(F.regexp_extract(c, r"(?s)\{.*\}", 0)), F.create_map().cast("map<string,string>"))


def column_prompt(name: Column, values: Column, stats: Column) -> Column:
    """What is embedded of a column: name, type and range, eight of its first 15 values, and stems of those values."""
    first = F.slice(F.coalesce(values, F.array().cast("array<string>")), 1, 15)
    kept = F.filter(F.transform(F.filter(first, lambda x: ~F.lower(F.trim(x)).startswith("step:")), normalize_value), lambda x: x != "")
    both = stats["num_min"].isNotNull() & stats["num_max"].isNotNull()
    span = F.when(both, F.concat(F.lit("range "), trim_number(stats["num_min"]), F.lit(".."), trim_number(stats["num_max"])))
    kinds = F.filter(F.transform(first, lambda x: F.lower(F.trim(x))), lambda x: x.isin("integer", "double", "date"))
    return _prompt(F.nullif(trimmed(name), F.lit("")), F.nullif(F.concat_ws(" ", F.get(kinds, F.size(kinds) - 1), span), F.lit("")), kept, F.slice(kept, 1, 8))


def field_prompt(name: Column, kind: Column, description: Column, enums: Column) -> Column:
    """What is embedded of a schema field: name and type, description and its first 15 values, and stems of them."""
    kept = F.slice(F.filter(F.transform(F.coalesce(enums, F.array().cast("array<string>")), normalize_value), lambda x: x != ""), 1, 15)
    kind, name, said = trimmed(kind), trimmed(name), trimmed(description)
    head = F.when(name == "", kind).when(kind == "", name).otherwise(F.concat(name, F.lit(" ("), kind, F.lit(")")))
    head = F.concat_ws(" | ", F.nullif(head, F.lit("")), F.nullif(said, F.lit("")))
    head = F.concat_ws(": ", F.nullif(head, F.lit("")), F.when(F.size(kept) > 0, F.array_join(kept, ", ")))
    return _prompt(F.nullif(head, F.lit("")), F.lit(None).cast("string"), kept, F.array().cast("array<string>"))


def _prompt(head: Column, kind: Column, kept: Column, shown: Column) -> Column:
    stems = F.slice(F.array_distinct(F.filter(F.transform(kept, stem_hints), lambda x: x.isNotNull())), 1, 8)
    hints = F.when(F.size(stems) > 0, F.concat(F.lit("stem_hints "), F.array_join(stems, ", ")))
    return F.concat_ws(" | ", head, kind, F.when(F.size(shown) > 0, F.array_join(shown, ", ")), hints)
