"""The role of a column, from its tokens and markers: the first rule that holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import role_tokens

# Words of each role, words of assessment items, values of flags.
IDENTIFIER = "id identifier subject patientid recordid".split()
DATE = "date dt timestamp".split()
DURATION = "duration los tsi elapsed".split()
DURATION_UNITS = "day days week weeks month months".split()
LIFE_EVENT = "birth born death deceased".split()
AGE = "age ageinjury".split()
DIAGNOSIS = "diagnosis diagnostic dx icd snomed".split()
FLAG = "flag indicator yesno".split()
FREE_TEXT = "note notes comment comments text description".split()
OUTCOME = "outcome event status state".split()
TOTAL = "total tot sum index subscale".split()
ITEM = """eating eat feeding feed bath bathing groom grooming toilet toileting transfer transfers mobility locomotion
stairs dressing dress bowel bladder memory comprehension expression interaction problem solving walking
ambulation""".split()
ITEM_ENDINGS = "eating feeding bath bathing grooming toilet toileting transfer transfers mobility stairs dressing bowel bladder".split()
FLAG_VALUES = "yes no true false y n 0 1 positive negative present absent".split()
ROLES = """IDENTIFIER DATE DURATION LIFE_EVENT_YEAR AGE TOTAL_SCORE ITEM_SCORE BOOLEAN_FLAG OUTCOME DIAGNOSIS FREE_TEXT
NUMERIC_MEASURE CATEGORICAL UNKNOWN""".split()  # in the order that decides ties of a vote
MARKER = r"^(min|max|earliest|latest|step):|^(integer|double|date|float|number|datetime)$"


def _any(tokens: Column, words: list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words)))


def categories(values: Column) -> Column:
    """Distinct values in lower case without blanks and markers."""
    plain = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(plain, lambda x: x.isNotNull() & (x != "") & ~x.rlike(MARKER)))


def is_flag(values: Column) -> Column:
    v = categories(values)
    return F.size(v).between(1, 3) & F.forall(v, lambda x: x.isin(FLAG_VALUES))


def column_role(column: Column, concept: Column, values: Column, stats: Column) -> Column:
    t = F.array_union(role_tokens(column), role_tokens(concept))
    numeric = stats["has_int"] | stats["has_double"] | stats["num_min"].isNotNull() | stats["num_max"].isNotNull()
    date = stats["has_date"] | stats["date_min_ms"].isNotNull() | stats["date_max_ms"].isNotNull()
    total = _any(t, TOTAL) | F.exists(t, lambda x: x.rlike("^tot|(total|index)$"))
    item = _any(t, ITEM) | F.exists(t, lambda x: x.rlike(f"({'|'.join(ITEM_ENDINGS)})$"))
    return (
        F.when(_any(t, IDENTIFIER), "IDENTIFIER")
        .when(date | _any(t, DATE), "DATE")
        .when(_any(t, DURATION) | (numeric & _any(t, DURATION_UNITS)), "DURATION")
        .when(_any(t, LIFE_EVENT), "LIFE_EVENT_YEAR")
        .when(_any(t, AGE), "AGE")
        .when(_any(t, DIAGNOSIS), "DIAGNOSIS")
        .when(is_flag(values) | _any(t, FLAG), "BOOLEAN_FLAG")
        .when(_any(t, FREE_TEXT), "FREE_TEXT")
        .when(_any(t, OUTCOME), "OUTCOME")
        .when(numeric & total, "TOTAL_SCORE")
        .when(numeric & item, "ITEM_SCORE")
        .when(numeric, "NUMERIC_MEASURE")
        .when(F.size(categories(values)) > 0, "CATEGORICAL")
        .otherwise("UNKNOWN")
    )
