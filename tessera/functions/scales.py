"""Clinical scales by label and range, and crosswalks between ordinal scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (parts of a label, smallest, largest, step, kind), the first that holds counts. None: any label.
SCALES = [
    (("nihss", "nih stroke scale", "national institutes health stroke"), 0, 42, 1, "NIHSS"),
    (("glasgow coma scale", "gcs"), 3, 15, 1, "GCS"),
    (("modified rankin", "rankin", "mrs"), 0, 6, 1, "MRS"),
    (("pain", "numeric rating scale", "nrs", "vas"), 0, 10, 1, "PAIN_NRS"),
    (("pain", "numeric rating scale", "nrs", "vas"), 0, 20, 1, "PAIN_NRS"),
    (("pain", "numeric rating scale", "nrs", "vas"), 0, 100, 10, "PAIN_NRS"),
    (("sofa", "sequential organ failure"), 0, 24, 1, "SOFA"),
    (("apache ii", "apache 2", "apache score", "apache"), 0, 71, 1, "APACHE_II"),
    (("news2", "news 2", "national early warning"), 0, None, 1, "NEWS2"),
    (("phq 9", "phq9", "patient health questionnaire 9"), 0, 27, 1, "PHQ9"),
    (("gad 7", "gad7", "generalized anxiety disorder 7"), 0, 21, 1, "GAD7"),
    (("moca", "montreal cognitive assessment"), 0, 30, 1, "MOCA"),
    (("mmse", "mini mental state", "mini mental status"), 0, 30, 1, "MMSE"),
    (("braden",), 6, 23, 1, "BRADEN"),
    (("morse fall", "morse"), 0, 125, 5, "MORSE_FALL"),
    (("cha2ds2 vasc", "cha2ds2vasc", "chads vasc", "chadsvasc"), 0, 9, 1, "CHA2DS2_VASC"),
    (("has bled", "hasbled"), 0, 9, 1, "HAS_BLED"),
    (("qsofa", "quick sofa", "quick sequential organ failure"), 0, 3, 1, "QSOFA"),
    (("apgar",), 0, 10, 1, "APGAR"),
    (("fim", "functional independence"), 1, 7, 1, "FIM"),
    (("barthel",), 0, 5, 5, "BARTHEL_ITEM"),
    (("barthel",), 0, 10, 5, "BARTHEL_ITEM"),
    (("barthel",), 0, 15, 5, "BARTHEL_ITEM"),
    (("barthel",), 0, 100, None, "BARTHEL_TOTAL"),
    (None, 1, 7, 1, "FIM"),
    (None, 0, 5, 5, "BARTHEL_ITEM"),
    (None, 0, 10, 5, "BARTHEL_ITEM"),
    (None, 0, 15, 5, "BARTHEL_ITEM"),
    (None, 0, 100, None, "BARTHEL_TOTAL"),
]
NEWS2_MOST, GENERIC_SPAN = 20, 20


def scale_label(column: Column, concept: Column) -> Column:
    return F.regexp_replace(F.lower(F.concat_ws(" ", column, concept)), "[^a-z0-9]+", " ")


def scale_domain(label: Column, stats: Column) -> Column:
    """struct(kind, lo, hi, step) of an integer column with both ends; null for columns without a scale."""
    lo, hi = F.floor(stats["num_min"] + 0.5).cast("int"), F.floor(stats["num_max"] + 0.5).cast("int")
    out = None
    for needles, a, b, step, kind in SCALES:
        hit = F.lit(True)
        if needles is not None:
            hit = F.lit(False)
            for needle in needles:
                hit = hit | label.contains(needle)
        hit = hit & (lo == a) & ((hi <= NEWS2_MOST) if b is None else (hi == b))
        by = F.lit(step) if step else F.coalesce(stats["step_hint"], F.lit(5))
        value = F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"), by.alias("step"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    generic = F.struct(F.lit("GENERIC").alias("kind"), lo.alias("lo"), hi.alias("hi"), F.lit(1).alias("step"))
    out = out.when((hi - lo).between(1, GENERIC_SPAN), generic)
    return F.when(stats["has_int"] & stats["num_min"].isNotNull() & stats["num_max"].isNotNull() & (hi >= lo), out)


def categories_of(domain: Column) -> Column:
    return F.sequence(domain["lo"], domain["hi"], domain["step"])


def scale_rank(kind: Column) -> Column:
    """Which of two scales with equally many categories is the canonical one: the larger."""
    return F.when(kind == "BARTHEL_ITEM", 4).when(kind == "FIM", 3).when(kind == "BARTHEL_TOTAL", 2).otherwise(1)


def ordinal_bucket(j: Column, sources: Column, targets: Column) -> Column:
    """Of the j-th (from 0) of so many source categories, the index of its target category."""
    return F.when(sources <= 1, 0).otherwise(F.floor(j * (targets - 1) / (sources - 1) + 0.5)).cast("int")


def backoff_ms(failures: Column, base: int = 2000, cap: int = 60000) -> Column:
    """Wait before a service is probed again after so many failures."""
    doublings = F.least(F.lit(10), F.greatest(failures - 1, F.lit(0)))
    return F.least(F.lit(cap).cast("bigint"), (F.lit(base) * F.pow(F.lit(2), doublings)).cast("bigint"))
