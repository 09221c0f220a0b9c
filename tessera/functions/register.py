"""The library's functions by name, for use in SQL text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..runtime import python_path


def register(spark: SparkSession) -> None:
    """Define fnv1a32(text), vector_cosine(a, b), is_abbreviation(a, b) and value_grams(text) in the session. The first
    two are expressions and stay in the JVM."""
    python_path(spark)
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION fnv1a32(s STRING) RETURNS BIGINT RETURN
        CASE WHEN coalesce(s, '') = '' THEN 2166136261L ELSE aggregate(transform(sequence(1, length(hex(encode(coalesce(s, ''), 'UTF-8'))) div 2), i -> cast(conv(substr(hex(encode(coalesce(s, ''), 'UTF-8')), 2 * i - 1, 2), 16, 10) AS BIGINT)),
                  2166136261L, (h, b) -> ((h ^ b) * 16777619L) & 4294967295L) END""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION vector_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN
        aggregate(zip_with(slice(a, 1, least(size(a), size(b))), slice(b, 1, least(size(a), size(b))), (x, y) -> x * y), 0D, (s, x) -> s + x)""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION vector_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN
        CASE WHEN vector_dot(a, a) >= 1e-12 AND vector_dot(b, b) >= 1e-12 THEN vector_dot(a, b) / sqrt(vector_dot(a, a) * vector_dot(b, b)) ELSE 0D END""")

    @F.pandas_udf("boolean")
    def is_abbreviation(a: pd.Series, b: pd.Series) -> pd.Series:
        from ..operators.clustering import is_abbreviation_pair

        return pd.Series([bool(x and y) and is_abbreviation_pair(x, y, x.split(), y.split()) for x, y in zip(a, b, strict=True)], dtype=bool)

    spark.udf.register("is_abbreviation", is_abbreviation)
