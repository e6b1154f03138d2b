"""The SQL surface: scalar functions as Spark SQL functions, tables as views."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from recordloom.functions.text import BLANKS


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: name -> (parameters, result, body). Bodies are SQL, so Catalyst inlines them like any expression.
FUNCTIONS = {
    "norm_text": ("t STRING", "STRING", f"trim(regexp_replace(lower(translate(java_method('com.ibm.icu.text.Normalizer', 'compose', coalesce(t, ''), true), {_text(BLANKS)}, repeat(' ', {len(BLANKS)}))), ' +', ' '))"),
    "token_set": ("t STRING", "ARRAY<STRING>", "array_distinct(filter(split(norm_text(t), ' '), w -> w <> ''))"),
    "char_set": ("t STRING", "ARRAY<STRING>", "array_distinct(filter(split(replace(norm_text(t), ' ', ''), ''), c -> c <> ''))"),
    "overlap_coefficient": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN least(size(a), size(b)) > 0 THEN size(array_intersect(a, b)) / least(size(a), size(b)) ELSE 0.0D END"),
    "text_overlap": ("a STRING, b STRING", "DOUBLE", "greatest(overlap_coefficient(char_set(a), char_set(b)), overlap_coefficient(token_set(a), token_set(b)))"),
    "vector_norm": ("v ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(v, 0.0D, (s, x) -> s + x * x))"),
    "cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN size(a) = size(b) AND size(a) > 0 AND vector_norm(a) * vector_norm(b) > 0 THEN greatest(-1.0D, least(1.0D, aggregate(zip_with(a, b, (x, y) -> x * y), 0.0D, (s, x) -> s + x) / (vector_norm(a) * vector_norm(b)))) ELSE 0.0D END"),
    "haversine": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE", "2 * 6371000.0D * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))"),
    "decay_score": ("distance DOUBLE, tau DOUBLE", "DOUBLE", "round(100 * exp(-distance / tau), 4)"),
    "rank_score": ("rank DOUBLE", "DOUBLE", "round(100 * rank / (rank + 1), 4)"),
    "joint_penalty": ("costs ARRAY<DOUBLE>", "DOUBLE", "coalesce(round((array_max(costs) + aggregate(costs, 0.0D, (s, x) -> s + x)) / 2, 4), 0.0D)"),
    "rrf": ("ranks ARRAY<INT>, k INT", "DOUBLE", "aggregate(ranks, 0.0D, (s, r) -> s + 1.0D / (CASE WHEN k = 0 THEN 60 ELSE k END + r))"),
}


def register(spark: SparkSession, tables: Mapping[str, DataFrame] | None = None) -> list[str]:
    """Makes the functions (and tables as views) known to the session; returns the functions' names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, table in (tables or {}).items():
        table.createOrReplaceTempView(name)
    return list(FUNCTIONS)
