"""Reports (SNK14): JSON and CSV from tables, Markdown from their small summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators import coverage, dedup, evaluate
from recordloom.operators.steps import shared_folder

#: Rows that a Markdown table shows, pairs in a JSON report, and pairs that it shows of a cluster.
MARKDOWN_ROWS, JSON_PAIRS, CLUSTER_PAIRS = 200, 400, 5


def markdown(table: DataFrame, title: str, rows: int = MARKDOWN_ROWS) -> str:
    """A Markdown table of the first rows in the table's order."""
    found = table.limit(rows).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(v) for v in r) + " |" for r in found), ""])


def json_report(table: DataFrame, path: str, rows: int | None = JSON_PAIRS) -> None:
    """JSON lines of the first ``rows`` rows (a report's length), or of all."""
    (table if rows is None else table.limit(rows)).write.mode("overwrite").json(path)


def written(table: DataFrame, name: str) -> str:
    """The table as JSON lines in the shared folder; returns where."""
    path = f"{shared_folder(table.sparkSession)}/report-{name}-{uuid.uuid4().hex}"
    json_report(table, path, None)
    return path


def csv_report(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)


def duplicate_pairs(pairs: DataFrame, limit: int = JSON_PAIRS) -> DataFrame:
    """The highest pairs of a duplicate report."""
    return pairs.orderBy(F.col("final_score").desc(), "a", "b").limit(limit)


def cluster_pairs(pairs: DataFrame, found: DataFrame, most: int = CLUSTER_PAIRS) -> DataFrame:
    """(cluster, representative, size, a, b, final_score, place): the highest pairs inside each cluster of two or more."""
    named = found.filter("size > 1").select(F.col("qid").alias("a"), "cluster", "representative", "size")
    inside = pairs.join(named, "a").join(found.select(F.col("qid").alias("b"), F.col("cluster").alias("_other")), "b").filter("cluster = _other")
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("final_score").desc(), "a", "b"))
    return inside.select("cluster", "representative", "size", "a", "b", "final_score", place.alias("place")).filter(F.col("place") <= most)


def duplicates(questions: DataFrame, pairs: DataFrame, found: DataFrame) -> dict[str, DataFrame]:
    """The tables of a duplicate report: totals, sizes, pairs of clusters, pairs on one topic, pairs that a conflict kept apart."""
    totals = questions.agg(F.count("*").alias("questions")).crossJoin(found.agg(F.countDistinct("cluster").alias("kept")))  # one row each
    return {"totals": totals, "sizes": dedup.size_histogram(found), "clusters": cluster_pairs(pairs, found), "topics": dedup.topic_pairs(pairs), "blocked": dedup.blocked_pairs(pairs), "pairs": duplicate_pairs(pairs)}


def evaluation(ranks: DataFrame, by: str) -> dict[str, DataFrame]:
    """The tables of a retrieval report: measures, measures by style or language, queries that missed."""
    return {"measures": evaluate.ranking(ranks), f"by {by}": evaluate.ranking(ranks, [by]), "missed": evaluate.failures(ranks)}


def blind_spots(covered: DataFrame) -> dict[str, DataFrame]:
    """The tables of a coverage report: domains, and items that no question covers."""
    return {"domains": coverage.by_domain(covered), "blind": covered.filter(~F.col("reachable"))}


def page(title: str, tables: dict[str, DataFrame], rows: int = MARKDOWN_ROWS) -> str:
    """A Markdown page of several tables."""
    return "\n".join([f"# {title}", "", *(markdown(table, name, rows) for name, table in tables.items())])
