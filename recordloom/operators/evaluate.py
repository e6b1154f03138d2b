"""Ranking and decision metrics (EV1-EV4, AGG1-AGG5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def target_ranks(results: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, rank, sources): where each query's target stands; null where it is not found (EV2)."""
    columns = ["query_id", "id", "rank", *(["sources"] if "sources" in results.columns else [])]
    return truth.join(results.select(*columns), ["query_id", "id"], "left").drop("id")


def ranking(ranks: DataFrame, by: list[str] | None = None, outside: int = 100) -> DataFrame:
    """Recall at 1, 3 and 10, MRR and misses; a missing rank counts 0 (EV1)."""
    hit = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 4)
    measures = [F.count("*").alias("n"), *[hit(k).alias(f"recall_{k}") for k in (1, 3, 10)], F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 5).alias("mrr"), F.count_if(F.col("rank").isNull() | (F.col("rank") > outside)).alias("outside")]
    return ranks.groupBy(*(by or [])).agg(*measures)


def failures(ranks: DataFrame) -> DataFrame:
    """Queries whose target is not first (EV1, a report)."""
    return ranks.filter(F.col("rank").isNull() | (F.col("rank") > 1))


def compare(runs: dict[str, DataFrame]) -> DataFrame:
    """The ranking measures of several runs or modes, one row each (EV3, EV4)."""
    out = None
    for name, ranks in runs.items():
        one = ranking(ranks).select(F.lit(name).alias("run"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def confusions(rows: DataFrame, actual: str, taken: str) -> DataFrame:
    """How often one kind is taken for another (EV3)."""
    return rows.filter(F.col(actual) != F.col(taken)).groupBy(actual, taken).agg(F.count("*").alias("n"))


def share(hits: Column, of: Column) -> Column:
    """A ratio of two conditional counts to four digits; null without any cases."""
    return F.round(F.try_divide(F.count_if(hits).cast("double"), F.count_if(of).cast("double")), 4)


def decision_metrics(decisions: DataFrame) -> DataFrame:
    """Counts and ratios over (decision, level) rows (AGG1): how often people confirm what was recommended."""
    confirmed, refused = F.col("decision") == "CONFIRMED", F.col("decision") == "REJECTED"
    high = F.col("level").isin("VERY_HIGH", "HIGH")
    decided = confirmed | refused
    return decisions.agg(
        F.count("*").alias("total"), F.count_if(confirmed).alias("confirmed"), F.count_if(refused).alias("rejected"), F.count_if(F.col("decision") == "DEFERRED").alias("deferred"),
        share(confirmed & high, confirmed).alias("assist_recall"), share(refused & high, high & decided).alias("wrong_recommendation_rate"), share(confirmed & high, high & decided).alias("precision_high"),
    )


def level_counts(candidates: DataFrame) -> DataFrame:
    """(level, n) (AGG2)."""
    return candidates.groupBy("level").agg(F.count("*").alias("n"))


def embedding_status(embeddings: DataFrame) -> DataFrame:
    """Counts by the five keys of an embedding (AGG3)."""
    return embeddings.groupBy("kind", "provider", "model", "version", "status").agg(F.count("*").alias("n"))


def training_pairs(decisions: DataFrame, hard: float = 85.0, limit: int | None = None) -> DataFrame:
    """Decided pairs as labels, newest first; a refused pair with a high score is a hard negative (AGG4)."""
    label = F.when(F.col("decision") == "CONFIRMED", 1).when(F.col("decision") == "REJECTED", 0)
    out = decisions.withColumn("label", label).filter("label IS NOT NULL").withColumn("hard_negative", (F.col("label") == 0) & (F.col("final_score") >= hard))
    out = out.orderBy(F.col("decided_at").desc(), "lost_id", "found_id")
    return out if limit is None else out.limit(limit)


def unclassified(records: DataFrame) -> DataFrame:
    """How many records have no category (AGG5)."""
    return records.agg(F.count_if(F.col("category").isNull()).alias("unclassified"), F.count("*").alias("total"))
