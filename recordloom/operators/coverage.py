"""Syllabus coverage (CV1-CV3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators.steps import settled


def coverage(items: DataFrame, pool: DataFrame, item: str = "kb", question: str = "qid") -> DataFrame:
    """Every syllabus item with the number of questions that cover it; 0 is a blind spot (CV1)."""
    counts = pool.select(item, question).distinct().groupBy(item).agg(F.count("*").alias("questions"))
    return items.join(counts, item, "left").withColumn("questions", F.coalesce("questions", F.lit(0)).cast("long")).withColumn("reachable", F.col("questions") > 0)


def by_domain(covered: DataFrame, domain: str = "domain") -> DataFrame:
    """(domain, blind, total, blind_ratio) (CV1)."""
    return covered.groupBy(domain).agg(F.count_if(~F.col("reachable")).alias("blind"), F.count("*").alias("total")).withColumn("blind_ratio", F.round(F.col("blind") / F.col("total"), 4))


#: Questions that a round looks at together; what overlaps waits for the next round.
BATCH = 64


def greedy_cover(pool: DataFrame, targets: DataFrame, k: int = 1, must: DataFrame | None = None, item: str = "kb", question: str = "qid") -> DataFrame:
    """Few questions that cover each target ``k`` times if the pool can: (step, qid, gain) (CV2).

    Questions of ``must`` come first, whatever they cover. Then each step takes
    the question that covers the most items still needed, the smallest id
    among equals, until nothing needed can be covered.

    A round ranks all questions left and takes the longest run from the top in
    which no two share a needed item: the gain of each is then what it was, and
    those of others can only have fallen, so single steps would take the same.
    What is needed and what is left are written each round; ``BATCH`` rows and
    their overlaps come to the driver.
    """
    pool = pool.select(question, item).distinct()
    need = targets.select(item).distinct().withColumn("_need", F.lit(k))
    steps = []
    at = 0
    if must is not None:
        forced = settled(pool.join(must.select(question).distinct(), question, "left_semi"))
        named = forced.select(question).distinct().sort(question).rdd.zipWithIndex().map(lambda r: (int(r[1]), r[0][0]))
        steps.append(settled(pool.sparkSession.createDataFrame(named, f"step int, {question} {dict(pool.dtypes)[question]}").withColumn("gain", F.lit(0).cast("long"))))
        at = steps[0].count()
        have = forced.groupBy(item).agg(F.count("*").alias("_have"))
        need = need.join(have, item, "left").select(item, (F.col("_need") - F.coalesce("_have", F.lit(0))).cast("int").alias("_need")).filter("_need > 0")
        pool = pool.join(steps[0].select(question), question, "left_anti")
    need = settled(need)
    left = settled(pool.join(need.select(item), item, "left_semi"))
    rows: list[tuple[int, object, int]] = []
    while True:
        heads = left.groupBy(question).agg(F.count("*").alias("gain")).orderBy(F.col("gain").desc(), question).limit(BATCH).collect()
        if not heads:
            break
        some = settled(left.filter(F.col(question).isin([r[0] for r in heads])))
        sharing = some.alias("x").join(some.alias("y"), item).filter(F.col(f"x.{question}") < F.col(f"y.{question}")).select(F.col(f"x.{question}").alias("a"), F.col(f"y.{question}").alias("b")).distinct()
        apart = {(r.a, r.b) for r in sharing.collect()}  # BATCH squared at most
        picked: list[object] = []
        for q, gain in heads:
            if any((q, p) in apart or (p, q) in apart for p in picked):
                break
            rows.append((at, q, gain))
            picked.append(q)
            at += 1
        got = some.filter(F.col(question).isin(picked)).groupBy(item).agg(F.count("*").alias("_got"))
        need = settled(need.join(got, item, "left").select(item, (F.col("_need") - F.coalesce("_got", F.lit(0))).cast("int").alias("_need")).filter("_need > 0"))
        left = settled(left.filter(~F.col(question).isin(picked)).join(need.select(item), item, "left_semi"))
        if len(rows) >= 10_000:  # what was chosen does not stay on the driver
            steps.append(settled(_as_steps(left, rows, question)))
            rows = []
    return reduce(DataFrame.unionByName, [*steps, _as_steps(left, rows, question)])


def _as_steps(pool: DataFrame, rows: list, question: str) -> DataFrame:
    return pool.sparkSession.createDataFrame(rows, f"step int, {question} {dict(pool.dtypes)[question]}, gain long")


def selection_coverage(pool: DataFrame, chosen: DataFrame, item: str = "kb", question: str = "qid") -> DataFrame:
    """(item, n): how often a selection covers each item (CV3)."""
    return pool.join(chosen.select(question).distinct(), question, "left_semi").groupBy(item).agg(F.count("*").alias("n"))
