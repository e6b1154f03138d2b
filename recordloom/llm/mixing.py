"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import WORD, written

#: A hash of 48 bits is read 12 bits at a time: 4096 buckets a source and level.
LEVELS, BITS = 4, 12


def water_levels(sources: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """Adds ``target`` to (source, source_size): weights by code point order, null last, capped and reshared.

    Targets are min(cap * size, level * weight) with the one level at which
    they add up to ``share`` of all sizes: what resharing the excess by weight
    ends at. The input has one row per source, so its sort is the only global
    one here.
    """
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    full = Window.partitionBy()
    rows = sources.withColumn("_w", F.element_at(kinds, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("_cap", F.col("source_size") * F.lit(float(cap))).withColumn("_r", F.col("_cap") / F.col("_w"))
    rows = rows.withColumn("_goal", F.sum(F.col("source_size").cast("double")).over(full) * share)
    upward = Window.orderBy("_r", F.col("source").asc_nulls_last())
    #: Were all sources before this one (by ratio) at their cap, this would be the level of the rest.
    before = F.coalesce(F.sum("_cap").over(upward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(upward.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_level", (F.col("_goal") - before) / rest)
    settled = F.when(F.col("_level") <= F.col("_r"), F.col("_level"))
    rows = rows.withColumn("_level", F.max(settled).over(full))
    # The first level that its own source's ratio reaches holds; taking out uncapped sources after it only lowers the level, so it is the largest.
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("_w")))
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """How often each document enters the mix: (doc_id, source, size, source_size, target, copies, taken, _hash).

    One pass over the texts leaves a narrow table (id, source, size, 48-bit
    hash). Each source takes every document ``floor(target / size)`` times and
    once more those whose hash is below a threshold. The threshold comes from
    nested histograms: words by source and 12 hash bits, then the same only
    for the bucket in which the budget ends, and so on; the last boundary
    value is in if that comes nearer to the target. Nothing is sorted, and a
    hot source is summed before it is shuffled.

    Null text: size 0, never taken. Null source: a source of its own, last.
    Rows that repeat an id and text share a hash and are taken alike. Empty
    table: no rows. Other columns of the input are ignored. ``cap`` is at
    most the number of copies that any document gets.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    mark = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - LEVELS * BITS)
    narrow = written(docs.select("doc_id", "source", size.alias("size"), mark.alias("_hash")), "mix-docs")
    sources = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = water_levels(sources, weights, share, cap)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(0).cast("int")
    plan = plan.withColumn("_base", base).withColumn("_left", F.greatest(F.lit(0.0), F.col("target") - F.col("_base") * F.col("source_size")))
    plan = written(plan, "mix-plan")
    edge = plan.select(F.col("source").alias("_s"), F.lit(0).cast("long").alias("_path"), "_left")
    for level in range(LEVELS):
        low = (LEVELS - 1 - level) * BITS
        inside = narrow.join(edge, narrow["source"].eqNullSafe(edge["_s"]) & (F.shiftright("_hash", low + BITS) == F.col("_path")))
        step = F.shiftright("_hash", low)
        sums = inside.groupBy("_s", step.alias("_path")).agg(F.sum("size").cast("double").alias("_words"), F.first("_left").alias("_left"))
        upto = F.sum("_words").over(Window.partitionBy("_s").orderBy("_path").rowsBetween(Window.unboundedPreceding, 0))
        first = Window.partitionBy("_s").orderBy("_path")
        sums = sums.withColumn("_upto", upto).filter(F.col("_upto") > F.col("_left")).withColumn("_rn", F.row_number().over(first)).filter("_rn = 1")
        edge = written(sums.select("_s", "_path", (F.col("_left") - (F.col("_upto") - F.col("_words"))).alias("_left"), "_words"), "mix-edge")
    limit = edge.select("_s", (F.col("_path") + F.when(F.col("_left") * 2 >= F.col("_words"), 1).otherwise(0)).alias("_limit"))
    plan = plan.join(limit, plan["source"].eqNullSafe(limit["_s"]), "left").select(F.col("source").alias("_s"), "source_size", "target", "_base", "_left", "_limit")
    more = F.when(F.col("_left") <= 0, 0).when(F.col("_limit").isNull() | (F.col("_hash") < F.col("_limit")), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.col("_base") + more).otherwise(0).cast("int")
    out = narrow.join(plan, narrow["source"].eqNullSafe(plan["_s"])).withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "_hash")


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns."""
    kept = mix(docs, **options).filter("copies > 0").select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_h"), "copies").dropDuplicates(["_id", "_h"])
    mark = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - LEVELS * BITS)
    columns = docs.columns
    out = docs.withColumn("_mark", mark).join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_h")))
    return out.select(*columns, F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")).drop("_copy")
