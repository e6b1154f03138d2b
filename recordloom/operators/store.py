"""Sinks as pure merges of old and new tables (SNK1-SNK13, SNK15).

Each function returns the table's next state; the caller writes it. Files are
never changed in place, so a failed job leaves the old state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import norm_text
from recordloom.schema import DECISIONS


def insert_records(records: DataFrame, new: DataFrame) -> DataFrame:
    """Appends records; manual attributes stand before extracted ones by their ordinal (SNK1)."""
    return records.unionByName(new, allowMissingColumns=True)


def changed(new: DataFrame, old: DataFrame, keys: list[str], digest: str = "content_hash") -> DataFrame:
    """The rows of ``new`` whose content is not in ``old`` under the same key (SNK2): only these need work."""
    return new.join(old.select(*keys, digest).distinct(), [*keys, digest], "left_anti").select(*new.columns)


def latest(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row a key: the one with the highest ``order``, and of equals the one whose values come last."""
    rest = [c for c in rows.columns if c not in keys]
    text = F.to_json(F.struct(*rest))
    rank = F.struct(F.col(order).alias("o"), text.alias("t")) if order else text
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row")).select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in rows.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] | None = None, order: str | None = None) -> DataFrame:
    """New rows replace old ones with their key; ``keep`` columns hold on to old values (SNK2, SNK3).

    Of new rows that repeat a key the latest by ``order`` counts.
    """
    kept = keep or []
    new = latest(new, keys, order)
    left = old.join(new.select(*keys), keys, "left_anti")
    before = latest(old.select(*keys, *kept), keys).select(*keys, *[F.col(c).alias(f"_{c}") for c in kept]) if kept else None
    merged = new if before is None else new.join(before, keys, "left")
    for c in kept:
        merged = merged.withColumn(c, F.coalesce(f"_{c}", c))
    return left.unionByName(merged.select(*old.columns))


def replace_by(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All old rows of the keys in ``new`` give way to its rows (SNK4)."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def run_log(run_id: str, config: Column, counts: DataFrame) -> DataFrame:
    """A run's row with its settings (SNK5)."""
    return counts.select(F.lit(run_id).alias("run_id"), F.to_json(config).alias("config"), F.current_timestamp().alias("at"), "*")


def audit(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows that differ between two states, as JSON (SNK6)."""
    a, b = (d.select(key, F.to_json(F.struct(*sorted(d.columns))).alias(n)) for d, n in ((before, "before"), (after, "after")))
    return a.join(b, key, "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))


def analysis_log(rows: DataFrame, text: str, result: str, version: str) -> DataFrame:
    """Analyses with the hash of what they read (SNK7)."""
    return rows.select("id", F.sha2(F.col(text).cast("binary"), 256).alias("input_hash"), F.lit(version).alias("prompt_version"), F.to_json(result).alias("result_json"))


def decide(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates with the status of their latest valid decision (SNK8)."""
    valid = decisions.filter(F.col("decision").isin(*DECISIONS))
    last = valid.groupBy("lost_id", "found_id").agg(F.max_by("decision", F.struct("decided_at", "decision")).alias("decision"))
    return candidates.join(last, ["lost_id", "found_id"], "left").withColumn("status", F.coalesce("decision", "status")).drop("decision")


def record_status(records: DataFrame, candidates: DataFrame, returns: DataFrame) -> DataFrame:
    """Both records of a confirmed pair are matched, returned ones are returned (SNK8, SNK9)."""
    matched = candidates.filter("status = 'CONFIRMED'").select(F.explode(F.array("lost_id", "found_id")).alias("id")).distinct().withColumn("_m", F.lit(True))
    gone = returns.select(F.explode(F.array("lost_id", "found_id")).alias("id")).distinct().withColumn("_r", F.lit(True))
    out = records.join(matched, "id", "left").join(gone, "id", "left")
    return out.withColumn("status", F.when(F.col("_r"), "RETURNED").when(F.col("_m"), "MATCHED").otherwise(F.col("status"))).select(*records.columns)


def resolve_locations(names: DataFrame, locations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, id) by normalised name or alias, and the names that no location has yet (SNK10)."""
    known = locations.select("id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).select("id", norm_text(F.col("n")).alias("form")).groupBy("form").agg(F.min("id").alias("id"))
    asked = names.select("name", norm_text(F.col("name")).alias("form")).filter("form <> ''").distinct()
    return asked.join(known, "form").select("name", "id"), asked.join(known, "form", "left_anti").groupBy("form").agg(F.min("name").alias("name")).select("name")


def reembed(old: DataFrame, new: DataFrame, keys: list[str], activate: bool = False) -> DataFrame:
    """Adds a model's vectors; ``activate`` retires other models by status, nothing is overwritten (SNK11)."""
    model = new.agg(F.max("model").alias("m"))
    out = upsert(old, new, keys)
    if activate:
        # One row: the model that is switched on.
        out = out.crossJoin(F.broadcast(model)).withColumn("status", F.when(F.col("model") == F.col("m"), "ACTIVE").otherwise("DEPRECATED")).drop("m")
    return out


def reextract(records: DataFrame, again: Callable[[DataFrame], DataFrame], fields: tuple[str, ...] = ("category", "brand", "model", "normalized_text")) -> DataFrame:
    """Records extracted anew: a version up, extracted attributes replaced, others kept; ``changed`` marks differences (SNK12)."""
    fresh = again(records).select("id", *[F.col(f).alias(f"_{f}") for f in fields], F.col("attributes").alias("_new"))
    out = records.join(fresh, "id")
    differ = F.lit(False)
    for f in fields:
        differ = differ | ~F.col(f).eqNullSafe(F.col(f"_{f}"))
    kept = F.filter(F.coalesce("attributes", F.array()), lambda a: F.coalesce(a["source"], F.lit("")) != "AI")
    ours = F.filter(F.coalesce("_new", F.array()), lambda a: a["source"] == "AI")
    return out.withColumn("changed", differ).withColumns({**{f: F.col(f"_{f}") for f in fields}, "attributes": F.concat(kept, ours), "version": F.col("version") + 1}).select(*records.columns, "changed")


def emptied(table: DataFrame) -> DataFrame:
    """The table without rows (SNK13)."""
    return table.limit(0)


def search_terms(record: dict[str, str] | None = None) -> Column:
    """The words a record is found by, made when it is written (SNK15)."""
    names = record or {"normalized": "normalized_text", "raw": "raw_description", "brand": "brand", "model": "model"}
    words = F.split(F.lower(F.concat_ws(" ", *[F.col(c) for c in names.values()])), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def write(table: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, replacing what is there; partitions that the table does not hold stay."""
    writer = table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if partition_by else "static")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
