"""Pair and batch matching, verdicts and explanations (RK1-RK9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.config import CATEGORY_TAU, FUNNEL, LOST_FOUND, TAU, DomainSpec
from recordloom.operators import conflicts as CF
from recordloom.operators import features as FT
from recordloom.operators import scoring as SC
from recordloom.operators.extract import attribute_map


def _tau(category: Column, i: int, name: str) -> Column:
    out = F.lit(TAU[name])
    for c, values in CATEGORY_TAU.items():
        out = F.when(category == c, F.lit(values[i])).otherwise(out)
    return out


def scored_pairs(pairs: DataFrame, spec: DomainSpec = LOST_FOUND, semantic: str | None = "semantic_cosine", keyword: str | None = "keyword_rank", image: str | None = None, parents: tuple[Column, Column] | None = None) -> DataFrame:
    """Adds all score columns, ``conflicts`` and ``evidence`` to rows with ``lost`` and ``found`` structs (RK1).

    The structs have ``schema.RECORD`` fields, ``category_candidates`` and
    ``category_uncertain``. Attribute maps are made once a side: of repeated
    codes the last one counts for scores, the first one for conflicts.
    """
    a, b = F.col("lost"), F.col("found")
    rows = pairs.withColumns({
        "_la": attribute_map(a["attributes"], True), "_fa": attribute_map(b["attributes"], True),
        "_lc": attribute_map(a["attributes"], False), "_fc": attribute_map(b["attributes"], False),
        "_cat": F.coalesce(F.nullif(a["category"], F.lit("")), b["category"]),
        "_open": F.coalesce(a["category_uncertain"], F.lit(False)) | F.coalesce(b["category_uncertain"], F.lit(False)),
    })
    plain = lambda c: F.transform_values(c, lambda k, v: v["value"])
    core = lambda side: {k: side[k] for k in ("category", "brand", "model")}
    marks_feature, marks = FT.distinctive(a["distinctive"], b["distinctive"])
    _, attribute_parts = FT.attribute(F.col("_la"), F.col("_fa"), F.col("_cat"))
    rows = rows.withColumns({"_lc": CF.core_first(plain(F.col("_lc")), core(a)), "_fc": CF.core_first(plain(F.col("_fc")), core(b)), "_attr": attribute_parts, "_mark": marks, "_dist": marks_feature})
    none = F.lit(None).cast("double")
    features = {
        "category": FT.category(a["category"], b["category"], a["category_candidates"], b["category_candidates"], F.col("_open"), *(parents or (None, None))),
        "attribute": FT.attribute_mean(F.col("_attr")),
        "location": FT.location(a["location"], b["location"], _tau(F.col("_cat"), 0, "location_tau_m")),
        "time": FT.time(a["start_at"], F.coalesce(a["end_at"], a["start_at"]), F.coalesce(b["start_at"], b["end_at"]), _tau(F.col("_cat"), 1, "time_tau_hours")),
        "distinctive": F.col("_dist"),
        "semantic": FT.semantic(F.col(semantic) if semantic else none),
        "keyword": FT.keyword(F.col(keyword) if keyword else none),
        "image": FT.semantic(F.col(image) if image else none),
    }
    broken = CF.conflicts(F.col("_lc"), F.col("_fc"), F.col("_open"))
    out = SC.with_score(rows, spec, features, broken, F.col("_cat"), {"attribute": F.col("_attr"), "distinctive": F.col("_mark")}, keep=True)
    return out.drop("_la", "_fa", "_lc", "_fc", "_cat", "_open", "_attr", "_mark", "_dist")


def strength(score: Column) -> Column:
    return F.when(score >= 95, "STRONG").when(score >= 75, "MODERATE").otherwise("WEAK")


def verdict(final: Column, conflicts: Column, evidence: Column) -> Column:
    """The rule analyst's decision from evidence at hand; it never changes a score (RK3)."""
    strong = F.size(F.filter(evidence, lambda e: ~e["is_conflict"] & e["evidence_type"].isin("DISTINCTIVE", "ATTRIBUTE") & (e["similarity_score"] >= 95)))
    row = lambda d, a, c: F.struct(F.lit(d).alias("decision"), F.lit(a).alias("recommended_action"), F.lit(c).alias("confidence"))
    return (
        F.when(CF.has_critical(conflicts), row("NOT_MATCH", "DO_NOT_RECOMMEND", 0.95))
        .when(F.exists(conflicts, lambda c: c["severity"] == "MAJOR"), row("UNLIKELY_MATCH", "DO_NOT_RECOMMEND", 0.8))
        .when((final >= 95) & (strong >= 2), row("MATCH", "AUTO_RECOMMEND", 0.93))
        .when(final >= 85, row("LIKELY_MATCH", "HUMAN_REVIEW", 0.85))
        .when(final >= 70, row("POSSIBLE_MATCH", "HUMAN_REVIEW", 0.65))
        .when(final >= 50, row("UNLIKELY_MATCH", "DO_NOT_RECOMMEND", 0.55))
        .otherwise(row("NOT_MATCH", "DO_NOT_RECOMMEND", 0.6))
    )


def tightened(action: Column, advised: Column) -> Column:
    """The analyst may lower an action, never raise it (RK5)."""
    order = F.array(F.lit("AUTO_RECOMMEND"), F.lit("HUMAN_REVIEW"), F.lit("DO_NOT_RECOMMEND"))
    return F.element_at(order, F.greatest(F.array_position(order, action), F.array_position(order, advised)).cast("int"))


def explanation(final: Column, level: Column, evidence: Column, conflicts: Column) -> Column:
    """A sentence from the strongest evidence (five at most) and the first conflicts (three at most) (RK4)."""
    for_it = F.filter(evidence, lambda e: ~e["is_conflict"] & (e["similarity_score"] >= 75))
    for_it = F.array_sort(for_it, lambda x, y: F.when(x["similarity_score"] > y["similarity_score"], F.lit(-1)).when(x["similarity_score"] < y["similarity_score"], F.lit(1)).when(x["field_name"] < y["field_name"], F.lit(-1)).otherwise(F.lit(1)))
    pros = F.array_join(F.transform(F.slice(for_it, 1, 5), lambda e: F.concat(e["field_name"], F.lit(" "), F.format_number(e["similarity_score"], 0))), ", ")
    cons = F.array_join(F.transform(F.slice(conflicts, 1, 3), lambda c: c["reason"]), "; ")
    return F.concat(F.format_string("%s (%.1f)", level, final), F.when(pros != "", F.concat(F.lit(": "), pros)).otherwise(""), F.when(cons != "", F.concat(F.lit(". Against: "), cons)).otherwise(""))


def run_matching(candidates: DataFrame, records: DataFrame, spec: DomainSpec = LOST_FOUND, scored: int = FUNNEL["scored"], reranked: int = FUNNEL["reranked"]) -> DataFrame:
    """Candidates (query_id, id, rrf_score, channel scores) to ranked, explained matches (RK2).

    The best ``scored`` candidates of a query by fusion are scored, the best
    ``reranked`` by score get the analyst's verdict, and all but IGNORE rows stay
    (rejected ones too, with a score of 0).
    """
    best = candidates.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rrf_score").desc(), "id"))).filter(F.col("_r") <= scored).drop("_r")
    side = F.struct(*records.columns)
    # Whichever record is the lost one stands on the lost side.
    kinds = records.select(F.col("id").alias("query_id"), F.col("record_type").alias("_kind"))
    turned = F.col("_kind") == "FOUND"
    best = best.join(kinds, "query_id").withColumns({"_l": F.when(turned, F.col("id")).otherwise(F.col("query_id")), "_f": F.when(turned, F.col("query_id")).otherwise(F.col("id"))}).drop("_kind")
    pairs = best.join(records.select(F.col("id").alias("_l"), side.alias("lost")), "_l").join(records.select(F.col("id").alias("_f"), side.alias("found")), "_f").drop("_l", "_f")
    out = scored_pairs(pairs, spec)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("final_score").desc(), F.col("rrf_score").desc(), "id")))
    out = out.withColumn("verdict", F.when(F.col("rank") <= reranked, verdict(F.col("final_score"), F.col("conflicts"), F.col("evidence"))))
    out = out.withColumn("action", F.coalesce(tightened(F.col("action"), F.col("verdict.recommended_action")), F.col("action")))
    out = out.withColumn("explanation", F.when(F.col("rank") <= reranked, explanation(F.col("final_score"), F.col("level"), F.col("evidence"), F.col("conflicts"))))
    return out.filter("level <> 'IGNORE'")


def search_view(matches: DataFrame, top_k: int = 10, include_low: bool = False) -> DataFrame:
    """What a search shows: no ignored or rejected rows unless asked for, the best ``top_k``, supporting evidence only (RK6)."""
    shown = matches if include_low else matches.filter(~F.col("level").isin("IGNORE", "REJECT"))
    shown = shown.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("final_score").desc(), "id"))).filter(F.col("_r") <= top_k)
    return shown.withColumn("evidence", F.filter("evidence", lambda e: ~e["is_conflict"])).drop("_r")


def match_list(candidates: DataFrame, evidence: DataFrame, items: DataFrame, least: float = 50.0, limit: int = 20) -> DataFrame:
    """Stored matches of each item from either side, best first, with ordered evidence (RK7, JN2).

    An item may stand on either side of a pair, so both directions are united
    and joined by equality.
    """
    both = candidates.select(F.col("lost_id").alias("item_id"), F.col("found_id").alias("other_id"), "*").unionByName(candidates.select(F.col("found_id").alias("item_id"), F.col("lost_id").alias("other_id"), "*"))
    both = both.join(items.select(F.col("id").alias("item_id")), "item_id", "left_semi").filter(F.col("final_score") >= least)
    both = both.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("final_score").desc(), "other_id"))).filter(F.col("rank") <= limit)
    rows = evidence.groupBy("lost_id", "found_id").agg(F.array_sort(F.collect_list(F.struct("is_conflict", (-F.col("contribution")).alias("order"), "field_name", "evidence_type", "similarity_score"))).alias("evidences"))
    return both.join(rows, ["lost_id", "found_id"], "left")


def stored_explanation(matches: DataFrame) -> DataFrame:
    """Explanations from stored evidence alone (RK8)."""
    pros = F.slice(F.filter("evidences", lambda e: ~e["is_conflict"]), 1, 5)
    cons = F.slice(F.filter("evidences", lambda e: e["is_conflict"]), 1, 3)
    names = lambda rows: F.array_join(F.transform(rows, lambda e: e["field_name"]), ", ")
    return matches.withColumn("explanation", F.concat_ws("; ", F.concat(F.lit("for: "), names(pros)), F.when(F.size(cons) > 0, F.concat(F.lit("against: "), names(cons)))))


def verify_secret(answers: Column, secrets: Column) -> Column:
    """Whether every secret attribute is answered, each value inside the other either way (RK9). Both are code -> value maps; no secrets, no proof."""
    from recordloom.functions.text import norm_text

    def meets(code: Column) -> Column:
        want, got = norm_text(F.element_at(secrets, code)), norm_text(F.try_element_at(answers, code))
        return (got != "") & (want.contains(got) | got.contains(want))

    return (F.size(F.map_keys(secrets)) > 0) & F.forall(F.map_keys(secrets), meets)
