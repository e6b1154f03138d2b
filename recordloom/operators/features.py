"""Pair features (FT1-FT9): columns from two sides to struct(score, reliability, relation, conflict).

A null score means that a side is missing: the dimension then leaves the
weighted mean altogether, it never counts as a mismatch.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.config import PROFILES, RELIABILITY, TAU, ZONE_SCORES
from recordloom.functions.dictionary import color_family
from recordloom.functions.geo import haversine, zone
from recordloom.functions.text import char_set, let, model_tokens, norm_text, overlap_coefficient, text_overlap, token_set

IDENTITY_CODES = ("serial_number", "imei", "passport_number")


def feature(score: Column, reliability: Column | float = 1.0, relation: Column | str | None = None, conflict: Column | bool = False) -> Column:
    lit = lambda v, kind: v if isinstance(v, Column) else F.lit(v).cast(kind)
    return F.struct(score.cast("double").alias("score"), lit(reliability, "double").alias("reliability"), lit(relation, "string").alias("relation"), F.coalesce(lit(conflict, "boolean"), F.lit(False)).alias("conflict"))


def category(lost: Column, found: Column, lost_candidates: Column | None = None, found_candidates: Column | None = None, uncertain: Column | None = None, lost_parent: Column | None = None, found_parent: Column | None = None) -> Column:
    """Same 100, same parent 70, parent and child 30, else 0 as a major conflict; open candidates decide only by overlap (FT1)."""
    a, b = F.nullif(lost, F.lit("")), F.nullif(found, F.lit(""))
    open_ = F.lit(False) if uncertain is None else F.coalesce(uncertain, F.lit(False))
    own = lambda c, v: F.array(norm_text(v)) if c is None else F.transform(F.when(F.coalesce(F.size(c), F.lit(0)) > 0, c).otherwise(F.array(v)), lambda x: norm_text(x))
    meets = F.arrays_overlap(own(lost_candidates, a), own(found_candidates, b))
    none = F.lit(None).cast("string")
    pa, pb = none if lost_parent is None else lost_parent, none if found_parent is None else found_parent
    same = norm_text(a) == norm_text(b)
    siblings, direct = F.coalesce(pa == pb, F.lit(False)), F.coalesce(pa == b, F.lit(False)) | F.coalesce(pb == a, F.lit(False))
    missing = a.isNull() | b.isNull()
    score = F.when(missing, None).when(open_, F.when(meets, 100.0)).when(same, 100.0).when(siblings, 70.0).when(direct, 30.0).otherwise(0.0)
    relation = F.when(missing, None).when(open_, F.when(meets, "SEMANTIC_MATCH")).when(same, "EXACT_MATCH").when(siblings | direct, "PARTIAL_MATCH").otherwise("MAJOR_CONFLICT")
    return feature(score, F.when(open_, 0.7).otherwise(1.0), relation, relation == "MAJOR_CONFLICT")


def attribute_similarity(code: Column, a: Column, b: Column) -> Column:
    """Similarity of two values of an attribute (FT2a)."""
    known = F.struct(a.alias("a"), b.alias("b"), norm_text(a).alias("na"), norm_text(b).alias("nb"))

    def models(p: Column) -> Column:
        least = F.least(F.size(p["x"]), F.size(p["y"]))
        prefix = F.when(least == 0, F.lit(True)).otherwise(F.slice(p["x"], F.lit(1), least) == F.slice(p["y"], F.lit(1), least))
        return F.when(p["x"] == p["y"], 100.0).when(prefix, 30.0).otherwise(0.0)

    def value(p: Column) -> Column:
        words = let(text_overlap(p["a"], p["b"]), lambda r: F.when(r >= 0.75, F.round(60 + 40 * r, 2)).when(r >= 0.4, F.round(50 + 30 * r, 2)).otherwise(0.0))
        return (
            F.when((p["na"] == "") | (p["nb"] == ""), 0.0)
            .when(p["na"] == p["nb"], 100.0)
            .when(code == "color", F.when(color_family(p["a"]) == color_family(p["b"]), 80.0).otherwise(0.0))
            .when(code == "model", let(F.struct(model_tokens(p["a"]).alias("x"), model_tokens(p["b"]).alias("y")), models))
            .when(code.isin(*IDENTITY_CODES), 0.0)
            .when(p["na"].contains(p["nb"]) | p["nb"].contains(p["na"]), 85.0)
            .otherwise(words)
        )

    return let(known, value)


def profile_weight(category_code: Column, code: Column, profiles: Mapping[str, Mapping[str, float]] = PROFILES) -> Column:
    """Weight of an attribute in its category's profile; the default profile has a weight for unknown categories, others weigh 1."""
    weights = lambda p: F.create_map(*[F.lit(x) for k, v in p.items() for x in (k, float(v))])
    out = weights(profiles["default"])
    for name, profile in profiles.items():
        if name != "default":
            out = F.when(category_code == name, weights(profile)).otherwise(out)
    return F.coalesce(F.try_element_at(out, code), F.lit(1.0))


def reliability_of(source: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in RELIABILITY.items() for x in p]), source), F.lit(RELIABILITY["USER"]))


def attribute(lost: Column, found: Column, category_code: Column, mass: float = 8.0, floor: float = 0.25) -> tuple[Column, Column]:
    """The weighted mean over shared attributes, and its parts (FT2b).

    Sides are map<code, struct<value, source>>. Little evidence weighs little:
    the reliability is the compared weight over ``mass``, ``floor`` at least.
    """
    codes = F.filter(F.array_sort(F.array_intersect(F.map_keys(lost), F.map_keys(found))), lambda c: c != "distinctive")

    def known(code: Column) -> Column:
        a, b = F.element_at(lost, code), F.element_at(found, code)
        trust = F.least(reliability_of(a["source"]), reliability_of(b["source"]))
        return F.struct(code.alias("field"), F.nullif(a["value"], F.lit("")).alias("x"), F.nullif(b["value"], F.lit("")).alias("y"), trust.alias("trust"))

    def compared(c: Column) -> Column:
        both = c["x"].isNotNull() & c["y"].isNotNull()
        return F.struct(c.alias("c"), F.when(both, attribute_similarity(c["field"], c["x"], c["y"])).alias("score"), F.when(both, profile_weight(category_code, c["field"])).otherwise(0.0).alias("weight"), F.when(both, c["trust"]).otherwise(1.0).alias("r"))

    def child(p: Column) -> Column:
        c = p["c"]
        return F.struct(c["field"].alias("field"), p["score"].alias("score"), p["r"].alias("reliability"), c["x"].alias("lost_value"), c["y"].alias("found_value"), p["weight"].alias("weight"), F.coalesce(p["weight"] * p["r"] * p["score"], F.lit(0.0)).alias("contribution"))

    children = F.transform(F.transform(F.transform(codes, known), compared), child)
    return attribute_mean(children, mass, floor), children


def attribute_mean(children: Column, mass: float = 8.0, floor: float = 0.25) -> Column:
    """The attribute dimension from its parts."""
    sums = F.aggregate(children, F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den")), lambda s, c: F.struct((s["num"] + c["contribution"]).alias("num"), (s["den"] + c["weight"] * c["reliability"]).alias("den")))
    return let(sums, lambda s: feature(F.when(s["den"] > 0, F.round(s["num"] / s["den"], 4)), F.round(F.greatest(F.lit(floor), F.least(F.lit(1.0), s["den"] / mass)), 4), "AGGREGATE"))


def location(lost: Column, found: Column, tau_m: Column | float = TAU["location_tau_m"], nearest: bool = False) -> Column:
    """By tree relation, else by distance, else by name (FT3c). Sides are ``schema.LOCATION`` structs."""
    z = zone(lost, found, nearest)
    by_zone = F.try_element_at(F.create_map(*[F.lit(x) for p in ZONE_SCORES.items() for x in p]), z)
    there = lost["lat"].isNotNull() & lost["lon"].isNotNull() & found["lat"].isNotNull() & found["lon"].isNotNull()
    tau = F.greatest(tau_m if isinstance(tau_m, Column) else F.lit(float(tau_m)), F.lit(1.0))
    by_distance = F.when(there, F.round(100 * F.exp(-haversine(lost["lat"], lost["lon"], found["lat"], found["lon"]) / tau), 4))
    by_name = F.when(norm_text(lost["name"]) == norm_text(found["name"]), 100.0).otherwise(0.0)
    score = F.when(lost.isNotNull() & found.isNotNull(), F.coalesce(by_zone, by_distance, by_name))
    return feature(score, 1.0, F.when(z == "SAME_LOCATION", "EXACT_MATCH").when(z.isNotNull() | there, "SEMANTIC_MATCH").when(by_name > 0, "EXACT_MATCH").otherwise("MINOR_CONFLICT"))


def hours_between(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 3.6e9


def time(start: Column, end: Column, found: Column, tau_hours: Column | float = TAU["time_tau_hours"]) -> Column:
    """100 inside the interval, else decay with the nearer end (FT4)."""
    gap = F.least(hours_between(found, start), hours_between(found, end))
    tau = F.greatest(tau_hours if isinstance(tau_hours, Column) else F.lit(float(tau_hours)), F.lit(0.1))
    inside = F.coalesce(found.between(start, end), F.lit(False))
    return feature(F.when(inside, 100.0).otherwise(F.round(100 * F.exp(-gap / tau), 4)), 1.0, F.when(inside, "EXACT_MATCH").otherwise("SEMANTIC_MATCH"))


def distinctive(lost: Column, found: Column) -> tuple[Column, Column]:
    """For each mark of the lost side the best partner; their mean, and the parts (FT5)."""
    have = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    # Normalised once a side, not once a pair.
    ready = lambda c: F.transform(have(c), lambda x: F.struct(x.alias("raw"), norm_text(x).alias("norm"), char_set(x).alias("chars"), token_set(x).alias("tokens")))
    left, right = ready(lost), ready(found)

    def best(mark: Column) -> Column:
        def against(other: Column, i: Column) -> Column:
            ratio = F.greatest(overlap_coefficient(mark["chars"], other["chars"]), overlap_coefficient(mark["tokens"], other["tokens"]))
            inside = mark["norm"].contains(other["norm"]) | other["norm"].contains(mark["norm"])
            score = F.when(mark["norm"] == other["norm"], 100.0).when(inside, 90.0).when(ratio >= 0.75, 90.0).when(ratio >= 0.4, 70.0).otherwise(20.0)
            return F.struct(score.alias("score"), (-i).alias("first"), other["raw"].alias("partner"))

        top = F.array_max(F.transform(right, against))
        return F.struct(F.lit("distinctive_feature").alias("field"), top["score"].alias("score"), F.lit(1.0).alias("reliability"), mark["raw"].alias("lost_value"), top["partner"].alias("found_value"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("contribution"))

    both = (F.size(left) > 0) & (F.size(right) > 0)
    children = F.when(both, F.transform(left, best))
    mean = F.aggregate(children, F.lit(0.0), lambda s, c: s + c["score"]) / F.size(children)
    return feature(F.when(both, F.round(mean, 4)), 1.0, "AGGREGATE"), children


def semantic(cos: Column) -> Column:
    """Cosine as a score (FT6); also image similarity (FT8)."""
    return feature(F.when(cos.isNotNull(), F.round(F.greatest(F.lit(0.0), cos) * 100, 4)), 1.0, "SEMANTIC_MATCH")


def keyword(rank: Column) -> Column:
    """An open-ended rank as a score below 100 (FT7)."""
    return feature(F.round(100 * rank / (rank + 1), 4), 1.0, "PARTIAL_MATCH")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets as a score; null where one is empty (FT9)."""
    both = (F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0) & (F.size(F.coalesce(b, F.array().cast("array<string>"))) > 0)
    return feature(F.when(both, F.round(100 * F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 4)), 1.0, "PARTIAL_MATCH")


def exam_features(a: str, b: str, stem_cos: Column, answer_cos: Column, keyword_sim: Column) -> dict[str, Column]:
    """The six dimensions of a question pair; ``a`` and ``b`` are struct columns (FT9). A keyword similarity of 0 is missing."""
    x, y = F.col(a), F.col(b)
    return {"stem": semantic(stem_cos), "answer": semantic(answer_cos), "services": jaccard(x["services"], y["services"]), "kps": jaccard(x["kps"], y["kps"]), "constraints": jaccard(x["constraints"], y["constraints"]), "keyword": semantic(F.nullif(keyword_sim, F.lit(0.0)))}
