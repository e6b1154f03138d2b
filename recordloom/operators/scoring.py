"""The scoring kernel (SC1-SC9): a spec and feature columns in, score columns out, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.config import LOST_FOUND, DomainSpec
from recordloom.operators.conflicts import costs, has_critical, penalty, rejected
from recordloom.operators.features import IDENTITY_CODES


def total(parts: list[Column]) -> Column:
    out = F.lit(0.0)
    for p in parts:
        out = out + p
    return out


def weights_for(spec: DomainSpec, category: Column | None) -> dict[str, Column]:
    """Each dimension's weight, by category where the spec has its own (SC1)."""
    out = {}
    for d in spec.dimensions:
        w = F.lit(float(spec.weights[d]))
        for c, own in spec.category_weights.items() if category is not None else ():
            w = F.when(category == c, F.lit(float(own[d]))).otherwise(w)
        out[d] = w
    return out


def weighted_mean(features: dict[str, Column], weights: dict[str, Column]) -> Column:
    """Mean of known scores by weight and reliability; 0 if none is known (SC2)."""
    trust = {d: F.coalesce(F.nullif(f["reliability"], F.lit(0.0)), F.lit(1.0)) for d, f in features.items()}
    mass = {d: F.when(f["score"].isNotNull(), weights[d] * trust[d]).otherwise(0.0) for d, f in features.items()}
    num = total([mass[d] * F.coalesce(f["score"], F.lit(0.0)) for d, f in features.items()])
    den = total(list(mass.values()))
    return F.when(den > 0, F.round(num / den, 4)).otherwise(0.0)


def bonus(spec: DomainSpec, distinctive: Column | None, attributes: Column | None) -> Column:
    """For strong marks (3 each, two at most) and for an equal identity number (6), up to the cap (SC3)."""
    out = F.lit(0.0)
    if distinctive is not None:
        strong = F.size(F.filter(F.coalesce(distinctive, F.array()), lambda c: F.coalesce(c["score"] >= 90, F.lit(False))))
        out = out + 3.0 * F.least(strong, F.lit(2))
    if attributes is not None:
        out = out + F.when(F.exists(F.coalesce(attributes, F.array()), lambda c: c["field"].isin(*IDENTITY_CODES) & F.coalesce(c["score"] >= 100, F.lit(False))), 6.0).otherwise(0.0)
    return F.round(F.least(out, F.lit(float(spec.bonus_cap))), 4)


def coverage(spec: DomainSpec, features: dict[str, Column], weights: dict[str, Column]) -> Column:
    """Weight of the known dimensions over all weight (SC5)."""
    used = total([F.when(features[d]["score"].isNotNull(), weights[d]).otherwise(0.0) for d in spec.dimensions])
    whole = total([weights[d] for d in spec.dimensions])
    return F.when(whole > 0, used / whole).otherwise(0.0)


def band(spec: DomainSpec, final: Column, covered: Column, identity: Column, critical: Column) -> Column:
    """The place of a score's band, lowered by caps (SC6). Bands are tried from the top and hold both ends."""
    place = {b[0]: i for i, b in enumerate(spec.bands)}
    at = F.lit(len(spec.bands) - 1)
    for i, (_, low, high, _) in reversed(list(enumerate(spec.bands))):
        at = F.when((final >= low) & (final <= high), F.lit(i)).otherwise(at)
    caps = [F.when(critical, place[spec.critical_cap]).otherwise(0), F.when(~identity, place[spec.identity_cap]).otherwise(0)]
    caps += [F.when(covered < below, place[cap]).otherwise(0) for below, cap in spec.coverage_caps]
    return F.greatest(at, *caps)


def named(spec: DomainSpec, at: Column, reject: Column) -> tuple[Column, Column]:
    """Level and action of a band."""
    names, actions = (F.array(*[F.lit(b[k]) for b in spec.bands]) for k in (0, 3))
    return F.when(reject, F.lit("REJECT")).otherwise(F.element_at(names, at + 1)), F.when(reject, F.lit("DO_NOT_RECOMMEND")).otherwise(F.element_at(actions, at + 1))


def confidence(features: dict[str, Column], critical: Column, spec: DomainSpec = LOST_FOUND) -> Column:
    """How sure the verdict is, from coverage and mean reliability (SC7). Always by the default weights of ``spec``."""
    covered = total([F.when(features[d]["score"].isNotNull(), float(spec.weights[d])).otherwise(0.0) if d in features else F.lit(0.0) for d in spec.dimensions]) / float(sum(spec.weights.values()))
    trusted = [F.when(f["score"].isNotNull() & (f["reliability"] > 0), f["reliability"]) for f in features.values()]
    many = total([F.when(t.isNotNull(), 1.0).otherwise(0.0) for t in trusted])
    mean = F.when(many > 0, total([F.coalesce(t, F.lit(0.0)) for t in trusted]) / many).otherwise(0.7)
    value = 0.6 * covered + 0.4 * mean
    return F.round(F.least(F.lit(0.99), F.when(critical, F.greatest(value, F.lit(0.9))).otherwise(value)), 4)


def with_score(df: DataFrame, spec: DomainSpec, features: dict[str, Column], conflicts: Column, category: Column | None = None, children: dict[str, Column] | None = None, keep: bool = False) -> DataFrame:
    """Adds the kernel's columns (SC4, SC9): base_score, bonus, penalty, final_score, coverage, level, action, confidence.

    Built in layers, so that each part is computed once however many later
    ones use it. ``children`` are the parts of the distinctive and attribute
    dimensions; ``keep`` also adds ``conflicts`` and ``evidence``.
    """
    parts = children or {}
    names = [f"_f_{d}" for d in features] + [f"_p_{d}" for d in parts] + ["_conflicts", "_category"]
    first = {f"_f_{d}": f for d, f in features.items()} | {f"_p_{d}": c for d, c in parts.items()}
    out = df.withColumns(first | {"_conflicts": conflicts, "_category": F.lit(None).cast("string") if category is None else category})
    found = {d: F.col(f"_f_{d}") for d in features}
    part = {d: F.col(f"_p_{d}") for d in parts}
    weights = weights_for(spec, F.col("_category") if category is not None else None)
    broken = F.col("_conflicts")
    identity = F.lit(False)
    for d in spec.identity_dimensions:
        if d in features:
            identity = identity | found[d]["score"].isNotNull()
    out = out.withColumns({"base_score": weighted_mean(found, weights), "bonus": bonus(spec, part.get("distinctive"), part.get("attribute")), "penalty": penalty(costs(broken)), "coverage": coverage(spec, found, weights), "_critical": has_critical(broken), "_reject": rejected(broken), "_identity": identity})
    final = F.when(F.col("_reject"), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("base_score") - F.col("penalty") + F.col("bonus"))), 4))
    out = out.withColumn("final_score", final).withColumn("_band", band(spec, F.col("final_score"), F.col("coverage"), F.col("_identity"), F.col("_critical")))
    label, action = named(spec, F.col("_band"), F.col("_reject"))
    out = out.withColumns({"level": label, "action": action, "confidence": confidence(found, F.col("_critical"))})
    if keep:
        out = out.withColumns({"conflicts": broken, "evidence": evidence(found, weights, part, broken)})
    return out.drop(*names, "_critical", "_reject", "_identity", "_band")


def evidence(features: dict[str, Column], weights: dict[str, Column], children: dict[str, Column], conflicts: Column) -> Column:
    """Evidence rows as one array, to be exploded (SC8): parts stand for their dimension, conflicts count negative."""
    row = "array<struct<evidence_type:string,field_name:string,similarity_score:double,reliability:double,weight:double,contribution:double,is_conflict:boolean,severity:string>>"

    def as_row(kind: str, field: Column, value: Column, trust: Column, weight: Column, share: Column) -> Column:
        return F.struct(F.lit(kind).alias("evidence_type"), field.alias("field_name"), value.alias("similarity_score"), trust.alias("reliability"), weight.alias("weight"), F.round(share, 4).alias("contribution"), F.lit(False).alias("is_conflict"), F.lit(None).cast("string").alias("severity"))

    def rows_of(kind: str):
        return lambda c: as_row(kind, c["field"], c["score"], c["reliability"], c["weight"], c["contribution"])

    parts = []
    for d, f in features.items():
        kind = d.upper()
        alone = F.when(f["score"].isNotNull(), F.array(as_row(kind, F.lit(d), f["score"], f["reliability"], weights[d], weights[d] * f["reliability"] * f["score"])))
        if d in children:
            known = F.filter(F.coalesce(children[d], F.array()), lambda c: c["score"].isNotNull())
            inner = F.transform(known, rows_of(kind))
            alone = F.when(F.size(known) > 0, inner).otherwise(alone)
        parts.append(F.coalesce(alone.cast(row), F.array().cast(row)))
    against = F.transform(conflicts, lambda c: F.struct(F.lit("CONFLICT").alias("evidence_type"), c["field"].alias("field_name"), F.lit(0.0).alias("similarity_score"), F.lit(1.0).alias("reliability"), F.lit(0.0).alias("weight"), (-c["penalty"]).alias("contribution"), F.lit(True).alias("is_conflict"), c["severity"].alias("severity")))
    return F.concat(*parts, against.cast(row))
