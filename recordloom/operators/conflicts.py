"""Conflict rules compiled to columns (CF1-CF4)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.config import EXCLUSIVE_GOALS, RULES, Rule
from recordloom.functions.dictionary import color_family
from recordloom.functions.text import let, model_tokens, norm_text
from recordloom.schema import CONFLICT


def _apart(a: Column, b: Column) -> Column:
    return let(F.struct(norm_text(a).alias("a"), norm_text(b).alias("b")), lambda p: (p["a"] != p["b"]) & ~p["a"].contains(p["b"]) & ~p["b"].contains(p["a"]))


def _models(a: Column, b: Column) -> Column:
    return let(F.struct(model_tokens(a).alias("a"), model_tokens(b).alias("b")), lambda p: (F.size(p["a"]) > 0) & (F.size(p["b"]) > 0) & (p["a"] != p["b"]))


#: What counts as a conflict of two known values (CF1).
COMPARATORS: dict[str, Callable[[Column, Column], Column]] = {
    "exact": lambda a, b: norm_text(a) != norm_text(b),
    "normalized": _apart,
    "color": lambda a, b: F.coalesce(color_family(a) != color_family(b), F.lit(False)),
    "model": _models,
}


def conflict(field: str, severity: str, lost: Column, found: Column, penalty: float, reason: str, reject: bool) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(severity).alias("severity"), lost.cast("string").alias("lost_value"), found.cast("string").alias("found_value"), F.lit(penalty).alias("penalty"), F.lit(reason).alias("reason"), F.lit(reject).alias("reject"))


def core_first(attributes: Column, core: dict[str, Column]) -> Column:
    """An attribute map (code -> value) with record fields where it has no own value."""
    extra = F.map_filter(F.create_map(*[x for k, v in core.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull() & (v != "") & ~F.coalesce(F.map_contains_key(attributes, k), F.lit(False)))
    return F.map_concat(F.coalesce(attributes, F.create_map().cast("map<string,string>")), extra)


def conflicts(lost: Column, found: Column, uncertain_category: Column | None = None, rules: Iterable[Rule] = RULES) -> Column:
    """All rules that two value maps break, in rule order (CF2). A missing side breaks none."""
    known = lambda m, k: F.nullif(F.try_element_at(m, F.lit(k)), F.lit(""))
    found_ones = []
    for r in rules:
        a, b = known(lost, r.attribute), known(found, r.attribute)
        hit = a.isNotNull() & b.isNotNull() & COMPARATORS[r.comparator](a, b)
        if r.attribute == "category" and uncertain_category is not None:
            hit = hit & ~F.coalesce(uncertain_category, F.lit(False))
        found_ones.append(F.when(hit, conflict(r.attribute, r.severity, a, b, r.cost, r.reason, r.reject)))
    return F.array_compact(F.array(*found_ones)).cast(f"array<{CONFLICT}>")


def penalty(costs: Column) -> Column:
    """The largest cost and half of the others (CF3); 0 without any."""
    sums = lambda c: F.round((F.array_max(c) + F.aggregate(c, F.lit(0.0), lambda s, x: s + x)) / 2, 4)
    return F.coalesce(let(costs, sums), F.lit(0.0))


def costs(found: Column) -> Column:
    return F.transform(found, lambda c: c["penalty"])


def has_critical(found: Column) -> Column:
    return F.exists(found, lambda c: c["severity"] == "CRITICAL")


def rejected(found: Column) -> Column:
    return F.exists(found, lambda c: c["reject"])


def exam_conflicts(a: Column, b: Column) -> Column:
    """Conflicts of two questions: number of choices, exclusive goals (one at most), no common service (CF4)."""
    only_a, only_b = F.array_except(a["constraints"], b["constraints"]), F.array_except(b["constraints"], a["constraints"])
    goals = F.lit(None)
    for pair in reversed(EXCLUSIVE_GOALS):
        both = F.array(*[F.lit(g) for g in pair])
        x, y = F.array_sort(F.array_intersect(only_a, both)), F.array_sort(F.array_intersect(only_b, both))
        goals = F.when((F.size(x) > 0) & (F.size(y) > 0), conflict("constraints", "CRITICAL", F.array_join(x, ", "), F.array_join(y, ", "), 45.0, "goals exclude each other", False)).otherwise(goals)
    disjoint = (F.size(a["services"]) > 0) & (F.size(b["services"]) > 0) & ~F.arrays_overlap(a["services"], b["services"])
    return F.array_compact(F.array(
        F.when(a["select_n"] != b["select_n"], conflict("select_n", "CRITICAL", a["select_n"], b["select_n"], 60.0, "different number of choices", False)),
        goals,
        F.when(disjoint, conflict("services", "MAJOR", F.array_join(a["services"], ", "), F.array_join(b["services"], ", "), 35.0, "no common service", False)),
    )).cast(f"array<{CONFLICT}>")
