"""Alias dictionaries: lookups as joins with a small table, and boundary rules as regular expressions (NRM2-6, 11, 12, 20-22)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.config import ATTRIBUTE_ALIASES, COLOR_FAMILIES, SYNONYMS
from recordloom.functions.text import PUNCTUATION, let, norm_text

IDEOGRAPH = "[一-鿿㐀-䶿]"
#: Dictionaries are configuration; a larger one than this must be joined without a broadcast.
MAX_BROADCAST_ALIASES = 100_000


def plain(value: str) -> str:
    """Dictionary entries are normalised on the driver, as texts are on the executors."""
    s = unicodedata.normalize("NFKC", value).strip().lower()
    return " ".join("".join(" " if ch in PUNCTUATION else ch for ch in s).split())


def alias_rows(section: Mapping[str, Iterable[str]]) -> list[tuple[str, str, int]]:
    """(alias, canonical, position) with later entries winning an alias; names with an underscore in front are notes."""
    table: dict[str, tuple[str, int]] = {}
    place = 0
    for canonical, aliases in section.items():
        if canonical.startswith("_"):
            continue
        for alias in (canonical, *aliases):
            if a := plain(alias):
                table[a] = (canonical, place)
                place += 1
    return [(a, c, p) for a, (c, p) in table.items()]


def alias_table(spark: SparkSession, section: Mapping[str, Iterable[str]]) -> DataFrame:
    return spark.createDataFrame(alias_rows(section), "alias string, canonical string, place int")


def canonical(c: Column, section: Mapping[str, Iterable[str]], strict: bool = False) -> Column:
    """The canonical value: by whole alias, else by the longest alias of two characters or more inside the text (NRM3).

    The dictionary is compiled into the plan, so nothing is joined or shuffled.
    Without a hit: null if ``strict``, else the normalised text.
    """
    rows = alias_rows(section)

    def value(n: Column) -> Column:
        out = F.lit(None).cast("string") if strict else n
        for a, k, _ in sorted((r for r in rows if len(r[0]) >= 2), key=lambda r: (len(r[0]), -r[2])):
            out = F.when(n.contains(a), F.lit(k)).otherwise(out)
        if not rows:
            return out
        whole = F.create_map(*[F.lit(x) for a, k, _ in rows for x in (a, k)])
        return F.when(n.isNotNull(), F.coalesce(F.try_element_at(whole, n), out))

    return let(F.nullif(norm_text(c), F.lit("")), value)


def canonical_category(c: Column, synonyms: Mapping[str, Mapping[str, Iterable[str]]] = SYNONYMS) -> Column:
    """The category that a name stands for; null for an unknown one (NRM4)."""
    return canonical(c, synonyms["category"], strict=True)


def canonical_brand(c: Column, synonyms: Mapping[str, Mapping[str, Iterable[str]]] = SYNONYMS) -> Column:
    """The brand that a name stands for; null for an unknown one (NRM4)."""
    return canonical(c, synonyms["brand"], strict=True)


def canonical_color(c: Column, synonyms: Mapping[str, Mapping[str, Iterable[str]]] = SYNONYMS) -> Column:
    """The color that a name stands for; an unknown one as it is, normalised (NRM4)."""
    return canonical(c, synonyms["color"])


def attribute_code(c: Column, aliases: Mapping[str, str] = ATTRIBUTE_ALIASES) -> Column:
    """One code for each attribute name: exact alias, alias without regard to case, lower case (NRM5)."""
    exact = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    low: dict[str, str] = {}
    for k, v in aliases.items():
        low.setdefault(k.lower(), v)
    loose = F.create_map(*[F.lit(x) for pair in low.items() for x in pair])
    name = F.trim(c)
    return F.coalesce(F.try_element_at(exact, name), F.try_element_at(loose, F.lower(name)), F.lower(name), F.lit(""))


def color_family(c: Column, families: Mapping[str, Iterable[str]] = COLOR_FAMILIES) -> Column:
    """The family of a color: by whole name, else the first family with a member inside the text, else the text itself (NRM6)."""
    names = [(f, [m for m in map(plain, members) if m]) for f, members in families.items()]

    def family(n: Column) -> Column:
        out = n
        for f, members in reversed(names):
            out = F.when(n.rlike("|".join(map(re.escape, members))), F.lit(f)).otherwise(out)
        for f, members in reversed(names):
            out = F.when(n.isin(members), F.lit(f)).otherwise(out)
        return out

    return let(F.nullif(norm_text(c), F.lit("")), family)


def alias_pattern(alias: str, short: int | None = None) -> str:
    """A regular expression with the boundaries that an alias needs (NRM11, NRM20).

    Plain words match as whole words; with ``short``, only words of at most so
    many letters do, longer ones anywhere. One ideograph matches where no
    ideograph stands beside it. Any other single character must be the whole text.
    """
    if re.fullmatch("[a-z0-9]+", alias):
        if short is not None and len(alias) > short:
            return alias
        return f"(?<![a-z0-9]){alias}(?![a-z0-9])"
    if short is None and len(alias) == 1:
        return f"(?<!{IDEOGRAPH}){alias}(?!{IDEOGRAPH})" if re.fullmatch(IDEOGRAPH, alias) else f"^{re.escape(alias)}$"
    return re.escape(alias)


def all_hits(c: Column, section: Mapping[str, Iterable[str]]) -> Column:
    """Every canonical value that some alias finds in a text, longest alias first: array of (canonical, alias) (NRM12)."""
    n = norm_text(c)
    entries: list[tuple[int, int, str, str]] = []
    for i, (k, aliases) in enumerate((k, a) for k, a in section.items() if not k.startswith("_")):
        entries += [(-len(a), i * 1000 + j, k, a) for j, a in enumerate(map(plain, (k, *aliases))) if a]
    entries.sort()
    if not entries:
        return F.array().cast("array<struct<canonical:string,alias:string>>")
    hits = let(n, lambda t: F.array_compact(F.array(*[F.when(t.rlike(alias_pattern(a)), F.struct(F.lit(k).alias("canonical"), F.lit(a).alias("alias"))) for _, _, k, a in entries])))
    # The first hit of each canonical value.
    return let(hits, lambda h: F.filter(h, lambda x, i: F.array_position(F.transform(h, lambda y: y["canonical"]), x["canonical"]) == i + 1))


def tag_longest(docs: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """(key, canonical, alias) of the longest alias in each text, by a join with a small table; ties by canonical.

    Whole-word aliases only: texts are split to words and runs of words, so the
    join is an equi-join and the dictionary may be of any size.
    """
    longest = aliases.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1
    words = docs.select(key, F.split(norm_text(F.col(text)), " ").alias("_w"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(int(longest))), lambda n: F.when(n <= F.size("_w"), F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.array_join(F.slice("_w", i, n), " "))).otherwise(F.array().cast("array<string>"))))
    found = words.select(key, F.explode(F.array_distinct(runs)).alias("alias")).join(aliases.select("alias", "canonical"), "alias")
    best = Window.partitionBy(key).orderBy(F.length("alias").desc(), "canonical")
    return found.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select(key, "canonical", "alias")


def tag_set(c: Column, section: Mapping[str, Iterable[str]], short: int | None = 4) -> Column:
    """The sorted set of canonical values with an alias in the text (NRM20); ``short`` None: any substring counts (NRM21)."""
    patterns = []
    for k, aliases in section.items():
        names = [a for a in map(plain, (k, *aliases) if short is not None else aliases) if a]
        if names:
            pattern = "|".join(alias_pattern(a, short) if short is not None else re.escape(a) for a in names)
            patterns.append((k, pattern))
    if not patterns:
        return F.array().cast("array<string>")
    return let(norm_text(c), lambda n: F.array_sort(F.array_compact(F.array(*[F.when(n.rlike(p), F.lit(k)) for k, p in patterns]))))


def canonical_term(c: Column, prefixes: Iterable[str], synonyms: Mapping[str, Iterable[str]]) -> Column:
    """A knowledge point without one vendor prefix, by the synonym table; points are never merged by containment (NRM22)."""
    n = norm_text(c)
    names = [plain(p) for p in prefixes]
    if names:
        n = F.regexp_replace(n, "^(?:" + "|".join(map(re.escape, names)) + ") ", "")
    table = {a: k for a, k, _ in alias_rows(synonyms)}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), n), n) if table else n
