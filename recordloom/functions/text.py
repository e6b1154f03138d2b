"""Text normalisation as Column expressions (NRM1, 7-10, 13, 14, 23, 24, 26, 29)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as blanks in normalised text.
PUNCTUATION = "·・.,，。、!！?？:：;；-_/\\()（）[]【】\"'“”‘’"
#: Every character that Unicode counts as white space.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(i) for i in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"


#: One pass of character replacement does punctuation and white space; a regular expression a step costs ten times that.
BLANKS = "".join(dict.fromkeys(PUNCTUATION + SPACES))


def nfkc(c: Column) -> Column:
    """Unicode NFKC by the ICU library that Spark brings along for its collations; null as empty.

    Spark calls the method by its name and takes it for non-deterministic: the
    result may be selected, filtered by and grouped by, but not stand inside a
    join condition or an aggregate. Select it first.
    """
    return F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(True))


def norm_text(c: Column) -> Column:
    """NFKC, lower case, punctuation as blanks, single blanks, trimmed; null as empty."""
    s = F.lower(F.translate(nfkc(c), BLANKS, " " * len(BLANKS)))
    return F.trim(F.regexp_replace(s, " +", " "))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it; else the plan would hold a copy each time."""
    return F.element_at(F.transform(F.array(value), body), 1)


def some(values: Column) -> Column:
    """An array without its empty strings."""
    return F.filter(values, lambda x: x != "")


def char_set(c: Column, normal: bool = False) -> Column:
    n = c if normal else norm_text(c)
    return F.array_distinct(some(F.split(F.replace(n, F.lit(" "), F.lit("")), "")))


def token_set(c: Column, normal: bool = False) -> Column:
    return F.array_distinct(some(F.split(c if normal else norm_text(c), " ")))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared share of the smaller set; 0 where one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def text_overlap(a: Column, b: Column) -> Column:
    """The larger of character-set and token-set overlap (NRM10); word sets alone would miss text without blanks."""
    parts = lambda n: F.struct(char_set(n, True).alias("c"), token_set(n, True).alias("t"))
    return let(F.struct(let(norm_text(a), parts).alias("a"), let(norm_text(b), parts).alias("b")), lambda p: F.greatest(overlap_coefficient(p["a"]["c"], p["b"]["c"]), overlap_coefficient(p["a"]["t"], p["b"]["t"])))


def model_tokens(c: Column) -> Column:
    return some(F.split(norm_text(c), "[^a-z0-9]+"))


def canonical_model(c: Column) -> Column:
    return F.nullif(F.array_join(model_tokens(c), " "), F.lit(""))


def canonical_lines(attributes: Column) -> Column:
    """A map as sorted ``key: value`` lines, empty values left out (NRM8)."""
    kept = F.filter(F.map_entries(attributes), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    return F.array_join(F.transform(F.array_sort(kept), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


# Phrases of reports that say nothing about the item, by language.
REPORT_PHRASES = (
    "の拾得物です", "の落とし物です", "の忘れ物です", "拾得物です", "落とし物です", "忘れ物です", "を拾いました", "を拾得しました", "拾得しました", "を保管しています", "保管しています", "を預かっています", "が届いています",
    "をなくしました", "を無くしました", "を失くしました", "なくしました", "無くしました", "を落としました", "落としました", "落としちゃった", "落とした", "を紛失しました", "紛失しました", "紛失", "を忘れました", "忘れました", "忘れてきた", "を置き忘れました", "置き忘れました", "が見つかりません", "見つかりません", "どっかいった", "をなくした", "なくした", "忘れた",
    "丢了一个", "丢了一台", "丢了一把", "丢了一部", "丢了", "丢失了", "丢失", "不见了", "找不到了", "找不到", "落了一瓶", "落了", "掉了",
    "i lost a", "i lost", "lost a", "lost my", "lost", "left a", "left my", "left", "missing a", "missing", "i cannot find", "cannot find",
)


def strip_phrases(c: Column, phrases: tuple[str, ...] = REPORT_PHRASES) -> Column:
    """Takes report phrases out, longest first, each as written, in capitals and in title case; never leaves nothing (NRM9)."""
    s = c
    for p in sorted(phrases, key=len, reverse=True):
        for form in dict.fromkeys((p, p.upper(), p.title())):
            s = F.replace(s, F.lit(form), F.lit(" "))
    s = F.trim(F.regexp_replace(F.regexp_replace(s, "[。．.、,，!！?？]+", " "), r"(?U)[\s　]+", " "))
    return F.coalesce(F.nullif(s, F.lit("")), F.trim(c), F.lit(""))


def window_before(c: Column, marker: str, before: int = 8) -> Column:
    """The first ``marker`` with up to ``before`` characters ahead of it; empty without one (NRM13)."""
    at = F.locate(marker.lower(), F.lower(c))
    begin = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.trim(F.substring(c, begin, at + len(marker) - begin))).otherwise(F.lit(""))


def imeis(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)\b(\d{15})\b"), 1)


def serials(c: Column, strict_reference: bool = False) -> Column:
    """8 to 20 letters and digits with one of each. ``strict_reference`` lets both lie anywhere later on the line."""
    digit, letter = (".*\\d", ".*[A-Za-z]") if strict_reference else ("[A-Za-z]*\\d", "\\d*[A-Za-z]")
    return F.regexp_extract_all(c, F.lit(rf"(?U)\b((?=[A-Za-z0-9]{{8,20}}\b)(?={digit})(?={letter})[A-Za-z0-9]{{8,20}})\b"), 1)


# Product families whose names carry a model, in the order in which they are tried.
MODEL_PATTERNS = (r"iphone\s*\d{1,2}\s*(?:pro\s*max|pro|plus|mini)?", r"galaxy\s*[a-z]?\d{1,3}\s*(?:ultra|plus|\+)?", r"pixel\s*\d{1,2}\s*(?:pro|a)?", r"xperia\s*\d{1,2}\s*(?:[ivx]+)?", r"macbook\s*(?:air|pro)?\s*\d{0,2}", r"ipad\s*(?:air|pro|mini)?\s*\d{0,2}", r"airpods\s*(?:pro|max)?\s*\d?")
MODEL_BRANDS = (("Apple", ("iphone", "ipad", "macbook", "airpods")), ("Samsung", ("galaxy",)), ("Sony", ("xperia",)))


def model_phrase(c: Column) -> Column:
    """The first model name by family order, as written; null without one."""
    found = [F.nullif(F.trim(F.regexp_extract(c, f"(?i)({p})", 1)), F.lit("")) for p in MODEL_PATTERNS]
    return F.coalesce(*found)


def brand_of_model(model: Column) -> Column:
    out = F.lit(None).cast("string")
    for brand, families in reversed(MODEL_BRANDS):
        hit = F.lit(False)
        for f in families:
            hit = hit | model.startswith(f)
        out = F.when(hit, F.lit(brand)).otherwise(out)
    return out


def grams(c: Column, n: int = 3) -> Column:
    """All character n-grams of the text without white space (DD1)."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s　]+", "")
    many = F.length(s) - (n - 1)
    return F.when(many > 0, F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda i: F.substring(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def ellipsis(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def as_text(values: Column) -> Column:
    return F.array_join(values, ", ")


def language_of(style: Column) -> Column:
    """A style name without its numbered or dashed ending."""
    return F.regexp_replace(style, r"[-_].*$", "")


def image_prompt(color: Column, material: Column, brand: Column, category: Column) -> Column:
    """``a photo of a ...`` from what is known of an item; null where nothing is (NRM28)."""
    words = F.nullif(F.trim(F.concat_ws(" ", color, material, brand, F.replace(category, F.lit("_"), F.lit(" ")))), F.lit(""))
    article = F.when(F.lower(F.substring(words, 1, 1)).isin(*"aeiou"), F.lit("an")).otherwise(F.lit("a"))
    return F.when(words.isNotNull(), F.concat(F.lit("a photo of "), article, F.lit(" "), words))


def quoted(words: list[str]) -> str:
    """A regular-expression alternation of literal words, longest first."""
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
