"""From descriptions to typed attributes (NRM14-NRM19)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.config import SYNONYMS
from recordloom.functions.dictionary import all_hits, attribute_code, canonical
from recordloom.functions.text import brand_of_model, canonical_model, imeis, let, model_phrase, norm_text, serials, window_before

# Words that announce a mark or a case.
MARK_WORDS = ("贴纸", "シール", "sticker", "图案", "圖案", "柄", "pattern", "刻字", "刻印", "engraving", "裂痕", "划痕", "傷", "crack", "scratch", "挂件", "吊饰", "ストラップ", "strap")
CASE_WORDS = ("手机壳", "手機殼", "手机套", "保护壳", "保护套", "保護ケース", "ケース", "カバー", "case", "cover")


def node(value: Column, original: Column, confidence: float | Column, kind: str | Column = "EXPLICIT") -> Column:
    """One extracted field: what it means, as written, how sure, and how it was found."""
    sure = confidence if isinstance(confidence, Column) else F.lit(confidence)
    how = kind if isinstance(kind, Column) else F.lit(kind)
    known = value.isNotNull()
    return F.struct(value.alias("value"), original.alias("original"), F.when(known, sure).otherwise(0.0).alias("confidence"), F.when(known, how).otherwise("UNCERTAIN").alias("source_type"))


def extract(text: Column, synonyms: Mapping[str, Mapping[str, tuple[str, ...]]] = SYNONYMS, guess: Column | None = None, strict_reference: bool = False) -> dict[str, Column]:
    """Field columns of a description, by dictionaries and patterns (NRM14, NRM15).

    ``guess`` is a category from elsewhere (zero-shot), used only where the
    dictionary has none and then marked as inferred. Several categories leave
    it uncertain, and nothing downstream may call that a conflict.
    """
    t = F.coalesce(text, F.lit(""))
    hits = {s: all_hits(t, synonyms.get(s, {})) for s in ("category", "brand", "color", "material", "location")}
    first = {s: F.get(h, F.lit(0)) for s, h in hits.items()}
    many = F.size(hits["category"])
    phrase = model_phrase(t)
    model = canonical_model(phrase)
    cat = first["category"]["canonical"]
    guessed = F.lit(None).cast("string") if guess is None else F.when(many == 0, guess)
    category = node(F.coalesce(cat, guessed), F.coalesce(first["category"]["alias"], guessed), F.when(many == 0, 0.6).when(many == 1, 0.9).otherwise(0.5), F.when(many == 0, "INFERRED").when(many == 1, "EXPLICIT").otherwise("UNCERTAIN"))
    brand = F.coalesce(first["brand"]["canonical"], brand_of_model(model))
    case = F.coalesce(*[F.nullif(window_before(t, w), F.lit("")) for w in CASE_WORDS])
    marks = F.filter(F.array(*[window_before(t, w, 6) for w in MARK_WORDS]), lambda m: m != "")
    found = serials(t, strict_reference)
    brandish = F.coalesce(first["brand"]["alias"], phrase, F.lit(""))
    ids = F.filter(found, lambda s: ~F.lower(F.concat_ws(" ", norm_text(phrase), norm_text(brandish))).contains(F.lower(s)))
    return {
        "category": category,
        "category_candidates": F.when(many > 0, F.transform(hits["category"], lambda h: h["canonical"])).otherwise(F.array_compact(F.array(guessed))),
        "category_uncertain": (many > 1) | guessed.isNotNull(),
        "brand": node(brand, F.coalesce(first["brand"]["alias"], phrase), 0.9),
        "model": node(model, phrase, 0.88),
        "color": node(first["color"]["canonical"], first["color"]["alias"], 0.85),
        "material": node(first["material"]["canonical"], first["material"]["alias"], 0.8),
        "case": node(F.when(case.isNotNull(), F.coalesce(canonical(case, synonyms.get("color", {}), strict=True), F.lit("case"))), case, 0.8),
        "location": node(first["location"]["canonical"], first["location"]["alias"], 0.85),
        "distinctive": F.transform(marks, lambda m: F.struct(norm_text(m).alias("value"), m.alias("original"), F.lit(0.75).alias("confidence"), F.lit("EXPLICIT").alias("source_type"))),
        "imei": F.get(imeis(t), F.lit(0)),
        "serial_number": F.when(F.size(imeis(t)) == 0, F.get(ids, F.lit(0))),
    }


def normalized(items: DataFrame, text: str, synonyms: Mapping[str, Mapping[str, tuple[str, ...]]] = SYNONYMS, guess: Column | None = None) -> DataFrame:
    """Adds core fields, ``attributes`` (``schema.ATTRIBUTE`` rows) and the normalised text to descriptions (NRM16, NRM18)."""
    got = extract(F.col(text), synonyms, guess)
    rows = []
    for i, (code, value, sure) in enumerate([
        *((c, got[c]["value"], got[c]["confidence"]) for c in ("color", "material", "case")),
        *((c, got[c], F.lit(1.0)) for c in ("imei", "serial_number")),
    ]):
        rows.append(F.when(value.isNotNull(), attribute(F.lit(code), value, F.lit("AI"), sure, i)))
    marks = F.transform(got["distinctive"], lambda m: attribute(F.lit("distinctive"), m["value"], F.lit("AI"), m["confidence"], 50))
    out = items.withColumns({
        "category": got["category"]["value"], "category_candidates": got["category_candidates"], "category_uncertain": got["category_uncertain"],
        "brand": got["brand"]["value"], "model": got["model"]["value"], "location_name": got["location"]["value"],
        "distinctive": F.transform(got["distinctive"], lambda m: m["value"]),
        "attributes": F.concat(F.array_compact(F.array(*rows)), marks),
    })
    return out.withColumn("normalized_text", description(F.col(text), [F.col("category"), F.col("brand"), F.col("model")], F.col("attributes")))


def attribute(code: Column, value: Column, source: Column, confidence: Column, ordinal: int, secret: bool = False) -> Column:
    return F.struct(code.alias("code"), value.alias("value"), source.alias("source"), confidence.cast("double").alias("confidence"), F.lit(secret).alias("is_secret"), F.lit(ordinal).alias("ordinal"))


def description(raw: Column, core: list[Column], attributes: Column) -> Column:
    """Raw text, core fields and attribute values, each once by normalised form, in order (NRM17)."""
    parts = F.concat(F.array(raw, *core), F.transform(F.coalesce(attributes, F.array()), lambda a: a["value"]))
    parts = F.filter(parts, lambda p: p.isNotNull() & (norm_text(p) != ""))
    forms = F.transform(parts, lambda p: norm_text(p))
    return F.array_join(F.filter(parts, lambda p, i: F.array_position(forms, norm_text(p)) == i + 1), " ")


def manual_attributes(values: Column, role: Column) -> Column:
    """Typed-in attributes (map code -> value) as rows: sure from staff, less from users; blanks dropped (NRM19)."""
    kept = F.filter(F.map_entries(values), lambda e: F.trim(e["value"]) != "")
    staff = role.isin("STAFF", "ADMIN")
    return F.transform(kept, lambda e, i: F.struct(attribute_code(e["key"]).alias("code"), F.trim(e["value"]).alias("value"), role.alias("source"), F.when(staff, 1.0).otherwise(0.85).alias("confidence"), F.lit(False).alias("is_secret"), (i - 1000).cast("int").alias("ordinal")))


def attribute_map(attributes: Column, last: bool) -> Column:
    """code -> struct(value, source); of repeated codes the last (scoring) or the first (conflicts) by ordinal."""
    known = F.filter(F.coalesce(attributes, F.array()), lambda a: a["value"].isNotNull() & (a["value"] != ""))
    known = F.array_sort(known, lambda x, y: F.when(x["ordinal"] < y["ordinal"], F.lit(-1)).when(x["ordinal"] > y["ordinal"], F.lit(1)).otherwise(F.lit(0)))
    coded = F.transform(F.reverse(known) if last else known, lambda a: F.struct(attribute_code(a["code"]).alias("code"), a["value"].alias("value"), a["source"].alias("source")))

    def first_ones(rows: Column) -> Column:
        kept = F.filter(rows, lambda z, i: F.array_position(F.transform(rows, lambda r: r["code"]), z["code"]) == i + 1)
        return F.map_from_entries(F.transform(kept, lambda z: F.struct(z["code"].alias("key"), F.struct(z["value"].alias("value"), z["source"].alias("source")).alias("value"))))

    return let(coded, first_ones)


def visible(attributes: Column) -> Column:
    """Attributes without the secret ones (NRM30)."""
    return F.filter(attributes, lambda a: ~F.coalesce(a["is_secret"], F.lit(False)))
