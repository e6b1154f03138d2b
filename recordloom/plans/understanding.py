"""Queries of the text side: dictionaries, descriptions, exam questions and their sources, each with its SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.config import COLOR_FAMILIES
from recordloom.functions import dictionary as D
from recordloom.functions import text as T
from recordloom.functions import vectors as V
from recordloom.operators import dedup, extract
from recordloom.plans.queries import norm, query
from recordloom.sources import questions as Q
from recordloom.sources.tables import demo_records, parquet, seeded, synonyms

#: A report about each part; the expression reads alike in Spark and in DuckDB.
REPORT = (
    "CASE p_partkey % 6 WHEN 0 THEN 'I lost my navy phone with a scratch, ' WHEN 1 THEN 'Lost a BLACK leather wallet near the terminal, ' WHEN 2 THEN 'missing backpack or purse: '"
    " WHEN 3 THEN 'imei ' || lpad('' || p_partkey, 15, '7') || ' ' WHEN 4 THEN 'LOST MY crimson umbrella (sony) with a sticker! ' ELSE 'left ' END || p_name || ', ' || p_brand || ' SN4' || lpad('' || p_partkey, 7, '0')"
)
KINDS = {"bag": ("backpack", "purse"), "phone": ("mobile phone",), "ring": ("old ring", "ringlet"), "on": ("or",), "rod": ()}
NOTED = {"_note": ("x",), "a": ("B c", "d"), "e": ("d", "F.g")}
WORDS = {
    "category": {"smartphone": ("phone",), "wallet": ("purse",), "umbrella": (), "bag": ("backpack",)},
    "brand": {"Sony": ("sony",)},
    "color": {"black": (), "blue": ("navy",), "red": ("crimson",)},
    "material": {"leather": ()},
    "location": {"Airport": ("terminal",)},
}


def quoted(*values: object) -> str:
    return "(" + ", ".join(str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'" for v in values) + ")"


def entries(section: dict) -> list[tuple[str, str, int]]:
    """(alias, canonical, place) of all aliases, overridden ones too, in the order in which they are tried."""
    return [(a, k, i * 1000 + j) for i, (k, names) in enumerate(section.items()) for j, a in enumerate(map(D.plain, (k, *names))) if a]


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "part").withColumn("report", F.expr(REPORT))


@query("SELECT * FROM (VALUES ('a', 'a', 0), ('b c', 'a', 1), ('d', 'e', 4), ('e', 'e', 3), ('f g', 'e', 5)) t(alias, canonical, place)")
def alias_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM2: normalised aliases; a later entry wins, names with an underscore are notes."""
    return D.alias_table(spark, NOTED)


@query("SELECT * FROM (VALUES ('s', 'a', 'a'), ('s', 'b c', 'a'), ('s', 'd', 'e'), ('s', 'e', 'e'), ('s', 'f g', 'e'), ('t', 'x', 'x')) t(section, alias, canonical)")
def synonym_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4: all sections of a dictionary file as one table."""
    return synonyms(spark, {"s": NOTED, "t": {"x": ()}})


CANONICAL_SQL = f"""
aliases(alias, canonical, place) AS (VALUES {', '.join(quoted(*e) for e in D.alias_rows(KINDS))}),
t AS (SELECT p_partkey, nullif({norm("CASE WHEN p_partkey % 5 = 0 THEN split_part(p_name, ' ', 2) WHEN p_partkey % 5 = 1 THEN '' ELSE p_name || ' backpack' END")}, '') AS n FROM part),
inside AS (SELECT p_partkey, canonical FROM t JOIN aliases ON length(alias) >= 2 AND contains(n, alias) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(alias) DESC, place) = 1)"""


@query(f"""
WITH {CANONICAL_SQL}
SELECT p_partkey, coalesce(aliases.canonical, inside.canonical) AS strict, CASE WHEN n IS NOT NULL THEN coalesce(aliases.canonical, inside.canonical, n) END AS loose
FROM t LEFT JOIN aliases ON alias = n LEFT JOIN inside USING (p_partkey)""")
def canonical_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM3, NRM4: by whole alias, else by the longest alias inside; null or the text itself without one."""
    words = F.expr("CASE WHEN p_partkey % 5 = 0 THEN split_part(p_name, ' ', 2) WHEN p_partkey % 5 = 1 THEN '' ELSE p_name || ' backpack' END")
    return parquet(spark, sf_dir, "part").select("p_partkey", D.canonical(words, KINDS, strict=True).alias("strict"), D.canonical(words, KINDS).alias("loose"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'color' WHEN 1 THEN 'distinctive' WHEN 2 THEN 'case' WHEN 3 THEN 'weird name' ELSE '' END AS code FROM part")
def attribute_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM5: one code for each name of an attribute."""
    name = F.expr("CASE p_partkey % 5 WHEN 0 THEN '颜色' WHEN 1 THEN ' Sticker ' WHEN 2 THEN 'CASE_TYPE' WHEN 3 THEN 'Weird Name' ELSE '' END")
    return parquet(spark, sf_dir, "part").select("p_partkey", D.attribute_code(name).alias("code"))


COLORS = "CASE p_partkey % 8 WHEN 0 THEN 'Navy' WHEN 1 THEN 'dark grey' WHEN 2 THEN 'off-white' WHEN 3 THEN 'bright wine bag' WHEN 4 THEN 'mauve' WHEN 5 THEN '' ELSE split_part(p_name, ' ', 1) END"


@query(f"""
WITH f(family, member, place) AS (VALUES {', '.join(quoted(f, D.plain(m), i) for i, (f, ms) in enumerate(COLOR_FAMILIES.items()) for m in ms)}),
t AS (SELECT p_partkey, nullif({norm(COLORS)}, '') AS n FROM part),
w AS (SELECT p_partkey, arg_min(family, place) AS whole FROM t JOIN f ON n = member GROUP BY p_partkey),
i AS (SELECT p_partkey, arg_min(family, place) AS inside FROM t JOIN f ON contains(n, member) GROUP BY p_partkey)
SELECT p_partkey, coalesce(whole, inside, n) AS family FROM t LEFT JOIN w USING (p_partkey) LEFT JOIN i USING (p_partkey)""")
def color_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM6: the family of a color by name, by a name inside, or the text itself."""
    return parquet(spark, sf_dir, "part").select("p_partkey", D.color_family(F.expr(COLORS)).alias("family"))


def hits_sql(section: dict, text: str = REPORT) -> str:
    return f"""
names(alias, canonical, place) AS (VALUES {', '.join(quoted(*e) for e in entries(section))}),
found AS (SELECT p_partkey, canonical, alias, place FROM part JOIN names ON CASE WHEN regexp_full_match(alias, '[a-z0-9]+') THEN regexp_matches({norm(text)}, '(^|[^a-z0-9])' || alias || '([^a-z0-9]|$)') ELSE contains({norm(text)}, alias) END
          QUALIFY row_number() OVER (PARTITION BY p_partkey, canonical ORDER BY length(alias) DESC, place) = 1)"""


@query(f"""
WITH {hits_sql(KINDS)}
SELECT p_partkey, coalesce(string_agg(canonical || ':' || alias, ',' ORDER BY length(alias) DESC, place), '') AS hits FROM part LEFT JOIN found USING (p_partkey) GROUP BY p_partkey""")
def boundary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM11, NRM12: every canonical value that an alias finds within its boundaries, longest alias first."""
    return parts(spark, sf_dir).select("p_partkey", F.array_join(F.transform(D.all_hits(F.col("report"), KINDS), lambda h: F.concat_ws(":", h["canonical"], h["alias"])), ",").alias("hits"))


def window_sql(text: str, marker: str, before: int) -> str:
    at = f"strpos(lower({text}), '{marker}')"
    return f"CASE WHEN {at} > 0 THEN trim(substring({text}, greatest(1, {at} - {before})::BIGINT, ({at} + {len(marker)} - greatest(1, {at} - {before}))::BIGINT)) ELSE '' END"


@query(f"SELECT p_partkey, {window_sql(REPORT, 'scratch', 8)} AS scratch, {window_sql(REPORT, 'sticker', 6)} AS sticker, {window_sql(REPORT, 'lost', 8)} AS lost FROM part")
def marker_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM13: a word with the characters ahead of it."""
    r = F.col("report")
    return parts(spark, sf_dir).select("p_partkey", T.window_before(r, "scratch").alias("scratch"), T.window_before(r, "sticker", 6).alias("sticker"), T.window_before(r, "lost").alias("lost"))


def stripped_sql(text: str) -> str:
    s = text
    for p in ("lost my", "missing", "lost", "left"):
        for form in (p, p.upper(), p.title()):
            s = f"replace({s}, '{form}', ' ')"
    return f"trim(regexp_replace(regexp_replace({s}, '[。．.、,，!！?？]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT p_partkey, coalesce(nullif({stripped_sql(REPORT)}, ''), trim({REPORT})) AS stripped FROM part")
def stripped_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM9: reports without the phrases that say nothing of the item."""
    return parts(spark, sf_dir).select("p_partkey", T.strip_phrases(F.col("report"), ("lost", "left", "lost my", "missing")).alias("stripped"))


SERIALS_SQL = f"list_filter(regexp_extract_all({REPORT}, '\\b[A-Za-z0-9]{{8,20}}\\b'), lambda x: regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]'))"


@query(f"SELECT p_partkey, array_to_string(regexp_extract_all({REPORT}, '\\b(\\d{{15}})\\b', 1), ',') AS imeis, array_to_string({SERIALS_SQL}, ',') AS serials FROM part")
def device_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM14: device and serial numbers in reports."""
    return parts(spark, sf_dir).select("p_partkey", F.array_join(T.imeis(F.col("report")), ",").alias("imeis"), F.array_join(T.serials(F.col("report")), ",").alias("serials"))


def section_hits(name: str) -> str:
    cte = hits_sql(WORDS[name]).replace("names(", f"names_{name}(").replace("JOIN names ", f"JOIN names_{name} ").replace("found AS", f"found_{name} AS")
    return f"{cte}, {name} AS (SELECT p_partkey, list(canonical ORDER BY length(alias) DESC, place) AS c, list(alias ORDER BY length(alias) DESC, place) AS a FROM found_{name} GROUP BY p_partkey)"


FIELDS_SQL = f"""{', '.join(section_hits(s) for s in WORDS)},
fields AS (
  SELECT p_partkey, {REPORT} AS report, category.c AS cats, brand.c[1] AS brand, color.c[1] AS color, material.c[1] AS material, location.c[1] AS location,
    regexp_extract_all({REPORT}, '\\b(\\d{{15}})\\b', 1)[1] AS imei, {SERIALS_SQL}[1] AS number,
    list_transform(list_filter([{window_sql(REPORT, 'sticker', 6)}, {window_sql(REPORT, 'scratch', 6)}], lambda x: x <> ''), lambda x: {norm('x')}) AS marks
  FROM part LEFT JOIN category USING (p_partkey) LEFT JOIN brand USING (p_partkey) LEFT JOIN color USING (p_partkey) LEFT JOIN material USING (p_partkey) LEFT JOIN location USING (p_partkey))"""


@query(f"""
WITH {FIELDS_SQL}
SELECT p_partkey, cats[1] AS category, CASE WHEN cats IS NULL THEN 0.0 WHEN len(cats) = 1 THEN 0.9 ELSE 0.5 END AS sure, coalesce(array_to_string(cats, ','), '') AS candidates, coalesce(len(cats) > 1, false) AS uncertain,
brand, color, material, location, imei, CASE WHEN imei IS NULL THEN number END AS serial_number, array_to_string(marks, '|') AS marks FROM fields""")
def extracted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM15: the fields of a report by dictionaries and patterns."""
    got = extract.extract(F.col("report"), WORDS)
    return parts(spark, sf_dir).select(
        "p_partkey", got["category"]["value"].alias("category"), got["category"]["confidence"].alias("sure"), F.array_join(got["category_candidates"], ",").alias("candidates"), got["category_uncertain"].alias("uncertain"),
        *[got[c]["value"].alias(c) for c in ("brand", "color", "material", "location")], got["imei"].alias("imei"), got["serial_number"].alias("serial_number"), F.array_join(F.transform(got["distinctive"], lambda m: m["value"]), "|").alias("marks"),
    )


ATTRIBUTES_SQL = f"""{FIELDS_SQL},
attrs AS (
  SELECT p_partkey, 'color' AS code, color AS value, 0.85 AS confidence, 0 AS ordinal FROM fields WHERE color IS NOT NULL UNION ALL SELECT p_partkey, 'material', material, 0.8, 1 FROM fields WHERE material IS NOT NULL
  UNION ALL SELECT p_partkey, 'imei', imei, 1.0, 3 FROM fields WHERE imei IS NOT NULL UNION ALL SELECT p_partkey, 'serial_number', number, 1.0, 4 FROM fields WHERE imei IS NULL AND number IS NOT NULL
  UNION ALL SELECT p_partkey, 'distinctive', unnest(marks), 0.75, 50 FROM fields)"""


@query(f"WITH {ATTRIBUTES_SQL} SELECT * FROM attrs")
def normalized_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM16: extracted attributes as rows."""
    items = extract.normalized(parts(spark, sf_dir), "report", WORDS)
    return items.select("p_partkey", F.explode("attributes").alias("a")).select("p_partkey", "a.code", "a.value", "a.confidence", "a.ordinal")


@query(f"""
WITH {ATTRIBUTES_SQL},
v AS (SELECT p_partkey, list(value ORDER BY ordinal) AS l FROM attrs GROUP BY p_partkey),
p AS (SELECT p_partkey, list_filter(list_concat([report, cats[1], brand], coalesce(l, [])), lambda x: x IS NOT NULL AND {norm('x')} <> '') AS l FROM fields LEFT JOIN v USING (p_partkey))
SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: {norm('y')}), {norm('x')}) = i), ' ') AS described FROM p""")
def described_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM17, NRM18: the text that an item is found by, each part once."""
    return extract.normalized(parts(spark, sf_dir), "report", WORDS).select("p_partkey", F.col("normalized_text").alias("described"))


@query("""
WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'STAFF' ELSE 'USER' END AS source, split_part(p_name, ' ', 1) AS tint, p_brand FROM part)
SELECT p_partkey, 'color' AS code, tint AS value, source, CASE source WHEN 'STAFF' THEN 1.0 ELSE 0.85 END AS confidence, -1000 AS ordinal FROM r
UNION ALL SELECT p_partkey, 'brand', p_brand, source, CASE source WHEN 'STAFF' THEN 1.0 ELSE 0.85 END, -999 FROM r""")
def manual_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM19: typed-in attributes as rows; blank ones go."""
    typed = F.create_map(F.lit("颜色"), F.split("p_name", " ")[0], F.lit("note"), F.lit("  "), F.lit("Brand"), F.concat(F.lit(" "), "p_brand"))
    role = F.when(F.col("p_partkey") % 2 == 0, "STAFF").otherwise("USER")
    rows = parquet(spark, sf_dir, "part").select("p_partkey", F.explode(extract.manual_attributes(typed, role)).alias("a"))
    return rows.select("p_partkey", "a.code", "a.value", "a.source", "a.confidence", "a.ordinal")


GOALS = {"speed": ("fast", "hot"), "size": ("large", "small"), "age": ("old",)}


@query(f"""
WITH g(alias, goal) AS (VALUES {', '.join(quoted(a, k) for k, names in GOALS.items() for a in names)})
SELECT p_partkey, coalesce(string_agg(DISTINCT goal, ',' ORDER BY goal), '') AS goals FROM part LEFT JOIN g ON contains({norm('p_name')}, alias) GROUP BY p_partkey""")
def goal_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM21: goals by any alias inside the text."""
    return parquet(spark, sf_dir, "part").select("p_partkey", F.array_join(D.tag_set(F.col("p_name"), GOALS, None), ",").alias("goals"))


@query("""
WITH t AS (SELECT p_partkey, lower(CASE p_partkey % 3 WHEN 0 THEN 'acme ' WHEN 1 THEN 'acme cloud ' ELSE '' END || p_type) AS n FROM part),
s AS (SELECT p_partkey, regexp_replace(n, '^(acme cloud|acme) ', '') AS n FROM t)
SELECT p_partkey, CASE n WHEN 'economy' THEN 'standard' WHEN 'cloud economy' THEN 'standard' ELSE n END AS term FROM s""")
def canonical_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM22: knowledge points without a vendor's name."""
    term = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'Acme ' WHEN 1 THEN 'ACME Cloud ' ELSE '' END || p_type")
    return parquet(spark, sf_dir, "part").select("p_partkey", D.canonical_term(term, ("Acme Cloud", "Acme"), {"standard": ("Economy", "cloud economy")}).alias("term"))


@query("""
SELECT p_partkey, CASE WHEN length(p_name) > 7 THEN left(p_name, 7) || '…' ELSE p_name END AS short, replace(p_name, ' ', ', ') AS listed, CASE p_partkey % 2 WHEN 0 THEN 'en' ELSE 'zh' END AS lang FROM part""")
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM29: cut texts, lists as text, the language of a style."""
    style = F.expr("CASE p_partkey % 2 WHEN 0 THEN 'en-' || p_size ELSE 'zh_formal-2' END")
    return parquet(spark, sf_dir, "part").select("p_partkey", T.ellipsis(F.col("p_name"), 7).alias("short"), T.as_text(F.split("p_name", " ")).alias("listed"), T.language_of(style).alias("lang"))


@query("SELECT s_suppkey, 'name' AS code, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', '' || s_nationkey FROM supplier WHERE s_suppkey % 2 = 0")
def visible_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM30: secret attributes never leave."""
    row = lambda code, value, hidden: extract.attribute(F.lit(code), value, F.lit("USER"), F.lit(1.0), 0).withField("is_secret", hidden)
    all_ = F.array(row("name", F.col("s_name"), F.lit(None).cast("boolean")), row("nation", F.col("s_nationkey").cast("string"), F.col("s_suppkey") % 2 == 1), row("balance", F.col("s_acctbal").cast("string"), F.lit(True)))
    return parquet(spark, sf_dir, "supplier").select("s_suppkey", F.explode(extract.visible(all_)).alias("a")).select("s_suppkey", "a.code", "a.value")


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[64]::DOUBLE, 6) AS last, len(embedding)::INT AS dim FROM embeddings")
def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC7: what a six-decimal text keeps of a vector."""
    e = parquet(spark, sf_dir, "embeddings").select("vec_id", V.as_stored(F.col("embedding")).alias("e"))
    return e.select("vec_id", F.get("e", 0).alias("first"), F.get("e", 63).alias("last"), F.size("e").alias("dim"))


@query("""
SELECT p_partkey AS id, 'TEXT' AS kind, p_name AS content FROM part
UNION ALL SELECT p_partkey, 'ATTRIBUTES', 'brand: ' || p_brand || CASE WHEN p_partkey % 3 > 0 THEN chr(10) || 'kind: ' || p_type ELSE '' END || CASE WHEN p_partkey % 3 = 2 THEN chr(10) || 'size: ' || p_size ELSE '' END FROM part WHERE p_partkey % 3 > 0""")
def embedding_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC8: a text for every item, attributes where two are known."""
    k = F.col("p_partkey") % 3
    known = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("kind"), F.when(k > 0, F.col("p_type")), F.lit("size"), F.when(k == 2, F.col("p_size").cast("string")))
    return V.embedding_inputs(parquet(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("normalized_text"), known.alias("attributes")))


# ---- exam questions ------------------------------------------------------------------------

RAW = "'问题 #' || item_id || ' ' || text || ' 哪个方案最好？' || chr(10) || 'A. one' || chr(10) || 'B、 ' || item_id || chr(10) || 'more' || chr(10) || '**C) three' || chr(10) || 'A． again'"
BLANKS = r"\s+"


@query(f"""
SELECT item_id, text || ' 哪个方案最好？' AS stem, 'A=again;B=' || item_id || chr(10) || 'more;C=three' AS options, trim(regexp_replace(text, '{BLANKS}', ' ', 'g')) AS short,
CASE item_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS choices FROM benchmark""")
def split_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM23, NRM24, NRM26: stem and options of a question, the stem without its asking, how many options it asks for."""
    stem, options = Q.split_question(F.expr(RAW))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    asked = Q.select_count(F.expr("CASE item_id % 3 WHEN 0 THEN '（选择两个）' WHEN 1 THEN 'choose three' ELSE 'x' END"))
    return parquet(spark, sf_dir, "benchmark").select("item_id", stem.alias("stem"), listed.alias("options"), Q.strip_asking(stem).alias("short"), asked.alias("choices"))


@query("SELECT item_id, 'A=use ' || item_id || ';B=second line' AS analyses FROM benchmark")
def option_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM25: what an answer says of each option."""
    answer = F.expr("'**A.** ok' || chr(10) || '> 分析：use ' || item_id || chr(10) || chr(10) || '**B.** no' || chr(10) || '> second' || chr(10) || '> line' || chr(10) || '**A.** late' || chr(10) || '> never'")
    found = F.transform(F.array_sort(F.map_entries(Q.option_analyses(answer))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return parquet(spark, sf_dir, "benchmark").select("item_id", F.array_join(found, ";").alias("analyses"))


@query("SELECT doc_id AS qid FROM labels WHERE quality <> toxic AND doc_id % 5 > 0")
def answer_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM27: questions whose two answer fields are there and differ."""
    letter = lambda c: F.array(F.when(F.col(c) == 1, "A").otherwise("B"))
    rows = parquet(spark, sf_dir, "labels").select(F.col("doc_id").alias("qid"), letter("quality").alias("answer"), F.when(F.col("doc_id") % 5 > 0, letter("toxic")).otherwise(F.array().cast("array<string>")).alias("answer_header"))
    return dedup.answer_disagreements(rows).select("qid")


FLAT = f"trim(regexp_replace(text, '{BLANKS}', ' ', 'g'))"
ZH_FILE = f"'前言' || chr(10) || '1. 问题 #' || item_id || ' ' || {FLAT} || '（选择两个）' || chr(10) || 'A. 一' || chr(10) || 'B. 二a' || chr(10) || 'B续' || chr(10) || chr(10) || 'C. 三' || chr(10) || '答案：C, A' || chr(10) || '解析：x' || chr(10) || '2. 问题 #9' || item_id || ' 缺选项' || chr(10) || 'A. 一' || chr(10) || 'B. 二'"
EN_FILE = f"'Question #' || item_id || ' ' || {FLAT} || ' on-' || chr(10) || 'site (choose three)' || chr(10) || 'A. one' || chr(10) || 'wrapped' || chr(10) || 'B. two' || chr(10) || 'C. four' || chr(10) || 'Answer: B' || chr(10) || 'Explanation: A. no'"


def exam_files(spark: SparkSession, sf_dir: str, file: str) -> DataFrame:
    spaced = file.replace(FLAT, r"trim(regexp_replace(text, '\\s+', ' '))")
    return parquet(spark, sf_dir, "benchmark").select(F.expr(spaced).alias("value"))


@query(f"""
SELECT '' || item_id AS no, {FLAT} || '（选择两个）' AS stem, 'A=一;B=二a B续;C=三' AS options, 'A,C' AS answer, 2 AS select_n, 'zh' AS language FROM benchmark
UNION ALL SELECT '' || item_id, {FLAT} || ' on-site (choose three)', 'A=one wrapped;B=two;C=four', 'B', 3, 'en' FROM benchmark""")
def exam_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7-SRC9: questions of exam texts in two languages, with layout breaks undone."""
    out = None
    for language, file in (("zh", ZH_FILE), ("en", EN_FILE)):
        found = Q.exam_text(exam_files(spark, sf_dir, file), language)
        options = F.array_join(F.transform(F.array_sort(F.map_entries("options")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
        one = found.select("no", "stem", options.alias("options"), F.array_join("answer", ",").alias("answer"), "select_n", F.lit(language).alias("language"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT '' || item_id AS no, 'stem ' || item_id AS stem, 'k1,k2' AS kps, 'disagreements' AS source FROM benchmark WHERE item_id % 2 = 1
UNION ALL SELECT '' || item_id, 'why ' || item_id, NULL, 'generated' FROM benchmark WHERE item_id % 2 = 0""")
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC10-SRC12: Markdown blocks and generated questions, one a number, the earliest source first."""
    b = parquet(spark, sf_dir, "benchmark")
    blocks = b.select(F.expr("'intro' || chr(10) || '## ' || item_id || ' x' || chr(10) || '> stem ' || item_id || chr(10) || '- A. a' || chr(10) || '- **B.** b' || chr(10) || '- C. c' || chr(10) || '知识点：k1、k2' || chr(10) || '## none' || chr(10) || '> lost'").alias("value"))
    made = b.filter("item_id % 2 = 0").select(F.to_json(F.struct(F.col("item_id").cast("string").alias("question_number"), F.expr("'问题 #' || item_id || ' why ' || item_id").alias("question"), F.create_map(*[F.lit(x) for x in "A1B2C3"]).alias("options"))).alias("value"))
    few = b.select(F.to_json(F.struct(F.col("item_id").cast("string").alias("question_number"), F.lit("short").alias("question"), F.create_map(F.lit("A"), F.lit("1")).alias("options"))).alias("value"))
    found = Q.merged(Q.generated_rows(made.union(few)), Q.disagreements(blocks))
    return found.select("no", "stem", F.array_join("kps", ",").alias("kps"), "source")


@query("""
SELECT '' || item_id AS qid, 'stem' || chr(10) || 'A. x' || chr(10) || 'B. ' || item_id AS raw_q, '✅ 正确答案: A, B' AS raw_a, 'jsonl' AS source FROM benchmark
UNION ALL SELECT 'q' || item_id, 'asked ' || item_id, 'told', 'course' FROM benchmark WHERE item_id % 2 = 0""")
def question_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5, SRC6: raw question rows of course files and of lines; broken and empty ones are left out."""
    b = parquet(spark, sf_dir, "benchmark")
    lines = b.select(F.to_json(F.struct(F.col("item_id").cast("string").alias("id"), F.lit("stem").alias("stem"), F.create_map(F.lit("B"), F.col("item_id").cast("string"), F.lit("A"), F.lit("x")).alias("options"), F.array(F.lit("A"), F.lit("B")).alias("answer"))).alias("value"))
    asked = F.to_json(F.struct(F.expr("'q' || item_id").alias("slug"), F.array(F.struct(F.expr("'asked ' || item_id").alias("q"), F.lit("told").alias("a"))).alias("interview_questions")))
    files = b.select(F.when(F.col("item_id") % 2 == 0, asked).when(F.col("item_id") % 4 == 1, "{ broken").otherwise('{"slug": "empty"}').alias("value"), F.lit("f/x.json").alias("path"))
    rows = lambda df, name: df.select("qid", "raw_q", "raw_a", F.lit(name).alias("source"))
    return rows(Q.jsonl_rows(lines), "jsonl").unionByName(rows(Q.course_rows(files), "course"))


@query("""
SELECT r_regionkey || '.' || n_nationkey || '.K' || i AS kb, n_name || '-' || i AS title, r_regionkey || '.' || n_nationkey AS task, n_name AS task_title, r_name AS domain
FROM nation JOIN region ON n_regionkey = r_regionkey, range(1, 3) t(i)""")
def syllabus_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC13: the items of a syllabus, numbered within their task."""
    n = parquet(spark, sf_dir, "nation").join(parquet(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    task = F.struct(F.concat_ws(".", "r_regionkey", "n_nationkey").alias("id"), F.col("n_name").alias("title"), F.array(F.concat("n_name", F.lit("-1")), F.concat("n_name", F.lit("-2"))).alias("knowledge"))
    # One region holds a handful of nations.
    domains = n.groupBy("r_name").agg(F.collect_list(task).alias("tasks")).select(F.to_json(F.struct(F.array(F.struct(F.col("r_name").alias("id"), F.col("r_name").alias("title"), "tasks")).alias("domains"))).alias("value"))
    return Q.blueprint_rows(domains)


@query("""
SELECT '' || l_orderkey AS qid, '' || l_partkey AS kb, 'pool' AS source FROM lineitem WHERE l_orderkey % 100 = 0 GROUP BY ALL
UNION ALL SELECT '' || o_orderkey, NULL, 'keep' FROM orders WHERE o_orderkey % 100 = 0
UNION ALL SELECT '' || (o_orderkey + 1), NULL, 'keep' FROM orders WHERE o_orderkey % 100 = 0""")
def question_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC14, SRC15: which question covers what, and which questions must stay; the query set is every hundredth order."""
    items = parquet(spark, sf_dir, "lineitem").filter("l_orderkey % 100 = 0")
    # An order holds a few lines.
    lists = items.groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("kbs")).select(F.to_json(F.create_map(F.col("l_orderkey").cast("string"), "kbs")).alias("value"))
    key = F.col("o_orderkey")
    pair = F.struct(F.concat(F.lit("sap-"), key).alias("a"), F.concat(F.lit("sap-"), key + 1).alias("b"))
    report = F.when(key % 200 == 0, F.to_json(F.struct(F.array(pair).alias("topic_pairs")))).otherwise(F.concat(F.lit("see sap-"), key, F.lit(" and sap-"), key + 1))
    reports = parquet(spark, sf_dir, "orders").filter("o_orderkey % 100 = 0").select(report.alias("value"))
    return Q.pool_rows(lists).withColumn("source", F.lit("pool")).unionByName(Q.keep_rows(reports).withColumns({"kb": F.lit(None).cast("string"), "source": F.lit("keep")}))


@query("""
SELECT 'demo-' || lpad('' || (p * 3 + c), 5, '0') AS id, ['bag', 'keys', 'sake'][c + 1] AS category, ['a red tote with logo', 'a blue ring with tag'][p + 1] AS raw_description, ['X', 'Y'][(p * 3 + c) % 2 + 1] AS location_name
FROM range(0, 2) a(p), range(0, 3) b(c)""")
def demo_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC16: synthetic records."""
    return demo_records(spark, ["bag", "keys", "sake"], [("red", "tote", "logo"), ("blue", "ring", "tag")], ["X", "Y"])


@query("SELECT n_nationkey AS code, n_name AS name FROM nation WHERE n_nationkey < 20 UNION ALL SELECT n_nationkey, lower(n_name) FROM nation WHERE n_nationkey >= 20")
def seeded_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC17, SRC18: master data gets the rows that it lacks."""
    n = parquet(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    return seeded(n.filter("code < 20"), n.withColumn("name", F.lower("name")), "code")
