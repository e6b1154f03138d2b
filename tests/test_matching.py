import datetime as dt

import pytest
from pyspark.sql import functions as F

from recordloom.operators import extract as EX
from recordloom.operators import matching as M
from recordloom.schema import ATTRIBUTE, LOCATION
from tests.conftest import value, values

SIDE = f"struct<id:string,record_type:string,category:string,brand:string,model:string,category_candidates:array<string>,category_uncertain:boolean,attributes:array<{ATTRIBUTE}>,distinctive:array<string>,location:{LOCATION},start_at:timestamp,end_at:timestamp>"
T0 = dt.datetime(2024, 5, 1, 19)


def side(kind="LOST", **kw):
    attrs = [(c, v, "USER", 1.0, False, i) for i, (c, v) in enumerate(kw.get("attrs", [("brand", "Apple"), ("model", "iPhone 15 Pro"), ("color", "black"), ("case", "clear")]))]
    place = kw.get("location", (1, "East Exit", [9], 35.0, 139.0))
    return (kw.get("id", kind), kind, kw.get("category", "smartphone"), kw.get("brand"), kw.get("model"), None, kw.get("uncertain"), attrs, kw.get("marks", ["cat sticker"]), place, kw.get("start", T0), kw.get("end", T0 + dt.timedelta(hours=2)))


def scored(spark, a, b, cos=0.91, rank=2.0):
    df = spark.createDataFrame([(a, b, cos, rank)], f"lost {SIDE}, found {SIDE}, semantic_cosine double, keyword_rank double")
    return M.scored_pairs(df).first()


def found(**kw):
    return side("FOUND", **({"start": T0 + dt.timedelta(hours=1), "end": None} | kw))


def test_textbook_pair(spark):
    r = scored(spark, side(), found())
    assert r.final_score >= 85 and r.level in ("HIGH", "VERY_HIGH") and r.penalty == 0
    assert {e.evidence_type for e in r.evidence} >= {"CATEGORY", "ATTRIBUTE", "LOCATION", "TIME", "DISTINCTIVE", "SEMANTIC", "KEYWORD"}


def test_model_tier_is_another_phone(spark):
    r = scored(spark, side(), found(attrs=[("brand", "Apple"), ("model", "iPhone 15 Pro Max"), ("color", "dark gray")]), 0.97, 5.0)
    assert [c.field for c in r.conflicts] == ["model"] and r.penalty >= 70 and r.final_score < 50 and r.level in ("LOW", "IGNORE")


def test_identity_number(spark):
    r = scored(spark, side(attrs=[("imei", "1" * 15)]), found(attrs=[("imei", "2" * 15)]))
    assert r.final_score == 0 and r.level == "REJECT"
    r = scored(spark, side(attrs=[("imei", "1" * 15)]), found(attrs=[("imei", "1" * 15)]))
    assert r.bonus >= 6 and r.final_score <= 100


def test_core_fields_and_uncertain_category(spark):
    assert [c.field for c in scored(spark, side(attrs=[], brand="Apple"), found(attrs=[], brand="Samsung")).conflicts] == ["brand"]
    assert scored(spark, side(attrs=[], brand="Apple"), found(attrs=[])).conflicts == []
    assert [c.field for c in scored(spark, side(), found(category="bag")).conflicts] == ["category"]
    assert scored(spark, side(uncertain=True), found(category="bag")).conflicts == []


def test_missing_place_weighs_nothing(spark):
    assert scored(spark, side(location=None), found(location=None)).final_score > 70


def test_semantic_alone_is_weak(spark):
    bare = dict(category=None, attrs=[], marks=[], location=None, start=None, end=None)
    r = scored(spark, side(**bare), found(**bare), 0.99, None)
    assert r.level not in ("VERY_HIGH", "HIGH", "MEDIUM") and r.confidence < 0.6


def test_repeated_codes(spark):
    rows = F.lit(None).cast(f"array<{ATTRIBUTE}>")
    assert value(spark, EX.attribute_map(rows, True)) == {}
    two = spark.createDataFrame([([("color", "red", "USER", 1.0, False, 2), ("颜色", "blue", "AI", 1.0, False, 1)],)], f"a array<{ATTRIBUTE}>")
    r = two.select(EX.attribute_map(F.col("a"), True).alias("last"), EX.attribute_map(F.col("a"), False).alias("first")).first()
    assert r.last["color"].value == "red" and r.first["color"].value == "blue"


def test_verdicts_never_raise(spark):
    got = values(spark, low=M.tightened(F.lit("AUTO_RECOMMEND"), F.lit("HUMAN_REVIEW")), keep=M.tightened(F.lit("DO_NOT_RECOMMEND"), F.lit("AUTO_RECOMMEND")), s=M.strength(F.lit(95.0)), w=M.strength(F.lit(10.0)))
    assert got == {"low": "HUMAN_REVIEW", "keep": "DO_NOT_RECOMMEND", "s": "STRONG", "w": "WEAK"}


def test_run_and_lists(spark):
    df = spark.createDataFrame([(side(id="L1"),), (found(id="F1"),), (found(id="F2", category="bag", attrs=[("brand", "Other")], marks=[]),)], f"r {SIDE}")
    records = df.select("r.*")
    candidates = spark.createDataFrame([("L1", "F1", 0.03, 0.9, 2.0), ("L1", "F2", 0.01, 0.1, None), ("F1", "L1", 0.03, 0.9, 2.0)], "query_id string, id string, rrf_score double, semantic_cosine double, keyword_rank double")
    out = M.run_matching(candidates, records)
    rows = {(r.query_id, r.id): r for r in out.collect()}
    assert rows["L1", "F1"].rank == 1 and rows["L1", "F1"].final_score == rows["F1", "L1"].final_score
    assert rows["L1", "F1"].verdict.decision in ("LIKELY_MATCH", "MATCH") and "HIGH" in rows["L1", "F1"].explanation
    assert [r.id for r in M.search_view(out.filter("query_id = 'L1'"), 1).collect()] == ["F1"]


def test_match_list_from_either_side(spark):
    c = spark.createDataFrame([("L1", "F1", 90.0), ("L2", "F1", 60.0), ("L3", "F1", 10.0)], "lost_id string, found_id string, final_score double")
    e = spark.createDataFrame([("L1", "F1", False, 5.0, "a", "A", 90.0), ("L1", "F1", False, 9.0, "b", "B", 95.0), ("L1", "F1", True, -5.0, "c", "C", 0.0)], "lost_id string, found_id string, is_conflict boolean, contribution double, field_name string, evidence_type string, similarity_score double")
    items = spark.createDataFrame([("F1",)], "id string")
    rows = M.stored_explanation(M.match_list(c, e, items)).orderBy("rank").collect()
    assert [(r.other_id, r.rank) for r in rows] == [("L1", 1), ("L2", 2)]
    assert [x.field_name for x in rows[0].evidences] == ["b", "a", "c"] and rows[0].explanation == "for: b, a; against: c"


def test_secrets(spark):
    m = lambda **kw: F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), F.lit(v))])
    got = values(spark, ok=M.verify_secret(m(pin="the 1234 one"), m(pin="1234")), bad=M.verify_secret(m(pin="99"), m(pin="1234")), none=M.verify_secret(m(pin="1"), F.create_map().cast("map<string,string>")), part=M.verify_secret(m(a="x"), m(a="x", b="y")))
    assert got == {"ok": True, "bad": False, "none": False, "part": False}


def test_extraction(spark):
    rows = spark.createDataFrame([("Lost my black iPhone 15 Pro, clear case, cat sticker, imei 123456789012345",), ("a bottle of sake",), (None,)], "t string")
    a, b, c = EX.normalized(rows, "t").collect()
    codes = {x.code: x.value for x in a.attributes}
    assert (a.category, a.brand, a.model) == ("smartphone", "Apple", "iphone 15 pro") and codes["color"] == "black" and codes["imei"] == "1" + "23456789012345" and codes["distinctive"].endswith("sticker")
    assert b.category_uncertain and set(b.category_candidates) == {"water_bottle", "sake"}
    assert c.category is None and c.attributes == []
    assert a.normalized_text.startswith("Lost my black")


def test_manual_attributes(spark):
    m = F.create_map(F.lit("颜色"), F.lit(" red "), F.lit("brand"), F.lit(" "))
    rows = value(spark, EX.manual_attributes(m, F.lit("STAFF")))
    assert [(r.code, r.value, r.confidence) for r in rows] == [("color", "red", 1.0)]


@pytest.mark.parametrize("value_, secret", [("a", True), ("b", False)])
def test_secret_attributes_are_hidden(spark, value_, secret):
    rows = F.array(EX.attribute(F.lit("x"), F.lit(value_), F.lit("USER"), F.lit(1.0), 0, secret))
    assert len(value(spark, EX.visible(rows))) == (0 if secret else 1)


def test_matched_pairs_what_is_scored(spark, tmp_path, monkeypatch):
    """Of many parts of a noun a query meets those that are scored, not all; results are those of the SQL."""
    import duckdb

    from recordloom.config import FUNNEL
    from recordloom.plans import pairs

    duckdb.sql(f"COPY (SELECT i AS p_partkey, 'red ' || CASE WHEN i % 10 < 9 THEN 'ring' ELSE 'bolt' END AS p_name, 'Brand#' || i // 7 % 2 AS p_brand, 'LARGE' AS p_type, (i // 3 % 7)::INT AS p_size, (900 + i % 300)::DOUBLE AS p_retailprice FROM range(1000) t(i)) TO '{tmp_path}/part.parquet'")
    seen, own = [], pairs.matching.run_matching
    monkeypatch.setattr(pairs.matching, "run_matching", lambda candidates, records: (seen.append(candidates.count()), own(candidates, records))[1])
    got = pairs.ranked_matches(spark, str(tmp_path)).collect()
    assert seen == [10 * FUNNEL["scored"]]
    want = duckdb.sql(pairs.query.__globals__["ORACLES"]["ranked_matches"].replace(" FROM part)", f" FROM '{tmp_path}/part.parquet')")).fetchall()
    assert got and sorted(map(tuple, got)) == sorted(want)
