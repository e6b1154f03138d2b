import math

import pytest
from pyspark.sql import functions as F

from recordloom.config import EXAM, LOST_FOUND, DomainSpec, domain_from_json, rules_from_json
from recordloom.operators import conflicts as CF
from recordloom.operators import features as FT
from recordloom.operators import scoring as SC
from recordloom.schema import CONFLICT
from tests.conftest import value, values

L = F.lit


def kernel(spark, scores, conflicts=None, spec: DomainSpec = LOST_FOUND, category=None, reliability=None):
    trust = reliability or {}
    conflicts = F.array().cast(f"array<{CONFLICT}>") if conflicts is None else conflicts
    f = {d: FT.feature(L(scores.get(d)).cast("double"), trust.get(d, 1.0)) for d in spec.dimensions}
    return SC.with_score(spark.range(1), spec, f, conflicts, None if category is None else L(category)).first()


def test_golden_pair(spark):
    scores = {"category": 100, "attribute": 98, "location": 100, "time": 100, "distinctive": 70, "semantic": 91, "keyword": 66.6667}
    r = kernel(spark, scores, category="smartphone")
    assert (r.base_score, r.final_score, r.level, r.penalty, r.confidence) == (pytest.approx(91.3825, abs=1e-3), pytest.approx(91.3825, abs=1e-3), "HIGH", 0.0, 0.97)
    model = F.array(CF.conflict("model", "CRITICAL", L("a"), L("b"), 70.0, "", False))
    r = kernel(spark, scores | {"attribute": 70, "semantic": 97, "keyword": 83.3333}, model, category="smartphone")
    assert (r.base_score, r.final_score, r.level) == (pytest.approx(83.586, abs=1e-3), pytest.approx(13.586, abs=1e-3), "IGNORE")


@pytest.mark.parametrize("score, level", [(98, "VERY_HIGH"), (95, "VERY_HIGH"), (90, "HIGH"), (85, "HIGH"), (75, "MEDIUM"), (60, "LOW"), (10, "IGNORE")])
def test_bands(spark, score, level):
    at = SC.band(LOST_FOUND, L(float(score)), L(1.0), L(True), L(False))
    assert value(spark, SC.named(LOST_FOUND, at, L(False))[0]) == level


def test_missing_evidence_is_no_mismatch(spark):
    full = {"category": 100, "attribute": 90, "location": 80, "time": 90, "distinctive": 90, "semantic": 90, "keyword": 90, "image": 90}
    for gone in full:
        some = {d: s for d, s in full.items() if d != gone}
        w = LOST_FOUND.weights
        want = sum(w[d] * s for d, s in some.items()) / sum(w[d] for d in some)
        assert kernel(spark, some).base_score == pytest.approx(want, abs=1e-3)
    assert kernel(spark, {}).base_score == 0


def test_caps(spark):
    r = kernel(spark, {"semantic": 99})
    assert r.level == "LOW" and r.confidence < 0.6
    r = kernel(spark, {"category": 100, "semantic": 100, "location": 100})
    assert r.level == "MEDIUM"
    reject = F.array(CF.conflict("imei", "CRITICAL", L("a"), L("b"), 70.0, "", True))
    r = kernel(spark, {"category": 100, "attribute": 100}, reject)
    assert (r.final_score, r.level, r.action) == (0, "REJECT", "DO_NOT_RECOMMEND")
    r = kernel(spark, {"stem": 100, "answer": 100, "services": 100, "kps": 100, "constraints": 100, "keyword": 100}, spec=EXAM)
    assert r.level == "DUPLICATE" and r.action == "AUTO_MERGE"


def test_penalties(spark):
    arrays = {"none": F.array().cast("array<double>"), "one": F.array(L(10.0)), "three": F.array(L(10.0), L(8.0), L(6.0)), "big": F.array(L(70.0), L(45.0), L(10.0))}
    assert values(spark, **{k: CF.penalty(v) for k, v in arrays.items()}) == {"none": 0.0, "one": 10.0, "three": 17.0, "big": 97.5}


def test_bonus(spark):
    child = lambda f, s: F.struct(L(f).alias("field"), L(s).cast("double").alias("score"))
    marks = F.array(*[child("distinctive_feature", s) for s in (100, 95, 90, 70)])
    ids = F.array(child("imei", 100), child("brand", None))
    got = values(spark, both=SC.bonus(LOST_FOUND, marks, ids), one=SC.bonus(LOST_FOUND, F.array(child("x", 90)), None), exam=SC.bonus(EXAM, marks, ids))
    assert got == {"both": 10.0, "one": 3.0, "exam": 0.0}


def test_features(spark):
    t = lambda s: F.to_timestamp(L(s))
    start, end = t("2024-01-01 10:00:00"), t("2024-01-01 12:00:00")
    loc = lambda i, up, lat=None, lon=None, name="x": F.struct(L(i).cast("long").alias("id"), L(name).alias("name"), F.array(*[L(u).cast("long") for u in up]).cast("array<bigint>").alias("ancestors"), L(lat).cast("double").alias("lat"), L(lon).cast("double").alias("lon"))
    s = lambda f: f["score"]
    got = values(
        spark,
        inside=s(FT.time(start, end, t("2024-01-01 11:00:00"))), day=s(FT.time(start, start, t("2024-01-02 10:00:00"))), two=s(FT.time(start, start, t("2024-01-03 10:00:00"))), none=s(FT.time(start, end, L(None).cast("timestamp"))), open=s(FT.time(start, L(None).cast("timestamp"), t("2024-01-02 10:00:00"))),
        same=s(FT.location(loc(1, []), loc(1, []))), child=s(FT.location(loc(1, [2]), loc(2, []))), near=s(FT.location(loc(1, [5]), loc(2, [5]))), area=s(FT.location(loc(1, [4, 5]), loc(2, [3, 5]))), closer=s(FT.location(loc(1, [4, 5]), loc(2, [4, 5]), nearest=True)),
        metres=s(FT.location(loc(1, [], 35.0, 139.0), loc(2, [], 35.0045, 139.0))), named=s(FT.location(loc(None, [], name="Main St."), loc(None, [], name="main st"))), apart=s(FT.location(loc(1, [], name="a"), loc(2, [], name="b"))),
        cat=s(FT.category(L("bag"), L("Bag"))), unknown=s(FT.category(L(None).cast("string"), L("bag"))), up=s(FT.category(L("a"), L("b"), lost_parent=L("p"), found_parent=L("p"))), direct=s(FT.category(L("a"), L("b"), lost_parent=L("b"))), other=s(FT.category(L("a"), L("b"))),
        maybe=s(FT.category(L("bottle"), L("sake"), F.array(L("bottle"), L("sake")), None, L(True))), cannot=s(FT.category(L("bottle"), L("bag"), F.array(L("bottle")), None, L(True))),
        sem=s(FT.semantic(L(-0.5))), key=s(FT.keyword(L(2.0))), jac=s(FT.jaccard(F.array(L("a"), L("b")), F.array(L("b"), L("c")))), empty=s(FT.jaccard(F.array().cast("array<string>"), F.array(L("b")))),
    )
    assert got["inside"] == 100 and got["day"] == pytest.approx(36.7879, abs=1e-3) and got["two"] == pytest.approx(13.5335, abs=1e-3) and got["none"] is None and got["open"] == got["day"]
    assert (got["same"], got["child"], got["near"], got["area"], got["closer"]) == (100, 95, 80, 60, 80) and 30 < got["metres"] < 45 and got["named"] == 100 and got["apart"] == 0
    assert (got["cat"], got["unknown"], got["up"], got["direct"], got["other"], got["maybe"], got["cannot"]) == (100, None, 70, 30, 0, 100, None)
    assert got["sem"] == 0 and got["key"] == pytest.approx(66.6667) and got["jac"] == pytest.approx(33.3333) and got["empty"] is None


def test_attribute_similarity(spark):
    sim = lambda c, a, b: FT.attribute_similarity(L(c), L(a), L(b))
    got = values(spark, same=sim("brand", "Apple", "apple"), family=sim("color", "black", "dark gray"), other=sim("color", "black", "red"), tier=sim("model", "iPhone 15 Pro", "iPhone 15 Pro Max"), far=sim("model", "iPhone 15", "Galaxy"), serial=sim("imei", "1", "2"), inside=sim("brand", "Apple", "Apple Inc"), some=sim("case", "abcde", "abxyz"), empty=sim("brand", "", "x"))
    assert got == {"same": 100, "family": 80, "other": 0, "tier": 30, "far": 0, "serial": 0, "inside": 85, "some": 62.0, "empty": 0} or got["some"] == pytest.approx(50 + 30 * 0.4)


def test_attribute_dimension(spark):
    side = lambda **kw: F.create_map(*[x for k, v in kw.items() for x in (L(k), F.struct(L(v).alias("value"), L("USER").alias("source")))])
    f, children = FT.attribute(side(brand="Apple", model="iPhone 15 Pro", color="black", distinctive="x"), side(brand="apple", model="iPhone 15 Pro", color="dark gray", distinctive="y"), L("smartphone"))
    r = spark.range(1).select(f.alias("f"), children.alias("c")).first()
    assert r.f.score == pytest.approx((600 + 800 + 160) / 16, abs=1e-4) and r.f.reliability == 1.0 and [c.field for c in r.c] == ["brand", "color", "model"]
    thin, _ = FT.attribute(side(color="black"), side(color="black"), L("smartphone"))
    assert value(spark, thin["reliability"]) == 0.25
    none, _ = FT.attribute(side(color="black"), side(brand="x"), L("smartphone"))
    assert value(spark, none["score"]) is None


def test_distinctive(spark):
    s = lambda a, b: FT.distinctive(F.array(*map(L, a)).cast("array<string>"), F.array(*map(L, b)).cast("array<string>"))[0]["score"]
    got = values(spark, some=s(["猫咪贴纸"], ["猫咪图案"]), same=s(["a b"], ["x", "A B"]), inside=s(["cat"], ["black cat"]), none=s([], ["x"]), mean=s(["same", "zzz"], ["same"]))
    assert got == {"some": 70, "same": 100, "inside": 90, "none": None, "mean": 60}


def test_conflicts(spark):
    side = lambda **kw: F.create_map(*[x for k, v in kw.items() for x in (L(k), L(v))])
    fields = lambda a, b, u=None: value(spark, F.transform(CF.conflicts(a, b, u), lambda c: c["field"]))
    assert fields(side(imei="1", color="black"), side(imei="2", color="dark gray")) == ["imei"]
    assert fields(side(model="iPhone 15 Pro", brand="Apple"), side(model="iPhone 15 Pro Max", brand="Apple Inc")) == ["model"]
    assert fields(side(category="bag"), side(category="keys"), L(True)) == []
    assert fields(side(category="bag", brand=""), side(category="keys", brand="x")) == ["category"]


def test_exam_conflicts(spark):
    q = lambda n, goals, services: F.struct(L(n).alias("select_n"), F.array(*map(L, goals)).cast("array<string>").alias("constraints"), F.array(*map(L, services)).cast("array<string>").alias("services"))
    found = lambda a, b: value(spark, F.transform(CF.exam_conflicts(a, b), lambda c: c["field"]))
    assert found(q(1, ["cost"], ["a"]), q(1, ["performance"], ["a"])) == ["constraints"]
    assert found(q(1, ["cost"], ["a"]), q(2, ["cost"], ["b"])) == ["select_n", "services"]
    assert found(q(1, [], []), q(1, ["cost"], ["b"])) == []


def test_specs_from_files(tmp_path):
    (tmp_path / "w.json").write_text('{"match_levels": [{"min": 50, "max": 100, "level": "YES", "action": "A"}, {"min": 0, "max": 50, "level": "NO", "action": "B"}], "critical_conflict_max_level": "NO", "evidence_bonus_max": 3, "default": {"category": 1}}')
    (tmp_path / "r.json").write_text('{"rules": [{"attribute": "a", "severity": "MINOR"}]}')
    spec = domain_from_json(str(tmp_path / "w.json"))
    assert spec.bands[0] == ("YES", 50.0, 100.0, "A") and spec.bonus_cap == 3 and spec.weights["category"] == 1 and spec.weights["image"] == 0
    assert rules_from_json(str(tmp_path / "r.json"))[0].cost == 10
    assert math.isclose(sum(LOST_FOUND.weights.values()), 1)
