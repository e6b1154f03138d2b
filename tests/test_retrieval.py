import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.functions import vectors as V
from recordloom.operators import evaluate as E
from recordloom.operators import retrieval as R
from tests.conftest import value, values


def test_fusion(spark):
    channel = lambda ids: spark.createDataFrame([("q", i, k + 1) for k, i in enumerate(ids)], "query_id string, id string, rank int")
    rows = R.fuse({"a": channel("AB"), "b": channel("BC"), "c": channel("B")}).orderBy("rank").collect()
    assert rows[0].id == "B" and rows[0].sources == ["a", "b", "c"] and rows[0].rrf_score == pytest.approx(1 / 62 + 1 / 61 + 1 / 61, abs=1e-8)
    assert [r.rank for r in rows] == [1, 2, 3]
    assert R.fuse({"a": channel("AB")}, k=0).first().rrf_score == pytest.approx(1 / 61, abs=1e-8)


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal((60, 5)), 1)
    x[7] = 0
    x[20] = x[21]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(90, None), (91, [1.0])]
    df = spark.createDataFrame(rows, "id int, embedding array<double>")
    queries = df.filter("id % 10 = 0").withColumnRenamed("id", "query_id")
    got = {}
    for r in R.nearest(queries, df, 4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.similarity))
    for q in (0, 10, 20, 30, 40, 50):
        sims = sorted(((-float(x[q] @ x[j] / np.linalg.norm(x[q]) / np.linalg.norm(x[j])), j) for j in range(60) if j not in (q, 7)))[:4]
        assert [j for _, j, _ in sorted(got[q])] == [j for _, j in sims]
    R.BLOCK, before = 7, R.BLOCK
    try:
        assert sorted(map(tuple, R.nearest(queries, df, 4).collect())) == sorted((q, j, s, k) for q, v in got.items() for k, j, s in v)
    finally:
        R.BLOCK = before


def test_keyword_falls_back_to_trigrams(spark):
    records = spark.createDataFrame([("1", "black leather wallet"), ("2", "red wallet"), ("3", "umbrella")], "id string, normalized_text string")
    queries = spark.createDataFrame([("a", "black wallet"), ("b", "umbrela")], "query_id string, query_text string")
    got = {(r.query_id, r.id) for r in R.keyword(queries, records).collect()}
    assert ("a", "1") in got and ("a", "2") not in got and ("b", "3") in got


def test_structured_and_pool(spark):
    rows = [("1", "FOUND", "ACTIVE", "bag", 3), ("2", "FOUND", "ACTIVE", "bag", 9), ("3", "FOUND", "CLOSED", "bag", 9), ("4", "LOST", "ACTIVE", None, 1)]
    records = spark.createDataFrame(rows, "id string, record_type string, status string, category string, created_at int")
    assert [r.id for r in R.base_pool(records, "FOUND").collect()] == ["2", "1"]
    assert R.base_pool(records, "FOUND", 1).count() == 1
    q = spark.createDataFrame([("2", "bag"), ("9", None)], "query_id string, category string")
    assert [(r.query_id, r.id) for r in R.structured(q, records.filter("status = 'ACTIVE'")).collect()] == [("2", "1")]


def test_hybrid(spark):
    records = spark.createDataFrame([("1", "bag", "black bag", 1), ("2", "keys", "key ring", 2)], "id string, category string, normalized_text string, created_at int")
    queries = spark.createDataFrame([("q", "bag", "black bag")], "query_id string, category string, query_text string")
    vectors = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.6, 0.8])], "id string, embedding array<double>")
    mine = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    rows = {r.id: r for r in R.hybrid(queries, records, vectors, mine, vectors, mine).collect()}
    assert rows["1"].rank == 1 and rows["1"].sources == ["attributes", "keyword", "structured", "text"] and rows["1"].semantic_cosine == 1
    assert rows["2"].keyword_rank is None and rows["2"].semantic_cosine == pytest.approx(0.6)


def test_image_search(spark):
    vectors = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.0, 1.0])], "id string, embedding array<double>")
    records = spark.createDataFrame([("1", "ACTIVE"), ("2", "CLOSED")], "id string, status string")
    images = spark.createDataFrame([("1", "b", False), ("1", "a", True)], "id string, url string, is_primary boolean")
    q = spark.createDataFrame([("q", [1.0, 1.0])], "query_id string, embedding array<double>")
    assert [(r.id, r.image_url) for r in R.image_search(q, vectors, records, images).collect()] == [("1", "a")]


def test_vectors(spark):
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v]).cast("array<double>")
    got = values(spark, one=V.cosine(a(1, 2), a(2, 4)), none=V.cosine(a(), a()), short=V.cosine(a(1), a(1, 2)), zero=V.cosine(a(0, 0), a(1, 2)), fit=V.fit_dim(a(1, 2, 3).cast("array<float>"), 2), pad=V.fit_dim(a(1).cast("array<float>"), 3), kept=V.as_stored(a(0.12345678)))
    assert got["one"] == pytest.approx(1) and (got["none"], got["short"], got["zero"]) == (0, 0, 0)
    assert got["fit"] == [1, 2] and got["pad"] == [1, 0, 0] and got["kept"] == [0.123457]


def test_hashing_embedder(spark):
    df = spark.createDataFrame([("black bag",), ("black bag",), ("umbrella",), ("",), (None,)], "t string")
    v = [r.v for r in df.select(V.hashing_embedder(64)("t").alias("v")).collect()]
    assert v[0] == v[1] and math.isclose(sum(x * x for x in v[0]), 1) and v[3] is None and v[4] is None
    assert abs(sum(x * y for x, y in zip(v[0], v[2]))) < 0.9
    doubled = V.model_embedder(lambda: lambda texts: [[len(t), 1.0] for t in texts], 2)
    assert value(spark.createDataFrame([("ab",)], "t string").sparkSession, doubled(F.lit("ab"))) == [2.0, 1.0]


def test_embedding_inputs(spark):
    items = spark.createDataFrame([("1", "x", {"a": "1", "b": "2"}), ("2", "y", {"a": "1"})], "id string, normalized_text string, attributes map<string,string>")
    assert sorted((r.id, r.kind) for r in V.embedding_inputs(items).collect()) == [("1", "ATTRIBUTES"), ("1", "TEXT"), ("2", "TEXT")]


@pytest.mark.parametrize("sims, want", [([0.9, 0.2, 0.21, 0.19, 0.2, 0.2], "c0"), ([0.5, 0.5, 0.5, 0.5], None), ([0.9, 0.89, 0.1, 0.1, 0.1, 0.1], None), ([0.3, 0.01, 0.01, 0.01, 0.01, 0.01], None), ([0.9, 0.1], None)])
def test_zero_shot(spark, sims, want):
    df = spark.createDataFrame([(1, f"c{i}", s) for i, s in enumerate(sims)], "id int, code string, sim double")
    assert V.zero_shot(df, "id", "code", "sim").first().guess == want


def test_metrics(spark):
    ranks = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("d", 200)], "query_id string, rank int")
    r = E.ranking(ranks).first()
    assert (r.n, r.recall_1, r.recall_3, r.recall_10, r.outside) == (4, 0.25, 0.5, 0.5, 2) and r.mrr == pytest.approx((1 + 0.5 + 1 / 200) / 4, abs=1e-5)
    results = spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], "query_id string, id string, rank int")
    truth = spark.createDataFrame([("a", "y"), ("b", "z")], "query_id string, id string")
    assert {(r.query_id, r.rank) for r in E.target_ranks(results, truth).collect()} == {("a", 2), ("b", None)}
    assert E.failures(ranks).count() == 3 and {r.run for r in E.compare({"x": ranks, "y": ranks}).collect()} == {"x", "y"}


def test_decision_metrics(spark):
    schema = "lost_id string, found_id string, decision string, level string, final_score double, decided_at int"
    rows = [("1", "1", "CONFIRMED", "HIGH", 90.0, 1), ("2", "2", "CONFIRMED", "LOW", 55.0, 2), ("3", "3", "REJECTED", "VERY_HIGH", 97.0, 3), ("4", "4", "DEFERRED", "HIGH", 90.0, 4)]
    d = spark.createDataFrame(rows, schema)
    r = E.decision_metrics(d).first()
    assert (r.total, r.confirmed, r.rejected, r.deferred, r.assist_recall, r.wrong_recommendation_rate, r.precision_high) == (4, 2, 1, 1, 0.5, 0.5, 0.5)
    assert E.decision_metrics(d.limit(0)).first().assist_recall is None
    pairs = [(r.lost_id, r.label, r.hard_negative) for r in E.training_pairs(d).collect()]
    assert pairs == [("3", 0, True), ("2", 1, False), ("1", 1, False)] and E.training_pairs(d, limit=1).count() == 1
    assert E.unclassified(spark.createDataFrame([("a",), (None,)], "category string")).first().unclassified == 1


def test_searches_meet_texts_once(spark, monkeypatch):
    """Rows that share a text are searched as one; results are those of all pairs of rows, ties and the query's own row included."""
    texts = ["red wallet", "red  Wallet", "old red wallet", "umbrella", "red umbrella"]
    rows = [(i, texts[i % 5]) for i in range(40)] + [(90, None), (91, "")]
    records = spark.createDataFrame(rows, "id int, normalized_text string")
    asked = [(i, texts[i % 5]) for i in range(0, 40, 3)] + [(200 + i, "wallets") for i in range(3)] + [(300, ""), (301, None), (302, "qzx red")]
    queries = spark.createDataFrame(asked, "query_id int, query_text string")
    grams = lambda t: {f"  {w} "[i : i + 3] for w in t.lower().split() for i in range(len(w) + 1)}

    def alike(limit):
        out = {}
        for q, t in asked:
            g = grams(t or "")
            scored = [(len(g & grams(u)) / len(g | grams(u)), i) for i, u in rows if u and g and i != q]
            out[q] = sorted((-round(s, 6), i) for s, i in scored if round(s, 6) > 0.05)[:limit]
        return {q: v for q, v in out.items() if v}

    def collected(df):
        out = {}
        for r in df.collect():
            out.setdefault(r.query_id, []).append((r.rank, -r.score, r.id))
        return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}

    for block in (R.GRAMS, 20):
        monkeypatch.setattr(R, "GRAMS", block)
        for limit in (1, 7, 500):
            assert collected(R.trigram(queries, records, limit=limit)) == alike(limit)
    both = collected(R.keyword(queries, records, 7))
    covers = collected(R.cover_density(queries, R.occurrences(records), 7))
    assert covers and both == {**alike(7), **covers}
    seen = []
    monkeypatch.setattr(R, "_gram_pairs", lambda asked, known, *_, own=R._gram_pairs: (seen.append((asked.kinds.count(), known.kinds.count())), own(asked, known, *_))[1])
    R.keyword(queries, records, 7).collect()
    assert seen == [(3, 6)]


def test_nearest_places_are_those_of_all_pairs(spark, monkeypatch):
    """Few pairs are compared, and the least distance is that of all: poles, the date line, ties, places that lack a part."""
    from recordloom.functions.geo import haversine

    rng = np.random.default_rng(2)
    spots = lambda n: [(int(k % 3), float(a), float(o)) for k, (a, o) in enumerate(zip(np.round(rng.uniform(-90, 90, n), 1), np.round(rng.uniform(-180, 180, n), 1)))]
    mine = spots(90) + [(0, 90.0, 12.0), (1, -90.0, 0.0), (2, 10.0, 179.99), (0, None, 1.0), (1, float("nan"), 1.0), (None, 1.0, 1.0), (7, 1.0, 1.0)]
    base = spots(200) + [(2, 10.0, -179.99), (0, 5.0, 5.0), (0, 5.0, 5.0), (0, 1.0, None), (2, float("inf"), 0.0)]
    q, b = (spark.createDataFrame(x, "g int, lat double, lon double") for x in (mine, base))
    b2 = b.withColumnsRenamed({"lat": "near_lat", "lon": "near_lon"})
    far = F.round(haversine(F.col("lat"), F.col("lon"), F.col("near_lat"), F.col("near_lon")), 3).alias("m")
    whole = q.filter("NOT isnan(lat)").join(b2.filter("near_lat < double('infinity')"), "g").select("g", "lat", "lon", far).filter("m IS NOT NULL")
    want = {(r.g, r.lat, r.lon): r.m for r in whole.groupBy("g", "lat", "lon").agg(F.min("m").alias("m")).collect()}
    assert len(want) == 93
    for abreast, beside, places in ((R.ABREAST, R.BESIDE, R.PLACES), ((4, 16), 2, 20)):
        for name, v in (("ABREAST", abreast), ("BESIDE", beside), ("PLACES", places)):
            monkeypatch.setattr(R, name, v)
        got = R.nearest_places(q, b, "g")
        assert {(r.g, r.lat, r.lon): r.m for r in got.select("g", "lat", "lon", far).collect()} == want
    assert got.count() < whole.count() / 20


def test_trigrams_of_records_are_not_joined_row_by_row(spark, tmp_path):
    """No row for each trigram of a record, which the planner may take for small and broadcast."""
    spark.createDataFrame([("1", "red wallet"), ("2", "umbrella")], "id string, normalized_text string").write.parquet(str(tmp_path / "r"))
    found = R.trigram(spark.createDataFrame([("a", "umbrela")], "query_id string, query_text string"), spark.read.parquet(str(tmp_path / "r")))
    assert "explode(g#" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.query_id, r.id, r.rank) for r in found.collect()] == [("a", "2", 1)]
