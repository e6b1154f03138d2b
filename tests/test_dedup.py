import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators import assign, coverage, dedup


def union_find(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [], [(5, 5)], [(random.Random(3).randrange(60), random.Random(i).randrange(60)) for i in range(50)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.id: r.component for r in dedup.components(df).collect()} == union_find(edges)


def sequential(edges):
    left, right, out = set(), set(), []
    for s, a, b in sorted(edges, reverse=True):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.append((a, b, s))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_assignment(spark, seed):
    rng = random.Random(seed)
    edges = list({(a, b): (float(rng.randrange(6)), a, b) for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(70))}.values())
    df = spark.createDataFrame([(a, b, s) for s, a, b in edges], "a long, b long, score double")
    assert sorted(map(tuple, assign.greedy_assignment(df, "a", "b", "score").collect())) == sequential(edges)
    assert assign.greedy_assignment(df.limit(0), "a", "b", "score").count() == 0


def test_alignment(spark):
    sim = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (2, 10, 0.9), (2, 11, 0.7)], "l int, r int, similarity double")
    truth = spark.createDataFrame([(1, 10), (2, 11), (3, 12)], "l int, r int")
    ranks = assign.truth_rank(sim, "l", "r", truth)
    assert {(r.l, r["rank"]) for r in ranks.collect()} == {(1, 1), (2, 2), (3, None)}
    r = assign.top_rates(ranks).first()
    assert r.top1 == pytest.approx(1 / 3) and r.top3 == pytest.approx(2 / 3)
    assert len(spark.range(1).select(assign.alignment_text(F.lit("x" * 2000), F.lit("y"))).first()[0]) == 1200


def test_rerank(spark):
    rows = [("a", ["s3"], ["p"], ["cost"], 1), ("b", ["vpn"], ["q"], ["performance"], 1)]
    q = spark.createDataFrame(rows, "qid string, services array<string>, kps array<string>, constraints array<string>, select_n int")
    sim = spark.createDataFrame([("a", "a", 0.8), ("a", "b", 0.85)], "l string, r string, similarity double")
    got = {(r.l, r.r): (r["rank"], r.final_score) for r in assign.rerank(sim, q, q).collect()}
    assert got["a", "a"][0] == 1 and got["a", "b"][1] < got["a", "a"][1]
    assert assign.rerank(sim, q, q, 1).collect()[0].r == "b"


def pool(spark, d):
    return spark.createDataFrame([(q, k) for q, ks in d.items() for k in ks], "qid string, kb string")


def test_greedy_cover(spark):
    p = pool(spark, {"a": "xy", "b": "yz", "c": "xyz", "d": "w"})
    targets = spark.createDataFrame([(k,) for k in "xyzwv"], "kb string")
    ids = lambda df: [r.qid for r in df.orderBy("step").collect()]
    assert ids(coverage.greedy_cover(p, targets)) == ["c", "d"]
    assert ids(coverage.greedy_cover(p, targets, 2)) == ["c", "a", "b", "d"]
    must = spark.createDataFrame([("a",), ("nobody",)], "qid string")
    assert ids(coverage.greedy_cover(p, targets, must=must)) == ["a", "b", "d"]
    n = {r.kb: r.n for r in coverage.selection_coverage(p, spark.createDataFrame([("a",), ("b",)], "qid string")).collect()}
    assert n == {"x": 1, "y": 2, "z": 1}


def test_coverage(spark):
    items = spark.createDataFrame([("x", "D1"), ("v", "D1"), ("z", "D2")], "kb string, domain string")
    c = coverage.coverage(items, pool(spark, {"a": "xz", "b": "x"}))
    assert {r.kb: (r.questions, r.reachable) for r in c.collect()} == {"x": (2, True), "v": (0, False), "z": (1, True)}
    assert {r.domain: (r.blind, r.total, r.blind_ratio) for r in coverage.by_domain(c).collect()} == {"D1": (1, 2, 0.5), "D2": (0, 1, 0.0)}


QUESTION = "qid string, stem string, options map<string,string>, answer array<string>, answer_header array<string>, answer_text string, kps array<string>, services array<string>, constraints array<string>, select_n int, stem_vector array<double>, answer_vector array<double>"


def question(qid, stem, vector, kps=("p",), services=("s3",), goals=("cost",), n=1, header=("A",)):
    return (qid, stem, {"A": "x", "B": "y"}, ["A"], list(header), "do x", list(kps), list(services), list(goals), n, vector, [1.0, 0.0])


def test_deduplicate_questions(spark):
    rows = [
        question("1", "move the archive to cold storage now", [1.0, 0.0]),
        question("2", "move the archive to cold storage now", [1.0, 0.0], kps=("p",)),
        question("3", "move the archive to cold storage now", [1.0, 0.0], goals=("performance",)),
        question("4", "a different thing about networks", [0.0, 1.0], services=("vpn",), header=("B",)),
    ]
    q = spark.createDataFrame(rows, QUESTION)
    pairs, clusters = dedup.deduplicate(q, k=2)
    found = {(r.a, r.b): r for r in pairs.collect()}
    assert found["1", "2"].level == "DUPLICATE" and ("1", "3") not in found
    c = {r.qid: (r.cluster, r.size, r.representative) for r in clusters.collect()}
    assert c["1"] == c["2"] == ("1", 2, "1") and c["3"][1] == 1 and c["4"][1] == 1
    assert {r["size"]: r.clusters for r in dedup.size_histogram(clusters).collect()} == {2: 1, 1: 2}
    assert dedup.topic_pairs(pairs).count() == 0 and dedup.blocked_pairs(pairs).count() == 0
    assert [r.qid for r in dedup.answer_disagreements(q).collect()] == ["4"]


def test_block_cap(spark):
    rows = spark.createDataFrame([(i, "big") for i in range(6)] + [(i, "small") for i in range(3)], "id int, k string")
    got = sorted(map(tuple, dedup.block_by_key(rows, "id", "k", 5).collect()))
    assert got == [(0, 1), (0, 2), (1, 2)]


def test_greedy_by_value_equals_all_pairs():
    """The neighbours on the line give what the sequential greedy takes from all pairs: ties, equal values, values that rounding makes equally far, no numbers."""
    import numpy as np

    from recordloom.operators.assign import closest_pairs

    rng = np.random.default_rng(3)
    odd = [float("nan"), float("inf"), float("-inf"), 1e308, -1e308]
    pools = [np.arange(5.0), np.round(rng.random(40) * 20, 2), np.array([0.0, 1.0, 2.0, 1e17, 1e17 + 16, -1e17, 3e16]), np.array([*odd, 0.0, 1.0, 2.0]), np.array([-0.0, 0.0, 5e-324, 1.0])]
    for turn in range(400):
        pool = pools[turn % len(pools)]
        x, y = (rng.choice(pool, rng.integers(0, 14)) for _ in range(2))
        xs, ys = rng.permutation(len(x)), rng.permutation(len(y))
        with np.errstate(invalid="ignore", over="ignore"):
            far = {(i, j): abs(x[i] - y[j]) for i in range(len(x)) for j in range(len(y))}
        rank = lambda p: (-1 if np.isnan(far[p]) else far[p], -xs[p[0]], -ys[p[1]])
        want, used = [], (set(), set())
        for i, j in sorted(far, key=rank):
            if i not in used[0] and j not in used[1]:
                want.append((i, j))
                used[0].add(i)
                used[1].add(j)
        with np.errstate(over="ignore"):
            assert [tuple(map(int, p)) for p in closest_pairs(x, xs, y, ys)] == want


def test_greedy_by_value_makes_no_pairs(spark):
    """5,000 times 5,000 rows of a group in one go; groups, ids and values that are missing have no pair."""
    from recordloom.operators.assign import greedy_by_value

    left = spark.range(5000).selectExpr("'a' AS g", "id AS l", "double(id * 7919 % 5000) AS v").union(spark.sql("SELECT null, 9001L, 1D UNION ALL SELECT 'b', null, 1D UNION ALL SELECT 'b', 9002L, null UNION ALL SELECT 'b', 9003L, 4D"))
    right = spark.range(5000).selectExpr("'a' AS g", "string(id) AS r", "double(id) AS v").union(spark.sql("SELECT null, '9', 1D UNION ALL SELECT 'b', 'x', 9D UNION ALL SELECT 'b', 'y', -1D UNION ALL SELECT 'c', 'z', 1D"))
    got = greedy_by_value(left, right, "g", "l", "r", "v")
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert sorted((r.l, r.r, r.score) for r in rows) == [*((i, str(i * 7919 % 5000), 0.0) for i in range(5000)), (9003, "y", -5.0)]
