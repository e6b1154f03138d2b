"""Inputs that once broke an operator: repeated keys, mixed lengths, deep trees, long chains, cycles."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom import config
from recordloom.api import Engine
from recordloom.functions import dictionary
from recordloom.operators import assign, coverage, dedup, report, retrieval, steps, store
from recordloom.sources import questions, tables
from tests.conftest import values


def test_vectors_of_different_lengths(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [0.9, 0.1, 0.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [1.0])]
    df = spark.createDataFrame(rows, "id int, embedding array<double>")
    got = {(r.query_id, r.id) for r in retrieval.nearest(df.withColumnRenamed("id", "query_id"), df, 5).collect()}
    assert got == {(1, 2), (2, 1), (3, 4), (4, 3)}


def test_ties_of_vector_blocks_go_to_the_larger_key(spark):
    df = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(4)] + [(9, [0.0, 1.0])], "id int, v array<double>")
    assert {(r.a, r.b) for r in dedup.block_by_vectors(df.filter("id < 9"), "id", "v", 1).collect()} == {(0, 3), (1, 3), (2, 3)}


def test_repeated_keys_of_stores(spark):
    old = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "x", 2), (1, "y", 3), (3, "z", 1), (3, "z", 1)], "k int, v string, at int")
    assert sorted(map(tuple, store.upsert(old, new, ["k"], order="at").collect())) == [(1, "y", 3), (2, "b", 1), (3, "z", 1)]
    assert sorted(r.v for r in store.upsert(old, new, ["k"], ["v"], "at").collect()) == ["a", "b", "z"]
    digests = new.select("k", F.col("v").alias("content_hash"))
    before = old.select("k", F.col("v").alias("content_hash")).union(digests.filter("content_hash = 'x'"))
    assert sorted((r.k, r.content_hash) for r in store.changed(digests.distinct(), before, ["k"]).collect()) == [(1, "y"), (3, "z")]


def test_deep_trees_and_cycles(spark):
    chain = spark.createDataFrame([(0, None)] + [(k, k - 1) for k in range(1, 40)], "id int, parent_id int")
    rows = {r.id: (r.ancestors, r.depth) for r in tables.ancestors(chain).collect()}
    assert len(rows) == 40 and rows[39] == (list(range(38, -1, -1)), 39)
    with pytest.raises(ValueError, match="cycle"):
        tables.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "id int, parent_id int"))


def test_assignment_of_a_long_chain(spark, monkeypatch):
    # Each edge is worse than the one before it and shares an end with it.
    edges = [(k // 2, (k + 1) // 2, float(1000 - k)) for k in range(600)]
    df = spark.createDataFrame(edges, "l int, r int, s double")
    got = sorted(map(tuple, assign.greedy_assignment(df, "l", "r", "s").collect()))
    left, right, want = set(), set(), []
    for l, r, s in sorted(edges, key=lambda e: -e[2]):  # noqa: E741
        if l not in left and r not in right:
            left.add(l)
            right.add(r)
            want.append((l, r, s))
    assert got == sorted(want) and len(want) > 200


@pytest.mark.parametrize("k", [1, 2])
def test_cover_takes_what_single_steps_would(spark, monkeypatch, k):
    monkeypatch.setattr(coverage, "BATCH", 5)
    rng = random.Random(k)
    pool = {q: {rng.randrange(60) for _ in range(rng.choice([1, 2, 3, 9]))} for q in range(40)}
    need, want = {i: k for i in range(60)}, []
    left = dict(pool)
    while left:
        gain = {q: sum(need.get(i, 0) > 0 for i in items) for q, items in left.items()}
        best = min(gain, key=lambda q: (-gain[q], q))
        if not gain[best]:
            break
        for i in left.pop(best):
            need[i] -= 1
        want.append((len(want), best, gain[best]))
    df = spark.createDataFrame([(q, i) for q, items in pool.items() for i in items], "qid int, kb int")
    targets = spark.range(60).select(F.col("id").cast("int").alias("kb"))
    assert sorted(map(tuple, coverage.greedy_cover(df, targets, k).collect())) == want


def test_merged_questions_stand_in_the_order_of_their_numbers(spark):
    one, two = (spark.createDataFrame([(n, s) for n in ns], "no string, stem string") for ns, s in ((["10", "9"], "first"), (["2", "10", "x"], "second")))
    assert [(r.no, r.stem) for r in questions.merged(one, two).collect()] == [("2", "second"), ("9", "first"), ("10", "first"), ("x", "second")]


def test_many_options_and_blocks(spark):
    text = "stem\n" + "\n".join(f"{'ABCDE'[k % 5]}. option {k}" for k in range(250))
    _, options = questions.split_question(F.lit(text))
    assert spark.range(1).select(options.alias("o")).first().o == {"ABCDE"[k % 5]: f"option {k}" for k in range(245, 250)}


def test_small_tables_are_broadcast_and_others_not(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(steps.small(spark.range(10), 10)) and not hinted(steps.small(spark.range(11), 10))


def test_rematch_reads_the_model_in_use(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), 16)
    schema = "id string, record_type string, raw_description string"
    e.register(spark.createDataFrame([("F1", "FOUND", "red umbrella"), ("L1", "LOST", "red umbrella")], schema))
    old = e.table("vectors")
    other = old.withColumns({"model": F.lit("other"), "embedding": F.array(F.lit(1.0), F.lit(2.0))}).unionByName(old.withColumns({"version": F.lit("0"), "status": F.lit("DEPRECATED")}))
    e._write("vectors", old.unionByName(other))
    e.rematch(spark.createDataFrame([("L1",)], "id string"))
    assert e.table("candidates").count() == 1


def test_reports(spark):
    q = spark.createDataFrame([(k,) for k in range(5)], "qid int")
    pairs = spark.createDataFrame([(0, 1, 99.0, "DUPLICATE", 0.0, []), (1, 2, 96.0, "DUPLICATE", 0.0, []), (3, 4, 80.0, "SAME_TOPIC", 35.0, ["x"])], "a int, b int, final_score double, level string, penalty double, conflicts array<string>")
    found = spark.createDataFrame([(0, 0, 3, 1), (1, 0, 3, 1), (2, 0, 3, 1), (3, 3, 1, 3), (4, 4, 1, 4)], "qid int, cluster int, size int, representative int")
    text = report.page("Duplicates", report.duplicates(q, pairs, found))
    assert "| 5 | 3 |" in text and "| 0 | 1 | 3 | 0 | 1 | 99.0 | 1 |" in text and "## blocked" in text
    ranks = spark.createDataFrame([("a", 1, "en"), ("b", None, "ja")], "query_id string, rank int, lang string")
    assert {r.lang: r.recall_1 for r in report.evaluation(ranks, "lang")["by lang"].collect()} == {"en": 1.0, "ja": 0.0}
    covered = spark.createDataFrame([("k", "d", 0, False), ("l", "d", 2, True)], "kb string, domain string, questions long, reachable boolean")
    assert [r.kb for r in report.blind_spots(covered)["blind"].collect()] == ["k"]


def test_configuration_is_read_again(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"a": 1}')
    watched = config.Watched(str(path))
    first = watched()
    assert first == {"a": 1} and watched() is first
    path.write_text('{"a": 22}')
    assert watched() == {"a": 22}


def test_canonical_names(spark):
    got = values(spark, a=dictionary.canonical_category(F.lit("My PARASOL")), b=dictionary.canonical_brand(F.lit("nobody")), c=dictionary.canonical_color(F.lit("Mauve!")), d=dictionary.canonical_color(F.lit("navy")))
    assert got == {"a": "umbrella", "b": None, "c": "mauve", "d": "blue"}


def test_cover_density_against_all_stretches(spark):
    rng = random.Random(3)
    docs = [(k, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 25)))) for k in range(60)]
    asked = [(100, "a b"), (101, "c A d"), (102, "e"), (103, "a zz"), (104, "")]
    got = {(r.query_id, r.id): r.score for r in retrieval.cover_density(spark.createDataFrame(asked, "query_id int, query_text string"), retrieval.occurrences(spark.createDataFrame(docs, "id int, t string"), "t")).collect()}
    want = {}
    for q, text in asked:
        terms = set(text.lower().split())
        for k, t in docs:
            w = t.split()
            whole = [(i, j) for i in range(len(w)) for j in range(i, len(w)) if terms and terms <= set(w[i : j + 1])]
            covers = [(i, j) for i, j in whole if not any((x, y) != (i, j) and i <= x and y <= j for x, y in whole)]
            if covers:
                want[q, k] = round(sum(0.1 / (1 + sum(x not in terms for x in w[i : j + 1])) for i, j in covers), 6)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
