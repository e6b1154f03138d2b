import json

import pytest
from pyspark.sql import functions as F

from recordloom.operators import report, store
from recordloom.sources import questions as Q
from recordloom.sources import tables as S
from recordloom.streaming import incremental
from tests.conftest import values

L = F.lit


def test_split_and_strip(spark):
    stem, options = Q.split_question(L("问题 #12 一家公司要归档。哪个解决方案最好？\nA. 用对象存储\nB. 用磁盘\nC. 都不用"))
    got = values(spark, stem=stem, options=options, short=Q.strip_asking(stem), only=Q.strip_asking(L("哪个方案？")), two=Q.select_count(L("请（选择两个）")), three=Q.select_count(L("Pick (Choose three)"), "en"), one=Q.select_count(L("x")))
    assert got["stem"].startswith("一家公司") and got["options"] == {"A": "用对象存储", "B": "用磁盘", "C": "都不用"}
    assert got["short"] == "一家公司要归档。" and got["only"] == "哪个方案？" and (got["two"], got["three"], got["one"]) == (2, 3, 1)


def test_build(spark):
    a = "✅ 正确答案: B, A\n**正确答案: C**\n**解题思路:** think hard\n**逐选项分析**\n**A.** ok\n> 分析：use s3\n\n**B.** no\n> second\n"
    df = spark.createDataFrame([("q1", "问题 #7 store it cheaply", a, ["Acme S3"], "t", "p")], "qid string, raw_q string, raw_a string, kps array<string>, title string, path string")
    r = Q.build(df, {"S3": ("s3",)}, {"cost": ("cheap",)}, ("Acme",)).first()
    assert r.answer == ["A", "B"] and r.answer_header == ["C"] and r.options == {"A": "use s3", "B": "second"} and r.answer_text == "use s3 second"
    assert r.kps == ["s3"] and r.services == ["S3"] and r.constraints == ["cost"] and r.source_no == "7" and r.select_n == 2 and r.qtype == "multi" and r.stem_truncated and r.rationale == "think hard"


TEXT = "1. 问题 #1 使用A\nurora 数据库（选择两个）\nA. 一\nB. 二\n续\nC. 三\n答案：A, C\n解析：no\n2. 问题 #2 缺选项\nA. 一\nB. 二\n"
ENGLISH = "Question #4A company is in an\non-premises site. (Choose two)\nA. one\nB. two-\nthree\nC. four\nAnswer: A\nExplanation: x"


@pytest.mark.parametrize("language, text, want", [("zh", TEXT, ("1", "使用Aurora 数据库（选择两个）", {"A": "一", "B": "二续", "C": "三"}, ["A", "C"], 2)), ("en", ENGLISH, ("4", "A company is in an on-premises site. (Choose two)", {"A": "one", "B": "two-three", "C": "four"}, ["A"], 2))])
def test_exam_text(spark, language, text, want):
    rows = Q.exam_text(spark.createDataFrame([(text,), (None,)], "value string"), language).collect()
    assert [(r.no, r.stem, r.options, r.answer, r.select_n) for r in rows] == [want]


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"title": "T", "knowledge_points": ["k"], "interview_questions": [{"q": "stem", "a": "x"}]}))
    (tmp_path / "b.json").write_text("{ broken")
    assert [(r.qid, r.raw_q, r.kps) for r in Q.course_json(spark, f"{tmp_path}/*.json").collect()] == [("a", "stem", ["k"])]
    (tmp_path / "q.jsonl").write_text('{"id": "1", "stem": "s", "options": {"B": "y", "A": "x"}, "answer": ["A"]}\n\n')
    r = Q.jsonl(spark, f"{tmp_path}/q.jsonl").first()
    assert r.raw_q == "s\nA. x\nB. y" and r.raw_a.endswith("A")
    (tmp_path / "g").mkdir()
    (tmp_path / "g/1.json").write_text(json.dumps({"question_number": "3", "question": "问题 #3 why", "options": {"A": "1", "B": "2", "C": "3"}}))
    g = Q.generated(spark, f"{tmp_path}/g")
    md = spark.createDataFrame([("intro\n## 3 x\n> other\n- A. a\n- B. b\n- C. c\n## 5 y\n> stem\n- A. a\n- B. b\n- C. c\n知识点：k1、k2\n",)], "value string")
    d = Q.disagreements(md)
    assert {(r.no, r.stem) for r in Q.merged(g, d).collect()} == {("3", "why"), ("5", "stem")}
    assert {r.no: r.kps for r in d.collect()}["5"] == ["k1", "k2"]
    (tmp_path / "bp.json").write_text(json.dumps({"domains": [{"id": "1", "title": "D", "tasks": [{"id": "1.1", "title": "T", "knowledge": ["a", "b"]}]}]}))
    assert sorted(r.kb for r in Q.blueprint(spark, f"{tmp_path}/bp.json").collect()) == ["1.1.K1", "1.1.K2"]
    (tmp_path / "pool.json").write_text('{"q1": ["a", "b"], "q2": ["a"]}')
    assert Q.pool(spark, f"{tmp_path}/pool.json").count() == 3
    (tmp_path / "r.json").write_text('{"topic_pairs": [{"a": "sap-1", "b": "sap-2"}]}')
    (tmp_path / "r.md").write_text("see sap-3 and sap-4")
    assert sorted(r.qid for r in Q.keep_pairs(spark, f"{tmp_path}/r.json").collect()) == ["1", "2"]
    assert sorted(r.qid for r in Q.keep_pairs(spark, f"{tmp_path}/r.md").collect()) == ["3", "4"]


def test_tables(spark, tmp_path):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99)], "id long, parent_id long")
    assert {r.id: r.ancestors for r in S.ancestors(tree).collect()} == {1: [], 2: [1], 3: [2, 1], 4: [99]}
    demo = S.demo_records(spark, ["bag", "keys"], [("red", "tote", "logo"), ("blue", "ring", "tag")], ["X", "Y", "Z"])
    assert demo.count() == 4 and {r.location_name for r in demo.collect()} == {"X", "Y", "Z"}
    assert S.synonyms(spark, {"a": {"x": ("y",)}}).count() == 2
    old = spark.createDataFrame([("a", 1)], "code string, n int")
    assert sorted(map(tuple, S.seeded(old, spark.createDataFrame([("a", 2), ("b", 3)], "code string, n int"), "code").collect())) == [("a", 1), ("b", 3)]
    (tmp_path / "i").mkdir()
    png = b"\x89PNG\r\n\x1a\n"
    (tmp_path / "i/a.png").write_bytes(png)
    (tmp_path / "i/b.png").write_bytes(png + b"x")
    (tmp_path / "i/c.png").write_bytes(b"x")
    (tmp_path / "i/d.txt").write_bytes(b"\xff\xd8\xff")
    assert sorted((r.length, r.name[-4:]) for r in S.images(spark, str(tmp_path / "i"), 8).collect()) == [(3, ".jpg"), (8, ".png")]


def test_bundles(spark):
    records = spark.createDataFrame([("1", "bag"), ("2", None)], "id string, category string")
    attrs = spark.createDataFrame([("1", "color", "red", "USER", 1.0, False, 1), ("1", "distinctive", "dent", "USER", 1.0, False, 0)], "id string, code string, value string, source string, confidence double, is_secret boolean, ordinal int")
    places = spark.createDataFrame([(5, "X", [6], 1.0, 2.0)], "id long, name string, ancestors array<bigint>, lat double, lon double")
    reports = spark.createDataFrame([("1", None, "2024-01-02", 5)], "id string, start_at string, at string, location_id long").select("id", F.to_timestamp("at").alias("at"), F.to_timestamp("start_at").alias("start_at"), F.to_timestamp("start_at").alias("end_at"), "location_id")
    rows = {r.id: r for r in S.bundles(records, attrs, places, reports).collect()}
    assert [a.code for a in rows["1"].attributes] == ["color"] and rows["1"].distinctive == ["dent"] and rows["1"].location.name == "X" and rows["1"].start_at == rows["1"].end_at is not None
    assert rows["2"].attributes == [] and rows["2"].location is None


def test_stores(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "h1", "KEPT"), (2, "b", "h2", "OLD")], "id int, v string, content_hash string, status string")
    new = spark.createDataFrame([(2, "B", "h9", "NEW"), (3, "c", "h3", "NEW")], "id int, v string, content_hash string, status string")
    assert sorted(r.id for r in store.changed(new.union(old.filter("id = 1")), old, ["id"]).collect()) == [2, 3]
    assert sorted(map(tuple, store.upsert(old, new, ["id"], ["status"]).collect())) == [(1, "a", "h1", "KEPT"), (2, "B", "h9", "OLD"), (3, "c", "h3", "NEW")]
    assert sorted(r.v for r in store.replace_by(old, new, ["id"]).collect()) == ["B", "a", "c"]
    assert sorted(r.id for r in store.audit(old, store.upsert(old, new, ["id"]), "id").collect()) == [2, 3]
    assert store.emptied(old).count() == 0 and store.insert_records(old, new).count() == 4
    path = str(tmp_path / "t")
    store.write(old, path, ["id"])
    store.write(new, path, ["id"])
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == ["B", "a", "c"]


def test_lifecycle(spark):
    c = spark.createDataFrame([("L1", "F1", "NEW"), ("L2", "F2", "NEW")], "lost_id string, found_id string, status string")
    d = spark.createDataFrame([("L1", "F1", "REJECTED", 1), ("L1", "F1", "CONFIRMED", 2), ("L2", "F2", "BOGUS", 3)], "lost_id string, found_id string, decision string, decided_at int")
    after = store.decide(c, d)
    assert {r.lost_id: r.status for r in after.collect()} == {"L1": "CONFIRMED", "L2": "NEW"}
    records = spark.createDataFrame([("L1", "ACTIVE"), ("F1", "ACTIVE"), ("L2", "ACTIVE"), ("F2", "ACTIVE")], "id string, status string")
    returns = spark.createDataFrame([("L2", "F2")], "lost_id string, found_id string")
    assert {r.id: r.status for r in store.record_status(records, after, returns).collect()} == {"L1": "MATCHED", "F1": "MATCHED", "L2": "RETURNED", "F2": "RETURNED"}


def test_locations_and_models(spark):
    places = spark.createDataFrame([(1, "Main Station", ["Central"]), (2, "Airport", None)], "id long, name string, aliases array<string>")
    names = spark.createDataFrame([("central",), ("AIRPORT",), ("Harbour",), ("harbour",), ("",)], "name string")
    known, fresh = store.resolve_locations(names, places)
    assert {r.name: r.id for r in known.collect()} == {"central": 1, "AIRPORT": 2} and [r.name for r in fresh.collect()] == ["Harbour"]
    old = spark.createDataFrame([("1", "m1", "ACTIVE")], "item string, model string, status string")
    new = spark.createDataFrame([("1", "m2", "ACTIVE")], "item string, model string, status string")
    assert {r.model: r.status for r in store.reembed(old, new, ["item", "model"], True).collect()} == {"m1": "DEPRECATED", "m2": "ACTIVE"}


def test_reextract(spark):
    attr = "array<struct<code:string,value:string,source:string>>"
    rows = spark.createDataFrame([("1", "bag", None, None, "x", 1, [("a", "1", "USER"), ("b", "2", "AI")])], f"id string, category string, brand string, model string, normalized_text string, version int, attributes {attr}")
    again = lambda df: df.withColumns({"category": F.lit("keys"), "attributes": F.array(F.struct(F.lit("c").alias("code"), F.lit("3").alias("value"), F.lit("AI").alias("source")))})
    r = store.reextract(rows, again).first()
    assert r.changed and r.category == "keys" and r.version == 2 and [a.code for a in r.attributes] == ["a", "c"]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, t string")
    assert report.markdown(df, "T").splitlines()[4] == "| 1 | a\\|b |"
    report.json_report(df, str(tmp_path / "j"), 1)
    report.csv_report(df, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1 and spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_stream(spark, tmp_path):
    schema = "id string, record_type string, ts timestamp"
    rows = [("1", "LOST", "2024-01-01 00:00:00"), ("1", "LOST", "2024-01-01 00:01:00"), ("2", "FOUND", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "id string, record_type string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = incremental.deduplicated(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "id")
    got = []
    q = incremental.on_arrival(stream, lambda df, other: df.withColumn("target", F.lit(other)), lambda df, epoch: got.extend((r.id, r.target) for r in df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted(got) == [("1", "FOUND"), ("2", "LOST")]
