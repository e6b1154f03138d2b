import pytest
from pyspark.sql import functions as F

from recordloom import sqlapi
from recordloom.api import Engine
from recordloom.functions import text as T
from recordloom.functions import vectors as V
from recordloom.schema import ATTRIBUTE


def test_sql_functions(spark):
    sqlapi.register(spark, {"things": spark.createDataFrame([("Red  BAG!", "red-bag")], "a string, b string")})
    r = spark.sql("SELECT norm_text(a) AS n, text_overlap(a, b) AS o, cosine(array(1.0D, 2.0D), array(2.0D, 4.0D)) AS c, joint_penalty(array(10.0D, 8.0D, 6.0D)) AS p, rrf(array(2, 1, 1), 0) AS r, haversine(35.0D, 139.0D, 35.0D, 139.0D) AS h FROM things").first()
    assert (r.n, r.o, r.p, r.h) == ("red bag", 1.0, 17.0, 0.0) and r.c == pytest.approx(1) and r.r == pytest.approx(1 / 62 + 2 / 61)
    own = spark.range(1).select(T.text_overlap(F.lit("abc d"), F.lit("xbc")).alias("o"), V.cosine(F.array(F.lit(1.0), F.lit(0.5)), F.array(F.lit(0.2), F.lit(1.0))).alias("c")).first()
    r = spark.sql("SELECT text_overlap('abc d', 'xbc') AS o, cosine(array(1.0D, 0.5D), array(0.2D, 1.0D)) AS c").first()
    assert (r.o, r.c) == (own.o, own.c)


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), 64)
    secret = [("pin", "1234", "STAFF", 1.0, True, 0)]
    found = spark.createDataFrame([("F1", "FOUND", "black Apple iPhone 15 Pro with a cat sticker", secret), ("F2", "FOUND", "a blue umbrella", None)], f"id string, record_type string, raw_description string, attributes array<{ATTRIBUTE}>")
    e.register(found)
    assert e.table("records").count() == 2 and e.table("candidates").count() == 0
    e.register(spark.createDataFrame([("L1", "LOST", "lost my black iPhone 15 Pro, cat sticker on the back")], "id string, record_type string, raw_description string"))
    best = e.table("candidates").orderBy(F.col("final_score").desc()).first()
    assert (best.lost_id, best.found_id, best.status) == ("L1", "F1", "NEW") and best.final_score > 60
    ids = spark.createDataFrame([("F1",)], "id string")
    assert [r.other_id for r in e.matches(ids).collect()] == ["L1"] and "for: " in e.explanation(ids).first().explanation
    assert [a.code for a in e.item(ids).first().attributes if a.is_secret] == [] and [r.code for r in e.secret_questions(ids).collect()] == ["pin"]
    answers = spark.createDataFrame([("F1", {"pin": "it is 1234"})], "id string, answers map<string,string>")
    assert e.verify_secret(answers).first().verified
    hits = e.search(spark.createDataFrame([("q", "iPhone 15 Pro, black")], "query_id string, raw_description string"), include_low=True).collect()
    assert hits[0].id == "F1"
    pair = spark.createDataFrame([("L1", "F1", "CONFIRMED")], "lost_id string, found_id string, decision string")
    e.decide(pair)
    assert {r.id: r.status for r in e.table("records").collect()} == {"L1": "MATCHED", "F1": "MATCHED", "F2": "ACTIVE"}
    with pytest.raises(ValueError, match="CONFIRMED"):
        e.decide(pair.withColumn("decision", F.lit("PERHAPS")))
    e.give_back(pair)
    assert {r.id: r.status for r in e.table("records").collect()}["L1"] == "RETURNED"
    assert e.metrics().first().confirmed == 1 and e.training_pairs().first().label == 1
    assert e.embedding_status().first().n == 3 and e.table("runs").count() == 2
    before = {r.id: r.content_hash for r in e.table("vectors").collect()}
    e.refresh_vectors()
    assert {r.id: r.content_hash for r in e.table("vectors").collect()} == before


def test_images(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), 16)
    e.register(spark.createDataFrame([("F1", "FOUND", "bag"), ("F2", "FOUND", "ring"), ("F3", "FOUND", "key")], "id string, record_type string, raw_description string"))
    rows = [("F1", "a", False, [1.0, 0.0]), ("F1", "b", True, [0.9, 0.1]), ("F2", "c", True, [0.0, 1.0])]
    images = spark.createDataFrame(rows, "id string, url string, is_primary boolean, embedding array<double>")
    e.add_images(images, "clip")
    e.add_images(images.filter("url = 'c'"), "clip")
    asked = spark.createDataFrame([("q", [1.0, 0.05])], "query_id string, embedding array<double>")
    assert [(r.id, r.image_url, r["rank"]) for r in e.search_images(asked, "clip", 2).orderBy("rank").collect()] == [("F1", "b", 1), ("F2", "c", 2)]
    assert e.search_images(asked, "other").count() == 0 and e.table("images").count() == 3 and e.config()["weights"]["attribute"] == 0.25
    e.rematch(spark.createDataFrame([("F1",)], "id string"))
