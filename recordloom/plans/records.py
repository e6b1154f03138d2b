"""Queries of stores, bundles and searches, each with its SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import assign, coverage, evaluate, report, retrieval, store
from recordloom.operators.steps import settled
from recordloom.plans.queries import COVER_SQL, NEAREST_SQL, covering, gram_sql, query, vector_queries
from recordloom.sources.tables import bundles, image_kind, parquet

# ---- bundles and stores --------------------------------------------------------------------


@query("""
WITH f AS (SELECT o_custkey, min(o_orderdate) AS seen FROM orders GROUP BY o_custkey)
SELECT '' || c_custkey AS id, 'segment=' || c_mktsegment || ';tier=' || c_nationkey % 3 AS codes, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS marks, n_name AS place, '' || r_regionkey AS above,
strftime(seen, '%Y-%m-%d') AS begins, strftime(CASE WHEN c_custkey % 3 = 0 THEN seen + INTERVAL 2 DAY ELSE seen END, '%Y-%m-%d') AS ends
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20 LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN f ON o_custkey = c_custkey""")
def record_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2, JN1: records with attributes, marks, location and report times as one row; a missing dimension stays open."""
    c, n, o = (parquet(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    key = F.col("c_custkey").cast("string").alias("id")
    row = lambda ordinal, code, value, when=F.lit(True): c.filter(when).select(key, F.lit(ordinal).alias("ordinal"), F.lit(code).alias("code"), value.cast("string").alias("value"), F.lit("USER").alias("source"), F.lit(1.0).alias("confidence"), F.lit(False).alias("is_secret"))
    rows = row(2, "tier", F.col("c_nationkey") % 3).union(row(1, "segment", F.col("c_mktsegment"))).union(row(0, "distinctive", F.col("c_name"), F.col("c_custkey") % 2 == 0))
    places = n.filter("n_nationkey < 20").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.array(F.col("n_regionkey").cast("long")).alias("ancestors"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    first = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("at"))
    reports = c.join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select(key, "at", F.lit(None).cast(dict(first.dtypes)["at"]).alias("start_at"), F.when(F.col("c_custkey") % 3 == 0, F.col("at") + F.expr("INTERVAL 2 DAYS")).alias("end_at"), F.col("c_nationkey").cast("long").alias("location_id"))
    out = bundles(c.select(key, F.col("c_mktsegment").alias("category")), rows, places, reports)
    codes = F.array_join(F.transform("attributes", lambda a: F.concat_ws("=", a["code"], a["value"])), ";")
    day = lambda t: F.date_format(t, "yyyy-MM-dd")
    return out.select("id", codes.alias("codes"), F.array_join("distinctive", ",").alias("marks"), F.col("location.name").alias("place"), F.col("location.ancestors")[0].cast("string").alias("above"), day("start_at").alias("begins"), day("end_at").alias("ends"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status, NULL AS note FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def inserted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1: new records behind old ones, with the columns that either lacks."""
    o = parquet(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("note"))
    return store.insert_records(o.filter("status = 'O'").drop("note"), o.filter("status = 'F'")).select("id", "status", "note")


@query("""
WITH d AS (SELECT o_custkey AS k, max(o_orderkey) AS id, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT c_custkey AS k, coalesce(d.id, -1) AS id, coalesce(n, 0) AS n FROM customer LEFT JOIN d ON k = c_custkey""")
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3: of new rows that repeat a key the latest counts, and old duplicates do not multiply."""
    c = parquet(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(-1).cast("long").alias("id"))
    o = parquet(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"))
    counts = o.groupBy("k").agg(F.count("*").alias("n"))
    return store.upsert(c, o, ["k"], order="id").join(counts, "k", "left").select("k", "id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7)
UNION ALL SELECT l_orderkey, 0, -l_quantity FROM lineitem WHERE l_linenumber = 7""")
def replaced_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK4: all rows of a key give way to its new ones."""
    rows = parquet(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return store.replace_by(rows, rows.filter("l_linenumber = 7").withColumns({"l_linenumber": F.lit(0), "l_quantity": -F.col("l_quantity")}), ["l_orderkey"])


@query("""SELECT 'r1' AS run_id, '{"limit":5,"mode":"full"}' AS config, true AS stamped, count(*) AS n FROM orders""")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5: a run with its settings."""
    counts = parquet(spark, sf_dir, "orders").agg(F.count("*").alias("n"))
    out = store.run_log("r1", F.struct(F.lit(5).alias("limit"), F.lit("full").alias("mode")), counts)
    return out.select("run_id", "config", F.col("at").isNotNull().alias("stamped"), "n")


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN '{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' END AS before,
CASE WHEN o_orderstatus <> 'F' THEN '{"id":' || o_orderkey || ',"status":"' || CASE o_orderstatus WHEN 'O' THEN 'o' ELSE 'P' END || '"}' END AS after FROM orders""")
def audited_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK6: rows that differ between two states, gone and new ones too."""
    o = parquet(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("id"))
    after = o.filter("status <> 'F'").withColumn("status", F.when(F.col("status") == "O", "o").otherwise(F.col("status")))
    return store.audit(o.filter("status <> 'P'"), after, "id")


@query("""SELECT doc_id AS id, sha256(coalesce(text, '')) AS input_hash, 'v1' AS prompt_version, '{"lang":"' || lang || '","n":' || n_chars || '}' AS result_json FROM documents""")
def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK7: analyses with the hash of what they read."""
    d = parquet(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.struct("lang", F.col("n_chars").alias("n")).alias("result"))
    return store.analysis_log(d, "text", "result", "v1")


DECIDED = "CASE l_linenumber % 5 WHEN 1 THEN 'CONFIRMED' WHEN 2 THEN 'REJECTED' WHEN 3 THEN 'DEFERRED' ELSE 'BOGUS' END"


@query(f"""
WITH d AS (SELECT l_orderkey, {DECIDED} AS decision, l_shipdate FROM lineitem WHERE {DECIDED} <> 'BOGUS' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, {DECIDED} DESC) = 1)
SELECT '' || o_custkey AS lost_id, '' || o_orderkey AS found_id, coalesce(decision, 'NEW') AS status FROM orders LEFT JOIN d ON l_orderkey = o_orderkey""")
def decided_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK8, JN3: candidates with the status of their latest valid decision."""
    o = parquet(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("lost_id"), F.col("o_orderkey").cast("string").alias("found_id"))
    made = parquet(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("found_id"), F.expr(DECIDED).alias("decision"), F.col("l_shipdate").alias("decided_at")).join(o, "found_id")
    return store.decide(o.withColumn("status", F.lit("NEW")), made)


@query("""
WITH m AS (SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 = 0), r AS (SELECT o_custkey AS id FROM orders WHERE o_orderkey % 11 = 0)
SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey IN (SELECT id FROM r) THEN 'RETURNED' WHEN c_custkey IN (SELECT id FROM m) THEN 'MATCHED' ELSE 'ACTIVE' END AS status FROM customer""")
def record_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK8, SNK9: both records of a confirmed pair are matched, returned ones returned."""
    o = parquet(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("lost_id"), F.concat(F.lit("o"), "o_orderkey").alias("found_id"), "o_orderkey", "o_orderstatus")
    records = parquet(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("ACTIVE").alias("status"))
    candidates = o.filter("o_orderkey % 5 = 0").select("lost_id", "found_id", F.when(F.col("o_orderstatus") == "F", "CONFIRMED").otherwise("NEW").alias("status"))
    return store.record_status(records, candidates, o.filter("o_orderkey % 11 = 0").select("lost_id", "found_id"))


@query("""
SELECT upper(n_name) AS name, n_nationkey::BIGINT AS id FROM nation WHERE n_nationkey < 15 UNION ALL SELECT 'the  ' || n_name, n_nationkey FROM nation WHERE n_nationkey < 15
UNION ALL SELECT upper(n_name), NULL FROM nation WHERE n_nationkey >= 15 UNION ALL SELECT 'the  ' || n_name, NULL FROM nation WHERE n_nationkey >= 15""")
def resolved_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK10: names by normalised name or alias, and the names that are new."""
    n = parquet(spark, sf_dir, "nation")
    places = n.filter("n_nationkey < 15").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("The "), "n_name")).alias("aliases"))
    names = n.select(F.upper("n_name").alias("name")).union(n.select(F.concat(F.lit("the  "), "n_name"))).union(n.select(F.lit(" . ")))
    known, fresh = store.resolve_locations(names, places)
    return known.unionByName(fresh.withColumn("id", F.lit(None).cast("long")))


@query("""
SELECT vec_id AS id, 'm1' AS model, label, 'DEPRECATED' AS status FROM embeddings WHERE vec_id % 3 > 0
UNION ALL SELECT vec_id, 'm2', label + 100, 'ACTIVE' FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id, 'm2', label, 'ACTIVE' FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 2 = 1""")
def reembedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK11: a model's vectors are added, and the other models retire by status."""
    e = parquet(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 > 0, "m1").otherwise("m2").alias("model"), "label", F.lit("ACTIVE").alias("status"))
    new = e.filter("id % 2 = 0").withColumns({"model": F.lit("m2"), "label": F.col("label") + 100})
    return store.reembed(e, new, ["id", "model"], activate=True)


@query("""
SELECT p_partkey AS id, p_type AS category, p_brand AS brand, 2 AS version, p_partkey % 4 > 0 AS changed, CASE WHEN p_partkey % 2 = 0 THEN 'mine,c' ELSE 'c' END AS codes FROM part""")
def reextracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK12: extracted anew: others' attributes stay, a version up, differences marked."""
    attr = lambda code, source: F.struct(F.lit(code).alias("code"), F.lit("1").alias("value"), source.alias("source"))
    own = F.when(F.col("p_partkey") % 2 == 0, F.lit("USER")).otherwise(F.lit("AI"))
    p = parquet(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_type")).when(F.col("p_partkey") % 4 == 1, "old").alias("category"), F.col("p_brand").alias("brand"), F.lit(None).cast("string").alias("model"), F.lit("t").alias("normalized_text"), F.lit(1).alias("version"), F.col("p_type").alias("_kind"), F.array(attr("mine", own), attr("b", F.lit("AI"))).alias("attributes"))
    again = lambda df: df.withColumns({"category": F.col("_kind"), "attributes": F.array(attr("c", F.lit("AI")), attr("d", F.lit("USER")))})
    out = store.reextract(p, again)
    return out.select("id", "category", "brand", "version", "changed", F.array_join(F.transform("attributes", lambda a: a["code"]), ",").alias("codes"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE false")
def emptied_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK13: the table without rows."""
    return store.emptied(parquet(spark, sf_dir, "supplier").select("s_suppkey", "s_name"))


@query("SELECT lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY lang")
def reported_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK14: a report as JSON lines in the shared folder, read again."""
    rows = parquet(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    path = report.written(rows, "counts")
    return spark.read.schema(rows.schema).json(path)


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'webp' END AS kind FROM part""")
def image_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC20: the kind of a file from its first bytes, whatever it is called."""
    head = F.expr("CASE p_partkey % 5 WHEN 0 THEN unhex('89504E470D0A1A0A00') WHEN 1 THEN unhex('FFD8FFE000') WHEN 2 THEN unhex('52494646000000005745425056503820') WHEN 3 THEN unhex('52494646000000004156492000') ELSE unhex('') END")
    return parquet(spark, sf_dir, "part").select("p_partkey", image_kind(head).alias("kind"))


# ---- searches ------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT a.p_partkey AS query_id, b.p_partkey AS id, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_partkey % 97 DESC, b.p_partkey) AS rank
           FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_partkey <> b.p_partkey WHERE a.p_partkey % 100 = 0 AND a.p_partkey % 300 > 0)
SELECT query_id, id, rank::INT AS rank FROM r WHERE rank <= 20""")
def structured_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET1, JN7: the newest records of a query's category, none for a query without."""
    p = parquet(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("category"), F.timestamp_seconds(F.col("p_partkey") % 97).alias("created_at"))
    q = p.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.when(F.col("id") % 300 > 0, F.col("category")).alias("category"))
    return retrieval.structured(q, p, 20)


@query(f"""
WITH q AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 200 = 0 THEN p_name || ' t' || lower(p_type) ELSE 'qzx ' || p_name END AS t FROM part WHERE p_partkey % 100 = 0),
r AS (SELECT p_partkey AS id, p_name || ' t' || lower(p_type) AS t FROM part),
x AS (SELECT q.query_id, id, 0.1::DOUBLE AS score FROM q JOIN r USING (t) WHERE id <> query_id),
g AS (SELECT query_id, {gram_sql('t')} AS g FROM q WHERE query_id NOT IN (SELECT query_id FROM x)), h AS (SELECT id, {gram_sql('t')} AS h FROM r),
y AS (SELECT query_id, id, round(len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))), 6) AS score FROM g JOIN h ON id <> query_id),
z AS (SELECT * FROM x UNION ALL SELECT * FROM y WHERE score > 0.05)
SELECT query_id, id, score FROM z QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20""")
def keyword_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET2, RET3: full text, and trigrams only for queries that it finds nothing for; the query set is every hundredth part."""
    text = F.concat("p_name", F.lit(" t"), F.lower("p_type"))
    p = parquet(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("normalized_text"), "p_name")
    q = p.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.when(F.col("id") % 200 == 0, F.col("normalized_text")).otherwise(F.concat(F.lit("qzx "), "p_name")).alias("query_text"))
    return retrieval.keyword(q, p, 20).select("query_id", "id", "score")


@query(f"""
WITH {NEAREST_SQL},
c AS (SELECT a.vec_id AS query_id, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id % 89 DESC, b.vec_id) AS rank FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
w AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(CASE WHEN b.vec_id % 2 = 1 THEN 0.1 ELSE 0.1 / 2 + 0.1 END, 6) AS score FROM v a JOIN v b ON a.vec_id % 7 = b.vec_id % 7 AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
k AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM w),
u AS (SELECT query_id, id, rank, 'text' AS s FROM r WHERE rank <= 500 UNION ALL SELECT query_id, id, rank, 'structured' FROM c WHERE rank <= 500 UNION ALL SELECT query_id, id, rank, 'keyword' FROM k WHERE rank <= 500),
f AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS rrf_score, string_agg(s, ',' ORDER BY s) AS sources FROM u GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id)::INT AS rank FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) <= 60)
SELECT t.query_id, t.id, rrf_score, sources, t.rank, k.score AS keyword_rank, round(CASE WHEN r.rank <= 500 THEN similarity END, 6) AS semantic_cosine
FROM t LEFT JOIN k ON k.query_id = t.query_id AND k.id = t.id AND k.rank <= 500 LEFT JOIN r ON r.query_id = t.query_id AND r.id = t.id""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET5, RET6: structured, keyword and vector channels fused, with raw channel scores; the query set is every hundredth vector."""
    q, e = vector_queries(spark, sf_dir)
    word = lambda c: F.concat(F.lit("item k"), (c % 7).cast("string"))
    records = e.select("id", F.col("label").cast("string").alias("category"), F.timestamp_seconds(F.col("id") % 89).alias("created_at"))
    # One cover without other words in it; or two, one of them with another word.
    text = F.when(F.col("id") % 2 == 1, F.concat(word(F.col("id")), F.lit(" z z"))).otherwise(F.concat(word(F.col("id")), F.lit(" z o item")))
    records = records.withColumn("normalized_text", text)
    queries = q.select("query_id", F.col("label").cast("string").alias("category"), F.concat(word(F.col("query_id")), F.lit(" Z")).alias("query_text"))
    out = retrieval.hybrid(queries, records, e.select("id", "embedding"), q.select("query_id", "embedding"), limit=60)
    return out.select("query_id", "id", "rrf_score", F.array_join("sources", ",").alias("sources"), "rank", "keyword_rank", F.round("semantic_cosine", 6).alias("semantic_cosine"))


@query(f"""
WITH {NEAREST_SQL},
a AS (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INT AS rank FROM r WHERE id % 3 > 0)
SELECT query_id, id, round(similarity, 6) AS similarity, rank, CASE WHEN id % 2 = 0 THEN 'u' || id || 'b' ELSE 'u' || id || 'a' END AS image_url FROM a WHERE rank <= 20""")
def image_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET7, RET8, JN8: active records by image similarity, each with its primary image."""
    q, e = vector_queries(spark, sf_dir)
    records = e.select("id", F.when(F.col("id") % 3 > 0, "ACTIVE").otherwise("RETURNED").alias("status"))
    image = lambda name, first: e.select("id", F.concat(F.lit("u"), "id", F.lit(name)).alias("url"), first.alias("is_primary"))
    images = image("a", F.col("id") % 2 == 1).union(image("b", F.col("id") % 2 == 0))
    return retrieval.image_search(q, e.select("id", "embedding"), records, images, 20).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank", "image_url")


ALIGNED_SQL = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.vec_id AS l, b.vec_id AS r, list_cosine_similarity(a.e, b.e) AS similarity FROM v a JOIN v b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY similarity DESC, r) AS rank FROM s)"""


@query(f"WITH {ALIGNED_SQL} SELECT vec_id AS l, k.rank::INT AS rank FROM v LEFT JOIN k ON k.l = vec_id AND k.r = vec_id + 1 AND k.rank <= 40 WHERE vec_id % 2 = 0 AND vec_id + 1 IN (SELECT vec_id FROM v)")
def alignment_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AL1, JN12, JN13: where each row's true partner stands among its 40 nearest of the other side."""
    e = parquet(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = retrieval.nearest(e.filter("vec_id % 2 = 0").withColumnRenamed("vec_id", "l"), e.filter("vec_id % 2 = 1").withColumnRenamed("vec_id", "r"), 40, "l", "r")
    truth = e.filter("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("l"), F.col("vec_id").alias("r"))
    return assign.truth_rank(found.drop("rank"), "l", "r", truth)


@query(f"""
WITH {ALIGNED_SQL}, t AS (SELECT vec_id AS l, k.rank FROM v LEFT JOIN k ON k.l = vec_id AND k.r = vec_id + 1 AND k.rank <= 40 WHERE vec_id % 2 = 0 AND vec_id + 1 IN (SELECT vec_id FROM v))
SELECT avg((coalesce(rank, 99) <= 1)::INT) AS top1, avg((coalesce(rank, 99) <= 3)::INT) AS top3, avg((coalesce(rank, 99) <= 10)::INT) AS top10 FROM t""")
def alignment_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AL4: the share of rows whose true partner is among the first."""
    return assign.top_rates(alignment_ranks(spark, sf_dir))


# ---- evaluation ----------------------------------------------------------------------------


@query(f"""
WITH {NEAREST_SQL}
SELECT vec_id AS query_id, r.rank::INT AS rank FROM v LEFT JOIN r ON r.query_id = vec_id AND r.id = vec_id + 1 AND r.rank <= 100 WHERE vec_id % 100 = 0""")
def target_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV2: where each query's target stands; null where it is not found."""
    q, e = vector_queries(spark, sf_dir)
    return evaluate.target_ranks(retrieval.nearest(q, e, 100), q.select("query_id", (F.col("query_id") + 1).alias("id")))


@query(f"""
WITH {NEAREST_SQL}, t AS (SELECT vec_id AS query_id, r.rank FROM v LEFT JOIN r ON r.query_id = vec_id AND r.id = vec_id + 1 AND r.rank <= 100 WHERE vec_id % 100 = 0) SELECT query_id, rank::INT AS rank FROM t WHERE rank IS NULL OR rank > 1""")
def missed_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV1: queries whose target is not first."""
    return evaluate.failures(target_ranks(spark, sf_dir))


RUNS_SQL = """
SELECT '{run}' AS run, count(*) AS n, round(avg((rank <= 1)::INT), 4) AS recall_1, round(avg((rank <= 3)::INT), 4) AS recall_3, round(avg((rank <= 10)::INT), 4) AS recall_10, round(avg(1.0 / rank), 5) AS mrr, count(*) FILTER (WHERE rank > 100) AS outside
FROM (SELECT user_id % {k} + 1 AS rank FROM events)"""


@query(" UNION ALL ".join(RUNS_SQL.format(run=r, k=k) for r, k in (("image", 5), ("text", 130))))
def compared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV3, EV4: the measures of several runs side by side."""
    e = parquet(spark, sf_dir, "events")
    return evaluate.compare({r: e.select((F.col("user_id") % k + 1).alias("rank")) for r, k in (("image", 5), ("text", 130))})


@query("SELECT actual, taken, count(*) AS n FROM (SELECT label % 2 AS actual, (label + vec_id % 3) % 10 % 2 AS taken FROM embeddings) WHERE actual <> taken GROUP BY ALL")
def confusable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV3: which kinds are taken for which others, and how often."""
    e = parquet(spark, sf_dir, "embeddings").select((F.col("label") % 2).alias("actual"), ((F.col("label") + F.col("vec_id") % 3) % 10 % 2).alias("taken"))
    return evaluate.confusions(e, "actual", "taken")


@query("SELECT count(*) FILTER (WHERE p_size % 4 = 0) AS unclassified, count(*) AS total FROM part")
def unclassified_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG5."""
    return evaluate.unclassified(parquet(spark, sf_dir, "part").select(F.when(F.col("p_size") % 4 > 0, F.col("p_type")).alias("category")))


@query(f"WITH {COVER_SQL} SELECT kb, count(*) AS n FROM q WHERE qid % 10 = 0 GROUP BY kb")
def selection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CV3: how often a selection covers each item."""
    items, pool = covering(spark, sf_dir)
    pool = settled(pool.distinct())
    return coverage.selection_coverage(pool, pool.filter("qid % 10 = 0"))
