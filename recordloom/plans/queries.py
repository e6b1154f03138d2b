"""One query per operator over the star-schema tables, each with its SQL form where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.config import LOST_FOUND
from recordloom.functions import dictionary as D
from recordloom.functions import text as T
from recordloom.functions import vectors as V
from recordloom.functions.geo import haversine
from recordloom.operators import conflicts, coverage, dedup, evaluate, retrieval, scoring, store
from recordloom.operators import features as FT
from recordloom.operators.matching import tightened, verdict, verify_secret
from recordloom.operators.steps import settled, small
from recordloom.sources.tables import ancestors, parquet
from recordloom.streaming.incremental import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL form if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


PUNCT = "[" + "".join("\\" + c if c in "[]\\-^" else c.replace("'", "''") for c in T.PUNCTUATION) + "]"


def norm(x: str) -> str:
    """SQL for normalised text of ASCII and Latin letters."""
    return f"trim(regexp_replace(regexp_replace(lower({x}), '{PUNCT}', ' ', 'g'), '\\s+', ' ', 'g'))"


def chars(x: str) -> str:
    return f"list_distinct(list_filter(string_split(replace({norm(x)}, ' ', ''), ''), lambda c: c <> ''))"


def words(x: str) -> str:
    return f"list_distinct(list_filter(string_split({norm(x)}, ' '), lambda c: c <> ''))"


def overlap(a: str, b: str) -> str:
    return f"(CASE WHEN least(len({a}), len({b})) > 0 THEN len(list_intersect({a}, {b})) / least(len({a}), len({b})) ELSE 0.0 END)"


# ---- sources and scalars -------------------------------------------------------------------


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 5000")
def base_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1: the newest open orders; the limit is the pool's."""
    o = parquet(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("LOST").alias("record_type"), F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("CLOSED").alias("status"), F.col("o_orderdate").alias("created_at"))
    return retrieval.base_pool(o, "LOST").select("id", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("""
SELECT c_custkey, c_name, n_name, r_name, count(o_orderkey) AS orders, coalesce(max(o_totalprice), 0.0) AS largest
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey
GROUP BY ALL""")
def bundle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2, JN1: a record with its dimensions and its grouped details."""
    c, n, r, o = (parquet(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders"))
    stats = o.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("o_totalprice").alias("largest"))
    out = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").join(stats, c.c_custkey == stats.o_custkey, "left")
    return out.select("c_custkey", "c_name", "n_name", "r_name", F.coalesce("orders", F.lit(0)).cast("long").alias("orders"), F.coalesce("largest", F.lit(0.0)).alias("largest"))


TREE_SQL = """SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id FROM region
UNION ALL SELECT 1000 + n_nationkey, n_regionkey FROM nation UNION ALL SELECT 1000000 + c_custkey, 1000 + c_nationkey FROM customer"""


@query(f"""
WITH RECURSIVE tree AS ({TREE_SQL}),
up AS (SELECT id, parent_id, '' AS path, 0 AS depth FROM tree
       UNION ALL SELECT up.id, tree.parent_id, path || '/' || tree.id, depth + 1 FROM up JOIN tree ON up.parent_id = tree.id)
SELECT id, path, depth FROM up WHERE parent_id IS NULL""")
def location_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3, JN4: ancestor chains of a three-level tree, nearest first."""
    r, n, c = (parquet(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    tree = r.select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"))
    tree = tree.union(n.select((F.col("n_nationkey") + 1000).cast("long"), F.col("n_regionkey").cast("long"))).union(c.select(F.col("c_custkey") + 1000000, (F.col("c_nationkey") + 1000).cast("long")))
    return ancestors(tree).select("id", F.concat_ws("", F.transform("ancestors", lambda a: F.concat(F.lit("/"), a.cast("string")))).alias("path"), "depth")


@query(f"SELECT p_partkey, {norm('p_name')} AS name, {norm('p_brand')} AS brand, {norm('p_type')} AS kind FROM part")
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM1."""
    return parquet(spark, sf_dir, "part").select("p_partkey", T.norm_text(F.col("p_name")).alias("name"), T.norm_text(F.col("p_brand")).alias("brand"), T.norm_text(F.col("p_type")).alias("kind"))


ITEMS = {"widget": ("gizmo",), "fastener": ("bolt", "red bolt"), "gearing": ("gear",), "jewelry": ("ring", "old ring"), "smithy": ("anvil",)}


def alias_values() -> str:
    return ", ".join(f"('{a}', '{k}')" for a, k, _ in D.alias_rows(ITEMS))


@query(f"""
WITH aliases(alias, canonical) AS (VALUES {alias_values()}),
hits AS (SELECT p_partkey, canonical, alias FROM part JOIN aliases ON (' ' || {norm('p_name')} || ' ') LIKE ('% ' || alias || ' %'))
SELECT p_partkey, canonical, alias FROM hits QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(alias) DESC, canonical) = 1""")
def longest_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM3, NRM12: the longest dictionary alias in each name, by an equi-join on runs of words."""
    return D.tag_longest(parquet(spark, sf_dir, "part"), "p_partkey", "p_name", D.alias_table(spark, ITEMS))


@query(f"""
WITH aliases(alias, canonical) AS (VALUES {alias_values()})
SELECT p_partkey, coalesce(string_agg(DISTINCT canonical, ',' ORDER BY canonical), '') AS tags
FROM part LEFT JOIN aliases ON CASE WHEN length(alias) <= 4 THEN (' ' || {norm('p_name')} || ' ') LIKE ('% ' || alias || ' %') ELSE contains({norm('p_name')}, alias) END
GROUP BY p_partkey""")
def alias_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM20: the set of canonical values; short aliases only as whole words."""
    return parquet(spark, sf_dir, "part").select("p_partkey", F.array_join(D.tag_set(F.col("p_name"), ITEMS), ",").alias("tags"))


@query(f"SELECT p_partkey, round(greatest({overlap(chars('p_name'), chars('p_type'))}, {overlap(words('p_name'), words('p_type'))}), 6) AS overlap FROM part")
def text_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM10."""
    return parquet(spark, sf_dir, "part").select("p_partkey", F.round(T.text_overlap(F.col("p_name"), F.col("p_type")), 6).alias("overlap"))


@query("""
SELECT p_partkey, 'a photo of ' || CASE WHEN lower(left(w, 1)) IN ('a', 'e', 'i', 'o', 'u') THEN 'an' ELSE 'a' END || ' ' || w AS prompt
FROM (SELECT p_partkey, split_part(p_name, ' ', 1) || ' ' || p_brand || ' ' || split_part(p_name, ' ', 2) AS w FROM part)""")
def image_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM28."""
    p = parquet(spark, sf_dir, "part").withColumn("w", F.split("p_name", " "))
    return p.select("p_partkey", T.image_prompt(F.col("w")[0], F.lit(None).cast("string"), F.col("p_brand"), F.col("w")[1]).alias("prompt"))


@query("""
SELECT p_partkey, 'brand: ' || p_brand || chr(10) || 'color: ' || split_part(p_name, ' ', 1) || chr(10) || 'kind: ' || p_type || chr(10) || 'size: ' || p_size AS lines FROM part""")
def attribute_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM8: attributes as sorted lines, empty ones left out."""
    values_ = {"size": F.col("p_size").cast("string"), "color": F.split("p_name", " ")[0], "brand": F.col("p_brand"), "kind": F.col("p_type"), "note": F.lit("")}
    return parquet(spark, sf_dir, "part").select("p_partkey", T.canonical_lines(F.create_map(*[x for k, v in values_.items() for x in (F.lit(k), v)])).alias("lines"))


@query("""
WITH t AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'lost my iPhone ' || p_size || ' Pro Max, ' WHEN 1 THEN 'a galaxy s' || p_size || ' and ' ELSE 'the ' END || p_name AS x FROM part),
m AS (SELECT p_partkey, nullif(trim(regexp_replace(lower(regexp_extract(x, '(?i)(iphone\\s*\\d{1,2}\\s*(?:pro\\s*max|pro|plus|mini)?|galaxy\\s*[a-z]?\\d{1,3}\\s*(?:ultra|plus|\\+)?)', 1)), '[^a-z0-9]+', ' ', 'g')), '') AS model FROM t)
SELECT p_partkey, model, CASE WHEN model LIKE 'iphone%' THEN 'Apple' WHEN model LIKE 'galaxy%' THEN 'Samsung' END AS brand FROM m""")
def model_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM7, NRM14: model names in descriptions and the brands that they imply."""
    k = F.pmod("p_partkey", F.lit(3))
    lead = F.when(k == 0, F.concat(F.lit("lost my iPhone "), "p_size", F.lit(" Pro Max, "))).when(k == 1, F.concat(F.lit("a galaxy s"), "p_size", F.lit(" and "))).otherwise("the ")
    rows = parquet(spark, sf_dir, "part").select("p_partkey", T.canonical_model(T.model_phrase(F.concat(lead, "p_name"))).alias("model"))
    return rows.withColumn("brand", T.brand_of_model(F.col("model")))


@query("SELECT h AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, sha256(text) AS h FROM documents) GROUP BY h")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC2: documents by the hash of their content."""
    return parquet(spark, sf_dir, "documents").select("doc_id", V.content_hash(F.col("text")).alias("content_hash")).groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""
WITH n AS (SELECT vec_id, list_resize(embedding, 16, 0.0)::DOUBLE[] AS e FROM embeddings)
SELECT vec_id, len(e) AS dim, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS length FROM n""")
def fit_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC4: vectors cut to a dimension."""
    e = parquet(spark, sf_dir, "embeddings").select("vec_id", V.fit_dim(F.col("embedding"), 16).alias("e"))
    return e.select("vec_id", F.size("e").alias("dim"), F.round(V.norm(F.col("e")), 6).alias("length"))


# ---- retrieval -----------------------------------------------------------------------------

PHRASES = (("q1", "the of and"), ("q2", "in to the"), ("q3", "la de que"))
NAMES = (("n1", "red bolts"), ("n2", "an old ring"), ("n3", "cold gizmo"))


def values(rows: tuple[tuple[str, str], ...]) -> str:
    return "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in rows) + ")"


def phrase_queries(spark: SparkSession, rows: tuple[tuple[str, str], ...]) -> DataFrame:
    return spark.createDataFrame(list(rows), "query_id string, query_text string")


INDEX_SQL = f"""
q(query_id, query_text) AS ({values(PHRASES)}),
w AS (SELECT doc_id AS id, unnest(list_filter(string_split({norm('text')}, ' '), lambda x: x <> '')) AS term FROM documents),
l AS (SELECT id, count(*) AS length FROM w GROUP BY id),
i AS (SELECT term, id, count(*) AS tf FROM w GROUP BY term, id),
t AS (SELECT DISTINCT query_id, unnest(string_split(query_text, ' ')) AS term FROM q)"""


@query(f"""
WITH {INDEX_SQL},
h AS (SELECT query_id, id, count(*) AS have, sum(1 + ln(tf)) AS s FROM t JOIN i USING (term) GROUP BY ALL),
n AS (SELECT query_id, count(*) AS wanted FROM t GROUP BY query_id),
r AS (SELECT query_id, id, round(s / (1 + ln(length)), 6) AS score FROM h JOIN n USING (query_id) JOIN l USING (id) WHERE have = wanted)
SELECT query_id, CAST(id AS VARCHAR) AS id, score FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(id AS VARCHAR)) <= 500""")
def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET2: documents that hold every term of a query, the best 500."""
    docs = parquet(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    asked = phrase_queries(spark, PHRASES)
    return retrieval.full_text(asked, retrieval.postings(docs, "text", retrieval.query_terms(asked))).select("query_id", "id", "score")


@query(f"""
WITH q(query_id, query_text) AS ({values(PHRASES)}),
l AS (SELECT doc_id AS id, list_filter(string_split({norm('text')}, ' '), lambda x: x <> '') AS l FROM documents),
w AS (SELECT id, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM l),
t AS (SELECT DISTINCT query_id, unnest(string_split(query_text, ' ')) AS term FROM q),
n AS (SELECT query_id, count(*) AS wanted FROM t GROUP BY query_id),
x AS (SELECT query_id, id, pos, term, row_number() OVER (PARTITION BY query_id, id ORDER BY pos) AS e FROM w JOIN t USING (term)),
y AS (SELECT x.query_id, x.id, e, pos, max(CASE WHEN x.term = t.term THEN e END) OVER (PARTITION BY x.query_id, x.id, t.term ORDER BY e) AS last FROM x JOIN t ON t.query_id = x.query_id),
z AS (SELECT query_id, id, e, any_value(pos) AS pos, min(last) AS b FROM y GROUP BY query_id, id, e HAVING count(last) = count(*)),
c AS (SELECT *, lag(b) OVER (PARTITION BY query_id, id ORDER BY e) AS before FROM z),
s AS (SELECT c.query_id, c.id, round(sum(0.1::DOUBLE / (1 + (c.pos - x.pos) - (c.e - b))), 6) AS score FROM c JOIN x ON x.query_id = c.query_id AND x.id = c.id AND x.e = b WHERE before IS NULL OR b > before GROUP BY ALL)
SELECT query_id, CAST(id AS VARCHAR) AS id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(id AS VARCHAR)) <= 500""")
def cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET2: documents that hold every term of a query, by how closely the terms stand together, the best 500."""
    docs = parquet(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    asked = phrase_queries(spark, PHRASES)
    return retrieval.cover_density(asked, retrieval.occurrences(docs, "text", retrieval.query_terms(asked))).select("query_id", "id", "score")


@query(f"""
WITH {INDEX_SQL},
d AS (SELECT term, count(*) AS df FROM i GROUP BY term),
m AS (SELECT count(*) AS n, avg(length) AS mean FROM l),
r AS (SELECT query_id, CAST(id AS VARCHAR) AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
      FROM t JOIN i USING (term) JOIN d USING (term) JOIN l USING (id) CROSS JOIN m GROUP BY ALL)
SELECT query_id, id, score FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 100""")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET2 with BM25: the best 100 documents by any shared term."""
    docs = parquet(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    asked = phrase_queries(spark, PHRASES)
    index = settled(retrieval.postings(docs, "text", retrieval.query_terms(asked)))
    return retrieval.bm25(asked, index, 100, totals=retrieval.corpus_totals(docs, "text")).select("query_id", "id", "score")


def gram_sql(x: str) -> str:
    return f"list_distinct(flatten(list_transform(list_filter(string_split({norm(x)}, ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i::INT, 3)))))"


@query(f"""
WITH q(query_id, query_text) AS ({values(NAMES)}),
a AS (SELECT query_id, {gram_sql('query_text')} AS g FROM q), b AS (SELECT CAST(p_partkey AS VARCHAR) AS id, {gram_sql('p_name')} AS h FROM part),
r AS (SELECT query_id, id, round(len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))), 6) AS score FROM a CROSS JOIN b)
SELECT query_id, id, score FROM r WHERE score > 0.05 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 500""")
def trigram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET3: names by trigram similarity, the best 500."""
    parts = parquet(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("normalized_text"))
    return retrieval.trigram(phrase_queries(spark, NAMES), parts).select("query_id", "id", "score")


def vector_queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stated query set (every hundredth id) and all vectors."""
    e = parquet(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return e.filter("id % 100 = 0").withColumnRenamed("id", "query_id"), e


NEAREST_SQL = """
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, a.label AS l1, b.label AS l2, list_cosine_similarity(a.e, b.e) AS similarity FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s)"""


@query(f"WITH {NEAREST_SQL} SELECT query_id, id, round(similarity, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET4: the ten nearest vectors of each query."""
    q, e = vector_queries(spark, sf_dir)
    return retrieval.nearest(q, e, 10).withColumn("similarity", F.round("similarity", 6))


@query(f"""
WITH {NEAREST_SQL},
c AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id % 83 DESC, id) AS rank FROM s WHERE l1 = l2),
u AS (SELECT query_id, id, rank FROM r WHERE rank <= 100 UNION ALL SELECT query_id, id, rank FROM c WHERE rank <= 100),
f AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS rrf_score, count(*) AS sources FROM u GROUP BY ALL)
SELECT query_id, id, rrf_score, sources, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id)::INT AS rank FROM f
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) <= 50""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET1, RET4, RET5: a vector channel and a structured channel by reciprocal ranks, the best 50."""
    q, e = vector_queries(spark, sf_dir)
    records = e.select("id", F.col("label").alias("category"), F.timestamp_seconds(F.col("id") % 83).alias("created_at"))
    channels = {"vector": retrieval.nearest(q, e, 100), "structured": retrieval.structured(q.withColumnRenamed("label", "category"), records, 100)}
    return retrieval.fuse(channels, limit=50).select("query_id", "id", "rrf_score", F.size("sources").cast("long").alias("sources"), "rank")


@query(f"""
WITH {NEAREST_SQL},
t AS (SELECT query_id, min(rank) FILTER (WHERE l1 = l2) AS rank FROM r WHERE rank <= 100 GROUP BY query_id)
SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 4) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 4) AS recall_3,
round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 4) AS recall_10, round(avg(coalesce(1.0 / rank, 0)), 5) AS mrr, count(*) FILTER (WHERE rank IS NULL OR rank > 100) AS outside FROM t""")
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV1: where the first neighbour with the query's label stands, to rank 100, beyond which it counts as outside."""
    q, e = vector_queries(spark, sf_dir)
    found = retrieval.nearest(q, e, 100).join(e.select("id", F.col("label").alias("l2")), "id").join(q.select("query_id", "label"), "query_id")
    ranks = found.groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("l2"), F.col("rank"))).alias("rank"))
    return evaluate.ranking(ranks)


@query("""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
x AS (SELECT label, i, avg(e[i]) AS m FROM v, range(1, 65) AS t(i) GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS p FROM x GROUP BY label),
s AS (SELECT vec_id, c.label AS code, list_cosine_similarity(e, p) AS sim FROM v CROSS JOIN c),
a AS (SELECT vec_id, avg(sim) AS mean, stddev_pop(sim) AS sd, count(*) AS n, list(sim ORDER BY sim DESC) AS l, arg_max(code, sim) AS best FROM s GROUP BY vec_id)
SELECT vec_id, CASE WHEN n >= 3 AND sd > 1e-9 AND (l[1] - mean) / sd >= 1.8 AND (l[1] - l[2]) / sd >= 0.25 AND l[1] >= 0.35 THEN best END AS guess, round(l[1], 6) AS similarity FROM a""")
def zero_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC10: vectors against one prototype a label, accepted only if the best stands out."""
    e = parquet(spark, sf_dir, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # One prototype a label.
    prototypes = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("p")).select(F.col("label").alias("code"), "p")
    sims = e.select("vec_id", "embedding").crossJoin(small(prototypes)).select("vec_id", "code", V.cosine(F.col("embedding"), F.col("p")).alias("sim"))
    return V.zero_shot(sims, "vec_id", "code", "sim").withColumn("similarity", F.round("similarity", 6))


# ---- pair features, conflicts, scores ------------------------------------------------------


@query("""
WITH s AS (SELECT s_nationkey AS nk, 35.0 + (s_suppkey % 100) * 0.001 AS lat, 139.0 + (s_suppkey % 77) * 0.001 AS lon FROM supplier),
c AS (SELECT c_custkey, c_nationkey AS nk, 35.0 + (c_custkey % 100) * 0.001 AS lat, 139.0 + (c_custkey % 77) * 0.001 AS lon FROM customer),
d AS (SELECT c_custkey, 2 * 6371000.0 * asin(sqrt(pow(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - c.lon) / 2), 2))) AS m FROM c JOIN s USING (nk))
SELECT c_custkey, round(max(100 * exp(-m / 500.0)), 4) AS score, round(min(m), 2) AS metres FROM d GROUP BY c_custkey""")
def haversine_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FT3a, FT3c: the nearest supplier of a customer's nation."""
    place = lambda k: ((F.lit(35.0) + F.pmod(k, F.lit(100)) * 0.001).alias("lat"), (F.lit(139.0) + F.pmod(k, F.lit(77)) * 0.001).alias("lon"))
    s = parquet(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nk"), *place(F.col("s_suppkey")))
    c = parquet(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nk"), *place(F.col("c_custkey")))
    side = lambda x: F.struct(F.lit(None).cast("bigint").alias("id"), F.lit("").alias("name"), F.lit(None).cast("array<bigint>").alias("ancestors"), F.col(f"{x}lat").alias("lat"), F.col(f"{x}lon").alias("lon"))
    # The score falls with the distance, so the nearest place has both; customers of one place share it.
    near = retrieval.nearest_places(c, s, "nk").select("nk", "lat", "lon", FT.location(side(""), side("near_"))["score"].alias("score"), haversine(F.col("lat"), F.col("lon"), F.col("near_lat"), F.col("near_lon")).alias("m"))
    best = near.groupBy("nk", "lat", "lon").agg(F.max("score").alias("score"), F.round(F.min("m"), 2).alias("metres"))
    found = c.join(s.select("nk").distinct(), "nk", "left_semi").join(best, ["nk", "lat", "lon"], "left")
    return found.groupBy("c_custkey").agg(F.max("score").alias("score"), F.min("metres").alias("metres"))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, epoch(l_shipdate) AS f, epoch(o_orderdate) AS s, epoch(o_orderdate) + 30 * 86400 AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
t AS (SELECT l_orderkey, CASE WHEN f BETWEEN s AND e THEN 100.0 ELSE round(100 * exp(-least(abs(f - s), abs(f - e)) / 3600.0 / 720.0), 4) END AS score FROM p)
SELECT l_orderkey, max(score) AS best, min(score) AS worst, count(*) FILTER (WHERE score = 100.0) AS inside FROM t GROUP BY l_orderkey""")
def time_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FT4: shipments against a window of thirty days from the order, decaying over thirty days."""
    rows = parquet(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate").join(parquet(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    score = FT.time(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"), F.col("l_shipdate"), 720.0)["score"]
    return rows.select("l_orderkey", score.alias("s")).groupBy("l_orderkey").agg(F.max("s").alias("best"), F.min("s").alias("worst"), F.count_if(F.col("s") == 100).alias("inside"))


@query("""
SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE WHEN a.n_name = b.n_name THEN 100.0 WHEN a.n_regionkey = b.n_regionkey THEN 70.0 ELSE 0.0 END AS score,
a.n_regionkey <> b.n_regionkey AS conflict FROM nation a JOIN nation b ON a.n_nationkey <= b.n_nationkey""")
def category_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FT1: nations as categories under regions; the dimension table is paired with itself."""
    n = parquet(spark, sf_dir, "nation")
    a, b = (n.select(F.col("n_nationkey").alias(x), F.col("n_name").alias(f"{x}_name"), F.col("n_regionkey").cast("string").alias(f"{x}_up")) for x in "ab")
    both = a.join(small(b), F.col("a") <= F.col("b"))
    f = FT.category(F.col("a_name"), F.col("b_name"), lost_parent=F.col("a_up"), found_parent=F.col("b_up"))
    return both.select("a", "b", f["score"].alias("score"), f["conflict"].alias("conflict"))


PAIRS_SQL = """
p AS (SELECT p_partkey AS k, count(*) OVER (PARTITION BY p_name, p_size) AS block, p_name, split_part(p_name, ' ', 1) AS tint, split_part(p_name, ' ', 2) AS noun, lower(p_brand) AS brand, lower(p_type) AS kind, p_size, p_retailprice AS price FROM part),
pairs AS (SELECT x.k AS a, y.k AS b, x.noun AS noun, x.brand AS b1, y.brand AS b2, x.kind AS t1, y.kind AS t2, x.p_size AS s1, y.p_size AS s2, x.tint AS c1, y.tint AS c2, least(x.price, y.price) / greatest(x.price, y.price) AS cos
          FROM p x JOIN p y ON x.p_size = y.p_size AND x.noun = y.noun AND x.tint = y.tint AND x.k < y.k AND x.block <= 120),
sims AS (SELECT *, CASE WHEN b1 = b2 THEN 100.0 WHEN contains(b1, b2) OR contains(b2, b1) THEN 85.0 ELSE NULL END AS brand_exact FROM pairs)"""


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts with one name and size, as items that may be the same; blocks as large as DD3 takes them.

    Blocks are counted and paired under one partitioning.
    """
    block = ["p_name", "p_size"]
    p = parquet(spark, sf_dir, "part").select("p_partkey", *block, F.lower("p_brand").alias("brand"), F.lower("p_type").alias("kind"), F.col("p_retailprice").alias("price"))
    p = p.withColumn("_n", F.count("*").over(Window.partitionBy(*block))).filter("_n <= 120")
    a, b = (p.select(*block, *[F.col(c).alias(f"{c}_{x}") for c in ("p_partkey", "brand", "kind", "price")]) for x in "ab")
    both = a.join(b, block).filter("p_partkey_a < p_partkey_b")
    return both.withColumnsRenamed({"p_partkey_a": "a", "p_partkey_b": "b"}).withColumn("cos", F.least("price_a", "price_b") / F.greatest("price_a", "price_b"))


@query(f"""
WITH {PAIRS_SQL},
o AS (SELECT a, b, b1, b2, greatest({overlap(chars('b1'), chars('b2'))}, {overlap(words('b1'), words('b2'))}) AS r, t1, t2 FROM sims),
s AS (SELECT a, b, CASE WHEN {norm('b1')} = {norm('b2')} THEN 100.0 WHEN contains({norm('b1')}, {norm('b2')}) OR contains({norm('b2')}, {norm('b1')}) THEN 85.0 WHEN r >= 0.75 THEN round(60 + 40 * r, 2) WHEN r >= 0.4 THEN round(50 + 30 * r, 2) ELSE 0.0 END AS brand,
      CASE WHEN t1 = t2 THEN 100.0 ELSE 0.0 END AS model FROM o)
SELECT a, b, round((4 * brand + 5 * 0.85 * model + 2 * 0.85 * 100 - 4 * 0.15 * brand) / (11 * 0.85), 4) AS score, 1.0 AS reliability FROM s""")
def attribute_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FT2a, FT2b: brand, model and color of part pairs by the default profile."""
    def side(x: str):
        value = lambda c: F.struct(c.alias("value"), F.lit("USER").alias("source"))
        return F.create_map(F.lit("brand"), value(F.col(f"brand_{x}")), F.lit("model"), value(F.col(f"kind_{x}")), F.lit("color"), value(F.split("p_name", " ")[0]))

    f, _ = FT.attribute(side("a"), side("b"), F.lit(None).cast("string"))
    return part_pairs(spark, sf_dir).select("a", "b", f["score"].alias("score"), f["reliability"].alias("reliability"))


CONFLICT_SQL = f"""
c AS (SELECT *, CASE WHEN {norm('b1')} <> {norm('b2')} AND NOT contains({norm('b1')}, {norm('b2')}) AND NOT contains({norm('b2')}, {norm('b1')}) THEN 45.0 ELSE 0.0 END AS cb, CASE WHEN t1 <> t2 THEN 50.0 ELSE 0.0 END AS ct FROM sims),
k AS (SELECT *, greatest(cb, ct) + least(cb, ct) / 2 AS penalty, (cb > 0)::INT + (ct > 0)::INT AS n FROM c)"""


def pair_conflicts():
    side = lambda x: F.create_map(F.lit("brand"), F.col(f"brand_{x}"), F.lit("category"), F.col(f"kind_{x}"), F.lit("size"), F.col("p_size").cast("string"))
    return conflicts.conflicts(side("a"), side("b"))


@query(f"WITH {PAIRS_SQL}, {CONFLICT_SQL} SELECT a, b, n::INT AS n, penalty FROM k")
def conflict_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CF1-CF3: rules on brand, category and size, and their joint penalty."""
    found = pair_conflicts()
    return part_pairs(spark, sf_dir).select("a", "b", F.size(found).alias("n"), conflicts.penalty(conflicts.costs(found)).alias("penalty"))


def pair_features() -> dict:
    cat = FT.category(F.split("p_name", " ")[1], F.split("p_name", " ")[1])
    attribute = FT.feature(F.when(F.col("kind_a") == F.col("kind_b"), 100.0).otherwise(40.0), 0.85)
    return {"category": cat, "attribute": attribute, "semantic": FT.semantic(F.col("cos")), "keyword": FT.keyword(F.when(F.col("brand_a") == F.col("brand_b"), F.lit(3.0)))}


def pair_spec():
    from dataclasses import replace

    kept = ("category", "attribute", "semantic", "keyword")
    return replace(LOST_FOUND, dimensions=kept, weights={d: LOST_FOUND.weights[d] for d in kept}, category_weights={})


SCORE_SQL = f"""
{CONFLICT_SQL},
f AS (SELECT a, b, penalty, cb, ct, 100.0 AS fc, CASE WHEN t1 = t2 THEN 100.0 ELSE 40.0 END AS fa, round(greatest(0, cos) * 100, 4) AS fs, CASE WHEN b1 = b2 THEN 75.0 END AS fk FROM k),
m AS (SELECT *, 0.1 + 0.25 * 0.85 + 0.15 + CASE WHEN fk IS NULL THEN 0 ELSE 0.05 END AS den, 0.1 * fc + 0.25 * 0.85 * fa + 0.15 * fs + coalesce(0.05 * fk, 0) AS num, CASE WHEN fk IS NULL THEN 0.5 ELSE 0.55 END AS used FROM f),
z AS (SELECT *, round(num / den, 4) AS base FROM m),
y AS (SELECT *, round(greatest(0, least(100, base - penalty)), 4) AS final FROM z)"""


@query(f"""
WITH {PAIRS_SQL}, {SCORE_SQL}
SELECT a, b, base AS base_score, penalty, final AS final_score, round(used / 0.55, 6) AS coverage,
CASE WHEN final >= 95 THEN 'VERY_HIGH' WHEN final >= 85 THEN 'HIGH' WHEN final >= 70 THEN 'MEDIUM' WHEN final >= 50 THEN 'LOW' ELSE 'IGNORE' END AS level FROM y""")
def match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC1-SC6: the scoring kernel on part pairs; a keyword score is missing where brands differ."""
    out = scoring.with_score(part_pairs(spark, sf_dir), pair_spec(), pair_features(), pair_conflicts())
    return out.select("a", "b", "base_score", "penalty", "final_score", F.round("coverage", 6).alias("coverage"), "level")


@query(f"""
WITH {PAIRS_SQL}, {SCORE_SQL},
e AS (SELECT a, b, 'CATEGORY' AS kind, round(0.1 * fc, 4) AS contribution, false AS is_conflict FROM y UNION ALL SELECT a, b, 'ATTRIBUTE', round(0.25 * 0.85 * fa, 4), false FROM y
UNION ALL SELECT a, b, 'SEMANTIC', round(0.15 * fs, 4), false FROM y UNION ALL SELECT a, b, 'KEYWORD', round(0.05 * fk, 4), false FROM y WHERE fk IS NOT NULL
UNION ALL SELECT a, b, 'CONFLICT', -cb, true FROM y WHERE cb > 0 UNION ALL SELECT a, b, 'CONFLICT', -ct, true FROM y WHERE ct > 0)
SELECT kind, is_conflict, count(*) AS n, min(contribution) AS low, max(contribution) AS high FROM e GROUP BY ALL""")
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC8: evidence of all part pairs, summed up by kind."""
    f, spec = pair_features(), pair_spec()
    rows = part_pairs(spark, sf_dir).select("a", "b", F.explode(scoring.evidence(f, scoring.weights_for(spec, None), {}, pair_conflicts())).alias("e"))
    return rows.groupBy(F.col("e.evidence_type").alias("kind"), F.col("e.is_conflict").alias("is_conflict")).agg(F.count("*").alias("n"), F.min("e.contribution").alias("low"), F.max("e.contribution").alias("high"))


@query(f"""
WITH {PAIRS_SQL}, {SCORE_SQL}
SELECT a, b, CASE WHEN cb > 0 OR ct > 0 THEN 'UNLIKELY_MATCH' WHEN final >= 85 THEN 'LIKELY_MATCH' WHEN final >= 70 THEN 'POSSIBLE_MATCH' WHEN final >= 50 THEN 'UNLIKELY_MATCH' ELSE 'NOT_MATCH' END AS decision,
CASE WHEN cb > 0 OR ct > 0 OR final < 70 THEN 'DO_NOT_RECOMMEND' ELSE 'HUMAN_REVIEW' END AS action FROM y""")
def rule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RK3, RK5: the rule analyst's decisions, which may only lower an action."""
    out = scoring.with_score(part_pairs(spark, sf_dir), pair_spec(), pair_features(), pair_conflicts(), keep=True)
    out = out.withColumn("v", verdict(F.col("final_score"), F.col("conflicts"), F.col("evidence")))
    return out.select("a", "b", "v.decision", tightened(F.col("action"), F.col("v.recommended_action")).alias("action"))


@query("""
SELECT s_suppkey, s_suppkey % 3 > 0 AND n_nationkey % 2 = 0 AS verified, s_suppkey % 4 > 0 AND n_nationkey < 10 AS partly
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def verify_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RK9: answers that hold or are held by each secret."""
    r = parquet(spark, sf_dir, "supplier").join(parquet(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    secrets = F.create_map(F.lit("name"), F.col("s_name"), F.lit("nation"), F.col("n_name"))
    named = F.when(F.col("s_suppkey") % 3 > 0, F.substring("s_name", 1, 9)).otherwise("nobody")
    right = F.create_map(F.lit("name"), named, F.lit("nation"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("it is "), "n_name")).otherwise(" "))
    # A digit stands in the names of the first ten alone at the end.
    partly = F.create_map(F.lit("nation"), F.concat(F.lit("NATION_"), F.substring("n_name", 8, 1), F.lit("."))), F.create_map(F.lit("nation"), F.col("n_name"))
    some = F.when(F.col("s_suppkey") % 4 > 0, partly[0]).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    short = F.when(F.length("n_name") < 9, F.col("n_name")).otherwise("elsewhere")
    return r.select("s_suppkey", verify_secret(right, secrets).alias("verified"), verify_secret(some, F.create_map(F.lit("nation"), short)).alias("partly"))


# ---- dedup, assignment, coverage -----------------------------------------------------------

TFIDF_SQL = """
t AS (SELECT item_id, regexp_replace(text, '\\s+', '', 'g') AS s FROM benchmark),
g AS (SELECT item_id, unnest(list_transform(range(1, greatest(length(s) - 1, 1)), lambda i: substring(s, i::INT, 3))) AS gram FROM t),
c AS (SELECT item_id, gram, count(*) AS tf FROM g GROUP BY ALL),
d AS (SELECT gram, count(*) AS df FROM c GROUP BY gram HAVING count(*) > 1),
r AS (SELECT item_id, gram, df, (1 + ln(tf)) * ln((SELECT count(*) FROM benchmark) / df) AS w FROM c JOIN d USING (gram)),
n AS (SELECT item_id, sqrt(sum(w * w)) AS l FROM r GROUP BY item_id),
x AS (SELECT item_id, gram, df, w / l AS weight FROM r JOIN n USING (item_id))"""


@query(f"WITH {TFIDF_SQL} SELECT item_id, count(*) AS grams, round(max(weight), 6) AS largest FROM x GROUP BY item_id")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD1, DD2: TF-IDF over character 3-grams."""
    return dedup.tfidf(parquet(spark, sf_dir, "benchmark"), "item_id", "text").groupBy("item_id").agg(F.count("*").alias("grams"), F.round(F.max("weight"), 6).alias("largest"))


@query(f"""
WITH {TFIDF_SQL}
SELECT a.item_id AS a, b.item_id AS b, round(sum(a.weight * b.weight), 6) AS similarity FROM x a JOIN x b USING (gram)
WHERE a.df <= 60 AND a.item_id < b.item_id GROUP BY ALL HAVING sum(a.weight * b.weight) >= 0.05""")
def gram_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD4: pairs by the product of rare grams."""
    w = dedup.tfidf(parquet(spark, sf_dir, "benchmark"), "item_id", "text")
    return dedup.block_by_grams(w, "item_id", least=0.05).withColumn("similarity", F.round("similarity", 6))


@query("""
WITH k AS (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) <= 120)
SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey WHERE a.o_custkey IN (SELECT o_custkey FROM k)""")
def block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD3, DD6: pairs inside blocks of at most 120."""
    return dedup.candidates(dedup.block_by_key(parquet(spark, sf_dir, "orders"), "o_orderkey", "o_custkey"))


@query("SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD8: components of chains, each order tied to the customer's next one only."""
    chain = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    edges = parquet(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(chain).alias("b")).filter("b IS NOT NULL")
    return dedup.components(edges)


def covering(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Part names as syllabus items under their noun, and the orders that hold them."""
    p = parquet(spark, sf_dir, "part")
    items = p.select(F.concat_ws("/", "p_name", "p_brand", "p_type", "p_size").alias("kb"), F.split("p_name", " ")[1].alias("domain")).distinct()
    pool = parquet(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("p_partkey")).join(p.select("p_partkey", F.concat_ws("/", "p_name", "p_brand", "p_type", "p_size").alias("kb")), "p_partkey").select("qid", "kb")
    return items, pool


COVER_SQL = """
i AS (SELECT DISTINCT p_name || '/' || p_brand || '/' || p_type || '/' || p_size AS kb, split_part(p_name, ' ', 2) AS domain FROM part),
q AS (SELECT DISTINCT l_orderkey AS qid, p_name || '/' || p_brand || '/' || p_type || '/' || p_size AS kb FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT i.kb, domain, count(q.kb) AS questions FROM i LEFT JOIN q ON q.kb = i.kb GROUP BY ALL)"""


@query(f"WITH {COVER_SQL} SELECT kb, domain, questions, questions > 0 AS reachable FROM n")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CV1."""
    return coverage.coverage(*covering(spark, sf_dir))


@query(f"WITH {COVER_SQL} SELECT domain, count(*) FILTER (WHERE questions = 0) AS blind, count(*) AS total, round(count(*) FILTER (WHERE questions = 0) / count(*), 4) AS blind_ratio FROM n GROUP BY domain")
def coverage_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CV1 by domain."""
    return coverage.by_domain(coverage.coverage(*covering(spark, sf_dir)))


# ---- stores, metrics, streams --------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text <> lower(text)")
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2: rows whose content differs from what is stored."""
    d = parquet(spark, sf_dir, "documents")
    new, old = (d.select("doc_id", V.content_hash(c).alias("content_hash")) for c in (F.col("text"), F.lower("text")))
    return store.changed(new, old, ["doc_id"])


@query("""
SELECT coalesce(n.o_orderkey, o.o_orderkey) AS id, coalesce(n.o_totalprice * 2, o.o_totalprice) AS price, coalesce(o.o_orderstatus, 'NEW') AS status
FROM (SELECT * FROM orders WHERE o_orderstatus <> 'P') o FULL JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') n ON o.o_orderkey = n.o_orderkey""")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3: new rows replace old ones by key, and a kept column holds its old value."""
    o = parquet(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    return store.upsert(o.filter("status <> 'P'"), o.filter("status <> 'F'").withColumns({"price": F.col("price") * 2, "status": F.lit("NEW")}), ["id"], ["status"])


@query("""
WITH d AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'CONFIRMED' WHEN 'error' THEN 'REJECTED' WHEN 'view' THEN 'DEFERRED' END AS decision, ts FROM events)
SELECT user_id, coalesce((SELECT arg_max(decision, ts) FROM d WHERE d.user_id = u.user_id AND decision IS NOT NULL), 'NEW') AS latest FROM (SELECT DISTINCT user_id FROM events) u""")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK8: a subject's status is its latest valid decision."""
    e = parquet(spark, sf_dir, "events").select("user_id", F.lit("x").alias("found_id"), "event_type", F.col("ts").alias("decided_at")).withColumn("lost_id", F.col("user_id").cast("string"))
    decision = F.when(F.col("event_type") == "purchase", "CONFIRMED").when(F.col("event_type") == "error", "REJECTED").when(F.col("event_type") == "view", "DEFERRED").otherwise("seen")
    subjects = e.select("user_id", "lost_id", "found_id").distinct().withColumn("status", F.lit("NEW"))
    return store.decide(subjects, e.select("lost_id", "found_id", decision.alias("decision"), "decided_at")).select("user_id", F.col("status").alias("latest"))


DECISION_SQL = "d AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'REJECTED' WHEN quality = 1 THEN 'CONFIRMED' ELSE 'DEFERRED' END AS decision, CASE WHEN n_chars > 3000 THEN 'HIGH' WHEN n_chars > 1000 THEN 'MEDIUM' ELSE 'LOW' END AS level, least(100.0, n_chars / 40.0) AS final_score, source FROM labels JOIN documents USING (doc_id))"


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as decisions on documents."""
    rows = parquet(spark, sf_dir, "labels").join(parquet(spark, sf_dir, "documents").select("doc_id", "n_chars", "source"), "doc_id")
    decision = F.when(F.col("toxic") == 1, "REJECTED").when(F.col("quality") == 1, "CONFIRMED").otherwise("DEFERRED")
    level = F.when(F.col("n_chars") > 3000, "HIGH").when(F.col("n_chars") > 1000, "MEDIUM").otherwise("LOW")
    return rows.select("doc_id", decision.alias("decision"), level.alias("level"), F.least(F.lit(100.0), F.col("n_chars") / 40.0).alias("final_score"), "source")


@query(f"""
WITH {DECISION_SQL}, c AS (SELECT count(*) AS total, count(*) FILTER (WHERE decision = 'CONFIRMED') AS confirmed, count(*) FILTER (WHERE decision = 'REJECTED') AS rejected, count(*) FILTER (WHERE decision = 'DEFERRED') AS deferred,
count(*) FILTER (WHERE decision = 'CONFIRMED' AND level = 'HIGH') AS ch, count(*) FILTER (WHERE decision = 'REJECTED' AND level = 'HIGH') AS rh FROM d)
SELECT total, confirmed, rejected, deferred, round(ch / confirmed, 4) AS assist_recall, round(rh / (ch + rh), 4) AS wrong_recommendation_rate, round(ch / (ch + rh), 4) AS precision_high FROM c""")
def decision_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1."""
    return evaluate.decision_metrics(decisions(spark, sf_dir))


@query(f"WITH {DECISION_SQL} SELECT level, count(*) AS n FROM d GROUP BY level")
def level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG2."""
    return evaluate.level_counts(decisions(spark, sf_dir))


@query("SELECT 'TEXT' AS kind, lang AS provider, source AS model, '1' AS version, CASE WHEN n_chars > 0 THEN 'ACTIVE' ELSE 'EMPTY' END AS status, count(*) AS n FROM documents GROUP BY ALL")
def embedding_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG3: counts by five keys."""
    d = parquet(spark, sf_dir, "documents").select(F.lit("TEXT").alias("kind"), F.col("lang").alias("provider"), F.col("source").alias("model"), F.lit("1").alias("version"), F.when(F.col("n_chars") > 0, "ACTIVE").otherwise("EMPTY").alias("status"))
    return evaluate.embedding_status(d)


@query(f"WITH {DECISION_SQL} SELECT doc_id AS lost_id, source AS found_id, (decision = 'CONFIRMED')::INT AS label, decision = 'REJECTED' AND final_score >= 85 AS hard_negative FROM d WHERE decision <> 'DEFERRED'")
def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG4."""
    rows = decisions(spark, sf_dir).select(F.col("doc_id").alias("lost_id"), F.col("source").alias("found_id"), "decision", "final_score", F.lit(0).alias("decided_at"))
    return evaluate.training_pairs(rows).select("lost_id", "found_id", "label", "hard_negative")


@query("SELECT p_partkey, len(list_distinct(list_filter(string_split_regex(lower(p_name || ' ' || p_brand || ' ' || p_name), '\\s+'), lambda x: x <> ''))) AS terms FROM part")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK15."""
    names = {"normalized": "p_name", "brand": "p_brand", "raw": "p_name"}
    return parquet(spark, sf_dir, "part").select("p_partkey", F.size(store.search_terms(names)).cast("long").alias("terms"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def arrival_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming extension: the windowed count, which runs alike on a stream and on a table."""
    return windowed_counts(parquet(spark, sf_dir, "events"), ["event_type"]).select(F.col("window.start").alias("start"), "event_type", "n")
