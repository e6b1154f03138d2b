"""Near-duplicate questions: blocking, pair scores, clusters, representatives (DD1-DD11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.config import EXAM
from recordloom.functions.text import grams
from recordloom.functions.vectors import cosine
from recordloom.operators import conflicts as CF
from recordloom.operators import features as FT
from recordloom.operators import scoring as SC
from recordloom.operators.retrieval import nearest
from recordloom.operators.steps import settled

MERGE, TOPIC = 95.0, 78.0


def tfidf(docs: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """(key, gram, weight): (1 + ln tf) * ln(N / df), grams of one document left out, length 1 (DD1, DD2)."""
    counts = docs.select(key, F.explode(grams(F.col(text), n)).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf"))
    df = counts.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")
    total = docs.agg(F.count("*").alias("n"))
    # ``total`` is one row.
    raw = counts.join(df, "gram").crossJoin(F.broadcast(total)).select(key, "gram", "df", ((1 + F.log("tf")) * F.log(F.col("n") / F.col("df"))).alias("w"))
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, key).select(key, "gram", "df", F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(0.0).alias("weight"))


def block_by_key(rows: DataFrame, key: str, block: str, most: int = 120) -> DataFrame:
    """(a, b), a < b, of rows that share a block of at most ``most`` rows (DD3).

    The cap is part of the definition: what larger blocks hold in common says
    too little. It also bounds the pairs to ``most`` a row and block.
    """
    found = rows.select(key, block).filter(F.col(block).isNotNull()).distinct()
    kept = found.join(found.groupBy(block).count().filter(F.col("count") <= most).select(block), block)
    return kept.alias("x").join(kept.alias("y"), block).filter(F.col(f"x.{key}") < F.col(f"y.{key}")).select(F.col(f"x.{key}").alias("a"), F.col(f"y.{key}").alias("b")).distinct()


def block_by_grams(weights: DataFrame, key: str, most: int = 60, least: float = 0.25) -> DataFrame:
    """(a, b, similarity): the part of the TF-IDF product from grams in at most ``most`` documents, ``least`` or more (DD4)."""
    kept = weights.filter(F.col("df") <= most).select(key, "gram", "weight")
    both = kept.alias("x").join(kept.alias("y"), "gram").filter(F.col(f"x.{key}") < F.col(f"y.{key}"))
    sums = both.groupBy(F.col(f"x.{key}").alias("a"), F.col(f"y.{key}").alias("b")).agg(F.sum(F.col("x.weight") * F.col("y.weight")).alias("similarity"))
    return sums.filter(F.col("similarity") >= least)


def block_by_vectors(vectors: DataFrame, key: str, vector: str, k: int = 8) -> DataFrame:
    """(a, b): each row with its ``k`` nearest, ties to the larger key (DD5)."""
    queries = vectors.select(F.col(key).alias("query_id"), F.col(vector).alias("embedding"))
    found = nearest(queries, vectors.select(F.col(key).alias("id"), F.col(vector).alias("embedding")), k, larger_key=True)
    return found.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b")).distinct()


def candidates(*blocks: DataFrame) -> DataFrame:
    """The union of candidate pairs (DD6)."""
    out = blocks[0].select("a", "b")
    for b in blocks[1:]:
        out = out.union(b.select("a", "b"))
    return out.distinct()


def score_pairs(pairs: DataFrame, questions: DataFrame, weights: DataFrame, least: float = TOPIC) -> DataFrame:
    """Scored question pairs of at least ``least`` (DD7); ``questions`` has the ``schema.QUESTION`` fields and stem and answer vectors."""
    side = F.struct(*questions.columns)
    rows = pairs.select("a", "b").join(questions.select(F.col("qid").alias("a"), side.alias("x")), "a").join(questions.select(F.col("qid").alias("b"), side.alias("y")), "b")
    product = pairs.select("a", "b").join(weights.select(F.col("qid").alias("a"), "gram", F.col("weight").alias("wa")), "a").join(weights.select(F.col("qid").alias("b"), "gram", F.col("weight").alias("wb")), ["b", "gram"])
    rows = rows.join(product.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("keyword_sim")), ["a", "b"], "left")
    cos = lambda f: F.when(F.col("x")[f].isNotNull() & F.col("y")[f].isNotNull(), cosine(F.col("x")[f], F.col("y")[f]))
    features = FT.exam_features("x", "y", cos("stem_vector"), cos("answer_vector"), F.col("keyword_sim"))
    out = SC.with_score(rows, EXAM, features, CF.exam_conflicts(F.col("x"), F.col("y")), keep=True)
    return out.filter(F.col("final_score") >= least).drop("x", "y", "keyword_sim")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): connected components by alternating large-star and small-star steps (DD8).

    Long chains take logarithmically many rounds. Each round is written, so a
    lost executor never reaches back further than one round.
    """
    nodes = settled(edges.select(F.explode(F.array(a, b)).alias("id")).distinct())
    current = settled(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not state.n or (state.n, state.h) == before:
            break
        before = (state.n, state.h)
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        current = settled(small.filter("u <> v").distinct())
    return nodes.join(current.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def clusters(questions: DataFrame, pairs: DataFrame, threshold: float = MERGE) -> DataFrame:
    """(qid, cluster, size, representative); a question without a partner is its own cluster (DD8, DD9)."""
    found = components(pairs.filter(F.col("final_score") >= threshold))
    rows = questions.join(found.withColumnRenamed("id", "qid"), "qid", "left").withColumn("cluster", F.coalesce("component", "qid"))
    # The most complete member: options, knowledge points, length of the stem; then the smallest id.
    rank = F.struct(F.size("options").alias("o"), F.size("kps").alias("k"), F.length("stem").alias("s"))
    tops = rows.groupBy("cluster").agg(F.count("*").alias("size"), F.max(rank).alias("best"))
    named = rows.join(tops, "cluster").filter(rank == F.col("best")).groupBy("cluster").agg(F.min("qid").alias("representative"))
    return rows.select("qid", "cluster").join(tops.select("cluster", "size"), "cluster").join(named, "cluster").select("qid", "cluster", "size", "representative")


def topic_pairs(pairs: DataFrame, low: float = TOPIC, high: float = MERGE) -> DataFrame:
    """Pairs on one topic that stay apart (DD10)."""
    return pairs.filter((F.col("final_score") >= low) & (F.col("final_score") < high) & (F.size("conflicts") == 0))


def blocked_pairs(pairs: DataFrame, limit: int = 20) -> DataFrame:
    """The highest pairs that a conflict kept apart (DD11, a report)."""
    return pairs.filter(F.col("level").isin("SAME_TOPIC", "RELATED") & (F.col("penalty") > 0)).orderBy(F.col("final_score").desc(), "a", "b").limit(limit)


def size_histogram(found: DataFrame) -> DataFrame:
    """(size, clusters) (DD11)."""
    return found.groupBy("cluster").agg(F.first("size").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))


def answer_disagreements(questions: DataFrame) -> DataFrame:
    """Questions whose two answer fields are both there and differ (NRM27)."""
    return questions.filter((F.size("answer") > 0) & (F.size("answer_header") > 0) & (F.col("answer") != F.col("answer_header")))


def deduplicate(questions: DataFrame, threshold: float = MERGE, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """(pairs, clusters) of questions with stem and answer vectors: three kinds of blocks, pair scores, components."""
    text = questions.select("qid", F.concat_ws(" ", "stem", "answer_text").alias("text"))
    weights = settled(tfidf(text, "qid", "text"))
    services = block_by_key(questions.select("qid", F.explode("services").alias("service")), "qid", "service")
    pairs = candidates(services, block_by_grams(weights, "qid"), block_by_vectors(questions.filter("stem_vector IS NOT NULL"), "qid", "stem_vector", k))
    scored = settled(score_pairs(pairs, questions, weights, min(threshold, TOPIC)))
    return scored, clusters(questions, scored, threshold)
