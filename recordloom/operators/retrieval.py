"""Retrieval channels and their fusion (RET1-RET9, SRC1)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.config import FUNNEL
from recordloom.functions.text import let, norm_text
from recordloom.operators.steps import settled, small

#: Vectors of a block.
BLOCK = 8192


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank from 1. Spark keeps k rows a group on the map side."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def base_pool(records: DataFrame, record_type: str, limit: int | None = FUNNEL["pool"]) -> DataFrame:
    """Active records of one type, newest first (SRC1). Category never narrows the pool. Without a limit: all."""
    found = records.filter((F.col("record_type") == record_type) & (F.col("status") == "ACTIVE"))
    return found if limit is None else found.orderBy(F.col("created_at").desc(), "id").limit(limit)


def structured(queries: DataFrame, records: DataFrame, limit: int = FUNNEL["keyword"]) -> DataFrame:
    """(query_id, id, rank): records of the query's category, newest first (RET1). No category, no rows.

    Records are ranked once a category, and one more than the limit is kept in
    case the query is among them, so a query meets ``limit + 1`` records at most.
    """
    order = [F.col("created_at").desc(), F.col("id")]
    heads = top(records.filter("category IS NOT NULL").select("id", "category", "created_at"), ["category"], order, limit + 1).drop("rank")
    both = queries.filter("category IS NOT NULL").select("query_id", "category").join(heads, "category").filter("id <> query_id")
    return top(both, ["query_id"], order, limit).select("query_id", "id", "rank")


def words(c: Column) -> Column:
    return F.filter(F.split(norm_text(c), " "), lambda w: w != "")


def query_terms(queries: DataFrame, text: str = "query_text") -> DataFrame:
    """(query_id, term), each term once."""
    return queries.select("query_id", F.explode(F.array_distinct(words(F.col(text)))).alias("term"))


def postings(records: DataFrame, text: str = "normalized_text", terms: DataFrame | None = None) -> DataFrame:
    """The inverted index: (term, id, tf, length); with ``terms`` only of these words, which is all that a query set needs.

    Words are picked before they are counted, so a few terms move few rows.
    """
    # The length is taken before the words are dealt out, else each word's row would carry them all.
    sized = records.select("id", words(F.col(text)).alias("words")).select("id", "words", F.size("words").alias("length"))
    dealt = sized.select("id", "length", F.explode("words").alias("term"))
    if terms is not None:
        dealt = dealt.join(small(terms.select("term").distinct()), "term", "left_semi")
    return dealt.groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def corpus_totals(records: DataFrame, text: str = "normalized_text") -> DataFrame:
    """One row (n, mean): how many records have words, and their mean length."""
    return records.select(F.size(words(F.col(text))).alias("length")).filter("length > 0").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))


def full_text(queries: DataFrame, index: DataFrame, limit: int = FUNNEL["keyword"], text: str = "query_text") -> DataFrame:
    """(query_id, id, score, rank): records that hold every term of the query, by a sum over term counts (beside RET2).

    The score is the sum of 1 + ln(tf) over the terms by 1 + ln(length).
    """
    terms = query_terms(queries, text)
    wanted = terms.groupBy("query_id").agg(F.count("*").alias("wanted"))
    hits = terms.join(index, "term").filter("id <> query_id").groupBy("query_id", "id").agg(F.count("*").alias("have"), F.sum(1 + F.log("tf")).alias("sum"), F.first("length").alias("length"))
    hits = hits.join(wanted, "query_id").filter("have = wanted").select("query_id", "id", F.round(F.col("sum") / (1 + F.log("length")), 6).alias("score"))
    return top(hits, ["query_id"], [F.col("score").desc(), F.col("id")], limit)


def occurrences(records: DataFrame, text: str = "normalized_text", terms: DataFrame | None = None) -> DataFrame:
    """(term, id, places): where each word stands in each record, from 1; with ``terms`` only of these words."""
    dealt = records.select("id", F.posexplode(words(F.col(text))).alias("place", "term"))
    if terms is not None:
        dealt = dealt.join(small(terms.select("term").distinct()), "term", "left_semi")
    return dealt.groupBy("term", "id").agg(F.array_sort(F.collect_list(F.col("place") + 1)).alias("places"))


#: What a cover without other words in it counts.
COVER = 0.1


def cover_density(queries: DataFrame, index: DataFrame, limit: int = FUNNEL["keyword"], text: str = "query_text") -> DataFrame:
    """(query_id, id, score, rank): records that hold every term of the query, by cover density (RET2).

    A cover is a shortest stretch of words with every term. Each counts
    ``COVER`` over one plus the number of other words in it, so terms that
    stand together, and often, rank high. One pass over the places of a
    record's terms finds all covers: a stretch that ends at a place begins at
    the earliest of the terms' last places, and is a cover if that has moved.
    """
    scored = _covers(queries, index, text).filter("id <> query_id")
    return top(scored, ["query_id"], [F.col("score").desc(), F.col("id")], limit)


def _covers(queries: DataFrame, index: DataFrame, text: str = "query_text", lead: bool = False) -> DataFrame:
    """(query_id, id, score): all records that hold every term of a query, a record that is the query itself too.

    With ``lead`` only records that hold the query's rarest term are looked at,
    and no query that has a term of no record; ``index`` is then read thrice.
    """
    asked = queries.select("query_id", F.array_distinct(words(F.col(text))).alias("t"))
    terms = asked.select("query_id", F.size("t").alias("wanted"), F.posexplode("t").alias("n", "term"))
    met = terms.join(index, "term")
    if lead:
        counted = terms.join(index.groupBy("term").agg(F.count("*").alias("df")), "term")
        first = counted.groupBy("query_id").agg(F.count("*").alias("have"), F.first("wanted").alias("wanted"), F.min_by("term", F.struct("df", "term")).alias("term")).filter("have = wanted")
        met = first.select("query_id", "term").join(index.select("term", "id"), "term").drop("term").join(terms, "query_id").join(index, ["term", "id"])
    found = met.select("query_id", "id", "wanted", F.transform("places", lambda p: F.struct(p.alias("p"), F.col("n").alias("n"))).alias("e"))
    hits = found.groupBy("query_id", "id").agg(F.count("*").alias("have"), F.first("wanted").alias("wanted"), F.array_sort(F.flatten(F.collect_list("e"))).alias("e")).filter("have = wanted")
    state = F.struct(F.array_repeat(F.lit(-1), F.col("wanted")).alias("last"), F.lit(-1).alias("begin"), F.lit(-1).alias("i"), F.lit(0.0).alias("score"))

    def step(s: Column, x: Column) -> Column:
        i = s["i"] + 1
        last = F.transform(s["last"], lambda v, k: F.when(k == x["n"], i).otherwise(v))

        def moved(z: Column) -> Column:
            fresh = z["b"] > s["begin"]
            others = x["p"] - F.get(F.col("e"), z["b"])["p"] - (i - z["b"])
            return F.struct(z["last"].alias("last"), F.greatest(z["b"], s["begin"]).alias("begin"), i.alias("i"), (s["score"] + F.when(fresh, COVER / (1 + others)).otherwise(0.0)).alias("score"))

        return let(last, lambda w: let(F.struct(w.alias("last"), F.array_min(w).alias("b")), moved))

    return hits.select("query_id", "id", F.round(F.aggregate("e", state, step)["score"], 6).alias("score"))


def bm25(queries: DataFrame, index: DataFrame, limit: int = FUNNEL["keyword"], k1: float = 1.2, b: float = 0.75, text: str = "query_text", totals: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank) by BM25 over any shared term.

    ``index`` may hold the queries' terms alone if ``totals`` (``corpus_totals``) comes with it.
    """
    lengths = index.groupBy("id").agg(F.first("length").alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("mean")) if totals is None else totals
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    # ``lengths`` is one row.
    hits = query_terms(queries, text).join(index, "term").join(df, "term").crossJoin(F.broadcast(lengths)).filter("id <> query_id")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = hits.groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))
    return top(scored, ["query_id"], [F.col("score").desc(), F.col("id")], limit)


def trigrams(c: Column) -> Column:
    """Distinct 3-grams of each word with two blanks before and one after it."""
    inside = F.transform(words(c), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(inside))


class Texts:
    """The distinct texts of rows: what depends on a text alone is found once for all rows that share it.

    ``kinds`` is (kind, first, text), each text with the smallest key of its
    rows; ``rows`` is (kind, key), at most ``most`` keys a text, the smallest
    ones. Rows without a key or a text are left out.
    """

    def __init__(self, df: DataFrame, key: str, text: str, most: int | None = None):
        found = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key IS NOT NULL AND text IS NOT NULL")
        self.type = dict(found.dtypes)["key"]
        # Written, so that the numbers of the texts stay as they are.
        self.kinds = settled(found.groupBy("text").agg(F.min("key").alias("first")).select(F.monotonically_increasing_id().alias("kind"), "first", "text"))
        found = found.distinct() if most is None else top(found.distinct(), ["text"], [F.col("key")], most).drop("rank")
        self.rows = found.join(self.kinds.select("kind", "text"), "text").select("kind", "key")


def _spread(pairs: DataFrame, asked: Texts, known: Texts, limit: int) -> DataFrame:
    """(query_id, id, score, rank) for rows from (q, kind, first, score) for texts.

    ``limit + 1`` texts of a query and as many rows of a text are enough: each
    text has a row, and one row at most is the query itself.
    """
    best = top(pairs, ["q"], [F.col("score").desc(), F.col("first")], limit + 1).select("q", "kind", "score")
    ids = top(best.join(known.rows.withColumnRenamed("key", "id"), "kind"), ["q"], [F.col("score").desc(), F.col("id")], limit + 1).select("q", "id", "score")
    hits = ids.join(asked.rows.select(F.col("kind").alias("q"), F.col("key").alias("query_id")), "q").filter("id <> query_id")
    return top(hits.select("query_id", "id", "score"), ["query_id"], [F.col("score").desc(), F.col("id")], limit)


#: Trigrams of a block of texts.
GRAMS = 1_000_000


def _gram_pairs(asked: Texts, known: Texts, least: float, k: int) -> DataFrame:
    """(q, kind, first, score): for each text asked the ``k`` texts of each block with the most similar trigram sets, over ``least``."""
    sides = [t.kinds.select("kind", "first", trigrams(F.col("text")).alias("g")).filter("size(g) > 0") for t in (asked, known)]
    many = [max(1, -(-(df.agg(F.sum(F.size("g"))).first()[0] or 0) // GRAMS)) for df in sides]
    spot = [F.pmod(F.xxhash64("kind"), F.lit(n)).cast("int") for n in many]
    left = sides[0].select("kind", "g", spot[0].alias("_q"), F.explode(F.sequence(F.lit(0), F.lit(many[1] - 1))).alias("_b"))
    right = sides[1].select("kind", "first", "g", F.explode(F.sequence(F.lit(0), F.lit(many[0] - 1))).alias("_q"), spot[1].alias("_b"))

    def meet(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q": q["kind"].iloc[:0], "kind": b["kind"].iloc[:0], "first": b["first"].iloc[:0], "score": np.zeros(0)})]
        if len(q) and len(b):
            b = b.sort_values("first", kind="stable")
            sizes = b["g"].map(len).to_numpy()
            codes, names = pd.factorize(np.concatenate(b["g"].to_list()))
            # The texts that hold each trigram, one trigram after the other.
            order = np.argsort(codes, kind="stable")
            owner, ends = np.repeat(np.arange(len(b)), sizes)[order], np.searchsorted(codes[order], np.arange(len(names) + 1))
            place = pd.Index(names)
            kinds, firsts = b["kind"].to_numpy(), b["first"].to_numpy()
            for kind, grams in zip(q["kind"], q["g"]):
                at = place.get_indexer(grams)
                both = np.bincount(np.concatenate([owner[:0], *(owner[ends[i] : ends[i + 1]] for i in at if i >= 0)]), minlength=len(b))
                have = np.flatnonzero(both)
                union = len(grams) + sizes[have] - both[have]
                # Rounded half up in whole numbers, as decimals are.
                score = (2_000_000 * both[have] + union) // (2 * union) / 1e6
                have, score = have[score > least], score[score > least]
                best = np.argsort(-score, kind="stable")[:k]
                out.append(pd.DataFrame({"q": kind, "kind": kinds[have[best]], "first": firsts[have[best]], "score": score[best]}))
        return pd.concat(out, ignore_index=True)

    return left.groupBy("_q", "_b").cogroup(right.groupBy("_q", "_b")).applyInPandas(meet, f"q long, kind long, first {known.type}, score double")


def trigram(queries: DataFrame, records: DataFrame, least: float = 0.05, limit: int = FUNNEL["keyword"], text: str = "normalized_text", query: str = "query_text") -> DataFrame:
    """(query_id, id, score, rank): records whose trigram sets overlap the query's, by Jaccard similarity (RET3).

    Distinct texts meet in pairs of blocks of about ``GRAMS`` trigrams a side;
    a pair of blocks hands on ``limit + 1`` texts a query, so neither the
    pairs that share a trigram nor either side is held in one place.
    """
    asked, known = Texts(queries, "query_id", query), Texts(records, "id", text, limit + 1)
    return _spread(_gram_pairs(asked, known, least, limit + 1), asked, known, limit)


def keyword(queries: DataFrame, records: DataFrame, limit: int = FUNNEL["keyword"]) -> DataFrame:
    """Full text by cover density, and trigrams for just those queries that it finds nothing for (RET2, RET3).

    Both run once for each pair of distinct texts, not of rows.
    """
    asked, known = Texts(queries, "query_id", "query_text"), Texts(records, "id", "normalized_text", limit + 1)
    known.rows = settled(known.rows)
    wanted = asked.kinds.select(F.col("kind").alias("query_id"), F.col("text").alias("query_text"))
    index = settled(occurrences(known.kinds.withColumnRenamed("kind", "id"), "text", query_terms(wanted)))
    pairs = _covers(wanted, index, lead=True).select(F.col("query_id").alias("q"), F.col("id").alias("kind"), "score").join(known.kinds.select("kind", "first"), "kind")
    exact = settled(_spread(pairs, asked, known, limit))
    rest = Texts(queries.join(exact.select("query_id").distinct(), "query_id", "left_anti"), "query_id", "query_text")
    return exact.unionByName(_spread(_gram_pairs(rest, known, 0.05, limit + 1), rest, known, limit))


def _best(sim: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` largest values, and of all that tie with the last of them."""
    own = np.flatnonzero(np.isfinite(sim))
    return own[sim[own] >= np.partition(sim[own], len(own) - k)[len(own) - k]] if len(own) > k else own


def nearest(queries: DataFrame, base: DataFrame, k: int, query_key: str = "query_id", key: str = "id", vector: str = "embedding", least: float | None = None, larger_key: bool = False) -> DataFrame:
    """(query_key, key, similarity, rank): the ``k`` most similar vectors of ``base`` to each query, exactly (RET4).

    Both sides are dealt to blocks by a hash; each pair of blocks is one matrix
    product in a task of bounded size, which hands on k rows a query. Neither
    side comes to the driver. Similarity is the cosine in double precision;
    vectors meet those of their own length only, and those without a length
    are left out; ties go to the smaller key, or to the larger one.
    """
    sides = [df.select(F.col(c).alias("key"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL AND size(v) > 0") for df, c in ((queries, query_key), (base, key))]
    many = [max(1, -(-df.count() // BLOCK)) for df in sides]
    spot = [F.pmod(F.xxhash64("key"), F.lit(n)).cast("int") for n in many]
    left = sides[0].select("key", "v", spot[0].alias("_q"), F.explode(F.sequence(F.lit(0), F.lit(many[1] - 1))).alias("_b"))
    right = sides[1].select("key", "v", F.explode(F.sequence(F.lit(0), F.lit(many[0] - 1))).alias("_q"), spot[1].alias("_b"))
    kinds = dict(queries.dtypes)[query_key], dict(base.dtypes)[key]

    def meet(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({query_key: q["key"].iloc[:0], key: b["key"].iloc[:0], "similarity": np.zeros(0)})]
        for size, some in q.groupby(q["v"].map(len)):
            rest = b[b["v"].map(len) == size]
            if not len(rest):
                continue
            x, y = np.stack(some["v"].to_numpy()), np.stack(rest["v"].to_numpy())
            names, own = rest["key"].to_numpy(), some["key"].to_numpy()
            far = np.sqrt((y * y).sum(axis=1))
            for at in range(0, len(x), 512):
                part = x[at : at + 512]
                scale = np.sqrt((part * part).sum(axis=1))[:, None] * far[None, :]
                sim = np.divide(part @ y.T, scale, out=np.full(scale.shape, -np.inf), where=scale > 0)
                sim[own[at : at + 512][:, None] == names[None, :]] = -np.inf
                if least is not None:
                    sim[sim < least] = -np.inf
                for row, name in zip(sim, own[at : at + 512]):
                    found = _best(row, k)
                    out.append(pd.DataFrame({query_key: [name] * len(found), key: names[found], "similarity": np.clip(row[found], -1, 1)}))
        return pd.concat(out, ignore_index=True)

    found = left.groupBy("_q", "_b").cogroup(right.groupBy("_q", "_b")).applyInPandas(meet, f"{query_key} {kinds[0]}, {key} {kinds[1]}, similarity double")
    return top(found, [query_key], [F.col("similarity").desc(), F.col(key).desc() if larger_key else F.col(key)], k)


#: Places of one side and the other that are compared at once, places next in latitude that give a first bound, and
#: query places of a task.
ABREAST, BESIDE, PLACES = (128, 8192), 32, 1_000_000


def nearest_places(queries: DataFrame, base: DataFrame, by: str) -> DataFrame:
    """(by, lat, lon, near_lat, near_lon): for each place of ``queries`` the nearest place of ``base`` with the same ``by``, and all as near but for rounding.

    Both sides are places (by, lat, lon) in degrees, each once; those that lack
    a part are left out. Distances are chords of the sphere. The bases next in
    latitude bound the distance, then only the strip of latitudes within it is
    compared, so few of a group's pairs are.
    """
    sides = [df.select(F.col(by).alias("_by"), "lat", "lon").filter(F.col("_by").isNotNull() & ~F.isnan(F.col("lat") + F.col("lon")) & (F.abs(F.col("lat")) + F.abs(F.col("lon")) < float("inf"))).distinct() for df in (queries, base)]
    parts = max(1, -(-sides[0].count() // PLACES))
    left = sides[0].withColumn("_p", F.pmod(F.xxhash64("lat", "lon"), F.lit(parts)))
    right = sides[1].withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    kind = dict(sides[0].dtypes)["_by"]

    def points(df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        lat, lon = np.radians(df["lat"].to_numpy("float64")), np.radians(df["lon"].to_numpy("float64"))
        return lat, np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])

    def chords(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.sqrt(sum((u[:, None] - v) ** 2 for u, v in zip(x, y)))

    def meet(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({by: q["_by"].iloc[:0], "lat": np.zeros(0), "lon": np.zeros(0), "near_lat": np.zeros(0), "near_lon": np.zeros(0)})]
        if len(q) and len(b):
            q, b = q.sort_values(["lat", "lon"]), b.sort_values("lat")
            (lat, x), (south, y) = points(q), points(b)
            for at in range(0, len(q), ABREAST[0]):
                part = slice(at, at + ABREAST[0])
                beside = np.clip(np.searchsorted(south, lat[part])[:, None] + np.arange(-BESIDE, BESIDE), 0, len(b) - 1)
                least = np.sqrt(sum((u[part][:, None] - v[beside]) ** 2 for u, v in zip(x, y))).min(axis=1)
                wide = 2 * np.arcsin(np.minimum(least.max() / 2, 1)) * (1 + 1e-9) + 1e-9
                low, high = np.searchsorted(south, lat[part].min() - wide), np.searchsorted(south, lat[part].max() + wide, "right")
                strips = [slice(k, min(k + ABREAST[1], high)) for k in range(low, high, ABREAST[1])]
                for strip in strips:
                    least = np.minimum(least, chords(x[:, part], y[:, strip]).min(axis=1))
                for strip in strips:
                    i, j = np.nonzero(chords(x[:, part], y[:, strip]) <= (least * (1 + 1e-9) + 1e-12)[:, None])
                    mine, near = q.iloc[i + at], b.iloc[j + strip.start]
                    out.append(pd.DataFrame({by: mine["_by"].to_numpy(), "lat": mine["lat"].to_numpy(), "lon": mine["lon"].to_numpy(), "near_lat": near["lat"].to_numpy(), "near_lon": near["lon"].to_numpy()}))
        return pd.concat(out, ignore_index=True)

    return left.groupBy("_by", "_p").cogroup(right.groupBy("_by", "_p")).applyInPandas(meet, f"{by} {kind}, lat double, lon double, near_lat double, near_lon double")


def fuse(channels: dict[str, DataFrame], k: int = FUNNEL["rrf_k"], limit: int = FUNNEL["fused"]) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, id, rank) channels (RET5): (query_id, id, rrf_score, sources, rank). ``k`` 0 means the default."""
    k = k or FUNNEL["rrf_k"]
    ranks = None
    for name, c in channels.items():
        one = c.select("query_id", "id", "rank", F.lit(name).alias("channel"))
        ranks = one if ranks is None else ranks.unionByName(one)
    fused = ranks.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf_score"), F.array_sort(F.collect_set("channel")).alias("sources"))
    return top(fused, ["query_id"], [F.col("rrf_score").desc(), F.col("id")], limit)


def hybrid(queries: DataFrame, records: DataFrame, text_vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, attribute_vectors: DataFrame | None = None, query_attribute_vectors: DataFrame | None = None, k: int = FUNNEL["rrf_k"], limit: int = FUNNEL["fused"]) -> DataFrame:
    """All channels fused, with raw channel scores (RET6).

    Attribute vectors help to find candidates only; the semantic score is the
    text vectors' cosine.
    """
    # What is read more than once is written once.
    found = settled(keyword(queries, records))
    channels = {"structured": structured(queries, records), "keyword": found}
    text_hits = None
    if text_vectors is not None and query_vectors is not None:
        text_hits = settled(nearest(query_vectors, text_vectors, FUNNEL["vector"]))
        channels["text"] = text_hits
    if attribute_vectors is not None and query_attribute_vectors is not None:
        channels["attributes"] = nearest(query_attribute_vectors, attribute_vectors, FUNNEL["vector"])
    out = fuse(channels, k, limit).join(found.select("query_id", "id", F.col("score").alias("keyword_rank")), ["query_id", "id"], "left")
    if text_hits is None:
        return out.withColumn("semantic_cosine", F.lit(None).cast("double"))
    return out.join(text_hits.select("query_id", "id", F.col("similarity").alias("semantic_cosine")), ["query_id", "id"], "left")


def image_search(queries: DataFrame, vectors: DataFrame, records: DataFrame, images: DataFrame, k: int = 20) -> DataFrame:
    """Records by image similarity, each with its primary image (RET7; RET8 with text or image query vectors)."""
    primary = images.groupBy("id").agg(F.max_by("url", F.struct(F.col("is_primary"), F.col("url"))).alias("image_url"))
    active = vectors.join(records.filter("status = 'ACTIVE'").select("id"), "id", "left_semi")
    return nearest(queries, active, k).join(primary, "id", "left")
