"""N-gram Jaccard join: grouped prefixes, filtered group pairs, verified members."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.census import CELL, cell_blobs, census_cell, hauls, hot_keys, id_filter, is_hot, may_hold, mix64, open_answer, spot_of, text_blocks
from recordloom.llm.common import components, in_batches, share, trim, written
from recordloom.llm.lm_scoring import split_words

#: Bytes of text whose shingles are dealt together.
HAUL = 8 << 20
#: Bytes of a text that is read at once.
LONG = 4 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Partners that meet one leader's text in a task.
FAN = 256


def long_parts(raw: bytes, n: int, size: int) -> Iterator[bytes]:
    """A long text in parts of about ``size`` bytes that share ``n - 1`` words, so that each shingle lies in one."""
    at, first = 0, True
    while at < len(raw):
        end = at + size
        while True:
            gap = SPACE.search(raw, min(end, len(raw)))
            end = gap.start() if gap else len(raw)
            part = raw[at:end]
            if end == len(raw) or len(part.split(None, n)) > n:
                break
            end += size
        if first or len(part.split(None, n)) >= n:
            yield part
        if end == len(raw):
            return
        at, first = at + len(part.rsplit(None, n - 1)[0]), False


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, key) of the distinct n-word shingles of each text, sorted by owner and key; shorter texts are one shingle.

    A text of more than ``LONG`` bytes is read in overlapping parts.
    """
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    wide = np.flatnonzero(sizes > LONG)
    if not len(wide):
        return _shingles(texts, n)
    owner, key = _shingles(pc.if_else(pa.array(sizes > LONG), pa.scalar("", texts.type), texts), n)
    owners, keys = [owner], [key]
    for i in wide.tolist():
        raw = texts[i].as_buffer().to_pybytes()
        mine = np.unique(np.concatenate([_shingles(pa.array([part], pa.binary()).cast(texts.type), n)[1] for part in long_parts(raw, n, LONG)]))
        owners.append(np.full(len(mine), i, owner.dtype))
        keys.append(mine)
    owner, key = np.concatenate(owners), np.concatenate(keys)
    order = np.argsort(owner, kind="stable")
    return owner[order], key[order]


def _shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    words, places, many = split_words(texts)
    owner = np.repeat(np.arange(len(many)), many)
    code = pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(words) else np.zeros(0, "uint64")
    code = code[places]
    starts = np.cumsum(many) - many
    rank = np.arange(len(code)) - np.repeat(starts, many)
    size = np.minimum(many, n)
    key = np.zeros(len(code), "uint64")
    for k in range(n):
        # Word k of the shingle that begins at each place, where the text (or a short text's one shingle) has it.
        there = np.zeros(len(code), "uint64")
        there[: max(0, len(code) - k)] = code[k:]
        there *= np.repeat(k < size, many)
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + there + np.uint64(k + 1))
    first = rank <= np.repeat(many - size, many)
    owner, key = owner[first], key[first]
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    keep = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])] if len(key) else np.zeros(0, bool)
    return owner[keep], key[keep]


def signatures(owner: np.ndarray, key: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each text's set, and two 64-bit marks that equal sets share."""
    size = np.bincount(owner, minlength=rows).astype("int64")
    a, b = np.zeros(rows, "uint64"), np.zeros(rows, "uint64")
    if len(key):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        a[owner[starts]] = np.add.reduceat(mix64(key + np.uint64(77)), starts)
        b[owner[starts]] = np.bitwise_xor.reduceat(mix64(key ^ np.uint64(0x5555AAAA12345678)), starts)
    return size, a, b


def least_common(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Shingles that a set shares at least with any partner: its partner cannot be larger than the union allows."""
    return -(-num * size // den)


def _scan(docs: DataFrame, n: int, cells: int, hot: np.ndarray) -> DataFrame:
    """(cell, block, blob): keys for the cells, and under cell -1 what a block needs to know about itself."""
    shared = share(docs.sparkSession, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hot = pickle.loads(shared.value)
        block = TaskContext.get().partitionId() << 32
        for parts in hauls(batches, 1, HAUL):
            ids = [i for part in parts for i in part.column(0).to_pylist()]
            owners, keys, marks, at = [], [], [], 0
            for part in parts:
                owner, key = shingles(part.column(1), n)
                marks.append(signatures(owner, key, part.num_rows))
                owners.append((owner + at).astype("uint32"))
                keys.append(key)
                at += part.num_rows
            owner, key = np.concatenate(owners), np.concatenate(keys)
            del owners, keys
            size, a, b = (np.concatenate(x) for x in zip(*marks))
            heat = is_hot(hot, key)
            home = pickle.dumps((ids, size, a, b, owner[heat], np.searchsorted(hot, key[heat]).astype("uint32")))
            # Texts with one set count once, so only the first of them in the haul asks.
            _, first = np.unique(np.stack([a, b]), axis=1, return_index=True)
            asks = np.zeros(at, bool)
            asks[first] = True
            ask = ~heat & asks[owner]
            kinds, names = [pa.int64(), pa.int64(), pa.binary()], ["cell", "block", "blob"]
            yield from in_batches([(-1, block, home)], kinds, names)
            yield from in_batches(((c, block, blob) for c, blob in cell_blobs(key[ask], cells, owner[ask])), kinds, names)
            block += 1
            del owner, key, heat, ask, home
            trim()

    return docs.mapInArrow(run, "cell long, block long, blob binary")


def _finish(num: int, den: int):
    """A block with its answers: (doc_id, n, a, b, prefix); the prefix is null where no text can be similar.

    Keys are ordered by how many texts hold them, rarest first, then by value.
    Two sets with enough in common share a key among their first
    ``n - least_common + 1``. Keys of a single text come first and match
    nothing, so only what follows them up to that length is kept.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        home = pdf[pdf["cell"] < 0]
        ids, size, a, b, hot_owner, hot_place = pickle.loads(home["blob"].iloc[0])
        owners, keys = [hot_owner.astype("int64")], [(np.uint64(255) << np.uint64(56)) | hot_place.astype("uint64")]
        for cell, blob in zip(pdf["cell"], pdf["blob"]):
            if cell >= 0:
                low, who, level = open_answer(blob)
                owners.append(who.astype("int64"))
                keys.append((level.astype("uint64") << np.uint64(56)) | (np.uint64(cell & 0xFFFFFF) << np.uint64(32)) | low)
        owner, key = np.concatenate(owners), np.concatenate(keys)
        order = np.lexsort((key, owner))
        owner, key = owner[order], key[order]
        known = np.bincount(owner, minlength=len(size))
        # Texts of one set: the first one asked for all.
        _, first, place = np.unique(np.stack([a, b]), axis=1, return_index=True, return_inverse=True)
        asked = first[np.ravel(place)]
        starts = np.cumsum(known) - known
        need = least_common(size, num, den)
        prefix: list[bytes | None] = []
        for i in range(len(size)):
            j = int(asked[i])
            some = int(known[j])
            if not size[i] or some < need[i]:
                prefix.append(None)
                continue
            keep = int(size[i] - need[i] + 1 - (size[i] - some))
            prefix.append(key[starts[j] : starts[j] + keep].astype("<u8").tobytes())
        return pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "n": size, "a": a.astype("int64"), "b": b.astype("int64"), "prefix": prefix})

    return run


def _verified(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int, name: str) -> DataFrame:
    """The pairs (u, v) of class keys whose sets are similar enough, from their texts.

    The texts of up to about ``FAN`` partners meet the text of u in a task; a u
    with more partners is dealt to several tasks.
    """
    pairs = written(pairs, f"{name}-pairs")
    parts = F.ceil(F.col("_c") / FAN).cast("int")
    sized = pairs.join(pairs.groupBy("u").agg(F.count("*").alias("_c")), "u").select("u", "v", F.pmod(F.xxhash64("v"), parts).alias("s"))
    rows = sized.select("u", "s", F.col("v").alias("cls"), F.lit(False).alias("lead")).union(sized.select("u", "s", F.col("u").alias("cls"), F.lit(True).alias("lead")).distinct())
    rows = rows.join(texts, "cls").select("u", "s", "cls", "lead", "data")

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[int] = []
        lead = pdf["lead"].to_numpy(bool)
        if lead.any() and not lead.all():
            _, mine = shingles(pa.array(pdf["data"][lead].iloc[:1].tolist(), pa.string()), n)
            rest = pdf[~lead]
            for at in range(0, len(rest), 64):
                part = rest.iloc[at : at + 64]
                owner, key = shingles(pa.array(part["data"].tolist(), pa.string()), n)
                size = np.bincount(owner, minlength=len(part))
                place = np.minimum(np.searchsorted(mine, key), len(mine) - 1)
                both = np.bincount(owner, mine[place] == key, minlength=len(part)).astype("int64")
                found += part["cls"][den * both >= num * (size + len(mine) - both)].tolist()
        return pd.DataFrame({"u": np.full(len(found), pdf["u"].iloc[0], "int64"), "v": np.array(found, dtype="int64")})

    return written(rows.groupBy("u", "s").applyInPandas(check, "u long, v long"), name)


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """Documents whose sets of word shingles have a Jaccard similarity of num/den or more.

    Returns (doc_id, n_shingles, component_id), one row per document: the size
    of its set and the smallest doc_id that links lead to.

    1. Texts with equal sets are one class.
    2. A census tells which shingles more than one class holds, and roughly
       how many do; shingles that a sample shows to be in many texts are
       ordered last without one. A class that shares too few can have no
       partner and is done.
    3. The others have a prefix under that order. Classes with the same prefix
       and size are one group.
    4. Group pairs share a prefix key and pass the size filter and the position
       filter. First each group is paired with the one leader that it shares
       most keys with (of those with the smallest share of shingles that no other text has), and members with their group; what these links join
       needs no more pairs. All pairs left between different components are
       then expanded to members and verified on their texts, so no link
       between components is lost.

    Keys are 64-bit hashes; a match between classes is decided by the hashes of
    whole sets. Null or empty text: size 0, linked with nothing. Null id: its
    own row with a null component unless its set equals another's. Rows that
    repeat an id have a row each. Empty table: no rows. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("data"))
    total = rows.agg(F.sum(F.octet_length("data")).alias("b")).first().b or 0
    cells = max(4, int(total / 6.0 / CELL) + 1)
    hot = hot_keys(rows, lambda texts: shingles(texts, words))
    scanned = _scan(rows, words, cells, hot)
    answered = scanned.groupBy("cell", F.when(F.col("cell") < 0, F.col("block")).alias("_own")).applyInPandas(census_cell, "block long, cell long, blob binary")
    known = written(answered.groupBy("block").applyInPandas(_finish(num, den), "doc_id long, n long, a long, b long, prefix binary"), "jaccard-docs")
    cls = F.xxhash64("n", "a", "b")
    classes = known.filter("prefix IS NOT NULL").groupBy(cls.alias("cls")).agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix")).filter("id IS NOT NULL")
    groups = classes.withColumn("grp", F.xxhash64("n", "prefix"))
    members = written(groups.join(groups.groupBy("grp").agg(F.min("cls").alias("gid")), "grp").select("cls", "gid", "id", "n", "prefix"), "jaccard-members")

    # Keys of each group, with their place in the whole order.
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gid, n, prefix in zip(*(batch.column(k).to_pylist() for k in range(3))):
                keys = np.frombuffer(prefix, "<u8")
                m = len(keys)
                before = n - int(least_common(np.int64(n), num, den)) + 1 - m
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype("int64")), pa.array(np.full(m, gid)), pa.array(np.full(m, n)), pa.array(np.arange(before, before + m, dtype="int64")), pa.array(np.full(m, before * 1000 // n))], names=["key", "gid", "n", "pos", "lone"])

    firsts = members.filter("cls = gid").select("gid", "n", "prefix")
    entries = firsts.mapInArrow(spread, "key long, gid long, n long, pos long, lone long")
    kept = entries.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    entries = written(entries.join(kept, "key"), "jaccard-keys")

    # Texts of the classes that have a group partner or key partner.
    active = entries.select("gid").distinct().union(members.filter("cls <> gid").select("gid")).distinct()
    needed = written(members.join(active, "gid").select("cls", "gid", "id"), "jaccard-needed")
    bits = share(spark, id_filter(needed, "id"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pickle.loads(bits.value)
        for batch in batches:
            some = batch.filter(pa.array(may_hold(held, batch.column(0).to_numpy())))
            for part in text_blocks(some, 1):
                size, a, b = signatures(*shingles(part.column(1), words), part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(a.astype("int64")), pa.array(b.astype("int64")), part.column(1)], names=["n", "a", "b", "data"])

    fetched = rows.filter("doc_id IS NOT NULL").select(spot_of("doc_id").alias("s"), "data").mapInArrow(fetch, "n long, a long, b long, data string")
    texts = written(fetched.select(cls.alias("cls"), "data").join(needed.select("cls"), "cls").dropDuplicates(["cls"]), "jaccard-texts")

    links = needed.filter("cls <> gid").select(F.col("gid").alias("u"), F.col("cls").alias("v"))
    #: Steps of size a little wider than the ratio that similar sets can have at most.
    scale = F.floor(F.log("n") / float(np.log(1.0001 * den / num))).cast("int")
    # Copies of one text differ from each other more than from it, and it has the fewest shingles of its own.
    for turn, last in enumerate((F.col("gid"), F.xxhash64("gid"))):
        sized = entries.withColumn("scale", scale)
        leaders = sized.groupBy("key", "scale").agg(F.min_by("gid", F.struct("lone", last.alias("last"))).alias("lead"))
        votes = sized.join(leaders, ["key", "scale"]).filter("lead <> gid").groupBy("gid", "lead").count()
        best = votes.groupBy("gid").agg(F.max_by("lead", F.struct("count", "lead")).alias("lead"))
        star = best.select(F.col("lead").alias("u"), F.col("gid").alias("v"))
        good = _verified(star.union(links) if not turn else star, texts, words, num, den, f"jaccard-star{turn}")
        found = good if not turn else found.union(good)
    ties = components(found, "jaccard-ties")
    label = needed.join(ties.withColumnRenamed("id", "cls"), "cls", "left").select("cls", "gid", F.coalesce("component", "cls").alias("comp"))
    label = written(label, "jaccard-label")

    # What is left: pairs of different components. A group stands for all its members' components.
    by_group = label.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    seen = entries.join(by_group, "gid")
    open_keys = seen.groupBy("key").agg(F.min("low").alias("l"), F.max("high").alias("h")).filter("l <> h").select("key")
    seen = written(seen.join(open_keys, "key"), "jaccard-open")
    common = seen.groupBy("key", "low").count().groupBy("key").agg(F.max_by("low", F.struct("count", "low")).alias("main"))
    # Everything outside a key's largest component meets everything of another component.
    minor = seen.join(written(common, "jaccard-main"), "key").filter("low <> main OR low <> high").select("key", F.col("gid").alias("g1"), F.col("n").alias("n1"), F.col("pos").alias("p1"), F.col("low").alias("l1"), F.col("high").alias("h1"), scale.alias("s1"))
    # Sets that differ by more than one step of size cannot be similar, so the step is part of the key.
    minor = minor.withColumn("scale", F.explode(F.array(F.col("s1") - 1, F.col("s1"), F.col("s1") + 1))).drop("s1")
    both = seen.withColumn("scale", scale).join(minor, ["key", "scale"]).filter("g1 <> gid AND NOT (l1 = low AND h1 = high AND l1 = h1)")
    need = F.ceil(F.lit(num) * (F.col("n") + F.col("n1")) / F.lit(num + den))
    reach = F.least(F.col("n") - F.col("pos"), F.col("n1") - F.col("p1"))
    both = both.filter((F.least("n", "n1") * den >= F.greatest("n", "n1") * num) & (reach >= need))
    pairs = both.select(F.least("gid", "g1").alias("x"), F.greatest("gid", "g1").alias("y")).distinct()
    inside = by_group.filter("low <> high").select(F.col("gid").alias("x"), F.col("gid").alias("y"))
    one, two = (label.select(F.col("gid").alias(g), F.col("cls").alias(c), F.col("comp").alias(k)) for g, c, k in (("x", "u", "cu"), ("y", "v", "cv")))
    expanded = pairs.union(inside).join(one, "x").join(two, "y").filter("cu <> cv").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    rest = _verified(expanded, texts, words, num, den, "jaccard-rest")
    final = components(found.union(rest), "jaccard-final").withColumnRenamed("id", "cls")

    per_class = known.filter("n > 0").groupBy(cls.alias("cls")).agg(F.min("doc_id").alias("id"))
    named = per_class.join(final, "cls", "left").select("cls", "id", F.coalesce("component", "cls").alias("component"))
    named = written(named, "jaccard-named")
    lowest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    by_class = named.join(lowest, "component").select("cls", "component_id")
    out = known.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, cls).alias("cls")).join(by_class, "cls", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


#: DuckDB SQL (ids distinct) for small tables.
JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM grams GROUP BY doc_id),
ids AS (SELECT g, list(doc_id) AS l FROM grams GROUP BY g HAVING count(*) > 1),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM grams a JOIN ids USING (g) JOIN grams b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM pairs JOIN sizes s ON s.doc_id = u JOIN sizes t ON t.doc_id = v WHERE 100 * c >= 75 * (s.n + t.n - c)),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, links.v FROM reach JOIN links ON reach.r = links.u),
low AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM low LEFT JOIN sizes ON doc_id = id
"""
