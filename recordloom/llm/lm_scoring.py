"""Language-model scores from a log-bilinear model trained by noise-contrastive estimation."""

from __future__ import annotations

import pickle
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import held_out, share, trim, written

#: Frequent words whose counts all executors hold, at most; the others meet their counts in a join.
HEAD = 1 << 18
#: Words that the network predicts one by one, and classes (by ending) that all others fall into.
WORDS, CLASSES = 1920, 126
END, BEGIN = WORDS + CLASSES, WORDS + CLASSES + 1
OUTPUTS, CONTEXTS = WORDS + CLASSES + 1, WORDS + CLASSES + 2
DIMS, NOISE, BATCH = 24, 64, 1024
#: Training passes; together they take every token of all training documents once.
ROUNDS = 2
#: Tokens of a replica, about. The number of replicas follows from the corpus, not from the cluster.
SHARE = 6_000_000
BLOCK = 4 << 20
LOG10 = float(np.log(10))


def ending_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def blocks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``BLOCK`` bytes of text, or one row."""
    lengths = pc.binary_length(batch.column(column)).to_numpy()
    start, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and size + n > BLOCK:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (A-Z lower-cased), the place of each word of all texts among them, and words a text."""
    # Lower-cased first: that copies a slice whole, which the cast of a slice does not do right.
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts).cast(pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    words, places = coded.dictionary, coded.indices.to_numpy().astype("int64")
    offsets = lists.offsets.to_numpy()
    owner = np.repeat(np.arange(len(texts)), offsets[1:] - offsets[:-1])
    # White space at the ends of a text leaves empty strings, which are no words.
    empty = pc.index(words, "").as_py()
    if empty >= 0:
        keep = places != empty
        places, owner = places[keep], owner[keep]
    return words, places, np.bincount(owner, minlength=len(texts))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c_train, c_all) over all texts; blocks are counted before they are shuffled. ``docs`` has (train, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(parts: list[pa.Table]) -> pa.Table:
            found = pa.concat_tables(parts).group_by("word").aggregate([("c_train", "sum"), ("c_all", "sum")])
            return pa.table([found["word"], found["c_train_sum"], found["c_all_sum"]], names=["word", "c_train", "c_all"])

        held: list[pa.Table] = []
        for batch in batches:
            for part in blocks(batch, 1):
                words, places, many = split_words(part.column(1))
                train = np.repeat(part.column(0).to_numpy(zero_copy_only=False), many)
                c_all = np.bincount(places, minlength=len(words))
                c_train = np.bincount(places[train], minlength=len(words))
                held.append(pa.table([words, c_train, c_all], names=["word", "c_train", "c_all"]).filter(pa.array(c_all > 0)))
                if sum(t.num_rows for t in held) > 700_000:
                    held = [merged(held)]
                    if held[0].num_rows > 500_000:
                        yield from held.pop().to_batches(max_chunksize=50_000)
        if held:
            yield from merged(held).to_batches(max_chunksize=50_000)
        held.clear()
        trim()

    found = docs.mapInArrow(run, "word string, c_train long, c_all long")
    return found.groupBy("word").agg(F.sum("c_train").alias("c_train"), F.sum("c_all").alias("c_all"))


@dataclass
class Lexicon:
    """Bounded facts about frequent words, and totals of the training tokens."""

    words: list[str]
    counts: np.ndarray
    unigram: np.ndarray
    total: int
    distinct: int
    class_total: np.ndarray
    class_distinct: np.ndarray

    def __post_init__(self) -> None:
        self.model_id = np.array([i if i < WORDS else WORDS + ending_class(w.encode()) for i, w in enumerate(self.words)], dtype="int32")

    def base10(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def inside10(self, counts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """log10 of a word within its class: the words seen there and one share for all that were not."""
        return np.log10((counts + 0.5) / (self.class_total[kinds] + 0.5 * (self.class_distinct[kinds] + 1)))


class LogBilinear:
    """P(w | two words before) ~ exp((Q[w1] C1 + Q[w2] C2) . R[w] + b[w])."""

    def __init__(self, unigram: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.q = (rng.standard_normal((CONTEXTS, DIMS)) * 0.3).astype("float32")
        self.r = (rng.standard_normal((OUTPUTS, DIMS)) * 0.1).astype("float32")
        self.b = np.log(unigram).astype("float32")
        self.c = [np.eye(DIMS, dtype="float32"), np.eye(DIMS, dtype="float32") * 0.5]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.q, self.r, self.b, *self.c)])

    def load(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for name in ("q", "r", "b"):
            x = getattr(self, name)
            setattr(self, name, flat[at : at + x.size].reshape(x.shape).astype("float32"))
            at += x.size
        self.c = [flat[at + k * DIMS * DIMS : at + (k + 1) * DIMS * DIMS].reshape(DIMS, DIMS).astype("float32") for k in range(2)]
        return self

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each word after each first and each second context word, and the log normaliser of each pair.

        The normaliser of all pairs is one matrix product: the sum over words
        of exp(S1[w1, w]) * exp(S2[w2, w]).
        """
        s1 = (self.q @ self.c[0]) @ self.r.T + self.b
        s2 = (self.q @ self.c[1]) @ self.r.T
        m1, m2 = s1.max(axis=1, keepdims=True), s2.max(axis=1, keepdims=True)
        z = np.exp(s1 - m1) @ np.exp(s2 - m2).T
        return s1, s2, np.log(np.maximum(z, 1e-35)) + m1 + m2.T


class Replica:
    """Noise-contrastive training of one copy of the model by Adagrad, batch by batch."""

    def __init__(self, model: LogBilinear, unigram: np.ndarray, seed: int, rate: float = 0.08):
        self.m, self.rate = model, rate
        self.rng = np.random.default_rng(seed)
        self.upto = np.cumsum(unigram / unigram.sum())
        self.offset = np.log(NOISE * unigram / unigram.sum()).astype("float32")
        self.seen = {"q": np.full(CONTEXTS, 1.0, "float32"), "r": np.full(OUTPUTS, 1.0, "float32"), "b": np.full(OUTPUTS, 1.0, "float32"), "c": [1.0, 1.0]}
        self.examples = 0

    def rows(self, name: str, at: np.ndarray, grad: np.ndarray) -> None:
        """Adds up gradients of equal rows and steps by the rows' own rates."""
        order = np.argsort(at, kind="stable")
        s = at[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        total, place = np.add.reduceat(grad[order], first, axis=0), s[first]
        seen = self.seen[name]
        seen[place] += (total * total).mean(axis=1) if total.ndim > 1 else total * total
        step = self.rate / np.sqrt(seen[place])
        x = getattr(self.m, name)
        x[place] -= total * (step[:, None] if total.ndim > 1 else step)

    def learn(self, w: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> None:
        m = self.m
        for at in range(0, len(w), BATCH):
            a, b, c = w[at : at + BATCH], w1[at : at + BATCH], w2[at : at + BATCH]
            noise = np.minimum(np.searchsorted(self.upto, self.rng.random(NOISE)), OUTPUTS - 1)
            qb, qc = m.q[b], m.q[c]
            h = qb @ m.c[0] + qc @ m.c[1]
            ra, rn = m.r[a], m.r[noise]
            good = 1 / (1 + np.exp(-np.clip((h * ra).sum(axis=1) + m.b[a] - self.offset[a], -20, 20))) - 1
            bad = 1 / (1 + np.exp(-np.clip(h @ rn.T + (m.b[noise] - self.offset[noise]), -20, 20)))
            dh = good[:, None] * ra + bad @ rn
            places = np.concatenate([a, noise])
            self.rows("r", places, np.concatenate([good[:, None] * h, bad.T @ h]))
            self.rows("b", places, np.concatenate([good, bad.sum(axis=0)]))
            for k, (q, at_q) in enumerate(((qb, b), (qc, c))):
                grad = q.T @ dh
                back = dh @ m.c[k].T
                self.seen["c"][k] += float((grad * grad).mean())
                m.c[k] -= self.rate * 0.3 / np.sqrt(self.seen["c"][k]) * grad
                self.rows("q", at_q, back)
            self.examples += len(a)


def encode(lexicon: Lexicon, head: pa.Array, texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Words of a block: distinct words, their place in the head or -1, their model ids, the place of each word, words a text."""
    words, places, many = split_words(texts)
    found = pc.fill_null(pc.index_in(words, value_set=head), -1).to_numpy().astype("int64")
    kinds = np.empty(len(words), "int32")
    inside = found >= 0
    kinds[inside] = lexicon.model_id[found[inside]]
    rest = np.flatnonzero(~inside)
    kinds[rest] = [WORDS + ending_class(w.encode()) for w in words.take(pa.array(rest)).to_pylist()]
    return words, found, kinds, places, many


def with_contexts(ids: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Model ids with an end after each text, the two before each, and where each text starts."""
    starts = np.cumsum(many + 1) - (many + 1)
    flat = np.full(len(ids) + len(many), END, "int32")
    inside = np.ones(len(flat), bool)
    inside[starts + many] = False
    flat[inside] = ids
    w1, w2 = np.full(len(flat), BEGIN, "int32"), np.full(len(flat), BEGIN, "int32")
    w1[1:], w2[2:] = flat[:-1], flat[:-2]
    w1[starts] = BEGIN
    w2[starts] = BEGIN
    second = starts[many > 0] + 1
    w2[second] = BEGIN
    return flat, w1, w2, starts


def drawn(starts: np.ndarray, many: np.ndarray, turn: int) -> np.ndarray:
    """Places of a round's tokens. They depend on the text alone, so each token has its round however blocks are cut."""
    inside = np.arange(int((many + 1).sum())) - np.repeat(starts, many + 1)
    return np.flatnonzero((inside + np.repeat(many, many + 1)) % ROUNDS == turn)


def _averaged(replicas: DataFrame, count: int) -> np.ndarray | None:
    """Mean of replicas by examples seen, in two steps, so that no task and not the driver holds all of them; summed in order."""

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("replica")
        n = pdf["examples"].to_numpy()
        total = sum(np.frombuffer(x, "float32").astype("float64") * k for x, k in zip(pdf["weights"], n))
        return pd.DataFrame({"g": [int(pdf["g"].iloc[0])], "examples": [int(n.sum())], "weights": [(total / max(1, n.sum())).astype("float32").tobytes()]})

    some = max(1, round(count**0.5))
    parts = replicas.withColumn("g", F.pmod("replica", F.lit(some))).groupBy("g").applyInPandas(mean, "g long, examples long, weights binary").collect()
    if not parts:
        return None
    parts = sorted(parts, key=lambda r: r.g)
    total = sum(np.frombuffer(r.weights, "float32").astype("float64") * r.examples for r in parts)
    return total / sum(r.examples for r in parts)


def _encoded(docs: DataFrame, known, replicas: int) -> DataFrame:
    """(replica, doc_id, n, ids): the model ids of each training document's words, two bytes a word, dealt by a hash of its id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = pickle.loads(known.value)
        head = pa.array(lex.words, pa.large_string())
        for batch in batches:
            for part in blocks(batch, 2):
                _, _, kinds, places, many = encode(lex, head, part.column(2))
                ids, ends = kinds[places].astype("<u2"), np.cumsum(many)
                data = [ids[a:b].tobytes() for a, b in zip((ends - many).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(many), pa.array(data, pa.binary())], names=["replica", "doc_id", "n", "ids"])
        trim()

    # A hot id or text must not decide a replica alone.
    replica = F.pmod(F.xxhash64("doc_id", "data"), F.lit(replicas))
    return docs.filter("train").select(replica.alias("replica"), "doc_id", "data").mapInArrow(run, "replica long, doc_id long, n long, ids binary")


def _train(spark, docs: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """Parameter mixing: replicas learn from their shares of the documents; the mean starts the next round.

    Shares, the order inside them and the order of sums follow from the
    documents alone, so another cluster or other files give the same weights.
    """
    flat = LogBilinear(lexicon.unigram).flat()
    replicas = max(1, round(lexicon.total / SHARE))
    known = share(spark, lexicon)
    shares = written(_encoded(docs, known, replicas), "lm-shares")
    for turn in range(ROUNDS):
        learnt = shares.groupBy("replica").applyInPandas(_round(known, share(spark, flat.astype("float32")), turn), "replica long, examples long, weights binary")
        mean = _averaged(learnt, replicas)
        if mean is not None:
            flat = mean
    return flat


def _round(known, start, turn: int):
    """A replica's pass over its share, from the shared weights."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lex = pickle.loads(known.value)
        number = int(pdf["replica"].iloc[0])
        replica = Replica(LogBilinear(lex.unigram).load(pickle.loads(start.value)), lex.unigram, turn + ROUNDS * number)
        pdf = pdf.sort_values(["doc_id", "n", "ids"])
        upto, at = np.cumsum(pdf["n"].to_numpy()), 0
        while at < len(pdf):
            # A million words at a time, and one document at least.
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 1_000_000, side="right")))
            part = pdf.iloc[at:end]
            many = part["n"].to_numpy()
            w, w1, w2, starts = with_contexts(np.frombuffer(b"".join(part["ids"]), "<u2").astype("int32"), many)
            pick = replica.rng.permutation(drawn(starts, many, turn))
            replica.learn(w[pick], w1[pick], w2[pick])
            at = end
        trim()
        some = int(replica.examples > 0)
        return pd.DataFrame({"replica": [number] * some, "examples": [replica.examples] * some, "weights": [replica.m.flat().astype("float32").tobytes()] * some})

    return run


def score(docs: DataFrame, folds: int = 5, fold: int = 1) -> DataFrame:
    """Unigram and log-bilinear log10 probabilities of whole texts.

    Returns (doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score), one row per document. Both models learn from all documents outside
    the held-out fold. ``base_score`` smooths unigram counts. ``score`` sums
    normalised probabilities: the network gives each frequent word, each
    class of other words and the end of text a share that adds up to one; a
    word of a class gets its smoothed share of the class.

    Words are counted over the whole corpus. The counts of at most ``HEAD``
    frequent words are broadcast; rarer words leave a document as (row, word,
    times), meet their counts in a join, and are summed back to the row, so
    neither the vocabulary nor a frequent word ever has to fit one task.

    Training shares, orders and sums follow from ids and texts, so a rerun on
    another cluster, or over other files, gives the same scores.

    Null text: no words, the end token alone. Null id: not held out. Repeated
    rows have a row each. Without training documents every count is 0. An
    empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", (~held_out(F.col("doc_id"), folds, fold)).alias("train"), F.coalesce("text", F.lit("")).alias("data"))
    counts = written(count_words(rows.select("train", "data")), "lm-counts")
    many_docs = rows.filter("train").count()
    level = F.floor(F.log2("c_all") * 32).cast("int")
    by_level = sorted(((r.l, r["count"]) for r in counts.groupBy(level.alias("l")).count().collect()), reverse=True)  # 2048 levels at most
    lowest, held = 1 << 20, 0
    for l, n in by_level:  # noqa: E741
        if held + n > HEAD:
            break
        lowest, held = l, held + n
    frequent = counts.filter(level >= lowest).toArrow()  # ``HEAD`` rows at most
    order = sorted(zip(frequent["c_train"].to_pylist(), frequent["word"].to_pylist()), key=lambda x: (-x[0], x[1]))
    kind = (F.pmod(F.crc32(F.expr("substring(CAST(word AS BINARY), -2, 2)")), F.lit(CLASSES)) + WORDS).cast("int")
    predicted = [w for _, w in order[:WORDS]]
    totals = counts.agg(F.sum("c_train").alias("n"), F.count(F.when(F.col("c_train") > 0, 1)).alias("v")).first()
    by_class = counts.groupBy(kind.alias("k")).agg(F.sum("c_train").alias("n"), F.count(F.when(F.col("c_train") > 0, 1)).alias("v")).collect()
    class_total, class_distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class:
        class_total[r.k - WORDS], class_distinct[r.k - WORDS] = r.n, r.v
    for c, w in order[:WORDS]:
        class_total[ending_class(w.encode())] -= c
        class_distinct[ending_class(w.encode())] -= c > 0
    unigram = np.zeros(OUTPUTS)
    unigram[: len(predicted)] = [c for c, _ in order[:WORDS]]
    unigram[WORDS:END], unigram[END] = class_total, many_docs
    unigram = (unigram + 0.5) / (unigram + 0.5).sum()
    lexicon = Lexicon([w for _, w in order], np.array([c for c, _ in order], dtype="float64"), unigram, (totals.n or 0) + many_docs, (totals.v or 0) + (many_docs > 0), class_total, class_distinct)
    weights = _train(spark, rows, lexicon)
    known, model = share(spark, lexicon), share(spark, weights.astype("float32"))
    token = f"{zlib.crc32(weights.tobytes())}-{zlib.crc32(known.value)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache = sys.__dict__.setdefault("_recordloom_lm", {})
        if token not in cache:  # a worker serves many tasks
            cache.clear()
            lex = pickle.loads(known.value)
            cache[token] = lex, pa.array(lex.words, pa.large_string()), LogBilinear(lex.unigram).load(pickle.loads(model.value)).tables()
        lex, head, (s1, s2, logz) = cache[token]
        end_base = float(lex.base10(np.array([many_docs], "float64"))[0])
        head_base = lex.base10(lex.counts)
        head_inside = np.zeros(len(lex.counts))
        head_inside[WORDS:] = lex.inside10(lex.counts[WORDS:], lex.model_id[WORDS:] - WORDS)
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in blocks(batch, 1):
                words, found, kinds, places, many = encode(lex, head, part.column(1))
                w, w1, w2, starts = with_contexts(kinds[places], many)
                p = (s1[w1, w] + s2[w2, w] - logz[w1, w2]).astype("float64") / LOG10
                sums = np.add.reduceat(p, starts)
                owner = np.repeat(np.arange(len(many)), many)
                at = found[places]
                inside = at >= 0
                n = len(many)
                base = np.bincount(owner[inside], head_base[at[inside]], minlength=n) + end_base
                sums += np.bincount(owner[inside], head_inside[at[inside]], minlength=n)
                seen = np.bincount(owner[inside], lex.counts[at[inside]] > 0, minlength=n).astype("int64") + (many_docs > 0)
                ids = np.arange(key, key + n)
                key += n
                yield pa.RecordBatch.from_arrays([pa.array(ids), part.column(0), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array(many + 1), pa.array(seen), pa.array(base), pa.array(sums)], names=NAMES)
                rare = np.flatnonzero(~inside)
                if len(rare):
                    pairs, times = np.unique(owner[rare] * len(words) + places[rare], return_counts=True)
                    m = len(pairs)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[pairs // len(words)]), pa.nulls(m, pa.int64()), words.take(pa.array(pairs % len(words))).cast(pa.string()), pa.array(times), *[pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]], names=NAMES)
            trim()

    scored = written(rows.select("doc_id", "data").mapInArrow(run, "row long, doc_id long, word string, times long, n_tokens long, n_known long, base_score double, score double"), "lm-rows")
    whole = scored.filter("word IS NULL").drop("word", "times")
    rare = scored.filter("word IS NOT NULL").select("row", "word", "times").join(counts.filter(level < lowest).select("word", "c_train"), "word")
    width = F.element_at(F.array(*[F.lit(float(x)) for x in lexicon.class_total + 0.5 * (lexicon.class_distinct + 1)]), (kind - WORDS + 1).cast("int"))
    up = F.log10(F.col("c_train") + 0.5)
    rare = rare.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), F.when(F.col("c_train") > 0, F.col("times")).otherwise(0).alias("n_known"), (F.col("times") * (up - F.lit(float(np.log10(lexicon.total + 0.5 * (lexicon.distinct + 1)))))).alias("base_score"), (F.col("times") * (up - F.log10(width))).alias("score"))
    both = whole.unionByName(rare).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), *(F.round(F.sum(c), 9).alias(c) for c in ("base_score", "score")))
    return both.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "n_tokens", "n_known", F.lit(int(lexicon.total)).cast("long").alias("train_tokens"), "base_score", "score")


NAMES = ["row", "doc_id", "word", "times", "n_tokens", "n_known", "base_score", "score"]
