"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import held_out, share, text_bytes, trim
from recordloom.llm.quality_rules import SYMBOLS, UPPER, repeat_words

#: At most so many labelled rows are learnt from; which ones is decided by a hash of their ids.
MAX_LABELLED = 4096
BIGRAMS = 1024
SHAPES = 9
#: Weight of the shape terms beside the byte-pair terms, whose length is 1.
SHAPE_WEIGHT = 1.5
#: Each pair of bytes counts for one of ``BIGRAMS`` terms, by a fixed shuffle.
PAIR_TERM = np.random.default_rng(20).permutation(65536).astype("int32") % BIGRAMS


def terms(text: bytes) -> np.ndarray:
    """The term vector of one whole text: byte pairs (log counts, length 1), then shape shares. Zero without text."""
    out = np.zeros(BIGRAMS + SHAPES, dtype="float32")
    raw = np.frombuffer(text, dtype="uint8").astype("int32")
    if len(raw) > 1:
        found = np.log1p(np.bincount(PAIR_TERM[raw[:-1] * 256 + raw[1:]], minlength=BIGRAMS))
        out[:BIGRAMS] = found / np.sqrt((found * found).sum())
    words = text.split()
    n = len(words)
    if n:
        repeated, distinct = repeat_words(words)
        size = len(text)
        lines = text.split(b"\n")
        symbols = size - len(text.translate(None, SYMBOLS))
        shares = (symbols / size, (size - len(text.translate(None, UPPER))) / size, text.count(b"!!") / n, repeated / n, 1 - distinct / n if n >= 20 else 0.0, text.count(b"|") / n, 1 - len(set(lines)) / len(lines), (size - len(text.translate(None, b"0123456789"))) / size, min(size / n, 40.0) / 40)
        out[BIGRAMS:] = SHAPE_WEIGHT * np.sqrt(np.clip(shares, 0, 1))
    return out


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest values of each row; of equal ones at the border the first columns."""
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    border = np.take_along_axis(cosine, near, axis=1).min(axis=1, keepdims=True)
    for i in np.flatnonzero((cosine >= border).sum(axis=1) > k):
        near[i] = np.argsort(-cosine[i], kind="stable")[:k]
    return near


class NeighbourVote:
    """Labelled vectors in a latent space, and the vote of the nearest ones.

    The space is spanned by the leading right singular vectors of the
    labelled term matrix after inverse-document-frequency weights.
    """

    def __init__(self, matrix: np.ndarray, labels: np.ndarray, dims: int = 64, neighbours: int = 15, sharpness: float = 24.0):
        self.neighbours, self.sharpness = neighbours, sharpness
        seen = (matrix[:, :BIGRAMS] > 0).sum(axis=0)
        self.weight = np.ones(BIGRAMS + SHAPES, dtype="float32")
        self.weight[:BIGRAMS] = np.log((1 + len(matrix)) / (1 + seen)) + 0.3
        x = (matrix * self.weight).astype("float64")
        _, vectors = np.linalg.eigh(x.T @ x)
        self.basis = np.ascontiguousarray(vectors[:, ::-1][:, :dims]).astype("float32")
        self.labels = labels.astype("float32")
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.known = self.project(matrix)

    def project(self, matrix: np.ndarray) -> np.ndarray:
        z = (matrix * self.weight) @ self.basis
        norm = np.sqrt((z * z).sum(axis=1, keepdims=True))
        return np.divide(z, norm, out=np.zeros_like(z), where=norm > 0)

    def score(self, matrix: np.ndarray, block: int = 512) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors; the prior for a zero vector."""
        out = np.full(len(matrix), self.prior)
        k = min(self.neighbours, len(self.known))
        for at in range(0, len(matrix) if k else 0, block):
            z = self.project(matrix[at : at + block])
            cosine = z @ self.known.T
            near = nearest(cosine, k)
            best = np.take_along_axis(cosine, near, axis=1).astype("float64")
            vote = np.exp(self.sharpness * (best - best.max(axis=1, keepdims=True)))
            share = (vote * self.labels[near]).sum(axis=1) / vote.sum(axis=1)
            filled = z.any(axis=1)
            out[at : at + block][filled] = share[filled]
        return out


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, max_labelled: int = MAX_LABELLED) -> NeighbourVote:
    """Learns from labelled documents outside the held-out fold, ``max_labelled`` at most.

    Ids that are null, lie in the held-out fold or carry contradicting labels
    are not learnt from. Of rows that repeat a labelled id one is learnt from,
    the same in each run. Other columns, of any names, are ignored. Without any
    labelled row every score is 0.5.
    """
    marks = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    marks = marks.filter((F.col("low") == F.col("high")) & ~held_out(F.col("_id"), folds, fold))
    chosen = marks.orderBy(F.xxhash64("_id", F.lit(7)), "_id").limit(max_labelled).select("_id", F.col("low").cast("int").alias("_label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(t.as_py()).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["id", "label", "terms"])

    # ``max_labelled`` small rows at most.
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), text_bytes(F.col("text")).alias("_data"))
    rows = texts.join(F.broadcast(chosen), "_id").select("_id", "_label", "_data").mapInArrow(run, "id long, label int, terms binary")
    found = sorted(rows.groupBy("id", "label").agg(F.min("terms").alias("terms")).collect(), key=lambda r: r.id)
    matrix = np.frombuffer(b"".join(r.terms for r in found), dtype="float32").reshape(-1, BIGRAMS + SHAPES)
    return NeighbourVote(matrix, np.array([r.label for r in found], dtype="float32"))


def classify(docs: DataFrame, model: NeighbourVote, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted) for every document, from its whole text alone.

    The labelled vectors (``MAX_LABELLED`` at most) are broadcast; a block of
    documents at a time is multiplied with all of them. No shuffle. Null or
    empty text scores the share of label 1 among the labelled rows. Repeated rows score
    alike; of neighbours that are equally near at the border of the vote those with the
    smaller ids count; an empty table gives no rows. Other columns, of any names, are ignored.
    """
    shared = share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vote = pickle.loads(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                matrix = np.stack([terms(t.as_py()) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vote.score(matrix))], names=["doc_id", "score"])

    rows = docs.select("doc_id", text_bytes(F.col("text")).alias("data")).mapInArrow(run, "doc_id long, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: NeighbourVote, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose whole text scores ``threshold`` or more, with all their columns."""
    shared = share(docs.sparkSession, model)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vote = pickle.loads(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                matrix = np.stack([terms(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in part.column(text)])
                kept = part.filter(pa.array(vote.score(matrix) >= threshold))
                if kept.num_rows:
                    yield kept
            trim()

    return docs.mapInArrow(run, docs.schema)
