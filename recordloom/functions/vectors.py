"""Vector and hashing functions (VEC1-4, 7, 8, 10)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import canonical_lines


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine within [-1, 1]; 0 for empty vectors, different lengths or a zero length (VEC1)."""
    scale = norm(a) * norm(b)
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(scale, F.lit(0.0))))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (scale > 0), value).otherwise(F.lit(0.0))


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def fit_dim(v: Column, dim: int) -> Column:
    """Cut or zero-padded to ``dim`` (VEC4)."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), dim)), 1, dim)


def as_stored(v: Column) -> Column:
    """What a six-decimal text form keeps of a vector (VEC7)."""
    return F.transform(v, lambda x: F.round(x.cast("double"), 6))


def hash_tokens(text: str) -> list[str]:
    """Words and the 2- and 3-grams of the text without blanks."""
    tight = "".join(text.split())
    return text.split() + [tight[i : i + n] for n in (2, 3) for i in range(len(tight) - n + 1)]


def hash_vector(text: str, dim: int) -> np.ndarray:
    """Signed feature hashing by 8 bytes of BLAKE2b, length 1; zero for no tokens."""
    v = np.zeros(dim)
    for t in hash_tokens(text):
        h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
        v[h % dim] += 1.0 if h & 1 else -1.0
    n = np.sqrt((v * v).sum())
    return v / n if n else v


def hashing_embedder(dim: int = 256):
    """The default provider: an Arrow UDF from normalised text to a vector (VEC3). Null and empty text give null."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: hash_vector(t, dim) if t else None, na_action="ignore")

    return embed


def model_embedder(load, dim: int):
    """A provider from any model (VEC5, VEC6): ``load()`` runs once a task and returns texts -> matrix. A failing model raises; there are no zero vectors."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            rows = np.asarray(model(texts.fillna("").tolist()), dtype="float64")
            if rows.shape != (len(texts), dim):
                raise ValueError(f"the model returned {rows.shape}, not {(len(texts), dim)}")
            yield pd.Series(list(rows))

    return embed


def embedding_inputs(items: DataFrame, attributes: str = "attributes") -> DataFrame:
    """(id, kind, content): TEXT for every item, ATTRIBUTES where at least two attribute lines exist (VEC8)."""
    lines = canonical_lines(F.col(attributes))
    text = items.select("id", F.lit("TEXT").alias("kind"), F.col("normalized_text").alias("content"))
    attrs = items.select("id", F.lit("ATTRIBUTES").alias("kind"), lines.alias("content")).filter(F.size(F.split("content", "\n")) >= 2)
    return text.unionByName(attrs)


def zero_shot(similarities: DataFrame, key: str, code: str, sim: str, z: float = 1.8, margin: float = 0.25, least: float = 0.35, prototypes: int = 3) -> DataFrame:
    """The best prototype of each key, if it stands out; else null (VEC10).

    It must be ``z`` population deviations above the mean, ``margin`` deviations
    above the runner-up and ``least`` at all, among ``prototypes`` or more.
    """
    stats = similarities.groupBy(key).agg(
        F.avg(sim).alias("mean"), F.stddev_pop(sim).alias("sd"), F.count(sim).alias("n"),
        F.max(F.struct(F.col(sim), F.col(code))).alias("best"),
        # One similarity a prototype: as many as there are categories.
        F.slice(F.sort_array(F.collect_list(sim), asc=False), 2, 1).alias("two"),
    )
    sd = F.nullif(F.when(F.col("sd") > 1e-9, F.col("sd")), F.lit(0.0))
    best = F.col("best")[sim]
    ok = (F.col("n") >= prototypes) & ((best - F.col("mean")) / sd >= z) & ((best - F.col("two")[0]) / sd >= margin) & (best >= least)
    return stats.select(key, F.when(F.coalesce(ok, F.lit(False)), F.col("best")[code]).alias("guess"), best.alias("similarity"))
