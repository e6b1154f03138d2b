"""Embedding near-duplicates by an exact metric range join."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import components, share, written

#: Pivots of all groups together, and vectors a pivot at least: the broadcast stays below 4096 vectors.
MAX_PIVOTS, PER_PIVOT = 4096, 1500
#: Rows of one side of a block; larger cells become pairs of blocks.
BLOCK = 4096
TASKS = "array<struct<i:int,j:int,left:boolean,right:boolean>>"


def unit_rows(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector over its length, in double precision; None where it is null, zero, or holds null or non-finite parts."""
    out: list[np.ndarray | None] = [None] * len(column)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    values = pc.fill_null(column.values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    lengths = offsets[1:] - offsets[:-1]
    there = ~column.is_null().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[there]):
        rows = np.flatnonzero(there & (lengths == n))
        if not n:
            continue
        x = values[offsets[rows][:, None] + np.arange(n)]
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        x = x[good] / np.abs(x[good]).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        for k, row in zip(rows[good], x):
            out[k] = row
    return out


def choose_pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """``k`` far-apart rows of a sample: each next one is the farthest from those taken."""
    taken = [0]
    far = 2 - 2 * (sample @ sample[0])
    while len(taken) < min(k, len(sample)):
        nxt = int(far.argmax())
        if far[nxt] < 1e-9:
            break
        taken.append(nxt)
        far = np.minimum(far, 2 - 2 * (sample @ sample[nxt]))
    return sample[taken]


def link_blocks(ids: np.ndarray, left: np.ndarray, right: np.ndarray, x: np.ndarray, threshold: float, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of each left row among the right rows by their weights, and for every row the smallest id it is tied to inside the block."""
    li, ri = np.flatnonzero(left), np.flatnonzero(right)
    link = np.empty((len(li), len(ri)), bool)
    for at in range(0, len(li), 1024):
        link[at : at + 1024] = x[li[at : at + 1024]] @ x[ri].T >= threshold
    link &= ids[li][:, None] != ids[ri][None, :]
    counts = np.zeros(len(ids), "int64")
    counts[li] = link.sum(axis=1) if weight is None else link @ weight[ri]
    root = ids.copy()
    far = np.iinfo("int64").max
    while link.any():
        before = root.copy()
        for at in range(0, len(li), 512):
            part = link[at : at + 512]
            low = np.where(part, root[ri][None, :], far).min(axis=1)
            rows = li[at : at + 512]
            root[rows] = np.minimum(root[rows], low)
        for at in range(0, len(li), 512):
            part = link[at : at + 512]
            rows = li[at : at + 512]
            low = np.where(part, root[rows][:, None], far).min(axis=0)
            root[ri] = np.minimum(root[ri], low)
        if (root == before).all():
            break
    return counts, root


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Links and components of vectors with equal labels and cosine >= ``threshold``: (vec_id, n_links, component_id, kept).

    Unit vectors with that cosine are at most r = sqrt(2 - 2 threshold)
    apart. Equal vectors of a label are one class, which is joined once and
    counts as often as it has vectors. A label with many classes gets pivots; a class belongs to the cell
    of its nearest pivot and is copied to each cell whose border, by the
    triangle inequality applied to the plane between both pivots, is within
    r. Every link is then found in the home cell of each of its ends, and
    cells are joined independently, large ones as pairs of blocks of bounded
    size, however many vectors meet in one ball. A block counts links and
    hands on one edge a class (to the smallest one it is tied to there), never
    its pairs; the components of these edges are those of all links.

    Null labels, and vectors that are null, empty, zero or hold null or
    non-finite parts, link with nothing; so do vectors of different lengths.
    Rows equal in id, label and vector are one vector. Other rows that repeat an
    id are vectors of their own with one component. Rows without an id link with
    nothing and keep a null component. An empty table gives no rows. Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    one = rows.filter("vec_id IS NOT NULL").distinct()

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = unit_rows(batch.column(2))
            ok = [v is not None and lab is not None for v, lab in zip(found, batch.column(1).to_pylist())]
            dims = [len(v) if k else None for v, k in zip(found, ok)]
            data = [v.tobytes() if k else None for v, k in zip(found, ok)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], names=["vec_id", "label", "dim", "unit"])

    clean = written(one.select("vec_id", F.col("label").cast("long"), "embedding").mapInArrow(units, "vec_id long, label long, dim int, unit binary"), "vec-units")
    same = [F.xxhash64("label", "dim", "unit").alias("h1"), F.xxhash64(F.lit(7), "unit", "dim", "label").alias("h2")]
    usable = clean.filter("unit IS NOT NULL").groupBy("label", "dim", "unit").agg(F.count("*").alias("w"))
    # Numbered where they are written, so that numbers stay.
    usable = written(usable.select(F.monotonically_increasing_id().alias("vec_id"), "label", "dim", "unit", "w"), "vec-classes")
    named = clean.filter("unit IS NOT NULL").select(F.col("vec_id").alias("id"), *same).join(usable.select("vec_id", "w", *same), ["h1", "h2"]).select("id", "vec_id", "w")
    named = written(named, "vec-members")
    many = usable.count()
    per_pivot = max(PER_PIVOT, -(-many // MAX_PIVOTS))
    groups = usable.groupBy("label", "dim").count().filter(F.col("count") > per_pivot)
    large = {(r.label, r.dim): r["count"] for r in groups.collect()}  # fewer than MAX_PIVOTS rows
    radius = float(np.sqrt(2 - 2 * threshold)) + 1e-9
    pivots: dict[tuple[int, int], np.ndarray] = {}
    if large:
        draw = F.shiftrightunsigned(F.xxhash64("unit", F.lit(3)), 11) / F.lit(float(1 << 53))
        sample = usable.join(F.broadcast(groups.select("label", "dim")), ["label", "dim"]).filter(draw < 4.0 / per_pivot)
        drawn: dict[tuple[int, int], list] = {}
        for r in sample.select("label", "dim", "unit").collect():
            drawn.setdefault((r.label, r.dim), []).append(bytes(r.unit))
        for key, found in drawn.items():
            x = np.stack([np.frombuffer(u, "float64") for u in sorted(found)])
            pivots[key] = choose_pivots(x, -(-large[key] // per_pivot))

    shared = share(spark, pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = pickle.loads(shared.value)
        apart = {key: np.sqrt(np.maximum(2 - 2 * (p @ p.T), 1e-18)) for key, p in pivots.items()}
        for batch in batches:
            ids, labels, dims, data, weights = (batch.column(k).to_pylist() for k in range(5))
            out: list[tuple] = []
            by_group: dict[tuple[int, int], list[int]] = {}
            for k, key in enumerate(zip(labels, dims)):
                by_group.setdefault(key, []).append(k)
            for key, ks in by_group.items():
                if key not in pivots:
                    out += [(key[0], key[1], 0, True, ids[k], data[k], weights[k]) for k in ks]
                    continue
                p = pivots[key]
                x = np.stack([np.frombuffer(data[k], "float64") for k in ks])
                square = np.maximum(2 - 2 * (x @ p.T), 0)
                home = square.argmin(axis=1)
                border = (square - square[np.arange(len(ks)), home][:, None]) / (2 * apart[key][home])
                near = border <= radius
                near[np.arange(len(ks)), home] = True
                for a, c in zip(*np.nonzero(near)):
                    out.append((key[0], key[1], int(c), bool(c == home[a]), ids[ks[a]], data[ks[a]], weights[ks[a]]))
            if out:
                types = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["label", "dim", "cell", "home", "vec_id", "unit", "w"])

    cells = written(usable.mapInArrow(place, "label long, dim int, cell int, home boolean, vec_id long, unit binary, w long"), "vec-cells")
    key = ["label", "dim", "cell"]
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / BLOCK)).cast("int")
    sizes = cells.groupBy(*key).agg(blocks(F.count(F.when(F.col("home"), 1))).alias("_nh"), blocks(F.count("*")).alias("_nm"))
    spot = F.xxhash64("vec_id")
    dealt = cells.join(sizes, key).withColumn("_i", F.pmod(spot, F.col("_nh")).cast("int")).withColumn("_j", F.pmod(spot, F.col("_nm")).cast("int"))
    # As left row: block _i with every block of the cell; as right row: block _j with every home block.
    lefts = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("_nm") - 1), lambda j: F.struct(F.col("_i").alias("i"), j.alias("j"), F.lit(True).alias("left"), (j == F.col("_j")).alias("right"))))
    rights = F.transform(F.filter(F.sequence(F.lit(0), F.col("_nh") - 1), lambda i: ~F.col("home") | (i != F.col("_i"))), lambda i: F.struct(i.alias("i"), F.col("_j").alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right")))
    tasks = dealt.select(*key, "vec_id", "unit", "w", F.explode(F.concat(F.coalesce(lefts, F.array().cast(TASKS)), rights)).alias("t")).select(*key, "t.*", "vec_id", "unit", "w")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["vec_id"].to_numpy()
        x = np.frombuffer(b"".join(pdf["unit"]), "float64").reshape(len(ids), -1)
        counts, root = link_blocks(ids, pdf["left"].to_numpy(bool), pdf["right"].to_numpy(bool), x, threshold, pdf["w"].to_numpy())
        some = (counts > 0) | (root != ids)
        return pd.DataFrame({"vec_id": ids[some], "links": counts[some], "root": root[some]})

    found = written(tasks.groupBy(*key, "i", "j").applyInPandas(join, "vec_id long, links long, root long"), "vec-links")
    # An id that names vectors of several classes ties them.
    again = named.groupBy("id").agg(F.min("vec_id").alias("low"), F.max("vec_id").alias("high")).filter("low <> high").select("id", "low")
    edges = found.filter("root <> vec_id").select(F.col("vec_id").alias("u"), F.col("root").alias("v")).union(named.join(again, "id").filter("vec_id <> low").select(F.col("vec_id").alias("u"), F.col("low").alias("v")))
    ties = components(edges.distinct(), "vec-components").withColumnRenamed("id", "vec_id")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    found = named.join(links, "vec_id", "left").join(ties, "vec_id", "left")
    found = written(found.select("id", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component")), "vec-found")
    lowest = found.groupBy("component").agg(F.min("id").alias("component_id"))
    out = found.join(lowest, "component").select(F.col("id").alias("vec_id"), "n_links", "component_id")
    # What links with nothing is its own component, unless another row with its id does link.
    alone = clean.filter("unit IS NULL").select("vec_id").join(out.groupBy("vec_id").agg(F.min("component_id").alias("component_id")), "vec_id", "left")
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    nameless = rows.filter("vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).unionByName(nameless).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: DuckDB SQL for distinct ids and finite vectors.
COMPONENTS_SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT reach.id, links.v FROM reach JOIN links ON reach.r = links.u),
low AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
many AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM low LEFT JOIN many ON u = id
"""
