"""Which 64-bit keys occur in two or more texts, found without shuffling texts.

A scan emits, for each haul of documents, one blob of key remainders per
cell of the key space. A cell sees all occurrences of its keys and answers
each haul with the keys that more than one text holds, and how often they
occur. Keys that a sample shows to be in many texts never go to a cell, so no
cell gets a hot key. A key costs four bytes and a part of a byte for its
owner, however many cells there are: a blob has no row per document.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import packed, share, trim, unpacked

#: Occurrences a cell should see.
CELL = 3_000_000
#: Bytes of text whose keys go to the cells together, and keys of a blob: a heap takes many small arrays better than a few large ones.
HAUL, BLOB = 16 << 20, 1 << 16
#: One document in SAMPLE is looked at for hot keys; a key is hot if at least HOT_SHARE of the sampled
#: documents, and HOT_LEAST of them, have it. So there are at most (keys a document) / HOT_SHARE hot keys.
SAMPLE, HOT_SHARE, HOT_LEAST = 32, 1 / 2000, 12
#: Bits of the filter that spares texts a shuffle: 16 an id, in these bounds (16 MB at most).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27


def text_blocks(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes in a column, or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    start, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and (size + n > most or i - start >= 60_000):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def hauls(batches: Iterator[pa.RecordBatch], column: int, most: int | None = None, block: int = 2 << 20) -> Iterator[list[pa.RecordBatch]]:
    """Blocks of all batches of a task, about ``HAUL`` bytes of text at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in text_blocks(batch, column, block):
            held.append(part)
            size += int(pc.sum(pc.binary_length(part.column(column))).as_py() or 0) + 64 * part.num_rows
            if size >= (most or HAUL):
                yield held
                held, size = [], 0
    if held:
        yield held


def mix64(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (the finaliser of MurmurHash3)."""
    x = x.astype("uint64", copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def hot_keys(docs: DataFrame, keys: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sorted keys that many texts hold, from one document in ``SAMPLE``; ``docs`` has (doc_id, data).

    ``keys`` maps texts to (owner, key) arrays without repeats inside a text.
    Equal texts count once. What comes to the driver is bounded by
    ``HOT_SHARE``, not by the number of documents.
    """
    some = docs.filter(F.pmod(F.xxhash64("data", F.lit(5)), F.lit(SAMPLE)) == 0).select("data").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_blocks(batch, 0):
                owner, key = keys(part.column(0))
                found, times = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype("int64")), pa.array(times), pa.array(np.r_[part.num_rows, np.zeros(max(0, len(found) - 1), "int64")][: len(found)])], names=["key", "times", "docs"])

    counts = some.mapInArrow(run, "key long, times long, docs long").groupBy("key").agg(F.sum("times").alias("times"), F.sum("docs").alias("docs"))
    sampled = counts.filter(f"times >= {HOT_LEAST}")
    total = some.count()
    found = sampled.filter(F.col("times") >= HOT_SHARE * total).select("key").toArrow()["key"].to_numpy()
    return np.sort(found.astype("uint64"))


def is_hot(hot: np.ndarray, key: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
    return hot[at] == key


def cell_blobs(key: np.ndarray, cells: int, owner: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
    """For each cell the keys there: 32-bit remainders, and their owners if given (keys then come by owner)."""
    cell = ((key >> np.uint64(32)) % np.uint64(cells)).astype("uint16" if cells <= 1 << 16 else "uint32")
    order = np.argsort(cell, kind="stable")
    low = key[order].astype("<u4")
    who = None if owner is None else owner[order]
    ends = np.cumsum(np.bincount(cell, minlength=cells))
    start = 0
    for c in np.flatnonzero(np.diff(np.r_[0, ends])).tolist():
        end = int(ends[c])
        for at in range(start, end, BLOB):
            stop = min(at + BLOB, end)
            yield c, _blob(low[at:stop], None if who is None else who[at:stop])
        start = end


def _blob(low: np.ndarray, who: np.ndarray | None, *more: np.ndarray) -> bytes:
    """Remainders as they are (they do not compress), then owners, which grow, by their steps."""
    head = np.uint32(len(low)).tobytes() + low.tobytes()
    return head if who is None else head + packed(np.diff(who.astype("int64"), prepend=0).astype("<u4"), *more)


def remainders(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u4", int(np.frombuffer(blob, "<u4", 1)[0]), 4)


def _owners(blob: bytes) -> list[bytes]:
    """Owners and what was packed with them; empty for a blob without."""
    at = 4 + 4 * int(np.frombuffer(blob, "<u4", 1)[0])
    return unpacked(blob[at:]) if at < len(blob) else []


def level_of(texts: np.ndarray) -> np.ndarray:
    """A small number that grows with the number of texts: twice its binary logarithm."""
    return np.minimum(2 * np.log2(np.maximum(texts, 1)), 250).astype("uint8")


def census_cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """Answers to the hauls of one cell; rows with a negative cell are passed on as they are.

    In: (cell, block, blob). Out: (block, cell, blob) with the remainders,
    owners and levels of the keys that occur at least twice. A haul gives a key
    at most once for each text.
    """
    cell = int(pdf["cell"].iloc[0])
    if cell < 0:
        return pd.DataFrame({"block": pdf["block"], "cell": pdf["cell"], "blob": pdf["blob"]})
    blobs_in = pdf["blob"].tolist()
    lows = np.concatenate([remainders(b) for b in blobs_in])
    lows.sort()
    first = np.flatnonzero(np.r_[True, lows[1:] != lows[:-1]])
    times = np.diff(np.r_[first, len(lows)])
    shared, levels = lows[first[times > 1]], level_of(times[times > 1])
    del lows, first, times
    blocks, blobs = [], []
    for block, b in zip(pdf["block"], blobs_in):
        if len(shared):
            low = remainders(b)
            at = np.minimum(np.searchsorted(shared, low), len(shared) - 1)
            hit = shared[at] == low
            if hit.any():
                owned = _owners(b)
                blocks.append(block)
                if owned:
                    who = np.cumsum(np.frombuffer(owned[0], "<u4").astype("int64"))
                    blobs.append(_blob(low[hit], who[hit], levels[at[hit]]))
                else:
                    blobs.append(_blob(np.unique(low[hit]), None))
    trim()
    return pd.DataFrame({"block": np.array(blocks, dtype="int64"), "cell": np.full(len(blocks), cell, "int64"), "blob": blobs})


def open_answer(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders, owners and levels from an answer of ``census_cell`` to keys that came with owners."""
    who, level = _owners(blob)
    return remainders(blob), np.cumsum(np.frombuffer(who, "<u4").astype("int64")), np.frombuffer(level, "uint8")


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bit set that holds every id of a column (and, by chance, others): False means certainly not in.

    It has 16 bits or more an id up to ``MOST_BITS``. A fuller one lets more rows
    through to the exact join behind it, and loses none.
    """
    many = ids.count()
    bits = LEAST_BITS
    while bits < min(16 * many, MOST_BITS):
        bits *= 2
    spot = F.pmod(F.xxhash64(column, F.lit(17)), F.lit(bits))
    parts = ids.select(spot.alias("s")).distinct().groupBy(F.shiftright("s", 15).alias("part")).agg(F.collect_list(F.col("s").bitwiseAND(F.lit(32767)).cast("int")).alias("spots"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for spots in batch.column(1):
                found = np.zeros(32768, bool)
                found[spots.values.to_numpy()] = True
                blobs.append(np.packbits(found).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["part", "bits"])

    out = np.zeros((bits >> 15, 4096), "uint8")
    for r in parts.mapInArrow(pack, "part long, bits binary").collect():  # MOST_BITS >> 15 rows at most
        out[r.part] = np.frombuffer(r.bits, "uint8")
    return out.ravel()


def spot_of(column: str) -> Column:
    """Where ``may_hold`` looks an id up, whatever the size of the filter (sizes are powers of two)."""
    return F.pmod(F.xxhash64(column, F.lit(17)), F.lit(MOST_BITS))


def may_hold(bits: np.ndarray, spots: np.ndarray) -> np.ndarray:
    spots = spots & (8 * len(bits) - 1)
    return (bits[spots >> 3] >> (7 - (spots & 7)) & 1).astype(bool)


def without(docs: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``gone`` (one column of that name, ids distinct).

    The filter lets most rows pass where they are; only those that
    it cannot clear are shuffled to an exact anti join.
    """
    bits = share(docs.sparkSession, id_filter(gone, column))
    columns = docs.columns
    rows = docs.withColumn("_spot", F.when(F.col(column).isNotNull(), spot_of(column)).otherwise(-1))

    def side(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spot = batch.column(batch.num_columns - 1).to_numpy()
                some = (spot >= 0) & may_hold(pickle.loads(bits.value), np.maximum(spot, 0))
                yield batch.filter(pa.array(some == wanted))
                trim()

        return rows.mapInArrow(run, rows.schema).select(*columns)

    return side(False).union(side(True).join(gone, column, "left_anti").select(*columns))
