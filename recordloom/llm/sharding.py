"""Sharding by sampled splitters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import text_bytes, written

#: Fine ranges a shard: the sample draws that many keys for each shard, so its size is bounded by shards, not rows.
OVERSAMPLE = 64
#: A range with more than so many times the mean of a range is cut again.
OVERFULL = 4.0
#: Rows that share one key are placed in parts of about so many.
PART = 500_000
#: The highest key.
LAST = (1 << 63) - 1


def _range_of(splitters: np.ndarray):
    @F.pandas_udf("int")
    def find(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, key.to_numpy(dtype="int64"), side="right").astype("int32"))

    return find


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """Deals documents to ``shards`` shards of near equal bytes: (doc_id, size, text_crc32, shard, slot).

    The key of a row is a hash of its text with a hash of its id in the low 24
    bits: equal texts are neighbours, and even a third of all rows with one
    text has many keys. A sample of keys weighted by the bytes of their rows gives
    quantile boundaries, with a range of its own for a key that fills one;
    ranges that turn out overfull are sampled and cut again until none is left
    that holds more than one key. A range that lies inside one shard's quantiles
    goes there as a whole; only in the ranges on a boundary the running sum of
    bytes tells rows apart, so a shard misses the mean by one document at most.
    The totals of the final ranges (a few thousand numbers, whatever the input)
    come to the driver. Rows are numbered by a window inside each range; a range
    of one key with very many rows is numbered in parts.

    Groups: equal texts have one hash, so they are neighbours in the order, but
    the law is ``bytes``: a group whose bytes cross a boundary is split there, as
    it must be where it holds more than a shard's share.

    Null text: no bytes (size ``overhead``), crc32 of the empty string. Repeated rows are
    separate rows. Empty table: no rows. Reruns agree, since sample and order
    come from hashes and ids; rows equal in id and text are interchangeable.
    Other columns are ignored.
    """
    data = text_bytes(F.col("text"))
    key = F.xxhash64("text").bitwiseAND(F.lit(~0xFFFFFF)).bitwiseOR(F.xxhash64("doc_id").bitwiseAND(F.lit(0xFFFFFF)))
    narrow = written(docs.select("doc_id", (F.octet_length(data) + overhead).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), key.alias("_key"), F.monotonically_increasing_id().alias("_row")), "shard-docs")
    # Rows that share a key cannot be parted, so keys are drawn by the bytes of all their rows.
    keys = written(narrow.groupBy("_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-keys")
    total = keys.agg(F.sum("bytes").alias("bytes")).first().bytes or 0
    ranges = shards * OVERSAMPLE

    def drawn(some: DataFrame, salt: int, rate: float) -> set[int]:
        draw = F.shiftrightunsigned(F.xxhash64("_key", F.lit(salt)), 11) / F.lit(float(1 << 53))
        return {r._key for r in some.filter(draw < F.col("bytes") * rate).select("_key").collect()}

    splitters: list[int] = []
    if total:
        # A key of a whole range's bytes gets a range of its own; there are ``ranges`` of them at most.
        heavy = {r._key for r in keys.filter(F.col("bytes") * ranges >= total).select("_key").collect()}
        splitters = sorted(drawn(keys, 11, ranges / total) | heavy | {k + 1 for k in heavy if k < LAST})
    turn = 0
    while True:
        dealt = keys.withColumn("_range", _range_of(np.array(splitters, dtype="int64"))("_key"))
        found = dealt.groupBy("_range").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("_key").alias("low"), F.max("_key").alias("high")).collect()
        over = [r for r in found if r.bytes > OVERFULL * total / ranges and r.low < r.high]
        if not over:
            break
        # The highest key of a range is always a new splitter, so each turn cuts each overfull range.
        again = dealt.filter(F.col("_range").isin([r._range for r in over]))
        splitters = sorted(set(splitters) | drawn(again, 101 + turn, 2.0 * ranges / total) | {r.high for r in over})
        turn += 1
    spark = docs.sparkSession
    # Few ranges have more rows of one key than a part.
    wide = {r._range: -(-r.rows // PART) for r in found if r.low == r.high and r.rows > PART}
    dealt = narrow.withColumn("_range", _range_of(np.array(splitters, dtype="int64"))("_key"))
    if wide:
        parts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for item in wide.items() for x in item]), F.col("_range")), F.lit(1))
        dealt = dealt.withColumn("_part", F.pmod(F.col("_row"), parts).cast("int"))
    else:
        dealt = dealt.withColumn("_part", F.lit(0))
    totals = sorted(tuple(r) for r in (dealt.groupBy("_range", "_part").agg(F.sum("size"), F.count("*")).collect() if wide else [(r._range, 0, r.bytes, r.rows) for r in found]))
    at_bytes, at_rows, rows = 0, 0, []
    for k, part, many_bytes, many_rows in totals:
        first, last = (min(shards - 1, at * shards // total) for at in (at_bytes, at_bytes + many_bytes))
        rows.append((k, part, at_bytes, at_rows, first, last))
        at_bytes, at_rows = at_bytes + many_bytes, at_rows + many_rows
    places = spark.createDataFrame(rows, "_r int, _p int, _bytes long, _rows long, _first int, _last int")
    inside = Window.partitionBy("_range", "_part").orderBy("_key", "doc_id", "text_crc32", "size")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    dealt = dealt.withColumn("_upto", upto).withColumn("_rn", F.row_number().over(inside))
    # One row a range or part, whose number is bounded by a multiple of shards * OVERSAMPLE and by rows over PART.
    dealt = dealt.join(F.broadcast(places), (F.col("_range") == F.col("_r")) & (F.col("_part") == F.col("_p")))
    middle = F.col("_bytes") + F.col("_upto") - F.col("size") / 2
    cut = F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards / total if total else 0.0))).cast("int")
    dealt = dealt.withColumn("shard", F.when(F.col("_first") == F.col("_last"), F.col("_first")).otherwise(cut))
    dealt = written(dealt.select("doc_id", "size", "text_crc32", "shard", (F.col("_rows") + F.col("_rn") - 1).alias("_at")), "shard-rows")
    first = dealt.groupBy("shard").agg(F.min("_at").alias("_start"))
    # One row a shard.
    return dealt.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_at") - F.col("_start")).alias("slot"))

