"""What the operators of this subpackage share: inputs, scratch tables, graph components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a longest run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of rows that go to a Python worker at a time.
BATCH_BYTES = "8m"


def small_batches(spark: SparkSession) -> None:
    """Limits Arrow batches by bytes: ten thousand texts at a time would take up the memory beside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, through Spark's reader (any file system it knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share for written intermediate tables.

    ``spark.checkpoint.dir`` names it. Only a local session without that
    setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="recordloom-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder as Parquet and read back.

    This cuts the lineage: a lost executor costs the running stage, not what
    came before it. The reader keeps no link to the original plan.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def share(spark: SparkSession, model: object) -> Broadcast[bytes]:
    """A model for all executors, pickled with its class; ``pickle.loads(shared.value)`` gives it back."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def trim() -> None:
    """Gives memory that a worker has freed back to the system, so that an idle worker is a small one."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def in_batches(rows: Iterable[tuple], types: list[pa.DataType], names: list[str], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is a blob, as batches of about ``most`` bytes, so that neither side holds a large one."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) + 32
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def packed(*parts: np.ndarray) -> bytes:
    """Columns as one compressed blob: their sizes in bytes, then their bytes."""
    data = b"".join(p.tobytes() for p in parts)
    return np.array([len(parts), *(p.nbytes for p in parts)], "<u4").tobytes() + pa.Codec("zstd", compression_level=4).compress(data, asbytes=True)


def unpacked(blob: bytes) -> list[bytes]:
    """The bytes of each column of ``packed``."""
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    sizes = np.frombuffer(blob, "<u4", n, 4).tolist()
    data = pa.decompress(blob[4 + 4 * n :], decompressed_size=sum(sizes), codec="zstd", asbytes=True) if sum(sizes) else b""
    ends = np.cumsum([0, *sizes]).tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def text_bytes(text: Column) -> Column:
    """The text as UTF-8 bytes, null as none."""
    return F.coalesce(text.cast("binary"), F.lit(b"").cast("binary"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges`` (u long, v long): (id, component), the smallest id of each.

    Large-star and small-star steps (Kiveris et al., "Connected components in
    MapReduce and beyond") until the edges are a star around each minimum. A
    round costs two joins on the edge list; hubs are split by AQE because the
    per-node minimum is aggregated before it is joined back. Ids that occur in
    no edge have no row. Self loops are allowed.
    """
    spark = edges.sparkSession
    nodes = None
    current = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = None
    while True:
        state = current.filter("u <> v").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state.n, state.h) == before or state.n == 0:
            break
        before = (state.n, state.h)
        if nodes is None:
            nodes = current
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        current = written(small.filter("u <> v").distinct(), name)
    star = current.filter("u <> v").select(F.col("u").alias("id"), F.col("v").alias("component"))
    ends = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct() if nodes is None else written(nodes.select(F.explode(F.array("u", "v")).alias("id")).distinct(), name)
    return ends.join(star, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def ranked(df: DataFrame, group: list[str], order: list[Column], rows: int, name: str, spread: list[Column], per_bucket: int = 200_000) -> DataFrame:
    """Adds ``rank`` (long, from 0, gapless) within ``group``, without a task that holds a whole hot group.

    Rows are dealt to hash buckets of ``spread`` inside each group; each bucket
    is numbered by a window, and a running sum over the bucket counts places it.
    """
    buckets = max(64, -(-rows // per_bucket))
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*group, "_b").count()
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = written(counts.select(*group, "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base")), name)
    inside = Window.partitionBy(*group, "_b").orderBy(*order)
    return dealt.withColumn("_rn", F.row_number().over(inside)).join(base, [*group, "_b"]).withColumn("rank", F.col("_base") + F.col("_rn") - 1).drop("_b", "_rn", "_base")
