"""What iterative and size-dependent operators share: written steps and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast.
SMALL = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a plain local session without one gets a folder of its own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="recordloom-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the table written to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows; else Spark deals both sides of a join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
