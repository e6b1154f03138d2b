"""Record, location and master-data sources (SRC1-SRC4, SRC16-SRC18, SRC20)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.dictionary import alias_table
from recordloom.operators.steps import settled, small

#: Bytes of an uploaded image at most (SRC20).
IMAGE_BYTES = 8 << 20


def parquet(spark: SparkSession, folder: str, name: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder}/{name}.parquet")


def ancestors(tree: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """(id, ancestors nearest first, depth) of every node of a forest (SRC3, JN4).

    One join a level of the tree, on keys; each level is written. A cycle raises.
    """
    nodes = settled(tree.select(F.col(key).alias("id"), F.col(parent).alias("parent")))
    up = nodes.select(F.col("id").alias("parent"), F.col("parent").alias("next"))
    done = nodes.filter("parent IS NULL").select("id", F.array().cast(f"array<{dict(nodes.dtypes)['id']}>").alias("ancestors"))
    open_ = nodes.filter("parent IS NOT NULL").select("id", F.array("parent").alias("ancestors"), "parent")
    while True:
        step = settled(open_.join(up, "parent", "left"))
        done = done.unionByName(step.filter("next IS NULL").select("id", "ancestors"))
        open_ = step.filter("next IS NOT NULL")
        left = open_.agg(F.count("*").alias("n"), F.count_if(F.array_contains("ancestors", F.col("next"))).alias("round")).first()
        if left["round"]:
            raise ValueError(f"{left['round']} nodes are on or below a cycle")
        if not left.n:
            return done.withColumn("depth", F.size("ancestors"))
        open_ = open_.select("id", F.concat("ancestors", F.array("next")).alias("ancestors"), F.col("next").alias("parent"))


def bundles(records: DataFrame, attributes: DataFrame, locations: DataFrame, reports: DataFrame) -> DataFrame:
    """Records with their attributes, distinctive marks, location and report times as one row (SRC2, JN1).

    ``reports`` has (id, at, start_at, end_at, location_id); open ends fall back to ``at``.
    """
    rows = attributes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "code", "value", "source", "confidence", "is_secret"))).alias("_a"))
    own = F.transform(F.coalesce("_a", F.array()), lambda a: F.struct(a["code"].alias("code"), a["value"].alias("value"), a["source"].alias("source"), a["confidence"].alias("confidence"), a["is_secret"].alias("is_secret"), a["ordinal"].alias("ordinal")))
    place = locations.select(F.col("id").alias("location_id"), F.struct("id", "name", "ancestors", "lat", "lon").alias("location"))
    out = records.join(rows, "id", "left").join(reports, "id", "left").join(place, "location_id", "left")
    return out.withColumns({
        "attributes": F.filter(own, lambda a: a["code"] != "distinctive"),
        "distinctive": F.transform(F.filter(own, lambda a: a["code"] == "distinctive"), lambda a: a["value"]),
        "start_at": F.coalesce("start_at", "at"), "end_at": F.coalesce("end_at", "at"),
    }).drop("_a", "at", "location_id")


def demo_records(spark: SparkSession, categories: list[str], products: list[tuple[str, str, str]], locations: list[str]) -> DataFrame:
    """Synthetic found records: every category with every (color, kind, feature), locations in turn (SRC16)."""
    c = spark.createDataFrame([(i, x) for i, x in enumerate(categories)], "ci int, category string")
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(products)], "pi int, color string, kind string, feature string")
    names = F.array(*[F.lit(x) for x in locations])
    # Both tables are literals of the caller.
    rows = c.crossJoin(small(p)).withColumn("n", F.col("pi") * len(categories) + F.col("ci"))
    return rows.select(F.format_string("demo-%05d", "n").alias("id"), "category", F.concat_ws(" ", F.lit("a"), "color", "kind", F.lit("with"), "feature").alias("raw_description"), F.element_at(names, (F.pmod("n", F.lit(len(locations))) + 1).cast("int")).alias("location_name"))


def seeded(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Master data with the rows it lacks; what is there stays (SRC17, SRC18)."""
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(*old.columns))


def synonyms(spark: SparkSession, sections: Mapping[str, Mapping[str, tuple[str, ...]]]) -> DataFrame:
    """All dictionary sections as (section, alias, canonical) (SRC4, NRM2)."""
    out = None
    for name, section in sections.items():
        one = alias_table(spark, section).select(F.lit(name).alias("section"), "alias", "canonical")
        out = one if out is None else out.unionByName(one)
    return out


def image_kind(content: Column) -> Column:
    """The kind of an image from its first bytes; null for anything else."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpg").when(head.startswith("52494646") & head.endswith("57454250"), "webp")


def images(spark: SparkSession, folder: str, most: int = IMAGE_BYTES) -> DataFrame:
    """Images of the allowed kinds and size, named by the hash of their bytes (SRC20). What a file is called does not count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    found = files.filter(F.col("length") <= most).withColumn("kind", image_kind(F.col("content"))).filter("kind IS NOT NULL")
    return found.select(F.concat(F.sha2("content", 256), F.lit("."), "kind").alias("name"), "path", "length", "content")
