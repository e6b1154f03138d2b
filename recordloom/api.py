"""The service surface as a library: what an application does with records, as calls on tables in a folder.

Each table is Parquet under ``root``. Where rows change, a write makes the
table's next state from its last one and the new rows (``operators.store``) in a
new version folder, and then names that version current. Where rows are only
added, they go to a folder of their own beside the current ones; many small
folders are written together once in a while. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.config import FUNNEL, LOST_FOUND, RULES, SYNONYMS
from recordloom.functions import vectors as V
from recordloom.operators import evaluate, extract, matching, retrieval, store
from recordloom.operators.steps import settled
from recordloom.schema import ATTRIBUTE, DECISIONS, LOCATION

RECORDS = (
    "id string, record_type string, status string, category string, category_candidates array<string>, category_uncertain boolean, brand string,"
    f" model string, raw_description string, normalized_text string, created_at timestamp, version int, attributes array<{ATTRIBUTE}>,"
    f" distinctive array<string>, location {LOCATION}, start_at timestamp, end_at timestamp"
)
TABLES = {
    "records": RECORDS,
    "vectors": "id string, kind string, provider string, model string, version string, content_hash string, embedding array<double>, status string",
    "candidates": "lost_id string, found_id string, final_score double, base_score double, penalty double, bonus double, confidence double, level string, action string, explanation string, status string, created_at timestamp",
    "evidence": "lost_id string, found_id string, evidence_type string, field_name string, similarity_score double, reliability double, weight double, contribution double, is_conflict boolean, severity string",
    "decisions": "lost_id string, found_id string, decision string, decided_at timestamp, note string",
    "returns": "lost_id string, found_id string, returned_at timestamp",
    "images": "id string, url string, is_primary boolean",
    "runs": "run_id string, trigger string, config string, at timestamp",
}

#: Folders that a table may have before they are written as one.
FOLDERS = 64


class Engine:
    """Records, matches and decisions under one folder, with one embedding model."""

    def __init__(self, spark: SparkSession, root: str, dim: int = 256, synonyms: Mapping = SYNONYMS):
        self.spark, self.root, self.dim, self.synonyms = spark, root.rstrip("/"), dim, synonyms
        self.embed = V.hashing_embedder(dim)
        self.model = f"hashing-{dim}"

    # ---- tables

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def table(self, name: str) -> DataFrame:
        """The current state of a table; empty before its first write."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/CURRENT")
        if not self._fs().exists(path):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.root}/{name}/{v}" for v in self._versions(name)])

    def _versions(self, name: str) -> list[str]:
        """The folders that hold the table now."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/CURRENT")
        return [r.value for r in self.spark.read.text(str(path)).collect()] if self._fs().exists(path) else []

    def _write(self, name: str, rows: DataFrame, beside: bool = False) -> None:
        """The table's next state, or with ``beside`` rows that are added to it."""
        before = self._versions(name) if beside else []
        if len(before) >= FOLDERS:
            rows, before = self.table(name).unionByName(rows.select(*self._columns(name))), []
        version = uuid.uuid4().hex
        rows.select(*self._columns(name)).write.parquet(f"{self.root}/{name}/{version}")
        jvm = self.spark.sparkContext._jvm
        out = self._fs().create(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/CURRENT"), True)
        out.write(bytearray("\n".join([*before, version]).encode()))
        out.close()

    def _columns(self, name: str) -> list[str]:
        return self.spark.createDataFrame([], TABLES[name]).columns

    # ---- records

    def understand(self, texts: DataFrame, column: str = "raw_description") -> DataFrame:
        """What a description says, without storing anything."""
        return extract.normalized(texts, column, self.synonyms)

    def register(self, rows: DataFrame) -> DataFrame:
        """Stores new records (id, record_type, raw_description and any other record column), embeds and matches them both ways."""
        # What follows reads this several times, and the plan need not carry the dictionaries each time.
        fresh = settled(self.understand(rows.drop("category", "brand", "model", "attributes", "distinctive")))
        manual = rows.select("id", *[F.col(c).alias(f"_m_{c}") for c in ("category", "brand", "model", "attributes", "distinctive") if c in rows.columns])
        fresh = fresh.join(manual, "id")
        for c in ("category", "brand", "model"):
            if f"_m_{c}" in fresh.columns:
                fresh = fresh.withColumn(c, F.coalesce(f"_m_{c}", c))
        if "_m_attributes" in fresh.columns:
            fresh = fresh.withColumn("attributes", F.concat(F.coalesce("_m_attributes", F.array().cast(f"array<{ATTRIBUTE}>")), "attributes"))
        if "_m_distinctive" in fresh.columns:
            fresh = fresh.withColumn("distinctive", F.concat(F.coalesce("_m_distinctive", F.array().cast("array<string>")), "distinctive"))
        kinds = dict(self.spark.createDataFrame([], RECORDS).dtypes)
        defaults = {"status": F.lit("ACTIVE"), "created_at": F.current_timestamp(), "version": F.lit(1)}
        for c in kinds:
            if c not in fresh.columns:
                fresh = fresh.withColumn(c, defaults.get(c, F.lit(None)))
        fresh = fresh.select(*[F.col(c).cast(t).alias(c) if "<" not in t else F.col(c).alias(c) if c in rows.columns or c in ("attributes", "distinctive", "category_candidates") else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
        self._write("records", store.upsert(self.table("records"), fresh, ["id"]))
        ids = rows.select("id")
        self.refresh_vectors(ids)
        return self.rematch(ids, "REGISTERED")

    def item(self, ids: DataFrame) -> DataFrame:
        """Records as others may see them."""
        return self.table("records").join(ids, "id", "left_semi").withColumn("attributes", extract.visible(F.col("attributes")))

    def refresh_vectors(self, ids: DataFrame | None = None) -> None:
        """Embeds texts whose content has changed since they were embedded."""
        records = self.table("records")
        records = records if ids is None else records.join(ids, "id", "left_semi")
        rows = records.select("id", F.lit("TEXT").alias("kind"), F.lit("builtin").alias("provider"), F.lit(self.model).alias("model"), F.lit("1").alias("version"), V.content_hash(F.col("normalized_text")).alias("content_hash"), F.col("normalized_text").alias("_t"), F.lit("ACTIVE").alias("status"))
        old = self.table("vectors")
        keys = ["id", "kind", "model", "version"]
        new = store.changed(rows, old, keys).withColumn("embedding", self.embed("_t")).drop("_t")
        self._write("vectors", store.upsert(old, new.select(*old.columns), keys))

    # ---- matching

    def _vectors(self, records: DataFrame) -> DataFrame:
        """The active text vectors of the model in use (VEC9)."""
        mine = (F.col("status") == "ACTIVE") & (F.col("model") == self.model) & (F.col("kind") == "TEXT")
        return self.table("vectors").filter(mine).join(records.select("id"), "id", "left_semi")

    def _search(self, queries: DataFrame, target: str, vectors: DataFrame) -> DataFrame:
        pool = retrieval.base_pool(self.table("records"), target, None)
        own = self._vectors(pool)
        return retrieval.hybrid(queries, pool, own, vectors)

    def search(self, texts: DataFrame, target: str = "FOUND", top_k: int = 10, include_low: bool = False) -> DataFrame:
        """Ad-hoc search: (query_id, raw_description) to ranked records; nothing is stored."""
        asked = settled(self.understand(texts.withColumnRenamed("query_id", "id")))
        queries = asked.select(F.col("id").alias("query_id"), "category", F.col("normalized_text").alias("query_text"))
        vectors = asked.select(F.col("id").alias("query_id"), self.embed("normalized_text").alias("embedding"))
        found = settled(self._search(queries, target, vectors))
        kinds = dict(self.spark.createDataFrame([], RECORDS).dtypes)
        other = "LOST" if target == "FOUND" else "FOUND"
        mine = asked.select(*[F.lit(other).alias(c) if c == "record_type" else F.col(c).alias(c) if c in asked.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
        return matching.search_view(matching.run_matching(found, self.table("records").unionByName(mine)), top_k, include_low)

    def rematch(self, ids: DataFrame, trigger: str = "MANUAL") -> DataFrame:
        """Matches stored records against the other type, and stores candidates, evidence and the run."""
        records = self.table("records")
        out = None
        for kind, target in (("LOST", "FOUND"), ("FOUND", "LOST")):
            mine = records.join(ids, "id", "left_semi").filter(F.col("record_type") == kind)
            queries = mine.select(F.col("id").alias("query_id"), "category", F.col("normalized_text").alias("query_text"))
            vectors = self._vectors(mine).select(F.col("id").alias("query_id"), "embedding")
            part = matching.run_matching(settled(self._search(queries, target, vectors)), records)
            lost, found = ("query_id", "id") if kind == "LOST" else ("id", "query_id")
            part = part.withColumns({"lost_id": F.col(lost), "found_id": F.col(found)})
            out = part if out is None else out.unionByName(part)
        rows = settled(out.drop("lost", "found").dropDuplicates(["lost_id", "found_id"]).withColumns({"status": F.lit("NEW"), "created_at": F.current_timestamp()}))
        keys = ["lost_id", "found_id"]
        self._write("candidates", store.upsert(self.table("candidates"), rows.select(*self._columns("candidates")), keys, ["status", "created_at"]))
        parts = rows.select(*keys, F.explode("evidence").alias("e")).select(*keys, "e.*")
        self._write("evidence", store.replace_by(self.table("evidence"), parts, keys))
        run = self.spark.createDataFrame([(uuid.uuid4().hex, trigger, json.dumps({"model": self.model}))], "run_id string, trigger string, config string").withColumn("at", F.current_timestamp())
        self._write("runs", run, beside=True)
        return self.table("candidates")

    def matches(self, ids: DataFrame, least: float = 50.0, limit: int = 20) -> DataFrame:
        return matching.match_list(self.table("candidates"), self.table("evidence"), ids, least, limit)

    def explanation(self, ids: DataFrame) -> DataFrame:
        return matching.stored_explanation(self.matches(ids, 0.0))

    # ---- images

    def add_images(self, rows: DataFrame, model: str) -> None:
        """Images of records (id, url, is_primary, embedding) with their vectors by an image model; an image replaces itself."""
        self._write("images", store.upsert(self.table("images"), rows.select("id", "url", "is_primary"), ["id", "url"]))
        made = rows.select("id", F.lit("IMAGE").alias("kind"), F.lit("image").alias("provider"), F.lit(model).alias("model"), F.col("url").alias("version"), V.content_hash(F.col("url")).alias("content_hash"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit("ACTIVE").alias("status"))
        self._write("vectors", store.upsert(self.table("vectors"), made, ["id", "kind", "model", "version"]))

    def search_images(self, queries: DataFrame, model: str, k: int = 20) -> DataFrame:
        """Active records by the similarity of their images to query vectors (query_id, embedding) of an image or of a text."""
        own = self.table("vectors").filter((F.col("kind") == "IMAGE") & (F.col("model") == model) & (F.col("status") == "ACTIVE"))
        # Each record by its nearest image: the best ``k`` records have one among so many images.
        most = own.groupBy("id").count().agg(F.max("count")).first()[0] or 1
        found = retrieval.image_search(queries, own.select("id", "embedding"), self.table("records"), self.table("images"), k * most)
        best = found.groupBy("query_id", "id").agg(F.max("similarity").alias("similarity"), F.first("image_url").alias("image_url"))
        return retrieval.top(best, ["query_id"], [F.col("similarity").desc(), F.col("id")], k)

    # ---- decisions

    def decide(self, rows: DataFrame) -> DataFrame:
        """Decisions (lost_id, found_id, decision, note); unknown ones are refused. Returns the candidates with their status."""
        wrong = rows.filter(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)))
        if not wrong.isEmpty():
            raise ValueError(f"a decision is one of {', '.join(DECISIONS)}")
        rows = rows.withColumn("decided_at", F.current_timestamp()).withColumn("note", F.col("note") if "note" in rows.columns else F.lit(None).cast("string"))
        self._write("decisions", rows, beside=True)
        self._write("candidates", store.decide(self.table("candidates"), self.table("decisions")).select(*self._columns("candidates")))
        self._write("records", store.record_status(self.table("records"), self.table("candidates"), self.table("returns")))
        return self.table("candidates")

    def give_back(self, rows: DataFrame) -> None:
        """Both records of each pair are returned."""
        self._write("returns", rows.select("lost_id", "found_id").withColumn("returned_at", F.current_timestamp()), beside=True)
        self._write("records", store.record_status(self.table("records"), self.table("candidates"), self.table("returns")))

    def secret_questions(self, ids: DataFrame) -> DataFrame:
        """(id, code) of the secrets that an owner may be asked for."""
        return self.table("records").join(ids, "id", "left_semi").select("id", F.explode("attributes").alias("a")).filter("a.is_secret").select("id", "a.code")

    def verify_secret(self, answers: DataFrame) -> DataFrame:
        """(id, verified) for rows of (id, answers: code -> value)."""
        hidden = F.filter("attributes", lambda a: F.coalesce(a["is_secret"], F.lit(False)))
        secrets = F.map_from_entries(F.transform(hidden, lambda a: F.struct(a["code"], a["value"])))
        return answers.join(self.table("records").select("id", secrets.alias("_s")), "id").select("id", matching.verify_secret(F.col("answers"), F.col("_s")).alias("verified"))

    # ---- administration

    def config(self) -> dict:
        """The weights, bands, rules and limits that matching works by."""
        return {"weights": dict(LOST_FOUND.weights), "bands": [list(b) for b in LOST_FOUND.bands], "rules": [r.attribute for r in RULES], "limits": dict(FUNNEL), "model": self.model}

    def _decided(self) -> DataFrame:
        return self.table("decisions").join(self.table("candidates").select("lost_id", "found_id", "level", "final_score"), ["lost_id", "found_id"])

    def metrics(self) -> DataFrame:
        return evaluate.decision_metrics(self._decided())

    def training_pairs(self, limit: int | None = None) -> DataFrame:
        return evaluate.training_pairs(self._decided(), limit=limit)

    def embedding_status(self) -> DataFrame:
        return evaluate.embedding_status(self.table("vectors"))
