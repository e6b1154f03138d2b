"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import held_out, read_table, small_batches


def op1_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordloom.llm.lm_scoring import score

    return score(read_table(spark, sf_dir, "documents"), 5, 1)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordloom.llm.mixing import mix

    out = mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordloom.llm.suffix_dedup import remove_repeats

    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordloom.llm.embedding_dedup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "embeddings"), 0.93)


def _op4_sql() -> str:
    from recordloom.llm.embedding_dedup import COMPONENTS_SQL

    return COMPONENTS_SQL


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from recordloom.llm.packing import pack

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordloom.llm.quality_rules import POLICIES, ledger, passes

    out = ledger(read_table(spark, sf_dir, "documents"))
    base, all_rules = POLICIES[1], POLICIES[2]
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes(base)).alias("base_failed"), passes(all_rules).alias("kept"), "failures")


def _op6_sql() -> str:
    from recordloom.llm.quality_rules import POLICIES, ledger_sql, policy_mask

    verdicts = f"(failures & {policy_mask(POLICIES[1])}) <> 0 AS base_failed, (failures & {policy_mask(POLICIES[2])}) = 0 AS kept"
    return ledger_sql(f"doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {verdicts}, failures")


def op7_neighbour_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordloom.llm.quality_classifier import classify, fit

    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return classify(docs, model).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op8_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordloom.llm.toxicity import classify, fit

    docs = read_table(spark, sf_dir, "documents")
    net = fit(docs, read_table(spark, sf_dir, "labels"))
    return classify(docs, net).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def op9_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordloom.llm.sharding import shard

    out = shard(read_table(spark, sf_dir, "documents"), 40)
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op10_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordloom.llm.ngram_join import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), 5, 75, 100)


def _op10_sql() -> str:
    from recordloom.llm.ngram_join import JACCARD_SQL

    return JACCARD_SQL


def _batched(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _batched(f) for f in (op1_log_bilinear, op2_mix_sources, op3_suffix_family, op4_metric_range_join, op5_best_fit_packing, op6_rule_ledger, op7_neighbour_vote, op8_recurrent_toxicity, op9_sampled_splitters, op10_prefix_join)}


def oracle_sql() -> dict[str, str]:
    return {"op4_metric_range_join": _op4_sql(), "op6_rule_ledger": _op6_sql(), "op10_prefix_join": _op10_sql()}
