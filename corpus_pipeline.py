"""From raw documents to packed training sequences, in stages that each call one operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import census, common, mixing, ngram_join, packing, quality_classifier, suffix_dedup

#: The columns of ``documents`` that all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words whose ids a packing worker keeps: fewer than alone, since a session that ran all stages has a grown heap beside it.
WORDS_KEPT = 500_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the neighbour vote accepts.

    A score belongs to a text, so rows that repeat an id are judged one by one.
    Null and empty texts score the share of label 1 among the labelled rows.
    Equally near neighbours at the border of the vote: the smaller ids count.
    Without labels every score is 0.5, and all rows stay. An empty table stays
    empty. Columns beyond those of documents are dropped, whatever their names.
    """
    common.small_batches(spark)
    model = quality_classifier.fit(docs, common.read_table(spark, sf_dir, "labels"))
    return quality_classifier.accepted(docs.select(*COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates.

    Rows that repeat an id go only where all of them are duplicates of a smaller
    one; rows without an id, and null or empty texts, which link with nothing,
    stay. An empty table stays empty.
    """
    common.small_batches(spark)
    found = ngram_join.near_duplicates(docs)
    gone = found.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("again")).filter("again").select("doc_id")
    return census.without(docs.select(*COLUMNS), gone, "doc_id")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; n_chars counts what is left.

    Bytes of a character that is cut in part go with it. A text that is cut
    whole stays as an empty one; the next stage takes no words of it. Null texts
    and rows without an id stay as they are; rows that repeat an id do not cut
    each other. An empty table stays empty.
    """
    common.small_batches(spark)
    out = suffix_dedup.remove_repeats(docs, ["text", "lang", "source", "n_chars"], as_text=True)
    # Untouched texts keep their column, null or not.
    changed = F.col("n_removed") > 0
    return out.select("doc_id", F.when(changed, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their target weights.

    Null and empty texts have no words and are not taken; a null source is a
    source. Rows that repeat an id are documents of their own; ties of the
    hash order go by id and text. An empty table stays empty.
    """
    common.small_batches(spark)
    return mixing.mixed_texts(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences of 2048 tokens; one row per piece.

    A null or empty text is one piece, the end id alone. Rows that the mix
    repeats are packed once each; equal lengths take places by id and piece. An
    empty table gives no rows.
    """
    common.small_batches(spark)
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, remembered=WORDS_KEPT)


#: (name, stage); a stage takes (spark, docs, sf_dir), and its result is written and read as the next one's docs.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("n-gram jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("source mixing", mixture),
    ("best-fit packing", packed),
]

#: The neighbour vote has no SQL form; tests hold each stage against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again."""
    docs = common.read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, f"pipeline-{k}")
    return docs
