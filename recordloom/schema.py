"""Schemas (as DDL) of the unified records, pair evidence and second-domain tables, and closed value lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECORD_TYPES = ("LOST", "FOUND")
STATUSES = ("ACTIVE", "MATCHED", "RETURNED", "CLOSED")
SEVERITIES = ("CRITICAL", "MAJOR", "MINOR")
LEVELS = ("VERY_HIGH", "HIGH", "MEDIUM", "LOW", "IGNORE", "REJECT")
ACTIONS = ("AUTO_RECOMMEND", "HUMAN_REVIEW", "DO_NOT_RECOMMEND")
DECISIONS = ("CONFIRMED", "REJECTED", "DEFERRED")

ATTRIBUTE = "struct<code:string,value:string,source:string,confidence:double,is_secret:boolean,ordinal:int>"
LOCATION = "struct<id:bigint,name:string,ancestors:array<bigint>,lat:double,lon:double>"
RECORD = (
    "id string, record_type string, status string, category string, brand string, model string, raw_description string,"
    " normalized_text string, created_at timestamp, version int,"
    f" attributes array<{ATTRIBUTE}>, distinctive array<string>, location {LOCATION}, start_at timestamp, end_at timestamp"
)
EMBEDDING = "item_id string, kind string, model string, version string, content_hash string, embedding array<float>, status string"
CANDIDATE = (
    "lost_id string, found_id string, final_score double, base_score double, penalty double, bonus double, confidence double,"
    " level string, action string, status string, created_at timestamp"
)
EVIDENCE = (
    "lost_id string, found_id string, evidence_type string, field_name string, similarity_score double, reliability double,"
    " weight double, contribution double, is_conflict boolean, severity string"
)
CONFLICT = "struct<field:string,severity:string,lost_value:string,found_value:string,penalty:double,reason:string,reject:boolean>"
QUESTION = (
    "qid string, raw string, stem string, options map<string,string>, answer array<string>, answer_header array<string>,"
    " answer_text string, rationale string, kps array<string>, services array<string>, constraints array<string>,"
    " qtype string, select_n int, source_no string, title string, path string, stem_truncated boolean"
)


def one_of(column: str, values: tuple[str, ...]) -> Column:
    """Whether a column holds one of the listed values; null does not."""
    return F.coalesce(F.col(column).isin(list(values)), F.lit(False))
