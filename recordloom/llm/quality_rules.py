"""Quality rules kept as a bitmask ledger: measure once, judge under any policy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import text_bytes

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_letters", "n_upper", "n_bangs")
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
SPACES = b" \t\n\r\x0b\x0c"


def repeat_words(words: list[bytes]) -> tuple[int, int]:
    """Words inside some 3-word window that the text has twice or more (first ones included), and distinct words."""
    codes: dict[bytes, int] = {}
    n = len(words)
    a = np.fromiter((codes.setdefault(w, len(codes)) for w in words), dtype="int64", count=n)
    m = len(codes)
    if n < 4:
        return 0, m
    pairs = a[:-1] * m + a[1:]
    if m > 2_000_000:  # three codes would not fit 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype("int64")
    keys = pairs[:-1] * m + a[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0, m
    hit = np.zeros(n, dtype=bool)
    twice = order[np.r_[same, False] | np.r_[False, same]]
    for d in range(3):
        hit[twice + d] = True
    return int(hit.sum()), m


def measure(text: bytes) -> tuple[int, ...]:
    """``MEASURES`` of one whole text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    repeated, distinct = repeat_words(words)
    letters = len(text) - len(text.translate(None, LETTERS))
    return (
        len(words),
        len(b"".join(words).decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated,
        distinct,
        letters,
        len(text) - len(text.translate(None, UPPER)),
        text.count(b"!!"),
    )


@dataclass(frozen=True)
class Rule:
    """A document fails where ``sql`` holds; ``sql`` uses integer measures only, so it means the same everywhere."""

    name: str
    sql: str


#: A rule's bit is its place here. New rules go to the end, so stored ledgers stay valid.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 2 * word_chars"),
    Rule("shouting", "100 * n_upper > 30 * n_letters"),
    Rule("exclamations", "100 * n_bangs > 5 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 3 * n_words OR word_chars > 12 * n_words"),
    Rule("few_distinct_words", "100 * n_distinct_words < 5 * n_words"),
)
#: Versioned policies: the rules whose failure rejects.
POLICIES = {1: ("few_words", "repeated_windows"), 2: tuple(r.name for r in RULES)}


def policy_mask(rules: Sequence[str]) -> int:
    place = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << place[name] for name in set(rules))


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measures, failures): every rule evaluated once over each whole text, bit i set where rule i fails.

    One narrow pass without a shuffle. Null text has no words and fails
    ``few_words`` alone. Repeated rows have a row each, an empty table none;
    other columns of the input are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.as_py()) for t in batch.column(1)]
            if rows:
                values = np.array(rows, dtype="int64").T
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v) for v in values]], names=["doc_id", *MEASURES])

    schema = ", ".join(["doc_id long", *[f"{m} long" for m in MEASURES]])
    rows = docs.select("doc_id", text_bytes(F.col("text")).alias("data")).mapInArrow(run, schema)
    bits = [F.when(F.expr(r.sql), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, r in enumerate(RULES)]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return rows.withColumn("failures", failures)


def passes(policy: Sequence[str]) -> Column:
    """Whether a ledger row passes the rules of ``policy``."""
    return F.col("failures").bitwiseAND(F.lit(policy_mask(policy))) == 0


def ablations(rows: DataFrame, policy: Sequence[str]) -> DataFrame:
    """What each rule of ``policy`` does: (rule, failing, only_failing, kept_without), from the stored bits in one aggregation.

    ``only_failing`` documents fail no other rule of the policy; they come
    back if the rule is dropped. No text is read again.
    """
    mask = policy_mask(policy)
    hit = F.col("failures").bitwiseAND(F.lit(mask))
    names = [(i, r.name) for i, r in enumerate(RULES) if r.name in policy]
    sums = [F.count(F.when(hit == 0, 1)).alias("kept")]
    for i, name in names:
        sums += [F.count(F.when(hit.bitwiseAND(F.lit(1 << i)) != 0, 1)).alias(f"f_{name}"), F.count(F.when(hit == (1 << i), 1)).alias(f"o_{name}")]
    table = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"f_{name}").alias("failing"), F.col(f"o_{name}").alias("only_failing"), (F.col("kept") + F.col(f"o_{name}")).alias("kept_without")) for _, name in names])
    return rows.agg(*sums).select(F.explode(table).alias("r")).select("r.*")


#: DuckDB SQL for the measures and failure bits of ``documents`` (ids distinct).
LEDGER_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, u.word AS word, u.pos AS pos
          FROM docs, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) WITH ORDINALITY AS u(word, pos)),
windows AS (SELECT doc_id, word, pos, lead(word, 1) OVER w AS w2, lead(word, 2) OVER w AS w3
            FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
hits AS (SELECT doc_id, word, pos, (w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, w2, w3) >= 2)::INT AS hit FROM windows),
covered AS (SELECT doc_id, word, greatest(hit, coalesce(lag(hit, 1) OVER w, 0), coalesce(lag(hit, 2) OVER w, 0)) AS c
            FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
by_word AS (SELECT doc_id, count(*)::BIGINT AS n_words, sum(length(word))::BIGINT AS word_chars, sum(c)::BIGINT AS n_repeat_words,
                   count(DISTINCT word)::BIGINT AS n_distinct_words FROM covered GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs),
by_line AS (SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines
            FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
measures AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
       length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
       coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
       coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_distinct_words, 0)::BIGINT AS n_distinct_words,
       length(regexp_replace(t, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
       ((length(t) - length(replace(t, '!!', ''))) // 2)::BIGINT AS n_bangs
       FROM docs d LEFT JOIN by_word USING (doc_id) LEFT JOIN by_line USING (doc_id)),
ledger AS (SELECT *, {bits} AS failures FROM measures)
SELECT {columns} FROM ledger
"""


def ledger_sql(columns: str) -> str:
    bits = " + ".join(f"CASE WHEN {r.sql} THEN {1 << i} ELSE 0 END" for i, r in enumerate(RULES))
    return LEDGER_SQL.replace("{bits}", f"({bits})::BIGINT").replace("{columns}", columns)
