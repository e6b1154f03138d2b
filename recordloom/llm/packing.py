"""Best-fit packing of tokenised documents into sequences."""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import ranked, trim, written

#: Words whose ids a worker keeps for good; it forgets others after each block. This bounds memory, not results.
REMEMBERED = 900_000
#: Bytes of text encoded together; a longer text is a block of its own.
BLOCK = 4 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokenizer:
    """Ids of whole texts by a lower-casing tokenizer that drops white space.

    Such a tokenizer never joins characters across white space, so the ids of a
    text are those of its words one after another, and each distinct word is
    encoded once. Words are cut only at the six ASCII white-space characters;
    what other white space they hold stays inside and is the tokenizer's
    matter. A full stop or comma that ends a word after a letter is a token
    of its own. Texts that may hold special tokens keep their case.
    """

    def __init__(self, definition: str, remembered: int | None = None):
        from tokenizers import Tokenizer

        # One thread a worker: Spark already runs a worker on each core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(definition)
        self.remembered = REMEMBERED if remembered is None else remembered
        self.known = pa.array([], pa.large_string())
        self.starts, self.counts, self.pool = np.zeros(0, "int32"), np.zeros(0, "int32"), np.zeros(0, "uint32")

    def _append(self, words: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, words])
        self.starts = np.concatenate([self.starts, (len(self.pool) + np.cumsum(counts) - counts).astype("int32")])
        self.counts, self.pool = np.concatenate([self.counts, counts.astype("int32")]), np.concatenate([self.pool, ids])

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        counts, ids = array("q"), array("I")
        for at in range(0, len(words), 10_000):
            for e in self.tokenizer.encode_batch(words[at : at + 10_000], add_special_tokens=False):
                found = e.ids
                counts.append(len(found))
                ids.extend(found)
        return np.frombuffer(counts, "int64"), np.frombuffer(ids, "uint32")

    def _learn(self, words: list[str]) -> np.ndarray:
        """Adds words that are not known; their places."""
        ended = [i for i, w in enumerate(words) if len(w) > 1 and w[-1] in ".," and "a" <= w[-2] <= "z"]
        marked = set(ended)
        stems = [words[i][:-1] for i in ended]
        there = pc.fill_null(pc.index_in(pa.array([*stems, ".", ","], pa.large_string()), value_set=self.known), -1).to_numpy()
        # Plain new words and the stems and marks that nothing held yet, each once.
        place: dict[str, int] = {}
        fresh: list[str] = []
        for w in [*(w for i, w in enumerate(words) if i not in marked), *(s for s, k in zip([*stems, ".", ","], there) if k < 0)]:
            if w not in place:
                place[w] = len(self.known) + len(fresh)
                fresh.append(w)
        self._append(pa.array(fresh, pa.large_string()), *self._encode(fresh))
        out = np.empty(len(words), "int64")
        if ended:
            stem = np.array([k if k >= 0 else place[s] for s, k in zip(stems, there.tolist())])
            dot, comma = (k if k >= 0 else place[m] for m, k in zip(".,", there[-2:].tolist()))
            mark = np.array([dot if words[i][-1] == "." else comma for i in ended])
            at = len(self.known) + np.arange(len(ended))
            both = np.stack([stem, mark], axis=1).ravel()
            self._append(pa.array([words[i] for i in ended], pa.large_string()), self.counts[stem] + self.counts[mark], self.gather(both))
            out[ended] = at
        plain = [i for i in range(len(words)) if i not in marked]
        out[plain] = [place[words[i]] for i in plain]
        return out

    def gather(self, places: np.ndarray) -> np.ndarray:
        """The ids of known words, one after another."""
        counts = self.counts[places]
        ends = np.cumsum(counts, dtype="int64")
        at = np.repeat((self.starts[places] - (ends - counts)).astype("int32"), counts)
        at += np.arange(len(at), dtype="int32")
        return self.pool[at]

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts, and where each text ends among them."""
        keep = pc.match_substring(texts, "<|")
        texts = pc.if_else(keep, texts, pc.ascii_lower(texts))
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_string())
        before = len(self.known), len(self.pool)
        found = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy().astype("int64")
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = self._learn(words.take(pa.array(new)).to_pylist())
        places = found[coded.indices.to_numpy()]
        ids = self.gather(places)
        upto = np.concatenate([[0], np.cumsum(self.counts[places], dtype="int64")])
        offsets = lists.offsets.to_numpy()
        ends = upto[offsets[1:] - offsets[0]]
        if before[0] > self.remembered:
            self.known = self.known.slice(0, before[0])
            self.starts, self.counts, self.pool = self.starts[: before[0]].copy(), self.counts[: before[0]].copy(), self.pool[: before[1]].copy()
        return ids, ends


def _tokenizer(definition: str, remembered: int) -> WordTokenizer:
    """The worker process's tokenizer: it stays with its words from task to task."""
    cache = sys.__dict__.setdefault("_recordloom_tokenizers", {})
    key = zlib.crc32(definition.encode())
    if key not in cache:
        cache[key] = WordTokenizer(definition)
    cache[key].remembered = remembered
    return cache[key]


def blocks(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes, or of one row."""
    start, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): ids of the text, then ``end_id``, cut only where longer than ``capacity``."""
    definition = Path(tokenizer_path).read_text(encoding="utf-8")
    # Sent once to each executor, 2 MB whatever the input; executors need no file of their own.
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared.value, remembered)
        for batch in batches:
            lengths = pc.binary_length(batch.column(1)).to_numpy()
            for low, high in blocks(lengths, BLOCK):
                ids, ends = tokenizer.block(batch.column(1).slice(low, high - low))
                data = ids.astype("<u4", copy=False)
                rows: list[tuple] = []
                begin = 0
                for doc_id, stop in zip(batch.column(0).slice(low, high - low).to_pylist(), ends.tolist()):
                    n = stop - begin + 1
                    for piece, start in enumerate(range(0, n, capacity)):
                        size = min(capacity, n - start)
                        part = data[begin + start : min(begin + start + size, stop)]
                        crc = zlib.crc32(part)
                        rows.append((doc_id, piece, start, size, zlib.crc32(end, crc) if start + size == n else crc))
                    begin = stop
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        trim()

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("data")).mapInArrow(run, PIECES)


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Slots for items given only as counts by size: (size, first rank, items, first bin, items a bin, offset), and the number of bins.

    Items above a third of the capacity go at most two to a bin: the largest
    left is matched with the largest that still fits beside it. Smaller items,
    from large to small, go into the bin with the least room that takes them,
    else into a new one. All bins that got the same items so far are one entry,
    so the work depends on the number of sizes, at most ``capacity``.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    left = {s: n for s, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    bins = 0
    #: Room left -> runs of bins (first bin, how many).
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def put(gap: int, first: int, n: int) -> None:
        if gap > 0 and n:
            if gap not in room:
                insort(rooms, gap)
            room.setdefault(gap, []).append((first, n))

    def take(size: int, items: int, first: int, each: int, offset: int) -> None:
        slots.append((size, used[size], items, first, each, offset))
        used[size] += items
        left[size] -= items

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        at = bisect_left(large, capacity - a + 1) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        if at < 0:
            n = left[a]
            take(a, n, bins, 1, 0)
            put(capacity - a, bins, n)
        elif large[at] == a and left[a] == 1:
            b_at = at - 1
            while b_at >= 0 and not left[large[b_at]]:
                b_at -= 1
            n = 1
            take(a, 1, bins, 1, 0)
            if b_at >= 0:
                b = large[b_at]
                take(b, 1, bins, 1, a)
                put(capacity - a - b, bins, 1)
            else:
                put(capacity - a, bins, 1)
        elif large[at] == a:
            n = left[a] // 2
            take(a, n, bins, 1, 0)
            take(a, n, bins, 1, a)
            put(capacity - 2 * a, bins, n)
        else:
            b = large[at]
            n = min(left[a], left[b])
            take(a, n, bins, 1, 0)
            take(b, n, bins, 1, a)
            put(capacity - a - b, bins, n)
        bins += n
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                n = max(1, left[size] // each)
                put(capacity, bins, n)
                bins += n
                continue
            gap = rooms[at]
            first, n = room[gap].pop()
            if not room[gap]:
                del room[gap]
                rooms.pop(at)
            each = min(gap // size, left[size])
            whole = min(n, left[size] // each)
            take(size, whole * each, first, each, capacity - gap)
            put(gap - each * size, first, whole)
            put(gap, first + whole, n - whole)
    return slots, bins


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, remembered: int = REMEMBERED) -> DataFrame:
    """Packs all documents: (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    The texts are tokenised once and leave only lengths and checksums. What is
    planned is the histogram of lengths, ``capacity`` numbers at most whatever
    the input; each piece then finds its place by its rank among the pieces of
    its length. Ranks are counted in hash buckets, so one length with a third
    of all rows is spread over many tasks.

    ``remembered`` is how many words' ids a worker keeps: memory against time,
    never the result.

    Null or empty text: one piece, the end id alone. Repeated rows are packed
    once each. Null ids are kept. Empty table: no rows. Other columns are ignored.
    """
    items = written(tokenized_pieces(docs, tokenizer_path, capacity, end_id, remembered), "pack-pieces")
    counts = {r.length: r["count"] for r in items.groupBy("length").count().collect()}  # ``capacity`` rows at most
    slots, _ = plan_bins(counts, capacity)
    by_size: dict[int, np.ndarray] = {}
    for size in counts:
        by_size[size] = np.array(sorted(s[1:] for s in slots if s[0] == size), dtype="int64").T
    placed = ranked(items, ["length"], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], sum(counts.values()), "pack-base", [F.col("doc_id"), F.col("piece")])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sequence, offset = np.empty(len(pdf), "int64"), np.empty(len(pdf), "int64")
            length, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                start, _, first, each, begin = by_size[int(size)]
                k = np.searchsorted(start, rank[at], side="right") - 1
                j = rank[at] - start[k]
                sequence[at] = first[k] + j // each[k]
                offset[at] = begin[k] + j % each[k] * size
            yield pdf.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return placed.select(*columns, "rank").mapInPandas(place, f"{PIECES}, sequence_id long, offset long")
