"""Suffix-array dedup: long byte matches with earlier documents, by a logarithmic family of suffix arrays."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.census import CELL, cell_blobs, census_cell, hauls, hot_keys, id_filter, is_hot, may_hold, mix64, remainders, spot_of
from recordloom.llm.common import in_batches, packed, share, text_bytes, trim, unpacked, written

#: Bytes of a match, bytes of an anchor inside it, and anchors among which a match chooses.
MATCH, ANCHOR = 50, 24
CHOICE = MATCH - ANCHOR + 1
#: An anchor with all bytes of the matches that may hold it.
AROUND = 2 * (CHOICE - 1) + ANCHOR
#: Anchors an index cell should get, anchors that share one family, and suffixes of a batch of its index.
INDEX_CELL, FAMILY, SUFFIX_BATCH = 250_000, 12_000, 1 << 16
#: Bytes of text whose anchors are dealt together, bytes looked at at once, and anchors held before they are dealt.
HAUL, PIECE, HELD = 16 << 20, 1 << 20, 120_000
BASE = np.uint64(0x9E3779B97F4A7C15)
BYTE = mix64(np.arange(1, 257, dtype="uint64"))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def _slide(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """``op`` over each run of ``width`` values; the last values see shorter runs."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[: len(out) - step] = op(out[: len(out) - step], out[step:])
        have += step
    return out


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of some texts and where each starts (one more entry for the end)."""
    return np.frombuffer(b"".join(texts), "uint8"), np.cumsum([0, *map(len, texts)])


def piece_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of the ``width`` bytes from each place; meaningless over an end.

    Pieces double while the bits of ``width`` are read, so a few arrays as long
    as the block are all that is held.
    """
    piece, size = BYTE[raw], 1
    out, have = None, 0
    while True:
        if width & size:
            if out is None:
                out, have = piece.copy(), size
            else:  # this piece, then what is there already
                longer = piece * _power(have)
                longer[: len(piece) - size] += out[size:]
                out, have = longer, have + size
        if 2 * size > width:
            return out
        longer = piece * _power(size)
        longer[: len(piece) - size] += piece[size:]
        piece, size = longer, 2 * size


def anchors(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, owner, key, low, high) of the anchors: in each ``MATCH`` bytes of a text, the first piece with the least hash.

    Which piece is chosen depends on the bytes of the match alone, so equal
    matches in two texts have an equal anchor at the same place inside. The
    matches that choose an anchor start ``CHOICE - 1`` bytes before it, plus
    ``low`` to ``high``.
    """
    n = len(raw)
    if n < MATCH:
        return (*[np.zeros(0, "int64")] * 2, np.zeros(0, "uint64"), *[np.zeros(0, "uint8")] * 2)
    key = mix64(piece_hashes(raw, ANCHOR))
    order = (key >> np.uint64(32)).astype("uint32") | np.uint32(1)
    least = _slide(order, CHOICE, np.minimum)
    # Only runs of MATCH bytes inside one text choose.
    valid = np.ones(n, bool)
    for e in starts[1:].tolist():
        valid[max(0, e - MATCH + 1) : e] = False
    least[~valid] = 0
    # The largest least value of the runs that hold a place, looking back.
    best = _slide(least[::-1], CHOICE, np.maximum)[::-1]
    place = np.flatnonzero(order == best)
    owner = np.searchsorted(starts, place, side="right") - 1
    low, high = np.zeros(len(place), "uint8"), np.zeros(len(place), "uint8")
    before = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(CHOICE - 1, "uint32"), least]), CHOICE)
    for at in range(0, len(place), 50_000):
        some = place[at : at + 50_000]
        mine = before[some] == order[some][:, None]
        low[at : at + 50_000], high[at : at + 50_000] = mine.argmax(axis=1), CHOICE - 1 - mine[:, ::-1].argmax(axis=1)
    # Of equal hashes the first is chosen.
    gap = np.diff(place)
    tied = np.flatnonzero((order[place[1:]] == order[place[:-1]]) & (owner[1:] == owner[:-1]) & (gap < CHOICE)) + 1
    low[tied] = np.maximum(low[tied], CHOICE - gap[tied - 1])
    kept = low <= high
    return place[kept], owner[kept], key[place[kept]], low[kept], high[kept]


def pieces(texts: list[bytes], size: int | None = None) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(owners, bases, parts) of about ``size`` bytes: whole texts, or parts of long ones, at their places.

    Parts of one text overlap by one byte less than a match, so each match lies in one.
    """
    size = size or PIECE
    out: tuple[list[int], list[int], list[bytes]] = ([], [], [])
    have = 0
    for k, text in enumerate(texts):
        for base in range(0, max(1, len(text) - MATCH + 1), size):
            part = text[base : base + size + MATCH - 1]
            if have and have + len(part) > size:
                yield out
                out, have = ([], [], []), 0
            for column, x in zip(out, (k, base, part)):
                column.append(x)
            have += len(part)
    if out[0]:
        yield out


def anchor_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(owner, key) of each text's distinct anchors."""
    owners, keys = [np.zeros(0, "int64")], [np.zeros(0, "uint64")]
    for who, _, parts in pieces(texts.to_pylist()):
        raw, starts = joined(parts)
        _, owner, key, _, _ = anchors(raw, starts)
        owners.append(np.array(who, "int64")[owner])
        keys.append(key)
    owner, key = np.concatenate(owners), np.concatenate(keys)
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    keep = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])] if len(key) else np.zeros(0, bool)
    return owner[keep], key[keep]


def strings(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first ``MATCH`` bytes of some suffixes of a text."""
    if not len(at):
        return np.zeros(0, f"S{MATCH}")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, MATCH)[at]).view(f"S{MATCH}").ravel()


class SuffixFamily:
    """Suffix arrays of batches of documents in id order, in levels of geometric size.

    A level is the array of its suffixes in order, each by its first ``MATCH``
    bytes and once. A new batch is sorted into a
    suffix array and merge-scanned against each level: both runs are in order,
    so a stable merge brings equal suffixes side by side. Then the batch becomes
    a level itself; before the next one, levels of like size merge, so there
    are never more than logarithmically many.
    """

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def merge(self) -> None:
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            later, earlier = self.levels.pop(), self.levels.pop()
            both = np.concatenate([earlier, later])
            both.sort(kind="stable")
            self.levels.append(both)

    def add(self, text: np.ndarray, at: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Whether the suffix of ``text`` at each place also starts in a document with a smaller id; batches come in id order."""
        self.merge()
        found = strings(text, at)
        order = np.argsort(found, kind="stable")
        array, owner = found[order], docs[order]
        first = np.r_[True, array[1:] != array[:-1]]
        run = np.cumsum(first) - 1
        unique = array[first]
        least = np.minimum.reduceat(owner, np.flatnonzero(first))
        hit = owner > least[run]
        earlier = np.zeros(len(unique), bool)
        for level in self.levels:
            both = np.concatenate([level, unique])
            merged = np.argsort(both, kind="stable")
            twin = np.flatnonzero(both[merged[1:]] == both[merged[:-1]]) + 1
            earlier[merged[twin] - len(level)] = True
        hit |= earlier[run]
        if not earlier.all():
            self.levels.append(unique[~earlier])
        out = np.empty(len(hit), bool)
        out[order] = hit
        return out


#: A run of anchors with equal bytes around them: the document, its mark, the first and last place (one byte to ``MATCH``
#: from each to the next), the matches that chose it, and their bytes (zeros around them).
ENTRY = np.dtype([("doc", "<i8"), ("mark", "<u4"), ("pos", "<u4"), ("last", "<u4"), ("low", "u1"), ("high", "u1"), ("data", f"S{AROUND}")])
SPAN = np.dtype([("doc", "<i8"), ("mark", "<u4"), ("start", "<u4"), ("end", "<u4")])
COLUMN = np.arange(AROUND)


def _held(rows: np.ndarray) -> np.ndarray:
    """Which bytes of each entry's data its matches cover."""
    return (COLUMN >= rows["low"][:, None]) & (COLUMN < rows["high"][:, None].astype("int64") + MATCH)


def _bytes(rows: np.ndarray) -> np.ndarray:
    return np.frombuffer(np.ascontiguousarray(rows["data"]).tobytes(), "uint8").reshape(len(rows), AROUND)


def _speakers(ids: list[int | None], texts: list[bytes]) -> list[int]:
    """Rows that speak for a block: of equal texts the one with the smallest id. Null ids take no part."""
    speaker: dict[bytes, int] = {}
    for i in sorted((i for i in range(len(ids)) if ids[i] is not None), key=lambda i: ids[i]):
        speaker.setdefault(texts[i], i)
    return sorted(speaker.values())


def _per_haul(docs: DataFrame, emit, schema: str) -> DataFrame:
    """Rows that ``emit`` makes of each haul of documents (its number, and ids and texts of its blocks).

    Hauls follow the files, so each scan of the same input sees the same ones.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    types = {"long": pa.int64(), "binary": pa.binary()}
    kinds = [types[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for parts in hauls(batches, 1, HAUL, PIECE):
            yield from in_batches(emit(block, ((p.column(0).to_pylist(), p.column(1).to_pylist()) for p in parts)), kinds, names)
            block += 1
            trim()

    return docs.mapInArrow(run, schema)


def _cell_rows(docs: DataFrame, cells: int, hot: np.ndarray) -> DataFrame:
    """(cell, block, blob): the anchor keys of each haul's speakers, for the census; a key that several hold goes there twice."""
    shared = share(docs.sparkSession, hot)

    def emit(block: int, parts) -> Iterator[tuple[int, int, bytes]]:
        hot = pickle.loads(shared.value)
        held = [np.zeros(0, "uint64")]
        for ids, texts in parts:
            _, key = anchor_keys(pa.array([texts[i] for i in _speakers(ids, texts)], pa.large_binary()))
            held.append(np.sort(key[~is_hot(hot, key)]))
        key = np.sort(np.concatenate(held), kind="stable")
        third = np.r_[np.zeros(2, bool), key[2:] == key[:-2]][: len(key)]
        for c, blob in cell_blobs(key[~third], cells):
            yield c, block, blob

    return _per_haul(docs, emit, "cell long, block long, blob binary")


def _home_rows(docs: DataFrame) -> DataFrame:
    """(block, part, blob): ids and texts of each haul's speakers, block by block, and their copies there."""

    def emit(block: int, parts) -> Iterator[tuple[int, int, bytes]]:
        for part, (ids, texts) in enumerate(parts):
            some = _speakers(ids, texts)
            first = {texts[i]: ids[i] for i in some}
            copies = [(i, zlib.crc32(t), len(t)) for i, t in zip(ids, texts) if i is not None and len(t) >= MATCH and i > first[t]]
            data, starts = joined([texts[i] for i in some])
            yield block, part, packed(data, starts.astype("<i8"), np.array([ids[i] for i in some], "<i8"), np.array(copies, "<i8").reshape(-1))

    return _per_haul(docs, emit, "block long, part long, blob binary")


def _blob(rows: np.ndarray) -> bytes:
    """Rows column by column, compressed; of data only the bytes that matter."""
    columns = [np.ascontiguousarray(rows[n]) for n in rows.dtype.names if n != "data"]
    if "data" in rows.dtype.names:
        columns.append(_bytes(rows)[_held(rows)])
    return packed(*columns)


def _rows(blobs, kind: np.dtype) -> np.ndarray:
    """All rows of some blobs."""
    parts = [unpacked(b) for b in blobs]
    many = [len(p[0]) // kind[0].itemsize for p in parts]
    out = np.zeros(sum(many), kind)
    for k, name in enumerate(kind.names):
        found = b"".join(p[k] for p in parts)
        if name == "data":
            data = np.zeros((len(out), AROUND), "uint8")
            data[_held(out)] = np.frombuffer(found, "uint8")
            out[name] = data.view(f"S{AROUND}").ravel()
        else:
            out[name] = np.frombuffer(found, kind[name])
    return out


def _anchor_of(rows: np.ndarray) -> np.ndarray:
    """A number for the anchor bytes of each entry."""
    words = np.ascontiguousarray(_bytes(rows)[:, CHOICE - 1 : CHOICE - 1 + ANCHOR]).view("<u8")
    return mix64(words[:, 0] + mix64(words[:, 1] + mix64(words[:, 2])))


def _data_hash(rows: np.ndarray) -> np.ndarray:
    """A number for each entry's bytes and the matches in them."""
    data = np.zeros((len(rows), 8 * -(-AROUND // 8)), "uint8")
    data[:, :AROUND] = _bytes(rows)
    out = rows["low"].astype("uint64") * np.uint64(256) + rows["high"]
    for k, word in enumerate(data.view("<u8").T):
        out += (word ^ word >> np.uint64(29)) * _power(2 * k + 3)
    return mix64(out)


def _by(place: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The rows of each place as one blob."""
    order = np.argsort(place, kind="stable")
    place, rows = place[order], rows[order]
    cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, "int64")
    for a, b in zip(cuts, np.r_[cuts[1:], len(place)]):
        yield int(place[a]), _blob(rows[a:b])


def _spans(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(doc), SPAN)
    out["doc"], out["mark"], out["start"], out["end"] = doc, mark, start, end
    return out


def _bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(doc.astype("uint64")) % np.uint64(buckets)).astype("int64")


def _entries(seen: np.ndarray, at: np.ndarray, **columns: np.ndarray) -> np.ndarray:
    """Entries of the anchors at some places of a padded text; neighbours that only repeat one are taken into it."""
    parts = [np.zeros(0, ENTRY)]
    for k in range(0, len(at), 50_000):
        rows = np.zeros(len(at[k : k + 50_000]), ENTRY)
        for name, values in columns.items():
            rows[name] = values[k : k + 50_000]
        rows["last"] = rows["pos"]
        rows["data"] = (seen[at[k : k + 50_000] + AROUND - (CHOICE - 1)] * _held(rows)).view(f"S{AROUND}").ravel()
        parts.append(_chained(rows))
    return np.concatenate(parts)


def _same(rows: np.ndarray, *names: str) -> np.ndarray:
    """Whether an entry has the values of the one before it."""
    same = np.ones(max(0, len(rows) - 1), bool)
    for name in names:
        same &= rows[name][1:] == rows[name][:-1]
    return np.r_[False, same] if len(rows) else same


def _chained(rows: np.ndarray) -> np.ndarray:
    """Entries that only repeat the one before them, at most a match later in the same text, taken into it."""
    if len(rows) < 2:
        return rows
    again = _same(rows, "low", "high", "doc", "mark", "data")
    gap = np.r_[0, rows["pos"][1:].astype("int64") - rows["last"][:-1]]
    head = np.flatnonzero(~(again & (gap >= 0) & (gap <= MATCH)))
    out = rows[head]
    out["last"] = rows["last"][np.r_[head[1:], len(rows)] - 1]
    return out


def _grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries by anchor and bytes around it, in document order; the number of each one's anchor; who speaks for it.

    The first entry with given bytes speaks for its document, the first one of
    a later document for all later ones: what they match is the same.
    """
    # Equal bytes have equal hashes; should others have the same one, there are only more speakers.
    rows = _chained(rows[np.lexsort((rows["pos"], rows["mark"], rows["doc"], _data_hash(rows), _anchor_of(rows)))])
    own = _anchor_of(rows)
    same = _same(rows, "low", "high", "data")
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(rows))))
    later = rows["doc"] > rows["doc"][first]
    turn = later & ~np.r_[False, later[:-1] & same[1:]] if len(rows) else later
    second = np.maximum.accumulate(np.where(turn, np.arange(len(rows)), 0))
    group = np.cumsum(np.r_[True, own[1:] != own[:-1]]) - 1 if len(rows) else own.astype("int64")
    return rows, group, np.where(later, second, first)


def _matches(rows: np.ndarray, group: np.ndarray, speaker: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """For each asked speaker which of its matches (by their start) also start in an earlier document, from a suffix family.

    Equal strings choose equal anchors, so a family of its own holds each range of anchors.
    """
    out = np.zeros((len(rows), CHOICE), bool)
    spots = np.flatnonzero(asked & (speaker == np.arange(len(rows))))
    while len(spots):
        # A range ends with an anchor.
        end = min(len(spots), FAMILY)
        end += int(np.searchsorted(group[spots[end:]], group[spots[end - 1]], side="right")) if end < len(spots) else 0
        some, spots = spots[:end], spots[end:]
        some = some[np.argsort(rows["doc"][some], kind="stable")]
        docs = rows["doc"][some]
        family = SuffixFamily()
        at = 0
        while at < len(some):
            stop = min(len(some), at + max(1, SUFFIX_BATCH // CHOICE))
            # A batch ends with a document.
            stop += int(np.searchsorted(docs[stop:], docs[stop - 1], side="right"))
            part = rows[some[at:stop]]
            many = part["high"].astype("int64") - part["low"] + 1
            row = np.repeat(np.arange(len(part)), many)
            shift = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + part["low"][row]
            hit = family.add(_bytes(part).ravel(), row * AROUND + shift, part["doc"][row])
            out[some[at:stop][row[hit]], shift[hit]] = True
            at = stop
    return out


def _covered(rows: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Merged spans of the entries' matches that are marked."""
    parts = [np.zeros(0, SPAN)]
    for k in range(0, len(rows), 100_000):
        some, hit = rows[k : k + 100_000], hits[k : k + 100_000]
        wide = np.pad(hit, ((0, 0), (1, 1)))
        row, start = np.nonzero(hit & ~wide[:, :-2])
        _, end = np.nonzero(hit & ~wide[:, 2:])
        begin = -(CHOICE - 1)
        parts.append(_merged(_spans(some["doc"][row], some["mark"][row], some["pos"][row].astype("int64") + begin + start, some["last"][row].astype("int64") + begin + end + MATCH)))
    return np.concatenate(parts)


def _ask(cells: int, index_cells: int, buckets: int, hot_shared):
    """A haul with its answers: what may repeat goes to the index cells; what the haul's own family settles goes out as spans."""

    def run(pdf: pd.DataFrame, home: pd.DataFrame) -> pd.DataFrame:
        hot = pickle.loads(hot_shared.value)
        asked = np.sort(np.concatenate([np.zeros(0, "uint64"), *(np.uint64(c) << np.uint64(32) | remainders(b).astype("uint64") for c, b in zip(pdf["cell"], pdf["blob"]))]))
        kinds, places, blobs = [], [], []
        held: dict[bool, list[np.ndarray]] = {False: [], True: []}

        def give(kind: int, place: np.ndarray, rows: np.ndarray) -> None:
            for p, blob in _by(place, rows):
                kinds.append(kind)
                places.append(p)
                blobs.append(blob)

        def deal(whole: bool) -> None:
            """Entries held so far: those that repeat an earlier document of the haul are settled, the others go to their cells."""
            rows = np.concatenate([np.zeros(0, ENTRY), *held[whole]])
            held[whole].clear()
            if not len(rows):
                return
            rows, group, speaker = _grouped(rows)
            first = np.maximum.accumulate(np.where(_same(rows, "low", "high", "data"), 0, np.arange(len(rows))))
            later = speaker != first
            asked = np.zeros(len(rows), bool)
            asked[first[later]] = asked[speaker[later]] = True
            hits = _matches(rows, group, speaker, asked)
            over = _covered(rows[later], hits[speaker[later]])
            give(1, _bucket(over["doc"], buckets), over)
            rows = rows[~later]
            rows = rows[np.lexsort((rows["pos"], rows["doc"]))]
            # A common anchor would fill a cell: its strings go where their own bytes send them.
            key = _string_of(rows) if whole else _anchor_of(rows)
            give(0, ((key >> np.uint64(20)) % np.uint64(index_cells)).astype("int64"), rows)

        def hold(whole: bool, rows: np.ndarray) -> None:
            held[whole].append(rows)
            if sum(map(len, held[whole])) > HELD:
                deal(whole)

        for blob in home.sort_values("part")["blob"]:
            data, edges, ids, copies = unpacked(blob)
            edges, doc_of = np.frombuffer(edges, "<i8").tolist(), np.frombuffer(ids, "<i8")
            texts = [data[a:b] for a, b in zip(edges, edges[1:])]
            crc = np.array([zlib.crc32(t) for t in texts], dtype="uint32")
            if copies:
                doc, mark, size = np.frombuffer(copies, "<i8").reshape(-1, 3).T
                give(1, _bucket(doc, buckets), _spans(doc, mark, np.zeros(len(doc)), size))
            for who, base, parts in pieces(texts):
                who, base = np.array(who, "int64"), np.array(base, "int64")
                raw, starts = joined(parts)
                place, owner, key, low, high = anchors(raw, starts)
                heat = is_hot(hot, key)
                take = ~heat & is_hot(asked, ((key >> np.uint64(32)) % np.uint64(cells)) << np.uint64(32) | (key & np.uint64(0xFFFFFFFF)))
                padded = np.concatenate([np.zeros(AROUND, "uint8"), raw, np.zeros(AROUND, "uint8")])
                seen = np.lib.stride_tricks.sliding_window_view(padded, AROUND)
                at, own = place[take], owner[take]
                hold(False, _entries(seen, at, doc=doc_of[who[own]], mark=crc[who[own]], pos=at - starts[own] + base[own], low=low[take], high=high[take]))
                if heat.any():
                    need = np.zeros(len(raw) + 1, "int32")
                    begin = place[heat] - (CHOICE - 1)
                    np.add.at(need, begin + low[heat], 1)
                    np.add.at(need, begin + high[heat] + 1, -1)
                    at = np.flatnonzero(np.cumsum(need[:-1]) > 0)
                    own = np.searchsorted(starts, at, side="right") - 1
                    fits = at + MATCH <= starts[own + 1]
                    # A string stands as an entry whose only match starts with its bytes.
                    for k in range(0, len(at), 200_000):
                        a, o = at[k : k + 200_000][fits[k : k + 200_000]], own[k : k + 200_000][fits[k : k + 200_000]]
                        none = np.zeros(len(a), "u1")
                        hold(True, _entries(seen, a + CHOICE - 1, doc=doc_of[who[o]], mark=crc[who[o]], pos=a + CHOICE - 1 - starts[o] + base[o], low=none, high=none))
        deal(False)
        deal(True)
        trim()
        return pd.DataFrame({"kind": np.array(kinds, dtype="int32"), "place": np.array(places, dtype="int64"), "blob": blobs})

    return run


def _string_of(rows: np.ndarray) -> np.ndarray:
    """A number for the first ``MATCH`` bytes of each entry's data."""
    data = np.zeros((len(rows), 8 * -(-MATCH // 8)), "uint8")
    data[:, :MATCH] = _bytes(rows)[:, :MATCH]
    out = np.zeros(len(rows), "uint64")
    for word in data.view("<u8").T:
        out = mix64(out + word)
    return out


def _merged(spans: np.ndarray) -> np.ndarray:
    """Spans of each document joined where they touch."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["mark"], spans["doc"]))]
    fresh = np.r_[True, (spans["doc"][1:] != spans["doc"][:-1]) | (spans["mark"][1:] != spans["mark"][:-1])]
    # Ends counted on from document to document, so that a running maximum does not reach over.
    shift = (np.cumsum(fresh) - 1).astype("int64") << 33
    reach = np.maximum.accumulate(spans["end"].astype("int64") + shift)
    cut = np.r_[True, spans["start"][1:].astype("int64") + shift[1:] > reach[:-1]]
    at = np.flatnonzero(cut)
    out = spans[at]
    last = np.r_[at[1:], len(spans)] - 1
    out["end"] = reach[last] - shift[at]
    return out


def _index_cell(buckets: int):
    """All shared anchors of an index cell: suffix families, range by range of anchors, decide what repeats."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["kind"].iloc[0] == 1:  # settled already
            return pdf[["place", "blob"]]
        rows, group, speaker = _grouped(_rows(pdf["blob"], ENTRY))
        # An anchor with one speaker has nothing to match.
        speaks = np.bincount(group, speaker == np.arange(len(rows)))
        hits = _matches(rows, group, speaker, speaks[group] > 1)
        found = _merged(_covered(rows, hits[speaker]))
        out = [*_by(_bucket(found["doc"], buckets), found)]
        del rows, group, speaker, hits
        trim()
        return pd.DataFrame({"place": np.array([p for p, _ in out], dtype="int64"), "blob": [b for _, b in out]})

    return run


def _per_document(pdf: pd.DataFrame) -> pd.DataFrame:
    spans = _merged(_rows(pdf["blob"], SPAN))
    cuts = np.flatnonzero(np.r_[True, (spans["doc"][1:] != spans["doc"][:-1]) | (spans["mark"][1:] != spans["mark"][:-1])])
    ends = np.r_[cuts[1:], len(spans)]
    pairs = np.stack([spans["start"], spans["end"]], axis=1).astype("<u4")
    return pd.DataFrame({"id": spans["doc"][cuts], "mark": spans["mark"][cuts].astype("int64"), "spans": [pairs[a:b].tobytes() for a, b in zip(cuts, ends)]})


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, mark, spans): merged byte ranges of each text that repeat from documents with smaller ids; mark is the text's crc32."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_bytes(F.col("text")).alias("data"))
    total = rows.agg(F.sum(F.octet_length("data")).alias("b")).first().b or 0
    expected = total * 2 / (CHOICE + 1)
    cells = max(4, int(expected / CELL) + 1)
    index_cells = max(4, int(expected * 0.3 / INDEX_CELL) + 1)
    buckets = max(4, int(total / (16 << 20)) + 1)
    hot = hot_keys(rows, anchor_keys)
    answered = _cell_rows(rows, cells, hot).groupBy("cell").applyInPandas(census_cell, "block long, cell long, blob binary")
    # Both scans run in stages of their own, where a haul has the same number.
    asked = answered.groupBy("block").cogroup(_home_rows(rows).groupBy("block")).applyInPandas(_ask(cells, index_cells, buckets, share(spark, hot)), "kind int, place long, blob binary")
    found = asked.groupBy("kind", "place").applyInPandas(_index_cell(buckets), "place long, blob binary")
    return written(found.groupBy("place").applyInPandas(_per_document, "id long, mark long, spans binary"), "suffix-spans")


def cut_spans(text: bytes, spans: bytes | None) -> tuple[bytes, int, int]:
    """What is left of a text, bytes removed, and number of runs removed."""
    if not spans:
        return text, 0, 0
    pairs = np.frombuffer(spans, "<u4").reshape(-1, 2).tolist()
    kept, at = [], 0
    for a, b in pairs:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    left = b"".join(kept)
    return left, len(text) - len(left), len(pairs)


def remove_repeats(docs: DataFrame, columns: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """Removes from each text all bytes covered by 50-byte strings that also start in a document with a smaller id.

    Returns (doc_id, n_bytes, n_removed, n_spans, kept, and ``columns`` of the
    input), one row per document; ``kept`` is the binary rest, or with ``as_text``
    the rest as text without the bytes of characters that were cut in part. Strings are
    judged on the input, on UTF-8 bytes of whole texts, and never cross texts.

    The suffix space is dealt to cells by anchors: each 50-byte string chooses,
    from its own bytes alone, pieces of 24 bytes. A census leaves anchors that
    two or more texts hold; these, with the bytes around them, meet in index
    cells, where batches in id order get suffix arrays and are merge-scanned
    against a logarithmic family of earlier ones. Anchors that a sample shows to
    be very common send each whole string to a cell of its own instead. A haul
    of documents first asks a family of its own, so a cell gets one entry a haul
    of what many texts repeat, and a text that repeats itself at short distance
    sends one entry for the run. Hashes only choose who meets; a match is always
    found by a suffix family on the bytes, or is that of an equal whole text in
    the same block. Long texts are read in overlapping parts. Texts are shuffled
    once to meet the answers, and only those with something to remove a second time.

    Null text: no bytes. Null id: nothing is removed from the document and it
    removes nothing. Rows that repeat an id do not repeat each other; equal ones
    among them lose the same bytes (different ones are told apart by crc32).
    ``columns`` may have any names. An empty table gives no rows. Texts below 4 GB.
    """
    spark = docs.sparkSession
    more = columns or []
    spans = repeated_spans(docs)
    bits = share(spark, id_filter(spans, "id"))
    rows = docs.select("doc_id", text_bytes(F.col("text")).alias("data"), F.when(F.col("doc_id").isNotNull(), spot_of("doc_id")).otherwise(-1).alias("spot"), F.struct(F.lit(None).cast("boolean").alias("_"), *(F.col(f"`{c}`") for c in more)).alias("more"))
    extra = f"more {dict(rows.dtypes)['more']}"

    def finished(batch: pa.RecordBatch, cuts: list[bytes | None]) -> pa.RecordBatch:
        left = [cut_spans(t.as_py(), cut) for t, cut in zip(batch.column(1), cuts)]
        arrays = [batch.column(0), pa.array([len(x) + n for x, n, _ in left], pa.int64()), pa.array([n for _, n, _ in left], pa.int64()), pa.array([k for _, _, k in left], pa.int64())]
        kept = pa.array([x.decode("utf-8", "ignore") for x, _, _ in left], pa.string()) if as_text else pa.array([x for x, _, _ in left], pa.binary())
        return pa.RecordBatch.from_arrays([*arrays, kept, batch.column(3)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "more"])

    def listed(batch: pa.RecordBatch) -> np.ndarray:
        spot = batch.column(2).to_numpy()
        return (spot >= 0) & may_hold(pickle.loads(bits.value), np.maximum(spot, 0))

    # Each stage has one Python step, so an executor runs one worker a core.
    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(~listed(batch)))
            yield finished(some, [None] * some.num_rows)
            trim()

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(listed(batch)))
            trim()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield finished(batch, batch.column(2).to_pylist())
            trim()

    out = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}, {extra}"
    some = rows.mapInArrow(rest, f"doc_id long, data binary, spot long, {extra}").withColumn("_mark", F.crc32("data"))
    some = some.join(spans, (F.col("doc_id") == F.col("id")) & (F.col("_mark") == F.col("mark")), "left").select("doc_id", "data", "spans", "more")
    found = rows.mapInArrow(plain, out).union(some.mapInArrow(cut, out))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept", *(F.col("more")[c].alias(c) for c in more))
