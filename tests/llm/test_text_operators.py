"""Operators 1, 2, 5, 6, 9 against plain Python, with nulls, ties, repeated rows, clashing columns and empty tables."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordloom.llm import lm_scoring, mixing, packing, quality_rules, sharding

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu the of and Été ñandú".split()


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 3, 20, 60]))), rng.choice(["a", "b", "c", None, "é"])) for i in range(n)]
    rows += [(n, None, "a"), (n + 1, "", "b"), (n + 2, " \t\n ", None), (None, "null id here", "c"), (5, rows[5][1], rows[5][2]), (n + 3, "word " * 3000, "a"), (n + 4, rows[3][1], "z"), (n + 5, "nbsp inside  x", "z")]
    return rows


def frame(spark, rows):
    # Columns with names that the operators use inside.
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({"size": F.lit("x"), "word": F.lit(1), "_b": F.lit(None).cast("int"), "data": F.lit("y"), "rank": F.lit(0)}).repartition(3)


def words(text):
    return (text or "").encode().split()


def test_mixing(spark):
    rows = corpus()
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        left = goal - sum(target.values())
        level = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if level[s] > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    target |= level
    most = max(len(words(t)) for _, t, _ in rows)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= most for s in sizes)
    again = {(r.doc_id, r.size, r.source): r.taken for r in mixing.mix(frame(spark, rows).repartition(2)).collect()}
    assert again == {(r.doc_id, r.size, r.source): r.taken for r in got}
    texts = mixing.mixed_texts(frame(spark, rows))
    assert texts.count() == sum(r.copies for r in got) and "rank" in texts.columns
    assert mixing.mix(frame(spark, rows[:0])).count() == 0
    assert [r.taken for r in mixing.mix(frame(spark, [(1, None, "a")])).collect()] == [0]


def test_water_levels_share_what_caps_leave(spark):
    s = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.water_levels(s, (3, 1, 2), 1.5, 2.0).collect()}
    assert got["a"] == 20 and got["b"] + got["c"] == pytest.approx(3015 - 20) and got["c"] == pytest.approx(2 * got["b"]) or got["c"] == 2000


def test_sharding(spark):
    rows = corpus(2, 400)
    got = sharding.shard(frame(spark, rows), 8).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    want = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for r in got:
        by[r.shard].append(r)
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s, part in by.items():
        assert 0 <= s < 8 and sorted(r.slot for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 8) <= most
    again = {(r.doc_id, r.text_crc32, r["size"]): r.shard for r in sharding.shard(frame(spark, rows).repartition(5), 8).collect()}
    assert again == {(r.doc_id, r.text_crc32, r["size"]): r.shard for r in got}
    assert sharding.shard(frame(spark, rows[:0])).count() == 0


def test_sharding_of_one_text(spark):
    rows = [(i, "same text", "a") for i in range(300)]
    by = collections.Counter(r.shard for r in sharding.shard(frame(spark, rows), 5).collect())
    assert max(by.values()) - min(by.values()) <= 2 and len(by) == 5


def test_sharding_of_one_row_many_times(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 40)
    rows = spark.range(900).select(F.when(F.col("id") < 700, 5).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 700, "same").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    got = sharding.shard(rows, 6).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    total = sum(r["size"] for r in got)
    assert len(got) == 900 and len(by) == 6 and sum(r.doc_id == 5 for r in got) == 700
    assert all(sorted(r.slot for r in part) == list(range(len(part))) and abs(sum(r["size"] for r in part) - total / 6) <= 24 for part in by.values())


def test_sharding_of_many_repeated_rows(spark):
    words = frame(spark, [(i, f"text {i} " + "x" * (i % 7), "a") for i in range(600)])
    rows = words.crossJoin(spark.range(200).select(F.lit(0).alias("copy"))).select("doc_id", "text")
    plain = spark.range(10_000, 30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("plain "), "id").alias("text"))
    for docs in (rows, rows.filter("doc_id < 20").unionByName(plain)):
        got = sharding.shard(docs, 8)
        want = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
        assert want.join(got.groupBy("doc_id").agg(F.count("*").alias("m")), "doc_id", "left").filter("m IS NULL OR n <> m").count() == 0
        by = got.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last"), F.max("size").alias("most")).collect()
        total = sum(r.bytes for r in by)
        assert len(by) == 8 and all(r.n == r.slots == r.last + 1 and abs(r.bytes - total / 8) <= max(x.most for x in by) for r in by)


@pytest.mark.parametrize("seed", range(6))
def test_bin_plan(seed):
    rng = random.Random(seed)
    cap = rng.choice([7, 30, 100])
    counts = collections.Counter(min(cap, 1 + int(rng.expovariate(3 / cap))) for _ in range(rng.randrange(1, 300)))
    slots, bins = packing.plan_bins(dict(counts), cap)
    filled, used = collections.defaultdict(list), collections.Counter()
    for size, start, n, first, each, offset in sorted(slots):
        assert start == used[size]
        used[size] += n
        for j in range(n):
            filled[first + j // each].append((offset + j % each * size, size))
    assert used == counts and set(filled) == set(range(bins))
    for items in filled.values():
        at = 0
        for offset, size in sorted(items):
            assert offset == at
            at += size
        assert at <= cap and sum(3 * s > cap for _, s in items) <= 2
    assert bins <= math.ceil(sum(s * n for s, n in counts.items()) / cap) * 1.25 + 2


def test_packing(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = corpus(3)
    rows += [(900, "a<|endoftext|>b <|ENDOFTEXT|>", "a"), (901, "x,. y. é, don't 12a. İ ΣΑΣ", "a")]
    got = packing.pack(frame(spark, rows), path, 64).collect()
    want = collections.Counter()
    for i, t, _ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            part = np.array(ids[k : k + 64], "<u4").tobytes()
            want[i, k // 64, k, len(part) // 4, zlib.crc32(part)] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= sum(r.length for r in got) / 64 * 1.1 + 2
    assert packing.pack(frame(spark, rows[:0]), path).count() == 0


def test_tokenizer_forgets_without_harm():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    texts = [t or "" for _, t, _ in corpus(4)]
    before, packing.REMEMBERED = packing.REMEMBERED, 3
    try:
        tok = packing.WordTokenizer(open(path, encoding="utf-8").read())
        got = []
        for k in range(0, len(texts), 7):
            ids, ends = tok.block(pa.array(texts[k : k + 7]))
            got += [x.tolist() for x in np.split(ids, ends[:-1])]
    finally:
        packing.REMEMBERED = before
    assert got == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def plain_measures(t):
    w = (t or "").encode().split()
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_rules(spark):
    rows = corpus(5) + [(700, "a b c a b c", "a"), (701, "x x x x", "a"), (702, "l1\nl1\n\n \nl2 |%", "a"), (703, "HEY!! " * 60, "a"), (704, " ".join(f"word{i}" for i in range(60)), "a")]
    led = quality_rules.ledger(frame(spark, rows))
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in led.collect()}
    assert got == {(i, *plain_measures(t)) for i, t, _ in rows}
    ok = {r.doc_id: r.failures for r in led.collect()}
    assert ok[704] == 0 and ok[703] & quality_rules.policy_mask(["shouting", "exclamations"]) == quality_rules.policy_mask(["shouting", "exclamations"])
    policy = quality_rules.POLICIES[2]
    kept = led.filter(quality_rules.passes(policy)).count()
    mask = quality_rules.policy_mask(policy)
    for r in quality_rules.ablations(led, policy).collect():
        bit = quality_rules.policy_mask([r.rule])
        assert r.failing == sum(f & bit != 0 for f in (x.failures for x in led.collect()))
        assert r.kept_without == kept + r.only_failing == sum(f & (mask & ~bit) == 0 for f in (x.failures for x in led.collect()))
    assert quality_rules.ledger(frame(spark, rows[:0])).count() == 0


def test_repeat_words_with_many_words():
    w = [str(i).encode() for i in range(3000)]
    assert quality_rules.repeat_words(w + [b"a", b"b", b"c"] * 2) == (6, 3003)


def test_language_model(spark):
    rows = corpus(6, 200) + [(i, f"rare{i} alpha beta", "a") for i in range(1000, 1040)]
    before = lm_scoring.HEAD
    lm_scoring.HEAD = 12  # most words take the join
    try:
        got = lm_scoring.score(frame(spark, rows)).collect()
    finally:
        lm_scoring.HEAD = before
    counts, train = collections.Counter(), 0
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    tokens = lambda t: [x.lower() for x in (t or "").encode().split()] + [None]
    for i, t, _ in rows:
        if not held(i):
            counts.update(tokens(t))
            train += len(tokens(t))
    base = lambda x: math.log10((counts[x] + 0.5) / (train + 0.5 * (len(counts) + 1)))
    want = sorted((-1 if i is None else i, held(i), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), round(sum(map(base, tokens(t))), 6)) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {train} and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm_scoring.score(frame(spark, rows[:0])).count() == 0


def test_language_model_trains_on_every_token(spark, monkeypatch):
    rows = corpus(6, 200)
    averaged, seen = lm_scoring._averaged, []

    def counting(replicas, count):
        seen.append(replicas.agg(F.sum("examples")).first()[0])
        return averaged(replicas, count)

    monkeypatch.setattr(lm_scoring, "_averaged", counting)
    got = lm_scoring.score(frame(spark, rows).repartition(3)).collect()
    assert sum(seen) == got[0].train_tokens and min(seen) > 0.4 * sum(seen)


def test_language_model_scores_are_plain_products(spark, monkeypatch):
    """Every score against a softmax over all outputs, token by token; two partitionings give the same scores."""
    monkeypatch.setattr(lm_scoring, "HEAD", 14)
    monkeypatch.setattr(lm_scoring, "SHARE", 700)
    train, kept = lm_scoring._train, {}

    def keeping(spark, docs, lexicon):
        kept["lexicon"], kept["weights"] = lexicon, train(spark, docs, lexicon)
        return kept["weights"]

    monkeypatch.setattr(lm_scoring, "_train", keeping)
    rows = corpus(7, 150) + [(i, f"rare{i} alpha rare{i % 7} beta", "a") for i in range(2000, 2030)]
    got = {(r.doc_id, r.n_tokens, round(r.base_score, 6)): r.score for r in lm_scoring.score(frame(spark, rows)).collect()}
    again = {(r.doc_id, r.n_tokens, round(r.base_score, 6)): r.score for r in lm_scoring.score(frame(spark, rows).repartition(7)).collect()}
    assert got == again
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = collections.Counter(x for i, t, _ in rows if not held(i) for x in (t or "").lower().encode().split())
    lex = kept["lexicon"]
    model = lm_scoring.LogBilinear(lex.unigram).load(kept["weights"])
    place = {w.encode(): k for k, w in enumerate(lex.words[: lm_scoring.WORDS])}
    kind = lambda w: place.get(w, lm_scoring.WORDS + lm_scoring.ending_class(w))
    for i, t, _ in rows[:40] + rows[-35:]:
        w1 = w2 = lm_scoring.BEGIN
        total = base = 0.0
        words_ = (t or "").lower().encode().split()
        for w in [*words_, None]:
            k = lm_scoring.END if w is None else kind(w)
            logits = model.r.astype("float64") @ (model.q[w1].astype("float64") @ model.c[0] + model.q[w2].astype("float64") @ model.c[1]) + model.b
            total += (logits[k] - logits.max() - math.log(np.exp(logits - logits.max()).sum())) / math.log(10)
            if w is not None and w not in place:
                mine = [x for x in counts if x not in place and kind(x) == k]
                total += math.log10((counts[w] + 0.5) / (sum(counts[x] for x in mine) + 0.5 * (len(mine) + 1)))
            w1, w2 = k, w1
        assert any(key[0] == i and key[1] == len(words_) + 1 and score == pytest.approx(total, rel=1e-4, abs=1e-3) for key, score in got.items())


def test_language_model_is_normalised():
    unigram = np.random.default_rng(0).random(lm_scoring.OUTPUTS)
    model = lm_scoring.LogBilinear(unigram / unigram.sum())
    s1, s2, logz = model.tables()
    for a, b in ((0, 1), (lm_scoring.BEGIN, 7), (lm_scoring.END, lm_scoring.WORDS)):
        assert np.exp(s1[a] + s2[b] - logz[a, b]).sum() == pytest.approx(1, abs=1e-4)


def test_language_model_learns_order():
    rng = np.random.default_rng(1)
    unigram = np.full(lm_scoring.OUTPUTS, 1e-6)
    unigram[:10] = 0.1
    w1 = rng.integers(0, 10, 40_000).astype("int32")
    w = (w1 + 1) % 10
    model = lm_scoring.LogBilinear(unigram / unigram.sum())
    lm_scoring.Replica(model, unigram, 0).learn(w, w1, w1)
    s1, s2, logz = model.tables()
    assert np.mean(s1[w1, w] + s2[w1, w] - logz[w1, w1]) > math.log(0.3)
