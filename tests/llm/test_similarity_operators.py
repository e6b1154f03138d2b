"""Operators 3, 4, 7, 8, 10 and the pipeline against brute force or held-out labels."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordloom.llm import census, embedding_dedup, ngram_join, quality_classifier, suffix_dedup, toxicity
from recordloom.llm.common import components, packed, unpacked


def plain_components(nodes, edges):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {x: find(x) for x in nodes}


def text(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def copies(seed=1):
    """Texts with exact copies, near copies, chains of edits, shared passages, short and odd ones."""
    rng = random.Random(seed)
    rows = [text(rng, rng.choice([8, 30, 80])) for _ in range(25)]
    passage = text(rng, 40)
    for base in rows[:8]:
        w = base.split()
        rows.append(base)
        for _ in range(4):
            v = list(w)
            for _ in range(rng.choice([1, 2, 4])):
                v[rng.randrange(len(v))] = f"new{rng.randrange(99)}"
            rows.append(" ".join(v))
        chain = list(w)
        for k in range(5):
            chain = chain[:-1] + [f"c{k}{len(rows)}"]
            rows.append(" ".join(chain))
    rows += [f"{passage} {text(rng, n)}" for n in (0, 2, 10, 60)] + [f"{text(rng, n)} {passage}" for n in (1, 12, 30)]
    rows += ["", None, "  \n", "one", "One", "a b c d", "A b C d", "a b c d e", "aaaa " * 200, "aaaa " * 190, "x" * 300, "y" + "x" * 300]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return sorted(zip(ids, rows))


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"n": F.lit("x"), "cell": F.lit(1), "data": F.lit("y"), "spans": F.lit(0), "key": F.lit(2)}).repartition(3)


def shingle_set(t):
    w = [x.lower() for x in (t or "").encode().split()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("seed, share", [(1, None), (2, None), (3, 0.02)])
def test_jaccard_join(spark, monkeypatch, seed, share):
    if share:  # every frequent shingle is hot
        monkeypatch.setattr(census, "SAMPLE", 1)
        monkeypatch.setattr(census, "HOT_SHARE", share)
        monkeypatch.setattr(census, "HOT_LEAST", 2)
        monkeypatch.setattr(census, "BLOB", 3)
        monkeypatch.setattr(ngram_join, "FAN", 2)
    rows = copies(seed)
    sets = {i: shingle_set(t) for i, t in rows}
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = plain_components(ids, links)
    got = ngram_join.near_duplicates(frame(spark, rows)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(sets[i]), want[i]) for i in ids} and len(got) == len(rows)


def test_jaccard_join_edges(spark):
    t = "one two three four five six"
    rows = [(None, t), (4, t), (4, t), (9, t.upper()), (None, "other words here now ok")]
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame(spark, rows)).collect())
    assert got == [(-1, 1, None), (-1, 2, 4), (4, 2, 4), (4, 2, 4), (9, 2, 4)]
    assert ngram_join.near_duplicates(frame(spark, rows[:0])).count() == 0
    assert ngram_join.near_duplicates(frame(spark, [(1, None)])).first().component_id == 1


def brute_spans(rows):
    seen, out = set(), {}
    for i, t in sorted((i, (t or "").encode()) for i, t in rows):
        grams = [t[k : k + 50] for k in range(len(t) - 49)]
        hit = np.zeros(len(t) + 1, bool)
        for k, g in enumerate(grams):
            if g in seen:
                hit[k : k + 50] = True
        seen.update(grams)
        kept = bytes(b for b, h in zip(t, hit) if not h)
        out[i] = (len(t), int(hit.sum()), int((hit[1:] & ~hit[:-1]).sum() + (hit[0] if len(t) else 0)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed, share", [(1, None), (4, 0.02)])
def test_suffix_dedup(spark, monkeypatch, seed, share):
    if share:
        monkeypatch.setattr(census, "SAMPLE", 1)
        monkeypatch.setattr(census, "HOT_SHARE", share)
        monkeypatch.setattr(census, "HOT_LEAST", 2)
        monkeypatch.setattr(census, "BLOB", 3)
        monkeypatch.setattr(suffix_dedup, "SUFFIX_BATCH", 27)
    rows = copies(seed)
    rng = random.Random(seed)
    long = "".join(rng.choice("abcdé ") for _ in range(500))
    rows += [(1000 + n, "z" * k + long[100 : 100 + n] + "q" * k) for k, n in enumerate((49, 50, 51, 63, 200))] + [(2000, long), (999, long[:120]), (3000, "\x00" * 120), (3001, "\x00" * 60)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == brute_spans(rows)


@pytest.mark.parametrize("share", [None, 0.02])
def test_suffix_dedup_periodic(spark, monkeypatch, share):
    if share:
        monkeypatch.setattr(census, "SAMPLE", 1)
        monkeypatch.setattr(census, "HOT_SHARE", share)
        monkeypatch.setattr(census, "HOT_LEAST", 2)
        monkeypatch.setattr(census, "BLOB", 3)
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    monkeypatch.setattr(suffix_dedup, "HELD", 40)
    monkeypatch.setattr(suffix_dedup, "FAMILY", 3)
    rng = random.Random(2)
    line = "".join(rng.choice("abcdefgh ") for _ in range(70)) + "\n"
    rows = [(1, "-" * 900), (2, "x" + "-" * 2000 + "y"), (3, "0123456" * 150), (4, "ab" + "0123456" * 60), (5, line * 30), (6, line[:40] + line * 9), (7, line[20:] + line[:60]), (8, "-" * 49), (9, ("-" * 30 + "=" * 10) * 40), (10, ("-" * 30 + "=" * 10) * 3 + "-" * 60), (11, "")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == brute_spans(rows)


def test_periodic_text_is_one_entry():
    raw, starts = suffix_dedup.joined([b"-" * 100_000])
    place, _, _, low, high = suffix_dedup.anchors(raw, starts)
    padded = np.concatenate([np.zeros(suffix_dedup.AROUND, "uint8"), raw, np.zeros(suffix_dedup.AROUND, "uint8")])
    seen = np.lib.stride_tricks.sliding_window_view(padded, suffix_dedup.AROUND)
    zero = np.zeros(len(place), "int64")
    rows = suffix_dedup._grouped(suffix_dedup._entries(seen, place, doc=zero, mark=zero, pos=place, low=low, high=high))[0]
    assert len(place) > 90_000 and len(rows) < 60


def test_suffix_dedup_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a" * 60, 1, 2, 3, 4, 5), (2, "b" + "a" * 60, 6, 7, 8, 9, 10)], "doc_id long, text string, id int, mark int, data int, spot int, more int")
    out = suffix_dedup.remove_repeats(rows, ["id", "mark", "data", "spot", "more"]).orderBy("doc_id").collect()
    assert [(r.n_removed, r.id, r.mark, r.data, r.spot, r.more) for r in out] == [(0, 1, 2, 3, 4, 5), (60, 6, 7, 8, 9, 10)]


def test_suffix_dedup_edges(spark):
    t = "0123456789" * 8
    rows = [(None, t), (3, t), (3, t), (7, t), (None, t)]
    out = suffix_dedup.remove_repeats(frame(spark, rows), ["cell"]).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed) for r in out) == [(-1, 0), (-1, 0), (3, 0), (3, 0), (7, 80)] and out[0].cell == 1
    assert suffix_dedup.remove_repeats(frame(spark, rows[:0])).count() == 0
    assert suffix_dedup.remove_repeats(frame(spark, [(1, None)])).first().n_bytes == 0


def test_suffix_family_keeps_few_levels():
    rng = random.Random(5)
    family, seen = suffix_dedup.SuffixFamily(), {}
    for batch in range(40):
        docs = np.repeat([2 * batch, 2 * batch + 1], 8)
        words = np.array([str(rng.randrange(60)).rjust(50, "x").encode() for _ in docs])
        hit = family.add(np.frombuffer(b"".join(words), "uint8"), np.arange(len(words)) * 50, docs)
        for w, d, h in zip(words, docs, hit):
            seen.setdefault(w, set()).add(d)
        assert hit.tolist() == [min(seen[w]) < d for w, d in zip(words, docs)]
        assert len(family.levels) <= 8 and all((np.sort(x) == x).all() and len(np.unique(x)) == len(x) for x in family.levels)


def test_blobs():
    a, b = np.arange(5, dtype="<u4"), np.zeros(0, "u1")
    assert unpacked(packed(a, b)) == [a.tobytes(), b""] and unpacked(packed(b)) == [b""]


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 6))
    rows = [(int(i), [float(x) for x in centres[rng.integers(12)] + rng.standard_normal(6) * 0.15], int(rng.integers(2))) for i in range(160)]
    rows += [(500, None, 1), (501, [0.0] * 6, 1), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (503, [float("nan")] + [1.0] * 5, 1), (504, rows[0][1], None), (505, rows[0][1], rows[0][2]), (506, [], 1), (507, [1.0, 2.0], 1), (508, [float("inf")] * 6, 0)]
    return rows


@pytest.mark.parametrize("per_pivot, block", [(1500, 4096), (20, 4096), (15, 7)])
def test_embedding_join(spark, monkeypatch, per_pivot, block):
    monkeypatch.setattr(embedding_dedup, "PER_PIVOT", per_pivot)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = vectors()
    good = {i: np.array(v, float) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: lab for i, _, lab in rows}
    links = [(a, b) for a in good for b in good if a < b and label[a] == label[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.93]
    many = collections.Counter(x for e in links for x in e)
    want = plain_components(list(label), links)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cell", F.lit("x"))
    got = embedding_dedup.near_duplicates(df, 0.93).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(i, many[i], want[i], want[i] == i) for i in label} and len(links) > 50


def test_embedding_join_edges(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (2, [1.0, 0.01], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()) == [(-1, 0, None, True), (1, 1, 1, True), (2, 1, 1, False)]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_join_of_equal_vectors(spark, monkeypatch):
    """A hot vector is one class: blocks see it once, and links count all its copies."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    monkeypatch.setattr(embedding_dedup, "PER_PIVOT", 10)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 5))
    rows = [(k, base[k].tolist(), 0) for k in range(30)] + [(100 + k, base[7].tolist(), 0) for k in range(300)] + [(500 + k, base[7].tolist(), 1) for k in range(5)]
    rows += [(100, base[9].tolist(), 0), (100, base[7].tolist(), 0), (600, (base[9] * 2).tolist(), 0), (8, None, 1)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want = {tuple(r[:1]) + (tuple(r[1] or ()), r[2]) for r in rows}
    assert len(got) == len(want)
    unit = {w: np.array(w[1]) / np.linalg.norm(w[1]) for w in want if w[1]}
    links = {w: sum(1 for o in unit if o != w and o[2] == w[2] and unit[o] @ unit[w] >= 0.93) if w in unit else 0 for w in want}
    pairs = [(w[0], o[0]) for w in unit for o in unit if o[2] == w[2] and unit[o] @ unit[w] >= 0.93]
    component = plain_components({r[0] for r in rows}, pairs)
    assert collections.Counter((r.vec_id, r.n_links, r.component_id) for r in got) == collections.Counter((w[0], links[w], component[w[0]]) for w in want)


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(30)], [], [(3, 3), (9, 3)], [(0, i) for i in range(1, 20)] + [(19, 40), (41, 40)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long")
    nodes = {x for e in edges for x in e}
    assert {r.id: r.component for r in components(df).collect()} == plain_components(nodes, edges)


def accuracy(spark, data, module, column, threshold):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = module.fit(docs, labels)
    got = module.classify(docs, model).join(labels, "doc_id").select("predicted", column, "score").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in got)
    return sum(r.predicted == r[column] for r in got) / len(got), model


def test_quality(spark, data):
    share, model = accuracy(spark, data, quality_classifier, "quality", 0.5)
    assert share > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (1, "a b")], "doc_id long, text string").withColumn("terms", F.lit(1))
    rows = quality_classifier.classify(odd, model).collect()
    assert len(rows) == 4 and rows[0].score == rows[1].score
    assert quality_classifier.classify(odd.limit(0), model).count() == 0
    assert quality_classifier.accepted(odd, model).columns == odd.columns
    none = quality_classifier.fit(odd, spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1)], "doc_id long, quality int"))
    assert {r.score for r in quality_classifier.classify(odd, none).collect()} == {0.5}


def test_vote_is_a_weighted_share():
    m = np.zeros((3, quality_classifier.BIGRAMS + quality_classifier.SHAPES), "float32")
    m[0, 0] = m[1, 0] = m[2, 1] = 1
    vote = quality_classifier.NeighbourVote(m, np.array([1, 1, 0]), neighbours=3)
    assert vote.score(m)[0] > 0.9 > 0.1 > vote.score(m)[2] and vote.score(np.zeros_like(m))[0] == pytest.approx(2 / 3)


def test_toxicity_learns(spark):
    rng = random.Random(2)
    bad = [f"vil{e}" for e in ("ar", "on", "um", "est", "ik", "or")]
    train, test = [], []
    for k in range(700):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 120))]
        toxic = k % 3 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(bad)
        (train if k < 550 else test).append((" ".join(w).encode(), int(toxic)))
    net = toxicity.train([t for t, _ in train], [y for _, y in train], epochs=5)
    score = toxicity.Scorer(net).score([t for t, _ in test])
    assert np.mean((score >= 0.3) == [y == 1 for _, y in test]) > 0.93
    assert toxicity.Scorer(net).score([b"", b" \n"]).tolist() == [0, 0]
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "w1 w2"), (3, "w1 " * 5000)], "doc_id long, text string").withColumn("score", F.lit("x"))
    assert toxicity.classify(odd, net).count() == 4 and toxicity.classify(odd.limit(0), net).count() == 0


def test_toxicity_reads_whole_words():
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abcdeghjkmnoprst") for _ in range(n))
    bad = ["vilarqux", "zorblify", "wyvulent"]
    train = []
    for k in range(600):
        w = [letters(rng.randrange(3, 10)) for _ in range(rng.randrange(20, 60))]
        if k % 3 == 0:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(bad) + letters(rng.randrange(4))
        train.append((" ".join(w).encode(), int(k % 3 == 0)))
    scorer = toxicity.Scorer(toxicity.train([t for t, _ in train], [y for _, y in train], epochs=5))
    tokens = [(letters(20 + k % 9), rng.choice(bad), letters(k % 5)) for k in range(60)]
    around = [[letters(6) for _ in range(20)] for _ in tokens]
    hidden = scorer.score([" ".join([*w, a + b + c]).encode() for w, (a, b, c) in zip(around, tokens)])
    clean = scorer.score([" ".join([*w, a + letters(8) + c]).encode() for w, (a, b, c) in zip(around, tokens)])
    assert np.mean(hidden >= 0.3) > 0.9 and np.mean(clean >= 0.3) < 0.1


def plain_score(net, text):
    """The highest window of a text by the plain forward pass, one window at a time."""
    words = toxicity.word_steps(text)
    top = -np.inf
    for start in toxicity.window_starts(len(words)) if words else ():
        part = words[start : start + toxicity.WINDOW]
        x = net.inputs(*toxicity.table(part))
        top = max(top, float(net.logits(net.projections(x, "f"), net.projections(x, "b"), np.arange(len(part))[None], np.array([len(part)]))[0]))
    slope, offset = net.scale
    return 1 / (1 + np.exp(-(slope * top + offset))) if words else 0.0


def test_batch_scores_are_plain_scores(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TOGETHER", 7)
    monkeypatch.setattr(toxicity, "REMEMBERED", 60)
    monkeypatch.setattr(toxicity, "LOOKED_UP", 5)
    rng = random.Random(4)
    net = toxicity.Network(9)
    net.scale = np.array([3.0, -0.5])
    texts = ["", "one", "a " * 70, "x" * 300, '"Wide, load" (ok) ... !', "日本語" * 30] + [text(rng, rng.randrange(1, 200), 90) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in toxicity.classify(rows, net).collect():
        assert r.score == pytest.approx(plain_score(net, texts[r.doc_id].encode()), abs=1e-4) and r.predicted == int(r.score >= 0.3)


def test_labelled_rows_that_repeat_or_clash(spark):
    rng = random.Random(6)
    rows = [(k, text(rng, 30) + (" vilarqux" if k % 2 else ""), 5, k % 2) for k in range(60)]
    docs = spark.createDataFrame(rows + [(1, "other text", 5, 9)] * 5, "doc_id long, text string, _id int, label int")
    docs = docs.withColumn("_label", F.lit(3)).withColumn("toxic", F.lit(1)).withColumn("quality", F.lit(0)).withColumn("data", F.lit(0))
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int").withColumn("quality", F.col("toxic"))
    one, two = (toxicity.fit(d, labels) for d in (docs, docs.repartition(5)))
    assert all((one.p[k] == two.p[k]).all() for k in one.p)
    vote, again = (quality_classifier.fit(d, labels) for d in (docs, docs.repartition(5)))
    assert (vote.known == again.known).all() and len(vote.known) == sum(1 for k in range(60) if zlib.crc32(str(k).encode()) % 3 != 1)
    assert toxicity.classify(docs, one).count() == quality_classifier.classify(docs, vote).count() == 65


def test_excerpt_of_a_long_text_is_bounded():
    words = text(random.Random(1), 20_000, 5000).encode()
    short = words[:3000]
    assert len(toxicity.excerpt(words)) == toxicity.MAX_WINDOWS and toxicity.excerpt(words) == toxicity.excerpt(words)
    assert len(toxicity.excerpt(short)) == len(toxicity.window_starts(len(toxicity.word_steps(short)))) and toxicity.excerpt(b"") == []


def test_steps_hold_every_run():
    for n in range(1, 60):
        word = bytes(range(65, 65 + n))
        parts = [word[: toxicity.REACH], *(s[1:] for s in toxicity.steps(word)[1:])]
        assert all(any(word[k : k + 8] in p for p in parts) for k in range(max(1, n - 7))) and all(len(p) <= toxicity.REACH for p in parts)


def test_toxicity_learns_from_whole_texts(spark, monkeypatch):
    """All windows of a long labelled text are learnt from; what an excerpt would hold makes no difference."""
    long = " ".join(f"w{i % 997}" for i in range(12_000))
    rows = [(4 * i, f"short text {i}", i % 2) for i in range(8)] + [(400, long, 1), (404, long + " end", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    seen = []

    class Spy(toxicity.Windows):
        def __init__(self, texts):
            super().__init__(texts)
            seen.append(np.bincount(self.owner).tolist())

    monkeypatch.setattr(toxicity, "Windows", Spy)
    toxicity.fit(docs, labels, folds=1, fold=5)
    assert seen == [[1] * 8 + [len(toxicity.window_starts(n)) for n in (12_000, 12_001)]] and seen[0][-1] > toxicity.MAX_WINDOWS
    texts = [b" ".join([b"plain%d" % (i * k % 31) for k in range(200)] + [b"vileword"] * (i % 2)) for i in range(40)]
    score = lambda: toxicity.Scorer(toxicity.train(texts, [i % 2 for i in range(40)], epochs=2)).score(texts).tolist()
    whole = score()
    monkeypatch.setattr(toxicity, "MAX_WINDOWS", 1)
    assert score() == whole


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network()
    net.p = {k: v.astype("float64") for k, v in net.p.items()}
    rows, filled = toxicity.table([b"alpha", b"beta", b"gammadelta"])
    ids = rng.integers(0, 3, (4, toxicity.WINDOW))
    args = (rows, filled, np.ones(3, bool), ids, np.array([toxicity.WINDOW, 5, 9, 1]), np.array([1.0, 0, 1, 0]), np.full(4, 0.25))
    _, g = net.gradients(*args)
    for name in ("uf", "ub", "wf", "att", "att_v", "out", "cf"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        x = net.p[name][at]
        sides = []
        for step in (1e-3, -1e-3):
            net.p[name][at] = x + step
            sides.append(net.gradients(*args)[0])
        net.p[name][at] = x
        assert (sides[0] - sides[1]) / 2e-3 == pytest.approx(g[name][at], rel=0.05, abs=1e-4)


def test_windows_cover_every_word():
    for n in (1, 31, 32, 33, 56, 57, 200):
        starts = toxicity.window_starts(n)
        assert {k for s in starts for k in range(s, min(n, s + toxicity.WINDOW))} == set(range(n)) and len(starts) == 1 + max(0, -(-(n - toxicity.WINDOW) // toxicity.STRIDE))


def test_census_counts_texts(spark):
    owner, key = ngram_join.shingles(pa.array(["a b c d e f", "b c d e f", "x"]), 5)
    assert owner.tolist() == [0, 0, 1, 2] and len(set(key.tolist())) == 3
    sliced = pa.array(["zz", "a b c d e f"]).slice(1)
    assert set(ngram_join.shingles(sliced, 5)[1]) == set(key[:2])


def test_long_texts_are_read_in_parts(monkeypatch):
    rng = random.Random(8)
    texts = [text(rng, n, 6) + end for n in (1, 3, 4, 5, 6, 30, 200) for end in ("", " ", "  \n")] + ["  " + text(rng, 50, 4), "é" * 200, "a b " + "x" * 90 + " c d e f", "", " \t "]
    whole = ngram_join.shingles(pa.array(texts), 5)
    for size in (1, 7, 40):
        monkeypatch.setattr(ngram_join, "LONG", size)
        parts = ngram_join.shingles(pa.array(texts), 5)
        assert (parts[0] == whole[0]).all() and (parts[1] == whole[1]).all()


def test_id_filter(spark):
    df = spark.range(0, 500, 3)
    bits = census.id_filter(df, "id")
    spots = [r.s for r in df.select(census.spot_of("id").alias("s")).collect()]
    assert census.may_hold(bits, np.array(spots)).all()
    assert {r.id for r in census.without(spark.range(500), df, "id").collect()} == set(range(500)) - set(range(0, 500, 3))


def staged(spark, stage, rows, data):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], columns).withColumn("label", F.lit(7))
    return [(r.doc_id, r.text, r.source, r.n_chars) for r in stage(spark, docs, data).collect()]


def test_pipeline_stages_against_plain_ones(spark, data):
    import corpus_pipeline as P

    rows = [(i, t, "ab"[(i or 0) % 2] if i != 3 else None) for i, t in copies(11)]
    rng = random.Random(11)
    passage = text(rng, 30)
    rows += [(700 + k, text(rng, 60) + " é" + passage + "ü " + text(rng, 40), "a") for k in range(4)] + [(800, None, "b"), (801, "", "b"), (None, passage * 2, "a"), (700, rows[0][1], "a")]
    size = lambda t: None if t is None else len(t)

    # Quality: the vote, text by text.
    labels = spark.read.parquet(f"{data}/labels.parquet")
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()], "doc_id long, text string")
    model = quality_classifier.fit(docs, labels)
    some = [(r.doc_id, r.text, "a") for r in docs.collect()][:60] + [(1, None, "a"), (None, "", "b")]
    want = [(i, t, s, size(t)) for i, t, s in some if one_by_one(model, (t or "").encode()) >= 0.5]
    real = quality_classifier.fit
    try:
        quality_classifier.fit = lambda *_: model
        got = staged(spark, P.quality, some, data)
    finally:
        quality_classifier.fit = real
    assert collections.Counter(got) == collections.Counter(want) and 0 < len(want) < len(some)

    # Near duplicates: components of all pairs.
    distinct = [r for k, r in enumerate(rows) if r[0] is not None and r[0] not in {x[0] for x in rows[:k]}]
    sets = {i: shingle_set(t) for i, t, _ in distinct}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    plain = plain_components(list(sets), links)
    want = [(i, t, s, size(t)) for i, t, s in distinct if plain[i] == i] + [(None, passage * 2, "a", 2 * len(passage))]
    assert collections.Counter(staged(spark, P.near_duplicates, [*distinct, rows[-2]], data)) == collections.Counter(want) and len(want) < len(distinct)

    # Repeated passages: bytes covered by strings of earlier documents, cut characters go.
    want, seen = [], set()
    for i, t, s in sorted(distinct, key=lambda r: r[0]):
        raw = (t or "").encode()
        grams = [raw[k : k + 50] for k in range(len(raw) - 49)]
        hit = np.zeros(len(raw), bool)
        for k, g in enumerate(grams):
            hit[k : k + 50] |= g in seen
        seen.update(grams)
        left = bytes(b for b, h in zip(raw, hit) if not h).decode("utf-8", "ignore") if hit.any() else t
        want.append((i, left, s, size(left)))
    got = staged(spark, P.repeated_passages, distinct, data)
    assert sorted(got) == sorted(want) if all(t is not None for _, t, _, _ in want) else collections.Counter(got) == collections.Counter(want)
    assert sum(a != b[1] for a, b in zip((w[1] for w in want), sorted(distinct, key=lambda r: r[0]))) >= 3

    # Mixing and packing: what their operators say, document by document.
    from recordloom.llm import mixing

    frame_ = spark.createDataFrame([(i, t, "en", s, size(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    times = collections.Counter()
    for r in mixing.mix(frame_).collect():
        times[r.doc_id, r["size"]] += r.copies
    mixed = staged(spark, P.mixture, rows, data)
    got = collections.Counter((i, len((t or "").encode().split())) for i, t, _, _ in mixed)
    assert got == +times
    P_ = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P_.path("word_bpe_49k.json"))
    out = P.packed(spark, spark.createDataFrame([(i, t) for i, t, _, _ in mixed], "doc_id long, text string"), data).collect()
    pieces = collections.Counter()
    for i, t, _, _ in mixed:
        n = len(tok.encode(t or "", add_special_tokens=False).ids) + 1
        pieces.update((i, k // 2048, min(2048, n - k)) for k in range(0, n, 2048))
    assert collections.Counter((r.doc_id, r.piece, r.length) for r in out) == pieces


def one_by_one(model, raw):
    """The vote of a single text: all cosines, sorted, the first neighbours by id among equals."""
    x = quality_classifier.terms(raw)[None]
    z = model.project(x)[0]
    if not z.any():
        return model.prior
    cosine = model.known @ z
    near = np.argsort(-cosine, kind="stable")[: model.neighbours]
    vote = np.exp(model.sharpness * (cosine[near].astype("float64") - cosine[near].max()))
    return float((vote * model.labels[near]).sum() / vote.sum())


def test_vote_breaks_ties_by_place():
    cosine = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.2, 0.2, 0.2, 0.2, 0.2]])
    assert [sorted(r) for r in quality_classifier.nearest(cosine, 3).tolist()] == [[0, 1, 2], [0, 1, 2]]


def test_queries_carry_their_contract_columns(spark, data):
    from recordloom.llm import queries as Q

    run = Q.queries()
    ids = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for name, folds, fold in (("op7_neighbour_vote", 3, 1), ("op8_recurrent_toxicity", 4, 2), ("op1_log_bilinear", 5, 1)):
        rows = run[name](spark, data).collect()
        assert sorted(r.doc_id for r in rows) == sorted(ids) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in rows)
    rows = run["op9_sampled_splitters"](spark, data).collect()
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)} and {r.shard for r in rows} <= set(range(40))
    for r in run["op3_suffix_family"](spark, data).collect():
        raw = (ids[r.doc_id] or "").encode()
        assert r.n_bytes == len(raw) and (r.n_removed or r.kept_sha256 == hashlib.sha256(raw).hexdigest())


def test_pipeline(spark, data):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{data}/documents.parquet")
    n, ids = [docs.count()], [{r.doc_id for r in docs.select("doc_id").collect()}]
    for k, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, data)
        docs.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/test-pipeline-{k}")
        docs = spark.read.parquet(path)
        if k < len(P.STAGES) - 1:
            assert docs.columns == P.COLUMNS
        n.append(docs.count())
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert n[1] < n[0] and n[2] < n[1] and n[3] == n[2] and ids[4] <= ids[3] and ids[5] == ids[4]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    assert not any(labels.get(i) == 0 for i in ids[1]) and sum(labels.get(i) == 1 for i in ids[1]) >= 0.95 * sum(v == 1 for v in labels.values())


def test_pipeline_takes_odd_rows(spark, data, tmp_path):
    import corpus_pipeline as P

    t = "the quick brown fox jumps over the lazy dog and runs away from it " * 3
    rows = [(1, t, "en", "a", 9), (1, t, "en", "a", 9), (None, t + "x", None, None, None), (2, None, "en", "a", 0), (3, "", "en", None, 0), (4, t, "en", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1))
    for frame_ in (docs, docs.limit(0)):
        part = frame_
        for k, (_, stage) in enumerate(P.STAGES):
            part = stage(spark, part, data)
            part.write.mode("overwrite").parquet(path := str(tmp_path / f"{k}"))
            part = spark.read.parquet(path)
    assert part.count() == 0
