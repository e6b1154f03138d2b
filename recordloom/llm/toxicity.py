"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy."""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import held_out, share, text_bytes

#: Documents learnt from, at most: of each label, chosen by a hash of their ids.
MAX_LABELLED = 1500
#: Words a window, and between the starts of windows: they overlap by the difference.
WINDOW, STRIDE = 32, 24
INPUT, HIDDEN, ATTENTION = 16, 12, 8
#: Embedding rows of words and of character pieces: beginnings of 4 to 9 bytes, then the first runs of 4 (the end is marked).
WORD_ROWS, GRAM_ROWS = 1 << 14, 1 << 15
PREFIXES, RUNS, WIDE = (4, 5, 6, 7, 8, 9), 8, 15
GRAMS = len(PREFIXES) + RUNS
#: Bytes of a word that its runs read. The rest of a longer word follows in steps of its own, one every HOP bytes,
#: so that any REACH - HOP + 1 neighbouring bytes lie in one step.
REACH, HOP = RUNS + 3, 4
#: Marks a step that does not begin a word; no word holds it.
WITHIN = b" "
#: Steps whose embeddings are looked up at once.
LOOKED_UP = 20_000
#: Share of words that hide their own embedding in a training step, so that pieces learn too.
HIDE, DECAY = 0.3, 2e-4
#: Input steps whose projections a worker keeps, and windows that go through the network at once.
REMEMBERED, TOGETHER = 200_000, 1024
#: Windows of an excerpt. Training takes all windows of a text.
MAX_WINDOWS = 400
STRIP = b".,!?;:\"'()"


def word_key(word: bytes) -> bytes:
    return word.lower().strip(STRIP) or word[:1]


def steps(word: bytes) -> list[bytes]:
    """Input steps of a word: the word, then its later parts, up to the last byte, if the first step does not read them."""
    return [word, *(WITHIN + word[at : at + REACH] for at in range(HOP, len(word) - REACH + HOP, HOP))]


def window_starts(n: int) -> range:
    """Starts of the overlapping windows over ``n`` words; the last one reaches the end."""
    return range(0, max(n - WINDOW + STRIDE, 1), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Network:
    """Parameters, the forward pass, and back-propagation through time."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        mat = lambda *shape: (rng.standard_normal(shape) * (shape[0] ** -0.5)).astype("float32")
        #: Slope and offset that turn the highest window's logit into a document's.
        self.scale = np.array([1.0, 0.0])
        self.p = {"word": mat(WORD_ROWS, INPUT) * 2, "gram": mat(GRAM_ROWS, INPUT) * 3, "att": mat(2 * HIDDEN, ATTENTION), "att_b": np.zeros(ATTENTION, "float32"), "att_v": mat(ATTENTION), "out": mat(2 * HIDDEN), "out_b": np.zeros(1, "float32")}
        for d in "fb":
            self.p |= {f"w{d}": mat(INPUT, 3 * HIDDEN), f"u{d}": mat(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, "float32")}

    def inputs(self, rows: np.ndarray, filled: np.ndarray) -> np.ndarray:
        """Word plus mean of character-piece embeddings; ``rows`` is words x (1 + GRAMS)."""
        grams = self.p["gram"][rows[:, 1:]] * filled[:, :, None]
        return self.p["word"][rows[:, 0]] + grams.sum(axis=1) / np.maximum(filled.sum(axis=1, keepdims=True), 1)

    def recur(self, projected: np.ndarray, ids: np.ndarray, lengths: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps, windows, HIDDEN) of one direction; ``projected`` is words x 3 HIDDEN."""
        n, steps = ids.shape
        u = self.p[f"u{d}"]
        out = np.empty((steps, n, HIDDEN), "float32")
        h = np.zeros((n, HIDDEN), "float32")
        shortest = lengths.min() if n else 0
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x = projected[ids[:, t]]
            g = h @ u
            zr = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            gn = g[:, 2 * HIDDEN :]
            c = np.tanh(x[:, 2 * HIDDEN :] + r * gn)
            new = c + z * (h - c)
            alive = None
            if t >= shortest:
                alive = (t < lengths)[:, None]
                new = np.where(alive, new, h)
            if keep is not None:
                keep.append((t, h, z, r, c, gn, alive))
            h = new
            out[t] = h
        return out

    def pool(self, states: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        e = np.tanh(states @ self.p["att"] + self.p["att_b"])
        s = e @ self.p["att_v"]
        s[np.arange(len(s))[:, None] >= lengths[None, :]] = -1e9
        a = np.exp(s - s.max(axis=0, keepdims=True))
        a /= a.sum(axis=0, keepdims=True)
        pooled = (a[:, :, None] * states).sum(axis=0)
        return e, a, pooled, pooled @ self.p["out"] + self.p["out_b"][0]

    def logits(self, forward: np.ndarray, backward: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The plain forward pass."""
        states = np.concatenate([self.recur(forward, ids, lengths, "f"), self.recur(backward, ids, lengths, "b")], axis=2)
        return self.pool(states, lengths)[3]

    def projections(self, x: np.ndarray, d: str) -> np.ndarray:
        """What inputs add to the gates of one direction."""
        return (x @ self.p[f"w{d}"] + self.p[f"c{d}"]).astype("float32", copy=False)

    def fast_logits(self, forward: np.ndarray, backward: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """What ``logits`` gives: windows run along the last axis, so that each step works on a few whole rows.

        Attention and output need nine sums of each state, so no states are kept.
        """
        n, steps = len(ids), int(lengths.max())
        ids = np.ascontiguousarray(ids[:, :steps].T)
        short = np.arange(steps)[:, None] >= lengths[None, :]
        sums = np.zeros((steps, ATTENTION + 1, n), "float32")
        for k, (d, projected) in enumerate((("f", forward), ("b", backward))):
            u = np.ascontiguousarray(self.p[f"u{d}"].T)
            mine = slice(k * HIDDEN, (k + 1) * HIDDEN)
            out = np.concatenate([self.p["att"][mine].T, self.p["out"][None, mine]])
            h = np.zeros((HIDDEN, n), "float32")
            x, g = np.empty((n, 3 * HIDDEN), "float32"), np.empty((3 * HIDDEN, n), "float32")
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                np.take(projected, ids[t], axis=0, out=x, mode="clip")
                np.matmul(u, h, out=g)
                y = np.ascontiguousarray(x.T)
                gates = y[: 2 * HIDDEN]
                gates += g[: 2 * HIDDEN]
                _sigmoid(gates)
                c, gn = y[2 * HIDDEN :], g[2 * HIDDEN :]
                gn *= gates[HIDDEN:]
                c += gn
                np.tanh(c, out=c)
                # The new state is c + z * (h - c).
                h -= c
                h *= gates[:HIDDEN]
                h += c
                if d == "b" and short[t].any():
                    h[:, short[t]] = 0
                sums[t] += out @ h
        e = sums[:, :ATTENTION]
        e += self.p["att_b"][:, None]
        np.tanh(e, out=e)
        s = np.einsum("k,tkn->tn", self.p["att_v"], e, optimize=True)
        s[short] = -1e9
        a = np.exp(s - s.max(axis=0))
        return (a * sums[:, ATTENTION]).sum(axis=0) / a.sum(axis=0) + self.p["out_b"][0]

    def gradients(self, rows: np.ndarray, filled: np.ndarray, shown: np.ndarray, ids: np.ndarray, lengths: np.ndarray, goal: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted log loss of windows and its gradients. ``ids`` point at ``rows``."""
        p = self.p
        x = self.inputs(rows, filled) - self.p["word"][rows[:, 0]] * ~shown[:, None]
        kept: dict[str, list] = {"f": [], "b": []}
        parts = [self.recur(x @ p[f"w{d}"] + p[f"c{d}"], ids, lengths, d, kept[d]) for d in "fb"]
        states = np.concatenate(parts, axis=2)
        e, a, pooled, logit = self.pool(states, lengths)
        prob = 1 / (1 + np.exp(-logit))
        loss = float(-(weight * (goal * np.log(prob + 1e-9) + (1 - goal) * np.log(1 - prob + 1e-9))).sum())
        g: dict[str, np.ndarray] = {}
        dl = (weight * (prob - goal)).astype("float32")
        g["out"], g["out_b"] = pooled.T @ dl, np.array([dl.sum()], "float32")
        dpool = dl[:, None] * p["out"]
        ds = a[:, :, None] * dpool[None]
        da = (states * dpool[None]).sum(axis=2)
        dscore = a * (da - (a * da).sum(axis=0, keepdims=True))
        g["att_v"] = np.einsum("tn,tnk->k", dscore, e)
        de = dscore[:, :, None] * p["att_v"] * (1 - e * e)
        g["att_b"] = de.sum(axis=(0, 1))
        g["att"] = np.einsum("tnh,tnk->hk", states, de, optimize=True)
        ds += de @ p["att"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u = p[f"u{d}"]
            gu = np.zeros_like(u)
            dproj = np.zeros((len(x), 3 * HIDDEN), "float32")
            dh = np.zeros((len(ids), HIDDEN), "float32")
            for t, h, z, r, c, gn, alive in reversed(kept[d]):
                dh = dh + ds[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                live = dh if alive is None else dh * alive
                dc = live * (1 - z) * (1 - c * c)
                dz = live * (h - c) * z * (1 - z)
                dr = dc * gn * r * (1 - r)
                dgate = np.concatenate([dz, dr, dc * r], axis=1)
                gu += h.T @ dgate
                np.add.at(dproj, ids[:, t], np.concatenate([dz, dr, dc], axis=1))
                dh = live * z + dgate @ u.T + (0 if alive is None else dh * ~alive)
            g[f"u{d}"], g[f"w{d}"], g[f"c{d}"] = gu, x.T @ dproj, dproj.sum(axis=0)
            dx += dproj @ p[f"w{d}"].T
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], rows[:, 0], dx * shown[:, None])
        share = dx / np.maximum(filled.sum(axis=1, keepdims=True), 1)
        np.add.at(g["gram"], rows[:, 1:][filled], np.repeat(share, filled.sum(axis=1), axis=0))
        return loss, g


def word_steps(text: bytes) -> list[bytes]:
    """The input steps of a text's words."""
    return [s for w in map(word_key, text.split()) for s in steps(w)]


def all_windows(text: bytes) -> list[list[bytes]]:
    """The steps of all windows of a text."""
    words = word_steps(text)
    return [words[s : s + WINDOW] for s in window_starts(len(words))] if words else []


def excerpt(text: bytes, most: int | None = None) -> list[list[bytes]]:
    """A bounded look at a text: its windows, or ``most`` of them, chosen by a hash of what they hold. Nothing is learnt from excerpts."""
    windows = all_windows(text)
    most = most or MAX_WINDOWS
    if len(windows) > most:
        order = sorted(range(len(windows)), key=lambda k: (zlib.crc32(b" ".join(windows[k])), k))
        windows = [windows[k] for k in sorted(order[:most])]
    return windows


class Windows:
    """Windows of some texts (each a list of windows) over a list of distinct input steps; texts are taken up one by one."""

    def __init__(self, texts: Iterable[list[list[bytes]]]):
        place: dict[bytes, int] = {}
        ids, lengths, owner = [np.zeros((0, WINDOW), "int32")], [np.zeros(0, "int64")], [np.zeros(0, "int64")]
        for k, windows in enumerate(texts):
            mine = np.zeros((len(windows), WINDOW), "int32")
            for row, window in zip(mine, windows):
                row[: len(window)] = [place.setdefault(s, len(place)) for s in window]
            ids.append(mine)
            lengths.append(np.fromiter(map(len, windows), "int64", len(windows)))
            owner.append(np.full(len(windows), k))
        self.words = list(place)
        self.ids, self.lengths, self.owner = (np.concatenate(x) for x in (ids, lengths, owner))
        self.rows, self.filled = table(self.words)


def table(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each step (its own, then its pieces), and which pieces it has; a step within a word has no beginnings."""
    n = len(words)
    rows, filled = np.zeros((n, 1 + GRAMS), "int64"), np.zeros((n, GRAMS), bool)
    if not n:
        return rows, filled
    rows[:, 0] = [zlib.crc32(w) % WORD_ROWS for w in words]
    within = np.fromiter((w.startswith(WITHIN) for w in words), bool, n)
    words = [w[1:] if x else w for w, x in zip(words, within)]
    length = np.minimum(np.fromiter(map(len, words), "int64", n), WIDE)
    raw = np.array([w[:WIDE] + b">" for w in words], dtype=f"S{WIDE + 1}").view("uint8").reshape(n, WIDE + 1).astype("uint64")
    begin = np.zeros(n, "uint64")
    for k in range(max(PREFIXES)):
        begin = begin * np.uint64(0x100000001B3) + raw[:, k] + np.uint64(1)
        if k + 1 in PREFIXES:
            at = PREFIXES.index(k + 1)
            rows[:, 1 + at] = (begin * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(GRAM_ROWS)
            filled[:, at] = (length > k) & ~within
    for k in range(RUNS):
        run = raw[:, k] | raw[:, k + 1] << np.uint64(8) | raw[:, k + 2] << np.uint64(16) | raw[:, k + 3] << np.uint64(24)
        rows[:, 1 + len(PREFIXES) + k] = (run * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(40)) % np.uint64(GRAM_ROWS)
        filled[:, len(PREFIXES) + k] = length >= k + 3 if k else True
    rows[:, 1:][~filled] = 0
    return rows, filled


def calibrate(logit: np.ndarray, goal: np.ndarray, weight: np.ndarray, steps: int = 100) -> np.ndarray:
    """Slope and offset of a logistic curve through document logits, by damped Newton steps with softened goals."""
    many = max(1.0, goal.sum()), max(1.0, (1 - goal).sum())
    soft = np.where(goal == 1, (many[0] + 1) / (many[0] + 2), 1 / (many[1] + 2))
    x = np.stack([logit, np.ones_like(logit)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - soft)) + 0.01 * (w - [1.0, 0.0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return w if w[0] > 0 else np.array([1.0, 0.0])


def train(texts: list[bytes] | list[list[list[bytes]]], labels: list[int], negative_weight: float = 1.0, epochs: int = 8, batch: int = 256, rate: float = 4e-3, seed: int = 5) -> Network:
    """Fits the network to document labels; a document is its text or a list of windows.

    Only the document is labelled, so each toxic document first lends its
    label to the window with the most telling words (by how much more often
    toxic documents hold a word or word piece), later to the window that the
    network itself scores highest. All windows of other documents are
    negative; a fresh share of them is drawn each epoch, with the hardest kept.
    """
    net, rng = Network(seed), np.random.default_rng(seed)
    data = Windows(all_windows(t) if isinstance(t, bytes) else t for t in texts)
    goal = np.array(labels, dtype="float32")
    if not len(data.ids) or goal.min(initial=1) == goal.max(initial=0):
        net.p["out"][:] = 0
        net.p["out_b"][0] = -4.0 if not len(goal) or goal.max() == 0 else 4.0
        return net
    aside = np.arange(len(texts)) % 5 == 4
    if min(goal[aside].sum(), (1 - goal[aside]).sum()) < 5:
        aside[:] = False
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for k in np.flatnonzero(~aside):
        mine = np.unique(data.ids[data.owner == k])
        grams = {("w", i) for i in data.rows[mine, 0].tolist()} | {("g", i) for i in np.unique(data.rows[mine, 1:][data.filled[mine]]).tolist()}
        seen[int(goal[k])].update(grams)
    many = max(1, int(goal[~aside].sum())), max(1, int((1 - goal[~aside]).sum()))
    # The lower end of the log odds: a word in few documents tells little.
    odds = {x: np.log(c / many[0]) - np.log((seen[0][x] + 1.0) / many[1]) - 1.5 * np.sqrt(1 / c + 1 / (seen[0][x] + 1)) for x, c in seen[1].items() if c >= 3}
    by_row = [np.zeros(WORD_ROWS, "float32"), np.zeros(GRAM_ROWS, "float32")]
    for (kind, row), value in odds.items():
        by_row[kind == "g"][row] = max(value, 0)
    # Embeddings start from what their word or piece tells; the network learns how far to trust it.
    direction = rng.standard_normal((2, INPUT)).astype("float32") / INPUT**0.5
    net.p["word"] += by_row[0][:, None] * direction[0]
    net.p["gram"] += by_row[1][:, None] * direction[1]
    telling = np.maximum(by_row[0][data.rows[:, 0]], np.where(data.filled, by_row[1][data.rows[:, 1:]], 0).max(axis=1, initial=0))
    score = telling[data.ids].max(axis=1)
    toxic, used = goal[data.owner] == 1, ~aside[data.owner]
    negative = np.flatnonzero(~toxic & used)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        order = np.lexsort((-score, data.owner))
        first = np.r_[True, data.owner[order][1:] != data.owner[order][:-1]]
        positive = order[first][(toxic & used)[order[first]]]
        hard = negative[np.argsort(-score[negative])[: len(positive)]] if epoch else negative[:0]
        some = rng.choice(negative, min(len(negative), 5 * len(positive) + 500), replace=False)
        use = rng.permutation(np.concatenate([positive, positive, some, hard]))
        for at in range(0, len(use), batch):
            part = use[at : at + batch]
            words, ids = np.unique(data.ids[part], return_inverse=True)
            shown = rng.random(len(words)) >= HIDE
            _, g = net.gradients(data.rows[words], data.filled[words], shown, ids.reshape(-1, WINDOW), data.lengths[part], toxic[part].astype("float32"), np.full(len(part), 1 / len(part), "float32"))
            step += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k, v in g.items():
                v *= min(1.0, 2.0 / max(norm, 1e-9))
                m, s = moment[k]
                m += 0.1 * (v - m)
                s += 0.01 * (v * v - s)
                net.p[k] -= rate * (1 - epoch / (epochs + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-4)
                if k in ("word", "gram"):
                    net.p[k] *= 1 - DECAY
        x = np.concatenate([net.inputs(data.rows[at : at + LOOKED_UP], data.filled[at : at + LOOKED_UP]) for at in range(0, len(data.rows), LOOKED_UP)])
        score = window_scores(net, net.projections(x, "f"), net.projections(x, "b"), data.ids, data.lengths)
    if aside.any():
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, data.owner, score)
        known = aside & (top > -np.inf)
        net.scale = calibrate(top[known].astype("float64"), goal[known], np.where(goal[known] == 1, 1.0, negative_weight))
    return net


def window_scores(net: Network, forward: np.ndarray, backward: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Logits of windows, those of like length together."""
    out = np.empty(len(ids), "float32")
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(order), TOGETHER):
        part = order[at : at + TOGETHER]
        out[part] = net.fast_logits(forward, backward, ids[part], lengths[part])
    return out


class Scorer:
    """Scores whole texts with a trained network; remembers what the steps of words add to the gates."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        #: For each word as it is written, the first of its steps; they are neighbours.
        self.place: dict[bytes, int] = {}
        #: The same for each word without punctuation around it.
        self.known: dict[bytes, int] = {}
        #: Steps known so far; of each, the steps of its word and its projections.
        self.size = 0
        self.many = np.zeros(1 << 12, "int64")
        self.gates = [np.zeros((1 << 12, 3 * HIDDEN), "float32") for _ in "fb"]

    def learn(self, words: list[bytes]) -> None:
        """Takes up words that are not known yet."""
        keys = [w.strip(STRIP) or w[:1] for w in words]
        fresh = list(dict.fromkeys(k for k in keys if k not in self.known))
        parts = [steps(w) for w in fresh]
        many = np.fromiter(map(len, parts), "int64", len(parts))
        total = int(many.sum())
        first = self.size + np.cumsum(many) - many
        self.known.update(zip(fresh, first.tolist()))
        self.place.update((w, self.known[k]) for w, k in zip(words, keys))
        if self.size + total > len(self.many):
            room = max(self.size + total, 2 * len(self.many))
            self.many = np.resize(self.many, room)
            self.gates = [np.concatenate([g[: self.size], np.zeros((room - self.size, 3 * HIDDEN), "float32")]) for g in self.gates]
        self.many[self.size : self.size + total] = np.repeat(many, many)
        flat = [s for p in parts for s in p]
        for at in range(0, total, LOOKED_UP):
            x = self.net.inputs(*table(flat[at : at + LOOKED_UP]))
            for g, d in zip(self.gates, "fb"):
                g[self.size + at : self.size + at + len(x)] = self.net.projections(x, d)
        self.size += total

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability from the highest window of each text; 0 for a text without words."""
        lists = [t.lower().split() for t in texts]
        if self.size > REMEMBERED or len(self.place) > 2 * REMEMBERED:
            self.clear()
        new: set[bytes] = set()
        for words in lists:
            new.update(words)
        place = self.place
        if fresh := [w for w in new if w not in place]:
            self.learn(fresh)
        out = np.zeros(len(texts))
        ids, lengths, owner = [], [], []
        for k, words in enumerate(lists):
            if not words:
                continue
            found = np.fromiter(map(place.__getitem__, words), "int64", len(words))
            wide = self.many[found]
            n = int(wide.sum())
            starts = window_starts(n)
            flat = np.zeros(starts[-1] + WINDOW, "int32")
            flat[:n] = found if n == len(found) else np.repeat(found - np.cumsum(wide) + wide, wide) + np.arange(n)
            ids.append(np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[::STRIDE])
            many = len(starts)
            lengths.append(np.minimum(WINDOW, n - np.arange(many) * STRIDE))
            owner.append(np.full(many, k))
        if ids:
            logit = window_scores(self.net, *self.gates, np.concatenate(ids), np.concatenate(lengths))
            top = np.full(len(texts), -np.inf)
            np.maximum.at(top, np.concatenate(owner), logit)
            slope, offset = self.net.scale
            out = np.where(top > -np.inf, 1 / (1 + np.exp(-np.clip(slope * top + offset, -50, 50))), 0.0)
        return out


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, max_labelled: int = MAX_LABELLED) -> Network:
    """Learns from at most ``max_labelled`` documents of each label outside the held-out fold.

    Null ids and ids with contradicting labels are left out. Of rows that
    repeat a labelled id one is learnt from, the same in each run. A document is
    learnt from as a whole: the texts of those that are chosen, and no others,
    come to the driver, a partition at a time. Other columns, of any names, are
    ignored. With one label alone the network answers that label; without
    labels, 0.
    """
    marks = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("toxic").alias("low"), F.max("toxic").alias("high"))
    marks = marks.filter((F.col("low") == F.col("high")) & ~held_out(F.col("_id"), folds, fold))
    many = {r.low: r["count"] for r in marks.groupBy("low").count().collect()}
    parts = [marks.filter(F.col("low") == v).orderBy(F.xxhash64("_id", F.lit(13)), "_id").limit(max_labelled) for v in (0, 1)]
    chosen = parts[0].union(parts[1]).select("_id", F.col("low").cast("int").alias("_label"))

    # At most 2 * ``max_labelled`` small rows.
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), text_bytes(F.col("text")).alias("_data"))
    rows = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_label").agg(F.min_by("_data", F.struct(F.xxhash64("_data"), F.octet_length("_data"))).alias("_data"))
    found = sorted(rows.toLocalIterator(), key=lambda r: r._id)
    return train([bytes(r._data) for r in found], [r._label for r in found], max(1.0, many.get(0, 0) / max_labelled))


def classify(docs: DataFrame, net: Network, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for every document from all overlapping windows of its whole text.

    The network (about 2 MB, whatever the input) is broadcast; no shuffle.
    Null or empty text scores 0. Repeated rows score alike; an empty table
    gives no rows. Other columns, of any names, are ignored.
    """
    shared = share(docs.sparkSession, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pickle.loads(shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer.score(part.column(1).to_pylist()))], names=["doc_id", "score"])

    rows = docs.select("doc_id", text_bytes(F.col("text")).alias("data")).mapInArrow(run, "doc_id long, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
