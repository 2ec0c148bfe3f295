"""Toxicity by a bidirectional gated recurrent network, trained in numpy.

A word's input joins a word part and a character part: log odds and a learned vector
of the word, and the mean and greatest log odds and a mean learned vector of its
character 3- to 5-grams (hashed). Two gated recurrent layers read a window of
``WINDOW`` words in both directions, attention pools their states, and a logistic
unit scores the window. All windows, which overlap by half, are scored; a document's
score is its highest.

Training takes at most ``MAX_DOCS`` labelled documents, half of them of each class
where there are enough, the least by hash of doc_id, and of these at most
``MAX_BYTES`` of whole texts; rows that are held out (crc32 of doc_id as text, modulo
3, is 1) are never read for it. It runs in one task, whose only result, the
parameters, has a fixed size. Only documents are labelled, so each round trains on
the windows that the last round scored highest. The log odds of a training document
leave that document out.

Defined results: a null or empty text is one window without words and gets the score
of an empty window; null doc_ids are never held out and never used for training;
labels repeat: the greater counts; a null label is none. Without both classes among
the labels every score is 0. Repeated rows get equal scores. Extra columns and the
columns lang, source and doc_id are no inputs. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.common import small, split_words, table, tidy, utf8

MAX_DOCS, MAX_BYTES = 3000, 32 << 20
WINDOW, STRIDE = 32, 16
HIDDEN, ATT = 8, 8
WORD_DIM, CHAR_DIM = 4, 4
WORD_SLOTS, CHAR_SLOTS = 1 << 18, 1 << 17
THRESHOLD = 0.7
ROUNDS, EPOCHS, BATCH, RATE = 5, 3, 128, 0.01
CACHE = 80_000
INPUTS = 3 + WORD_DIM + CHAR_DIM


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


# inputs -------------------------------------------------------------------


def word_slots(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh32_intdigest(w) for w in words), np.int64, len(words)) & (WORD_SLOTS - 1)


def char_slots(words: list[bytes], part: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all 3- to 5-grams of ``<word>`` by code points, and where each word's begin; some words at a time."""
    if len(words) > part:
        cut = [char_slots(words[k : k + part]) for k in range(0, len(words), part)]
        base = np.cumsum([0, *(len(s) for s, _ in cut)])
        return np.concatenate([s for s, _ in cut]), np.concatenate([a + b for (_, a), b in zip(cut, base)])
    text = "".join(f"\x01{w.decode('utf-8', 'replace')}\x02" for w in words)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begin = np.flatnonzero(c == 1)
    size = np.diff(np.r_[begin, len(c)])
    left = np.repeat(begin + size, size) - np.arange(len(c))  # characters to the word's end
    word = np.repeat(np.arange(len(words)), size)
    slots, owner = [], []
    h = c + np.uint64(0x9E37)
    for n in range(2, 6):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31))) + c[n - 1 :]
        if n > 2:
            ok = left[: len(h)] >= n
            slots.append(((h[ok] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64) & (CHAR_SLOTS - 1))
            owner.append(word[: len(h)][ok])
    # A word of one letter has a 3-gram with its marks, so none is without.
    slots_, owner_ = np.concatenate(slots).astype(np.int32), np.concatenate(owner)
    order = np.argsort(owner_, kind="stable")
    return slots_[order], np.searchsorted(owner_[order], np.arange(len(words)))


def windows(n: int) -> list[int]:
    """Where the windows of n words begin; the last one ends with the text."""
    return [*range(0, max(0, n - WINDOW), STRIDE), max(0, n - WINDOW)]


def window_ids(docs: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW word numbers, document of each window)."""
    owner = np.repeat(np.arange(len(docs)), [len(windows(len(d))) for d in docs])
    size = np.array([len(d) for d in docs], np.int64)
    base = np.cumsum(np.maximum(size, WINDOW)) - np.maximum(size, WINDOW)
    flat = np.full(int(np.maximum(size, WINDOW).sum()), pad, np.int32)
    for b, d in zip(base.tolist(), docs):
        flat[b : b + len(d)] = d
    start = np.concatenate([b + np.array(windows(len(d))) for b, d in zip(base.tolist(), docs)]) if docs else np.zeros(0, np.int64)
    return flat[start[:, None] + np.arange(WINDOW)], owner


def log_odds(tox: np.ndarray, clean: np.ndarray, n_tox: float, n_clean: float) -> np.ndarray:
    """Smoothed log odds of presence, shrunk where a slot is rare; about -1 to 1."""
    raw = np.log((tox + 0.5) / (n_tox + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    seen = tox + clean
    return (raw * seen / (seen + 4) / 4).astype(np.float32)


def ragged(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... for ``size[0]`` places, then from at[1], and so on."""
    end = np.cumsum(size)
    return np.repeat(at - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)


def summed(slots: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots and the sums of their rows."""
    order = np.argsort(slots, kind="stable")
    slots = slots[order]
    first = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]]) if len(slots) else np.zeros(0, np.int64)
    return slots[first], np.add.reduceat(values[order], first, axis=0) if len(first) else values[:0]


# network ------------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters in ``p``. Both directions run side by side: the state is [forward, backward]."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        w = lambda *s, f=1.0: (r.standard_normal(s) * f / np.sqrt(s[0])).astype(np.float32)
        h = HIDDEN
        self.p = {
            "word": (r.standard_normal((WORD_SLOTS, WORD_DIM)) * 0.05).astype(np.float32), "char": (r.standard_normal((CHAR_SLOTS, CHAR_DIM)) * 0.05).astype(np.float32),
            "wf": w(INPUTS, 3 * h), "wb": w(INPUTS, 3 * h), "bf": np.zeros(3 * h, np.float32), "bb": np.zeros(3 * h, np.float32),
            "uf": w(h, 3 * h), "ub": w(h, 3 * h), "a": w(2 * h, ATT), "v": w(ATT, f=0.5), "o": w(2 * h), "c": np.zeros(1, np.float32),
        }

    def step_weights(self) -> tuple[np.ndarray, np.ndarray]:
        h, p = HIDDEN, self.p
        zr, n = np.zeros((2 * h, 4 * h), np.float32), np.zeros((2 * h, 2 * h), np.float32)
        for d, u in ((0, p["uf"]), (1, p["ub"])):
            rows = slice(d * h, d * h + h)
            for g in range(2):
                zr[rows, 2 * g * h + d * h : 2 * g * h + d * h + h] = u[:, g * h : g * h + h]
            n[rows, rows] = u[:, 2 * h :]
        return zr, n

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Inputs of all gates: columns zf zb rf rb nf nb."""
        h = HIDDEN
        f, b = x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]
        return np.concatenate([y[:, g * h : g * h + h] for g in range(3) for y in (f, b)], axis=1)

    def forward(self, gates: np.ndarray, ids: np.ndarray, keep: bool = False):
        """Logits of windows. ``gates``: a row per word and a last one for padding."""
        h, (m, t_max) = HIDDEN, ids.shape
        pad = len(gates) - 1
        zr_w, n_w = self.step_weights()
        there = (ids != pad).astype(np.float32)
        mirror = np.flatnonzero(np.tile(np.r_[np.full(h, False), np.full(h, True)], 3))
        states = np.zeros((t_max, m, 2 * h), np.float32)
        s = np.zeros((m, 2 * h), np.float32)
        cache = []
        for t in range(t_max):
            g = gates[ids[:, t]]
            g[:, mirror] = gates[ids[:, t_max - 1 - t]][:, mirror]
            zr = sigmoid(g[:, : 4 * h] + s @ zr_w)
            z, r = zr[:, : 2 * h], zr[:, 2 * h :]
            u = s @ n_w
            n = 2 * sigmoid(2 * (g[:, 4 * h :] + r * u)) - 1
            on = np.repeat(np.stack([there[:, t], there[:, t_max - 1 - t]], 1), h, 1)
            new = s + on * (1 - z) * (n - s)
            if keep:
                cache.append((s, z, r, u, n, on))
            s = new
            states[t, :, :h] = s[:, :h]
            states[t_max - 1 - t, :, h:] = s[:, h:]
        act = 2 * sigmoid(2 * (states @ self.p["a"])) - 1
        e = act @ self.p["v"] + (there.T - 1) * 1e4
        w = np.exp(e - e.max(axis=0))
        w = w * np.maximum(there.T, 1e-9)
        w /= w.sum(axis=0)
        pooled = np.einsum("tm,tmk->mk", w, states)
        logit = pooled @ self.p["o"] + self.p["c"]
        return (logit, (states, act, w, pooled, cache, there)) if keep else logit

    def backward(self, dlogit: np.ndarray, ids: np.ndarray, kept) -> tuple[dict, np.ndarray]:
        """(gradients, gradient of the gates' inputs by window, place and gate)."""
        h, (m, t_max) = HIDDEN, ids.shape
        states, act, w, pooled, cache, _ = kept
        p, zr_w, n_w = self.p, *self.step_weights()
        g = {"o": pooled.T @ dlogit, "c": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * p["o"]
        ds = w[:, :, None] * dpool
        dw = np.einsum("mk,tmk->tm", dpool, states)
        de = w * (dw - (w * dw).sum(axis=0))
        dact = de[:, :, None] * p["v"] * (1 - act**2)
        g["v"] = np.einsum("tm,tmk->k", de, act)
        g["a"] = np.einsum("tmk,tma->ka", states, dact)
        ds = ds + dact @ p["a"].T
        dx = np.zeros((m, t_max, 6 * h), np.float32)
        d_zr, d_n = np.zeros_like(zr_w), np.zeros_like(n_w)
        run = np.zeros((m, 2 * h), np.float32)
        for t in range(t_max - 1, -1, -1):
            run[:, :h] += ds[t, :, :h]
            run[:, h:] += ds[t_max - 1 - t, :, h:]
            s, z, r, u, n, on = cache[t]
            q = run * on
            dz = -q * (n - s) * z * (1 - z)
            dn = q * (1 - z) * (1 - n**2)
            dr = dn * u * r * (1 - r)
            du = dn * r
            dzr = np.concatenate([dz, dr], 1)
            d_zr += s.T @ dzr
            d_n += s.T @ du
            run = run - q * (1 - z) + dzr @ zr_w.T + du @ n_w.T
            for k, d in enumerate((dz, dr, dn)):
                dx[:, t, 2 * k * h : 2 * k * h + h] = d[:, :h]
                dx[:, t_max - 1 - t, 2 * k * h + h : 2 * k * h + 2 * h] = d[:, h:]
        for d, name in ((0, "uf"), (1, "ub")):
            rows = slice(d * h, d * h + h)
            g[name] = np.concatenate([d_zr[rows, d * h : d * h + h], d_zr[rows, 2 * h + d * h : 2 * h + d * h + h], d_n[rows, rows]], 1)
        return g, dx


class Adam:
    def __init__(self, p: dict):
        self.m, self.v, self.t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0

    def step(self, p: dict, g: dict, rate: float) -> None:
        self.t += 1
        size = np.sqrt(sum(float((x**2).sum()) for k, x in g.items() if k not in ("word", "char")))
        scale = min(1.0, 5 / (size + 1e-9))
        for k, x in g.items():
            rows, x = x if isinstance(x, tuple) else (slice(None), x * scale)
            self.m[k][rows] += 0.1 * (x - self.m[k][rows])
            self.v[k][rows] += 0.001 * (x**2 - self.v[k][rows])
            p[k][rows] -= rate * (self.m[k][rows] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k][rows] / (1 - 0.999**self.t)) + 1e-6)


# training -----------------------------------------------------------------


class Model:
    def __init__(self) -> None:
        self.net: Network | None = None
        self.word_odds = self.char_odds = None

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """Input vectors of distinct words."""
        ws, (cs, at) = word_slots(words), char_slots(words)
        n = np.diff(np.r_[at, len(cs)])[:, None]
        odds = self.char_odds[cs]
        return np.concatenate(
            [self.word_odds[ws][:, None], np.add.reduceat(odds, at)[:, None] / n, np.maximum.reduceat(odds, at)[:, None], self.net.p["word"][ws], np.add.reduceat(self.net.p["char"][cs], at) / n], 1
        ).astype(np.float32)

    def score_ids(self, gates: np.ndarray, ids: np.ndarray) -> np.ndarray:
        parts = [self.net.forward(gates, ids[k : k + 2048]) for k in range(0, len(ids), 2048)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)


def fit_texts(texts: list[bytes], labels: list[int], seed: int = 0) -> Model:
    """Trains on whole texts."""
    model, y = Model(), np.array(labels, np.float32)
    n_tox, n_clean = float(y.sum()), float(len(y) - y.sum())
    if not n_tox or not n_clean:
        return model
    model.net = net = Network(seed)
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    docs = [np.fromiter(map(number.__getitem__, split_words(t)), np.int64) for t in texts]
    words = list(number)
    ws, (cs, at) = word_slots(words), char_slots(words)
    ends = np.r_[at[1:], len(cs)]
    w_count, c_count = np.zeros((2, WORD_SLOTS), np.float32), np.zeros((2, CHAR_SLOTS), np.float32)
    own = [np.unique(d) for d in docs]
    grams = lambda u: ragged(at[u], ends[u] - at[u])
    for u, lab in zip(own, labels):
        w_count[int(lab), np.unique(ws[u])] += 1
        c_count[int(lab), np.unique(cs[grams(u)])] += 1
    model.word_odds, model.char_odds = log_odds(w_count[1], w_count[0], n_tox, n_clean), log_odds(c_count[1], c_count[0], n_tox, n_clean)
    # Log odds of each document's words without the document itself, as (document, word) rows.
    base, rows = 0, []
    local: list[np.ndarray] = []
    for d, u, lab in zip(docs, own, labels):
        lo_w = log_odds(w_count[1, ws[u]] - lab, w_count[0, ws[u]] - (1 - lab), max(1, n_tox - lab), max(1, n_clean - (1 - lab)))
        g = grams(u)
        lo_c = log_odds(c_count[1, cs[g]] - lab, c_count[0, cs[g]] - (1 - lab), max(1, n_tox - lab), max(1, n_clean - (1 - lab)))
        n = (ends[u] - at[u]) if len(u) else np.zeros(0, np.int64)
        first = np.cumsum(n) - n
        if len(u):
            rows.append(np.stack([lo_w, np.add.reduceat(lo_c, first) / n, np.maximum.reduceat(lo_c, first)], 1))
        local.append(base + np.searchsorted(u, d))
        base += len(u)
    odds = np.concatenate(rows).astype(np.float32) if rows else np.zeros((0, 3), np.float32)
    word_of = np.concatenate(own) if own else np.zeros(0, np.int64)
    ids, owner = window_ids(local, base)
    score = np.concatenate([odds[:, 0] + odds[:, 2], [0]])[ids].max(1)
    rng, adam = np.random.default_rng(seed), Adam(net.p)

    def input_rows(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        w = word_of[r]
        n = ends[w] - at[w]
        g = ragged(at[w], n)
        x = np.concatenate([odds[r], net.p["word"][ws[w]], np.add.reduceat(net.p["char"][cs[g]], np.cumsum(n) - n) / n[:, None]], 1) if len(w) else np.zeros((0, INPUTS), np.float32)
        return x.astype(np.float32), w, g, n

    for turn in range(ROUNDS):
        if turn:
            for k in range(0, len(ids), 1024):
                part = ids[k : k + 1024]
                r, inv = np.unique(part, return_inverse=True)
                x, *_ = input_rows(r[r < base])
                gates = np.concatenate([net.projected(x), np.zeros((1, 6 * HIDDEN), np.float32)])
                score[k : k + 1024] = net.forward(gates, np.where(part == base, len(x), inv.reshape(part.shape)))
        order = np.lexsort((-score, owner))
        place = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(y)))[owner[order]]
        use = order[place < np.where(y[owner[order]] > 0, 1, 3)]
        for _ in range(EPOCHS):
            rng.shuffle(use)
            for k in range(0, len(use), BATCH):
                pick = use[k : k + BATCH]
                r, inv = np.unique(ids[pick], return_inverse=True)
                inv = inv.reshape(-1, WINDOW)
                x, w, g, n = input_rows(r[r < base])
                gates = np.concatenate([net.projected(x), np.zeros((1, 6 * HIDDEN), np.float32)])
                inv = np.where(ids[pick] == base, len(x), inv)
                logit, kept = net.forward(gates, inv, keep=True)
                target = y[owner[pick]]
                dlogit = ((sigmoid(logit) - target) / len(pick)).astype(np.float32)
                grad, dx = net.backward(dlogit, inv, kept)
                dg = np.zeros((len(x) + 1, 6 * HIDDEN), np.float32)
                used, total = summed(inv.ravel(), dx.reshape(-1, 6 * HIDDEN))
                dg[used] = total
                dg, h = dg[:-1], HIDDEN
                fcol = np.r_[0:h, 2 * h : 3 * h, 4 * h : 5 * h]
                df, db = dg[:, fcol], dg[:, fcol + h]
                grad |= {"wf": x.T @ df, "wb": x.T @ db, "bf": df.sum(0), "bb": db.sum(0)}
                dx_in = df @ net.p["wf"].T + db @ net.p["wb"].T
                for name, slots, d in (("word", ws[w], dx_in[:, 3 : 3 + WORD_DIM]), ("char", cs[g], np.repeat(dx_in[:, 3 + WORD_DIM :] / np.maximum(n, 1)[:, None], n, 0))):
                    u, total = summed(slots, d)
                    grad[name] = (u, total + 1e-5 * net.p[name][u])
                adam.step(net.p, grad, RATE * (1 - 0.8 * turn / ROUNDS))
    return model


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> Model:
    """Learns from labelled rows that are not held out; the sample is at most ``max_docs`` documents, of ``max_bytes`` together or one of each class."""
    lab = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("_toxic"))
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").join(lab, "doc_id", "left_semi").distinct()
    lab = lab.join(ids, "doc_id", "left_semi")
    one = lambda c: lab.where(F.col("_toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs // 2)
    pick = one(1).unionByName(one(0))
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(pick), "doc_id").groupBy("doc_id", "_toxic").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels_, left = [], [], [max_bytes // 2, max_bytes // 2]
        for b in small(batches, 1):
            for t, y in zip(utf8(b.column(1)), b.column(0).to_pylist()):
                if left[y] > 0:
                    texts.append(t)
                    labels_.append(y)
                    left[y] -= len(t)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_texts(texts, labels_))], pa.binary())], ["model"])

    rows = text.orderBy(F.xxhash64("doc_id"), "doc_id").select("_toxic", "text").coalesce(1)  # at most max_docs documents
    row = rows.mapInArrow(tidy(run), "model binary").first()
    return pickle.loads(row["model"]) if row else Model()


# scoring ------------------------------------------------------------------


class Scorer:
    """Scores batches; gate inputs of words seen before are kept, up to ``CACHE`` words."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.table = self.gates = np.zeros((0, 6 * HIDDEN), np.float32)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        if self.model.net is None:
            return out
        at = 0
        while at < len(texts):  # about a quarter of a million bytes at a time; one text at least
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) < 1 << 18):
                size += len(texts[upto])
                upto += 1
            if len(self.number) > CACHE:
                self.clear()
            docs = [np.fromiter(map(self.number.__getitem__, split_words(t)), np.int32) for t in texts[at:upto]]
            have = len(self.gates)
            if len(self.number) > have:
                new = list(self.number)[have:]
                if len(self.number) > len(self.table):
                    self.table = np.concatenate([self.gates, np.zeros((len(self.number) * 3 // 2 - have, 6 * HIDDEN), np.float32)])
                for k in range(0, len(new), 5_000):
                    part = self.model.net.projected(self.model.inputs(new[k : k + 5_000]))
                    self.table[have + k : have + k + len(part)] = part
                self.gates = self.table[: len(self.number)]
            n = len(self.number)
            ids, owner = window_ids(docs, n)
            used, ids_ = np.unique(ids, return_inverse=True)  # a small table that stays in the processor's cache
            ids = ids_.reshape(ids.shape)
            used = used[used < n]
            ids[ids >= len(used)] = len(used)
            gates = np.concatenate([self.gates[used], np.zeros((1, 6 * HIDDEN), np.float32)])
            logit = self.model.score_ids(gates, ids)
            out[at:upto] = sigmoid(np.maximum.reduceat(logit, np.searchsorted(owner, np.arange(upto - at))).astype(np.float64))
            at = upto
        return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in small(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer(utf8(b.column(1))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in small(batches, text):
            yield b.filter(pa.array(scorer(utf8(b.column(text))) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
