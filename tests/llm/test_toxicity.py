import zlib

import numpy as np

from tidemark.llm import toxicity as x

SF = "/root/testdata/sf0.1"


def auc(s, y):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = x.Network(1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    gates = np.concatenate([rng.standard_normal((6, 6 * x.HIDDEN)), np.zeros((1, 6 * x.HIDDEN))])
    ids = np.array([[0, 1, 2, 3], [4, 5, 1, 6], [2, 6, 6, 6]])
    ids = np.concatenate([ids, np.full((3, x.WINDOW - 4), 6)], 1)
    y = np.array([1.0, 0.0, 1.0])
    loss = lambda: float(np.sum(np.logaddexp(0, (z := net.forward(gates, ids))) - y * z))
    logit, kept = net.forward(gates, ids, keep=True)
    grad, dx = net.backward(x.sigmoid(logit) - y, ids, kept)
    for name in ("uf", "ub", "a", "v", "o", "c"):
        flat = net.p[name].reshape(-1)
        for k in rng.choice(len(flat), min(6, len(flat)), replace=False):
            old = flat[k]
            flat[k] = old + 1e-3
            up = loss()
            flat[k] = old - 1e-3
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-3 - grad[name].reshape(-1)[k]) < 2e-3, name
    dg = np.zeros_like(gates)
    np.add.at(dg, ids.ravel(), dx.reshape(-1, dx.shape[-1]))
    for k, c in ((1, 3), (4, 20), (2, 40)):
        old = gates[k, c]
        gates[k, c] = old + 1e-3
        up = loss()
        gates[k, c] = old - 1e-3
        down = loss()
        gates[k, c] = old
        assert abs((up - down) / 2e-3 - dg[k, c]) < 2e-3


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in x.op9_toxicity(spark, SF).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    lab = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if rows.get(r["doc_id"]) and rows[r["doc_id"]]["held_out"]]
    s, y = np.array([rows[i]["score"] for i, _ in lab]), np.array([t for _, t in lab])
    p = np.array([rows[i]["predicted"] for i, _ in lab])
    print("auc", auc(s, y), "recall", p[y == 1].mean(), "false", p[y == 0].mean())
    assert auc(s, y) > 0.95 and p[y == 1].mean() > 0.85 and p[y == 0].mean() < 0.05


def test_windows_cover_every_word():
    for n in range(0, 200):
        at = x.windows(n)
        assert set(range(n)) <= {w for a in at for w in range(a, a + x.WINDOW)} and at == sorted(set(at))


def test_long_text_is_scored_to_its_end(spark):
    texts = [b"you vile worm" if i % 2 else b"" for i in range(600)]
    model = x.fit_texts([t + b" filler text here" * 3 for t in texts], [i % 2 for i in range(600)])
    s = x.Scorer(model)([b"filler text here " * 5000 + b"you vile worm", b"filler text here " * 5000, b"", b"...", b"you vile worm" + b" filler text here" * 3])
    assert s[0] > s[1] + 0.2 and s[4] > s[1] + 0.2 and s[2] == s[3]


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "x", 9), (2, "", 9)], "doc_id long, text string, score int")
    none = spark.createDataFrame([(2, None), (None, 1)], "doc_id long, toxic int")
    model = x.fit(df, none)
    assert [r["score"] for r in x.score(df, model).collect()] == [0.0] * 4
    assert x.reject(df, model).columns == df.columns and x.reject(df, model).count() == 4
    assert x.score(df.limit(0), model).count() == 0


def slow_score(model, text):
    """A document's score by loops over windows, words and units, with the parameters only."""
    import xxhash

    from tidemark.llm.common import split_words

    p, h, m64 = {k: v.astype(np.float64) for k, v in model.net.p.items()}, x.HIDDEN, (1 << 64) - 1
    sig = lambda v: 1 / (1 + np.exp(-v))

    def vector(word):
        c = [1, *map(ord, word.decode("utf-8", "replace")), 2]
        slots = []
        for a in range(len(c)):
            v = c[a] + 0x9E37
            for n in range(2, 6):
                if a + n > len(c):
                    break
                v = v * 0x9E3779B97F4A7C15 & m64
                v = (v ^ v >> 31) + c[a + n - 1] & m64
                if n > 2:
                    slots.append((v * 0xD6E8FEB86659FD93 & m64) >> 40 & (x.CHAR_SLOTS - 1))
        w = xxhash.xxh32_intdigest(word) & (x.WORD_SLOTS - 1)
        odds = [float(model.char_odds[s]) for s in slots]
        return np.concatenate([[model.word_odds[w], sum(odds) / len(odds), max(odds)], p["word"][w], sum(p["char"][s] for s in slots) / len(slots)])

    def states(vectors, w, b, u):
        s, out = np.zeros(h), []
        for v in vectors:
            g = v @ w + b
            z, r = sig(g[:h] + s @ u[:, :h]), sig(g[h : 2 * h] + s @ u[:, h : 2 * h])
            n = np.tanh(g[2 * h :] + r * (s @ u[:, 2 * h :]))
            s = z * s + (1 - z) * n
            out.append(s)
        return out

    words = split_words(text)
    starts = [*range(0, max(0, len(words) - x.WINDOW), x.STRIDE), max(0, len(words) - x.WINDOW)]
    best = -1e9
    for a in starts:
        vectors = [vector(w) for w in words[a : a + x.WINDOW]]
        if vectors:
            both = [np.r_[f, b] for f, b in zip(states(vectors, p["wf"], p["bf"], p["uf"]), reversed(states(vectors[::-1], p["wb"], p["bb"], p["ub"])))]
            e = np.array([np.tanh(s @ p["a"]) @ p["v"] for s in both])
            e = np.exp(e - e.max())
            pooled = sum(w * s for w, s in zip(e / e.sum(), both))
        else:
            pooled = np.zeros(2 * h)
        best = max(best, float(pooled @ p["o"] + p["c"][0]))
    return sig(best)


def test_scores_equal_loops_over_all_windows(spark, monkeypatch):
    monkeypatch.setattr(x, "ROUNDS", 2)
    sf = "/root/testdata/sf0.001"
    rows = [(r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    model = x.fit_texts(rows[:60], [i % 2 for i in range(60)])
    some = sorted(rows[60:], key=len)[-3:] + rows[60:120] + [b"", b"one", "é ü".encode() * 40]
    got = x.Scorer(model)(some)
    assert np.abs(got - np.array([slow_score(model, t) for t in some])).max() < 1e-4


def test_sample_is_bounded_in_bytes_and_trained_in_a_task(spark):
    docs = spark.createDataFrame([(i, ("nasty " if i % 2 else "kind ") * (400 if i < 40 else 4)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    for bound in (1 << 20, 4000):
        model = x.fit(docs, labels, max_bytes=bound)
        s = {r["doc_id"]: r["score"] for r in x.score(docs, model).collect()}
        assert min(s[i] for i in range(1, 200, 2)) > max(s[i] for i in range(0, 200, 2))
