import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash as x


def slow_fp(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    sh = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in h) * 2 > len(h))


def brute(fps, r):
    ids = list(range(len(fps)))
    while True:
        new = [min(ids[j] for j in range(len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= r) for i in range(len(fps))]
        if new == ids:
            return ids
        ids = new


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def family(rng, n, flips):
    base, out = [rng.getrandbits(64) for _ in range(4)], []
    for _ in range(n):
        f = rng.choice(base)
        for _ in range(rng.randrange(flips)):
            f ^= 1 << rng.randrange(64)
        out.append(f)
    return out


@pytest.mark.parametrize("radius,chunk,few", [(3, None, x.FEW), (3, 16, 0), (1, None, x.FEW), (5, 40, 0)])
def test_classes_against_brute_force(spark, monkeypatch, radius, chunk, few):
    monkeypatch.setattr(x, "FEW", few)
    rng = random.Random(radius)
    fps = family(rng, 300, 8) + [rng.getrandbits(64) for _ in range(100)] + [0, 0, (1 << 64) - 1]
    df = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r["fp"]: r["component"] for r in x.classes(df, radius, chunk).collect()}
    want = brute(fps, radius)
    assert {signed(f): want[i] for i, f in enumerate(fps)} == got


def test_fingerprints(spark):
    texts = ["", None, "one", "One two", "a b  c\nd a b c d", "É é " * 40, "x y z " * 30_000, "Tab\tand\x0bmore\x0c"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    got = {r["doc_id"]: r["fingerprint"] for r in x.near_duplicates(df).collect()}
    assert got == {i: f"{slow_fp(t):016x}" for i, t in enumerate(texts)}


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("a é b"))).first()[0] == signed(xxhash.xxh64_intdigest("a é b".encode(), 42))


def test_links_on_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows.sort(key=lambda r: r["doc_id"])
    fps = [slow_fp(r["text"]) for r in rows]
    want = {rows[i]["doc_id"]: rows[c]["doc_id"] for i, c in enumerate(brute(fps, 3))}
    got = {r["doc_id"]: r["component_id"] for r in x.op2_simhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_repeated_null_and_empty(spark):
    df = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (2, "q r s t u"), (None, "lonely words here")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in x.near_duplicates(df).collect()), key=str)
    assert got == sorted([(3, 3), (3, 3), (None, 3), (2, 2), (None, None)], key=str)
    assert x.near_duplicates(df.limit(0)).count() == 0


def test_search_is_exact_on_dense_groups():
    rng = random.Random(9)
    fps = np.array(sorted(set(family(rng, 600, 6)), key=lambda v: v ^ v >> 1), np.uint64)
    unit = np.sort(np.array([rng.randrange(3) for _ in fps]))
    side = np.full(len(fps), 2)
    got = {(a, b) for p in x.links(unit, side, fps, 3) for a, b in zip(p[0].tolist(), p[1].tolist())}
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if unit[a] == unit[b] and bin(int(fps[a] ^ fps[b])).count("1") <= 3}
    assert got == want


def shingles(text, k=5):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or {b" ".join(w)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def near_copies(rng, groups, edits):
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(3000)]
    rows, i = [], 0
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randrange(40, 600))]
        for c in range(3):
            w = list(base)
            for _ in range(int(len(w) * edits) if c else 0):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((i, " ".join(w), g))
            i += 1
    return rows


@pytest.mark.parametrize("edits", [0.01, 0.02])
def test_similar_texts_recall_and_clean_texts(spark, edits):
    rows = near_copies(random.Random(7), 200, edits)
    df = spark.createDataFrame(rows, "doc_id long, text string, node int").repartition(6)
    kept = {r["doc_id"] for r in x.keep_one(df).collect()}
    assert x.keep_one(df).columns == df.columns
    groups = {g for i, _, g in rows if i in kept}
    assert len(groups) == 200  # no group is lost
    sh = [shingles(t) for _, t, _ in rows]
    pairs = [(i, j) for i in range(0, len(rows), 3) for j in (i + 1, i + 2) if jaccard(sh[i], sh[j]) >= 0.8]
    assert len(pairs) > 250
    assert sum(j in kept for _, j in pairs) <= 0.1 * len(pairs)


def test_keep_one_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "other words stand here in a row"), (None, "a b"), (5, "z " * 100_000), (6, "A  b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = x.keep_one(df).collect()
    assert sorted(((r["doc_id"], (r["text"] or "")[:5]) for r in kept), key=str) == sorted([(1, ""), (3, "a b"), (3, "other"), (5, "z z z")], key=str)
    assert x.keep_one(df.limit(0)).count() == 0


def groups_of(texts, least=0.8):
    """Least row number that pairs of true similarity connect each text to."""
    sh = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    root = lambda i: i if label[i] == i else root(label[i])
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sh[i], sh[j]) >= least:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def lone_pairs(rng, n):
    """Texts in pairs without a third copy, at similarities about 0.7 to 0.9, with a common paragraph in some."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    common, out = [word() for _ in range(60)], []
    for i in range(n):
        base = [word() for _ in range(rng.randrange(8, 400))] + (common if i % 3 == 0 else [])
        w = list(base)
        at = rng.randrange(len(w))
        cut = max(1, round(len(w) * rng.uniform(0.04, 0.14)))
        w[at : at + cut] = [word() for _ in range(cut)]
        out += [" ".join(base), " ".join(w)]
    return out


@pytest.mark.parametrize("chunk,unit", [(x.CHUNK, x.UNIT), (16, 3000)])
def test_lone_pairs_against_true_similarity(spark, chunk, unit):
    texts = lone_pairs(random.Random(5), 200)
    want = {i for i, g in enumerate(groups_of(texts)) if g == i}
    assert 220 < len(want) < 380
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    assert {r["doc_id"] for r in x.keep_one(df, chunk=chunk, unit=unit).collect()} == want


def test_texts_below_the_similarity_stay(spark):
    rng = random.Random(3)
    texts = []
    for i in range(40):  # 0.67, 0.71, 0.75 and 0.78: only the last word differs
        base = [f"w{rng.randrange(10**9)}" for _ in range(9 + i % 4)]
        texts += [" ".join(base), " ".join([*base[:-1], "other"])]
    assert groups_of(texts) == list(range(len(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert x.keep_one(df).count() == len(texts)


def test_number_of_rows_does_not_decide(spark, monkeypatch):
    texts = lone_pairs(random.Random(8), 60)
    want = {i for i, g in enumerate(groups_of(texts)) if g == i}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows in (1, 1 << 40):
        monkeypatch.setattr(type(df), "count", lambda self, rows=rows: rows)
        got = {r["doc_id"] for r in x.keep_one(df).collect()}
        assert got == want


def test_null_ids_link_and_bridge(spark):
    fps = [(5, 0x1), (None, 0xF), (9, 0x7F), (None, 0xFF << 40), (None, 0x7F << 40), (3, signed(1 << 63))]
    df = spark.createDataFrame(fps, "doc_id long, fp long")
    got = {r["fp"]: r["component"] for r in x.classes(df).collect()}
    assert got == {0x1: 3, 0xF: 3, 0x7F: 3, 0xFF << 40: None, 0x7F << 40: None, signed(1 << 63): 3}


def test_hot_bucket_is_split_by_other_blocks(spark):
    rng = random.Random(2)
    fps = sorted({rng.getrandbits(48) for _ in range(20_000)})  # all agree in the top block
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    units = x._units(df, 3, 2048).collect()
    assert len(units) <= 4 * len(fps) + 4 * len(fps)
    assert max(__import__("collections").Counter((r["bucket"], r["a"], r["b"]) for r in units).values()) <= 2 * 2048


def test_units_hold_each_pair_of_classes(spark):
    rng = random.Random(4)
    rows = [(g, i, c) for g, (n, k) in enumerate([(7, 2), (90, 1), (120, 3), (300, 2), (200, 200)]) for i, c in ((1000 * g + i, 0 if k < 50 and rng.random() < 0.9 else rng.randrange(k)) for i in range(n))]
    df = spark.createDataFrame(rows, "g long, node long, cls long")
    out = x._dealt(df, "g", 20).collect()
    units = {}
    for r in out:
        units.setdefault((r["g"], r["a"], r["b"]), []).append((r["node"], r["side"]))
    met = set()
    for u in units.values():
        assert len(u) <= 80
        met |= {frozenset((a, b)) for a, s in u for b, t in u if a != b and (s == t == 2 or {s, t} == {0, 1})}
    for g, i, c in rows:
        for h, j, d in rows:
            if g == h and i < j and (c != d or g == 1):
                assert frozenset((i, j)) in met
    # A large class with few others: in proportion.
    hot = spark.range(4000).selectExpr("1L AS g", "id AS node", "IF(id < 5, id, 5) AS cls")
    assert x._dealt(hot, "g", 20).count() <= 4000 + 5 * 202


def test_hot_group_of_near_copies_with_outsiders(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    base = [word() for _ in range(80)]
    texts = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(80)] = word()
        texts.append(" ".join(w))
    for cut in (3, 6, 9, 14, 20):  # about as similar as 0.8 to some of the copies, or less
        w = list(base)
        w[:cut] = [word() for _ in range(cut)]
        texts.append(" ".join(w))
    want = {i for i, g in enumerate(groups_of(texts)) if g == i}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r["doc_id"] for r in x.keep_one(df, chunk=16, unit=1500).collect()} == want
