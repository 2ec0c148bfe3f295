import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import suffix_dedup as x


def brute(rows, n):
    """doc_id -> (n_bytes, n_removed, n_spans, kept)."""
    seen, out = set(), []
    order = sorted({(i is None, i or 0, t or "") for i, t in rows}, key=lambda r: r[:2])
    for none, i, t in order:
        b = t.encode()
        cut = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - n + 1):
            w = b[s : s + n]
            if w in seen:
                cut[s : s + n] = True
            seen.add(w)
        spans = int((cut[1:] & ~cut[:-1]).sum() + cut[0])
        out.append((None if none else i, len(b), int(cut.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cut[:-1]])).hexdigest()))
    return sorted(out, key=str)


def got(df, n, gram=None):
    rows = x.remove_repeats(df, n, gram).collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in rows), key=str)


def corpus(seed, docs=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randrange(1, 9)))
    shared = ["".join(word() for _ in range(rng.randrange(5, 40))) for _ in range(6)]
    rows = []
    for i in range(docs):
        parts = [rng.choice([rng.choice(shared), "".join(word() for _ in range(rng.randrange(0, 60)))]) for _ in range(rng.randrange(0, 5))]
        rows.append((i, "".join(parts)))
    return rows + [(100, "ab" * 300), (101, "a" * 500), (102, None), (103, ""), (None, rows[3][1] + "zz"), (104, "b" * 500), (105, "short")]


@pytest.mark.parametrize("seed,n,gram", [(1, 30, None), (2, 12, 5), (3, 100, None)])
def test_against_brute_force(spark, seed, n, gram):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, b"") for i, t in rows], "doc_id long, text string, start int, bytes binary").repartition(5)
    assert got(df, n, gram) == brute(rows, n)


def test_frequent_keys_are_dealt_by_window(spark, monkeypatch):
    monkeypatch.setattr(x, "HOT", 2)
    rows = corpus(4)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 40) == brute(rows, 40)


def test_pieces_of_long_texts(spark, monkeypatch):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(400_000))
    rows = [(1, long), (2, long[1000:1500] + "x" + long[131_000:131_200]), (3, long + long[:50])]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 100) == brute(rows, 100)


def test_repeated_rows_and_empty(spark):
    rows = [(1, "x" * 30 + "abcdefgh" * 9), (1, "x" * 30 + "abcdefgh" * 9), (2, "abcdefghi")]
    one = brute(rows, 8)
    assert set(got(spark.createDataFrame(rows, "doc_id long, text string"), 8)) == set(one)
    assert x.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = x.op7_suffix_dedup(spark, sf).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in out), key=str) == brute(rows, 100)


def test_full_sets_let_more_pass_and_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(x, "_bits", lambda keys, bits: np.full(1, (1 << 64) - 1, np.uint64))
    rows = corpus(6)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 40) == brute(rows, 40)
    monkeypatch.setattr(x, "HOT", 1)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 40) == brute(rows, 40)


def test_radix_of_windows():
    rows = [b"abcabcabc", b"xabcabcx", b"abcabcabc"]
    row, j = x.later_windows(np.zeros(3, np.int64), np.array([4, 3, 4]), rows, 6)
    assert sorted(zip(row.tolist(), j.tolist())) == [(0, 3), (1, 1), (2, 0), (2, 1), (2, 2), (2, 3)]
