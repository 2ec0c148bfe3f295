import itertools
import random

import numpy as np

from tidemark.llm import license_scan as x
from tidemark.llm.common import split_words


def full(template, words):
    """Matched words of the best local alignment without a band."""
    m, n = len(template), len(words)
    best = [[(0, 0)] * (n + 1) for _ in range(m + 1)]
    top = (0, 0)
    for i in range(m):
        for j in range(n):
            same = template[i] == words[j]
            best[i + 1][j + 1] = max((0, 0), (best[i][j][0] + (2 if same else -1), best[i][j][1] + same), (best[i][j + 1][0] - 1, best[i][j + 1][1]), (best[i + 1][j][0] - 1, best[i + 1][j][1]))
            top = max(top, best[i + 1][j + 1])
    return top[1]


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([[], [w[k], "really"], ["odd"]])
    return " ".join(w)


def test_edited_templates_are_found_with_spans(spark):
    rng = random.Random(2)
    filler = lambda n: " ".join("".join(rng.choice("rstlne") for _ in range(4)) for _ in range(n))
    rows, want = [], {}
    for i, name in enumerate(sorted(x.TEMPLATES) * 3):
        body = edited(rng, x.TEMPLATES[name], len(x.TEMPLATES[name].split()) // 15)
        head = filler(rng.randrange(0, 60))
        rows.append((i, f"{head} {body} {filler(20)}", "z"))
        want[i] = (name, body, len(head))
    got = {}
    for r in x.scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, (name, body, _) in want.items():
        t = [w.decode() for w in split_words(x.TEMPLATES[name].encode())]
        ref = full(t, [w.decode() for w in split_words(body.encode())])
        if ref >= 0.8 * len(t):
            own = [r for r in got[i] if r["license"] == name]
            assert own and max(r["matched_words"] for r in own) == ref, (name, ref)
            words = split_words(rows[i][1][own[0]["start"] : own[0]["end"]].encode())
            assert words[0].decode() in t and words[-1].decode() in t


def test_several_copies_and_overlaps(spark):
    mit, apache = x.TEMPLATES["MIT-notice"], x.TEMPLATES["Apache-2.0"]
    text = f"é {mit}\n{mit} x {apache}"
    got = x.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [r["license"] for r in got] == ["MIT-notice", "MIT-notice", "Apache-2.0"]
    assert text[got[0]["start"] : got[0]["end"]] == mit[:-1] and text[got[1]["start"] : got[1]["end"]] == mit[:-1]
    assert all(r["coverage"] == 1.0 for r in got)


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "license " * 60_000), (4, x.TEMPLATES["MIT-notice"]), (4, x.TEMPLATES["MIT-notice"])], "doc_id long, text string")
    assert [r["doc_id"] for r in x.scan(df).collect()] == [4, 4]
    assert x.scan(df.limit(0)).count() == 0
    try:
        x.Index({"short": "two words"})
        raise AssertionError
    except ValueError:
        pass


def best(template, words, most=True):
    """Matched words of the best local alignment without a band, row by row; the most or the fewest of equally good ones."""
    one = 1 if most else -1
    j = np.arange(len(words)) * (1 << 20)
    row = np.zeros(len(words) + 1, np.int64)
    top = 0
    for t in template:
        straight = row[:-1] + np.where(words == t, (2 << 20) + one, -(1 << 20))
        new = np.maximum(np.maximum(straight, row[1:] - (1 << 20)), 0)
        new = np.maximum(np.maximum.accumulate(new + j) - j, 0)
        row = np.r_[0, new]
        top = max(top, int(new.max(initial=0)))
    return top & ((1 << 20) - 1) if most else -top & ((1 << 20) - 1)


def test_query_against_alignments_of_all_texts(spark):
    sf = "/root/testdata/sf0.001"
    got = {}
    for r in x.op10_license_scan(spark, sf).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], r["matched_words"]))
    index = x.Index(x.TEMPLATES)
    assert len(index.names) >= 25
    found = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = index.ids(split_words((r["text"] or "").encode()))
        ref = {n: (best(w, ids), best(w, ids, most=False), x.COVERAGE * len(w)) for n, w in zip(index.names, index.words)}
        want = {n for n, (m, _, least) in ref.items() if m >= least}
        mine = got.get(r["doc_id"], [])
        assert {n for n, _ in mine} <= want, r["doc_id"]
        for n, (_, m, least) in ref.items():  # reported, or beside one that overlaps it and matches as much
            assert m < least or any(n == k or c >= m for k, c in mine), (r["doc_id"], n)
        found += len(mine)
    assert found


def test_whole_licenses_are_told_apart(spark):
    rows = [(n, f"Copyright 2020 Somebody. All rights reserved.\n{t}\nend") for n, t in x.TEMPLATES.items()]
    got = x.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    for i, (n, _) in enumerate(rows):
        assert (n, 1.0) in {(r["license"], r["coverage"]) for r in got if r["doc_id"] == i}


def test_few_edits_of_short_notices_always_hit():
    """Whichever words change: as many as the coverage allows."""
    index = x.Index(x.TEMPLATES)
    for name, words in zip(index.names, index.words):
        m = len(words)
        if m > 17:
            continue
        text = split_words(x.TEMPLATES[name].encode())
        for edits in itertools.combinations(range(m), int(m * (1 - x.COVERAGE) + 1e-9)):
            t = b" ".join(b"zzz" if i in edits else w for i, w in enumerate(text))
            ref = best(words, index.ids(t.split()), most=False)  # an edit near an end can cost the words beyond it
            assert ref < x.COVERAGE * m or any(n == name or c >= ref for _, n, c, *_ in x.scan_texts(index, [t], x.COVERAGE)), (name, t)


def test_query_finds_every_notice(spark):
    sf = "/root/testdata/sf0.01"
    lines = {t.lower(): n for n, t in x.TEMPLATES.items() if n.endswith("notice")}
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want |= {(r["doc_id"], lines[s.strip().lower()]) for s in (r["text"] or "").split("\n") if s.strip().lower() in lines}
    got = {(r["doc_id"], r["license"]) for r in x.op10_license_scan(spark, sf).collect()}
    assert want and want <= got


def test_winnowing_keeps_one_of_neighbours():
    keys = np.array([random.Random(i).randrange(1 << 60) for i in range(50)])
    kept = set(x.winnowed(keys, 4).tolist())
    assert all(kept & set(range(i, i + 4)) for i in range(47))
