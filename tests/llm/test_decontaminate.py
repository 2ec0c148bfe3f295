import hashlib
import re

import pytest

from tests.oracle import same
from tidemark.llm import decontaminate as x

SF = "/root/testdata/sf0.01"


def split(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)


def brute(docs, items, n=10):
    out = []
    for i, t in docs:
        w, hit, ids = split(t), set(), set()
        for item, text in items:
            b = split(text)
            length = min(n, len(b))
            for k in range(len(b) - length + 1 if b else 0):
                for p in range(len(w) - length + 1):
                    if w[p : p + length] == b[k : k + length]:
                        hit.update(range(p, p + length))
                        ids.add(str(item))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


W = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
ITEMS = [(1, " ".join(W)), (2, "Éa! ÉA"), (10, "solo"), (11, ""), (12, None), (2, "Éa éa")]
DOCS = [
    (1, "x " + ", ".join(W[:10]).upper() + " y"), (2, " ".join(W) + " " + " ".join(W)), (3, None), (4, ""), (5, "Éa...ÉA éa éa"), (6, " ".join(W[:9])), (7, "a solo-flight SOLO"),
    (8, "k " * 30_000 + "solo"), (8, "solo"), (8, "solo"), (9, "..."),
]


def frames(spark):
    return spark.createDataFrame([(i, t, 1, "z") for i, t in DOCS], "doc_id long, text string, items int, gram string"), spark.createDataFrame(ITEMS, "item_id long, text string")


def test_query_equals_sql(spark):
    assert same(x.op6_decontaminate(spark, SF), x.OP6_SQL, SF) == 1000


def test_against_brute_force(spark):
    d, b = frames(spark)
    assert sorted(map(tuple, x.verdicts(d, b).collect()), key=str) == brute(DOCS, ITEMS)


def test_larger_sets_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(x, "MAX_BROADCAST", 0)
    d, b = frames(spark)
    assert sorted(map(tuple, x.verdicts(d, b).collect()), key=str) == brute(DOCS, ITEMS)


def test_clean_documents_and_spans(spark):
    d, b = frames(spark)
    bad = {r[0] for r in brute(DOCS, ITEMS) if r[5]}
    kept = x.clean(d, b)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in DOCS if i not in bad)
    cut = x.clean(d, b, mode="span")
    assert cut.count() == len(DOCS)
    assert not [r for r in x.verdicts(cut, b).where("doc_id <> 5").collect() if r["contaminated"]]
    texts = {r["doc_id"]: r["text"] for r in cut.where("doc_id in (1, 7)").collect()}
    assert texts == {1: "x y", 7: "a flight "}
    with pytest.raises(ValueError):
        x.clean(d, b, mode="other")


def test_empty_tables(spark):
    d, b = frames(spark)
    assert x.verdicts(d.limit(0), b).count() == 0
    assert x.verdicts(d, b.limit(0)).where("contaminated").count() == 0
    assert x.clean(d, b.limit(0)).count() == len(DOCS)


def test_full_filters_let_more_pass_and_change_nothing(spark, monkeypatch):
    from tidemark.llm import common

    d, b = frames(spark)
    want = sorted(r["doc_id"] for r in x.clean(d, b).collect())
    monkeypatch.setattr(x, "MAX_BIT_WORDS", 1)
    for f in (common.bit_filter, common.with_maybe):
        monkeypatch.setattr(x, f.__name__, lambda *a, f=f: f(*a, words=1))
    assert sorted(r["doc_id"] for r in x.clean(d, b).collect()) == want
    assert sorted(map(tuple, x.verdicts(d, b).collect()), key=str) == brute(DOCS, ITEMS)
