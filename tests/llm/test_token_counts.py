from collections import Counter

import tiktoken  # noqa: F401
from tidemark.llm import token_counts as x

SF = "/root/testdata/sf0.001"
W = "doc_id long, source string, lang string, version string, tokens long, extra int"


def rows(spark, *r):
    return spark.createDataFrame([(*x_, 0) for x_ in r], W)


def totals(ledger):
    return {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in ledger.totals().collect()}


def test_inserts_deletes_revisions_and_replays(spark, tmp_path):
    ledger = x.Ledger(spark, f"file://{tmp_path}/l")
    one = rows(spark, (1, "a", "en", "v1", 10), (2, "a", "en", "v1", 5), (3, None, "fr", "v1", 7), (4, "b", "en", "v1", None), (None, "b", "en", "v1", 2), (1, "a", "en", "v1", 10), (1, "a", "en", "v1", 9))
    assert ledger.apply("one", one) and totals(ledger) == {("a", "en", "v1"): (2, 15), (None, "fr", "v1"): (1, 7), ("b", "en", "v1"): (2, 2)}
    assert not ledger.apply("one", rows(spark, (9, "a", "en", "v1", 99)))
    gone = spark.createDataFrame([(2,), (2,), (77,), (None,)], "doc_id long")
    assert ledger.apply("two", rows(spark, (1, "c", "en", "v2", 4), (2, "a", "en", "v2", 1)), gone)
    want = {("c", "en", "v2"): (1, 4), (None, "fr", "v1"): (1, 7), ("b", "en", "v1"): (1, 0)}
    assert totals(ledger) == want
    ledger.compact()
    again = x.Ledger(spark, ledger.root)
    assert totals(again) == want
    again.apply("three", rows(spark, (3, "a", "fr", "v2", 8)))
    assert totals(again) == {("c", "en", "v2"): (1, 4), ("a", "fr", "v2"): (1, 8), ("b", "en", "v1"): (1, 0)}
    assert not again.apply("two", None, gone)
    again.compact()
    again.apply("four", None, spark.createDataFrame([(1,), (2,)], "doc_id long"))
    assert totals(again) == {("a", "fr", "v2"): (1, 8), ("b", "en", "v1"): (1, 0)}
    again.files.delete("entries/batch=one")  # nothing reads what a base stands for
    assert {r["doc_id"] for r in again.current().collect()} == {3, 4}


def test_broken_batch_is_not_seen(spark, tmp_path):
    ledger = x.Ledger(spark, f"file://{tmp_path}/l")
    one = rows(spark, (1, "a", "en", "v1", 10))
    publish, ledger.files.publish = ledger.files.publish, lambda *_: False
    assert not ledger.apply("one", one) and totals(ledger) == {}
    ledger.files.publish = publish
    assert ledger.apply("one", one) and totals(ledger) == {("a", "en", "v1"): (1, 10)}
    assert x.Ledger(spark, f"file://{tmp_path}/none").totals().count() == 0


def test_query_against_direct_counts(spark):
    count = {v: x.RankCounter(f"{x.FOLDER}/{v}.tiktoken") for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    want = Counter()
    docs = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if r["doc_id"] not in toxic:
            v = "byte_bpe_50k" if r["lang"] == "en" else "byte_bpe_multi_50k"
            want[r["source"], r["lang"], v] += count[v]([r["text"] or ""])[0]
            docs[r["source"], r["lang"], v] += 1
    got = {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in x.op1_token_counts(spark, SF).collect()}
    assert got == {k: (docs[k], want[k]) for k in docs}


def test_texts(spark):
    d = spark.createDataFrame([(1, "s", "en", None), (2, "s", "en", ""), (3, "s", "en", "word " * 50_000)], "doc_id long, source string, lang string, text string")
    got = {r["doc_id"]: r["tokens"] for r in x.count_tokens(d, "v", x.RankCounter(f"{x.FOLDER}/byte_bpe_50k.tiktoken")).collect()}
    assert got[1] == got[2] == 0 and got[3] >= 50_000
