import hashlib
import re

from pyspark.sql import functions as F

from tests.oracle import same
from tidemark.llm import exact_dedup as x

SF = "/root/testdata/sf0.01"


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    return sorted(((i, min(groups[norm(t)])[3], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=str)


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \n"), (7, "é x"), (8, "éx"), (9, "a\t\r\x0b\x0cb"), (10, "x" * 200_000), (11, "y " * 100_000), (12, "y" * 100_000), (None, "ab")]


def test_query_equals_sql(spark):
    assert same(x.op4_exact_dedup(spark, SF), x.OP4_SQL, SF) == 1000


def test_edge_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("row", F.lit(2)).withColumn("keep", F.lit(3))
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in x.verdicts(df).collect()), key=str)
    assert got == brute(ROWS)
    kept = x.keep_unique(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for _, k, _, _ in brute(ROWS)}


def test_colliding_digests_are_told_apart_by_bytes(spark):
    df = spark.createDataFrame(ROWS * 2, "doc_id long, text string")
    weak = lambda t: F.substring(F.encode(t, "UTF-8"), 1, 1)
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in x.verdicts(df, weak).collect()), key=str)
    assert got == sorted([r[:3] for r in brute(ROWS * 2)], key=str)


def test_colliding_digests_keep_one_of_each_text(spark):
    df = spark.createDataFrame(ROWS * 2, "doc_id long, text string")
    weak = lambda t: F.substring(F.encode(t, "UTF-8"), 1, 1)
    want = sorted({(k, sha) for _, k, _, sha in brute(ROWS * 2)}, key=str)
    got = [(r["doc_id"], hashlib.sha256(re.sub(r"[\x20\x09-\x0d]", "", r["text"] or "").encode()).hexdigest()) for r in x.keep_unique(df, weak).collect()]
    assert sorted(got, key=str) == want


def test_repeated_rows_keep_one(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, " a"), (2, "b")], "doc_id long, text string")
    v = x.verdicts(df).collect()
    assert sum(r["kept"] for r in v) == 2 and len(v) == 4
    assert sorted((r["doc_id"], r["text"]) for r in x.keep_unique(df).collect()) == [(1, " a"), (2, "b")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert x.verdicts(df).count() == 0 and x.keep_unique(df).count() == 0


def test_index_grows_by_batches(spark, tmp_path):
    ix = x.DigestIndex(spark, f"file://{tmp_path}/ix")
    for b, rows in enumerate([[(5, "a"), (6, "b")], [(1, "a"), (2, "a  ")]]):
        ix.flush(spark.createDataFrame(rows, "doc_id long, text string"), b)
        ix.compact([b])
    got = {r["keep"]["doc_id"]: r["n"] for r in x.DigestIndex(spark, ix.root).index().collect()}
    assert got == {2: 3, 6: 1}
