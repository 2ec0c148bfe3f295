from collections import Counter, defaultdict

import corpus_pipeline as p

from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_exact_dedup import brute as copies
from tests.llm.test_simhash import shingles
from tidemark.llm import pieces, toxicity

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names = [n for n, _ in p.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "sentencepiece"]
    at = docs
    for name, stage in p.STAGES:
        before = text(at)
        out = p.written(stage(spark, at, SF), "test")
        after = text(out)
        assert set(after) <= set(before) and all(after[i] == before[i] for i in after)
        if name != "sentencepiece":
            assert out.schema.names == docs.schema.names
        if name == "toxicity":
            scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
            assert set(after) == {i for i in before if scores[i] < toxicity.THRESHOLD}
        elif name == "exact_dedup":
            assert set(after) == {k for _, k, _, _ in copies(list(before.items()))}
        elif name == "simhash_near_dedup":
            sets = {i: shingles(t) for i, t in before.items()}
            at_ = defaultdict(list)
            for i, sh in sets.items():
                for x in sh:
                    at_[x].append(i)
            like = {i: {j for j, c in Counter(j for x in sh for j in at_[x]).items() if j != i and 9 * c >= 4 * (len(sh) + len(sets[j]))} for i, sh in sets.items()}
            groups = {}
            for i in sorted(before):  # least member of each group
                todo = [] if i in groups else [i]
                while todo:
                    j = todo.pop()
                    if j not in groups:
                        groups[j] = i
                        todo += like[j]
            assert set(after) == set(groups.values()) and len(after) < len(before)
        elif name == "decontamination":
            some = dict(list(before.items())[:150])
            bad = {r[0] for r in contaminated(list(some.items()), items) if r[5]}
            assert set(some) & set(after) == set(some) - bad
        at = out
    v = pieces.Vocabulary.load(pieces.MODEL)
    for r in at.limit(50).collect():
        assert r["decoded"] == r["text"] and v.decode(r["token_ids"]).decode() == r["text"]


def test_run_keeps_clean_documents(spark):
    out = p.run(spark, SF)
    assert 400 < out.count() < 1000 and "token_ids" in out.columns


def test_stages_on_odd_rows_and_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    own = [(None, "no id at all, but words", "en"), (1, None, "en"), (2, "", None), (2, "", None), (3, "plain text of a few words", "de"), (3, "plain text of a few words", "de"), (4, "plain  text of a few words", None), (5, "long " * 50_000, "en"), (6, "▁ mark \x00 <|im_end|>\n", "en")]
    names = ["node", "bucket", "size", "digest", "row", "keep", "_maybe", "text_key", "spans", "token_ids", "side", "cls", "_i", "_t", "fp", "score"]
    rows = [(*r, "src", len(r[1] or ""), *range(len(names))) for r in own]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for name, stage in p.STAGES:
        out = stage(spark, df, sf)
        kept = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
        assert out.columns[: len(df.columns)] == df.columns
        if name == "exact_dedup":
            want = [r[:2] for r in own if r[0] in (None, 1, 4, 5, 6)]  # the longest of equal texts, then the least doc_id
            assert kept == sorted(want, key=str)
        elif name == "simhash_near_dedup":
            assert {i for i, _ in kept} == {None, 1, 3, 5, 6}
        else:
            assert kept == sorted((r[:2] for r in own), key=str)
        empty = stage(spark, df.limit(0), sf)
        assert empty.columns[: len(df.columns)] == df.columns and empty.count() == 0
