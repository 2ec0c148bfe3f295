import hashlib
import random

import numpy as np
import pytest
import sentencepiece
import sentencepiece.sentencepiece_model_pb2 as pb

from tidemark.llm import pieces as x

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vocabulary():
    return x.Vocabulary.load(x.MODEL)


def fuzz(rng, n):
    alphabet = ["a", "e", "th", "ing", " ", "  ", "   ", "\n", "é", "ü", "ß", "漢", "😀", "\t", "0", "12", "The", "_", "<s>", "\x00", "ﬁ", ".", "'", " " * 17]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def test_same_ids_as_the_library(spark, vocabulary):
    lib = sentencepiece.SentencePieceProcessor(model_file=x.MODEL)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + fuzz(random.Random(3), 3000)
    encoder = x.Encoder(vocabulary)
    ids, ends = encoder(texts)
    for k, t in enumerate(texts):
        own = ids[ends[k] : ends[k + 1]].tolist()
        assert own == lib.encode(t), t
        assert vocabulary.decode(own) == t.encode()


def test_cache_may_shrink(monkeypatch, vocabulary):
    monkeypatch.setattr(x, "CACHE", 20)
    lib, encoder = sentencepiece.SentencePieceProcessor(model_file=x.MODEL), x.Encoder(vocabulary)
    for t in fuzz(random.Random(8), 400):
        assert encoder([t])[0].tolist() == lib.encode(t), t


def test_unigram_viterbi_same_as_the_library(tmp_path):
    """The same pieces read as a unigram model, with scores that make sums differ."""
    m = pb.ModelProto()
    with open(x.MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    rng = random.Random(1)
    for p in m.pieces:
        if p.type == 1:
            p.score = -5 - 10 * rng.random() - (3 if len(p.piece) > 3 else 0)
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(m.SerializeToString())
    lib, v = sentencepiece.SentencePieceProcessor(model_file=path), x.Vocabulary.load(path)
    texts = fuzz(rng, 1500)
    ids, ends = x.Encoder(v)(texts)
    for k, t in enumerate(texts):
        own, theirs = ids[ends[k] : ends[k + 1]].tolist(), lib.encode(t)
        # The library adds single-precision scores, so that rounding may decide between equal sums.
        if own != theirs:
            assert sorted(own) == sorted(theirs), t


def test_unigram_against_all_segmentations():
    pieces = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca"]
    scores = [0, -3.1, -2.2, -2.5, -2.7, -3.3, -3.4, -5.9, -3.2, -5.1, -4.0]
    v = x.Vocabulary(pieces, scores, ["unknown"] + ["normal"] * 10, bpe=False)

    def best(w):
        if not w:
            return 0.0
        return max(scores[v.ids[w[:k]]] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in v.ids)

    words = sorted({"▁" + "".join(random.Random(s).choice("abc") for _ in range(s % 8)) for s in range(60)})
    for w, ids in zip(words, v.encode_sorted(words)):
        assert sum(scores[i] for i in ids) == pytest.approx(best(w)) and "".join(pieces[i] for i in ids) == w


def test_literal_marks_and_edges_round_trip(spark, vocabulary):
    rows = [(1, "a▁b ▁"), (2, None), (3, ""), (4, " "), (5, "  x  "), (6, "é😀\r\n"), (7, "long " * 60_000), (8, "x" * 50_000), (1, "a▁b ▁")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, token_ids string")
    got = x.round_trips(df, vocabulary).collect()
    assert len(got) == len(rows) and sum(r["n_tokens"] == 0 for r in got) == 2
    assert all(r["exact"] for r in got)
    coded = x.encode_rows(df, vocabulary)
    assert coded.columns == [*df.columns, "_token_ids"]
    back = x.decode_rows(coded, vocabulary, "_token_ids").collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    both = x.encode_rows(df, vocabulary, decoded="decoded").collect()
    assert [r["decoded"] for r in both] == [t or "" for _, t in rows] and [r["_token_ids"] for r in both] == [r["_token_ids"] for r in back]
    assert x.round_trips(df.limit(0), vocabulary).count() == 0


def test_query(spark):
    rows = x.op8_sentencepiece(spark, SF).collect()
    assert len(rows) == 1000 and all(r["exact"] for r in rows)
    text = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id = 7").first()["text"]
    ids = sentencepiece.SentencePieceProcessor(model_file=x.MODEL).encode(text)
    r = next(r for r in rows if r["doc_id"] == 7)
    assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
