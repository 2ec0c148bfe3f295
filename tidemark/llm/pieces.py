"""SentencePiece encoding and decoding over a trie of marked words.

A space is written as the mark ``▁``, one mark stands before the text, and no piece
has a mark behind another character, so a text falls into marked words that encode
independently. The distinct words of a batch are sorted, which walks their trie depth
first: a word keeps the forward scores of the prefix it shares with the word before
it and computes only the rest. A forward step is Viterbi's: the state of a prefix is
its best last piece, found from the states of shorter prefixes.

* Unigram models: best is the greatest sum of piece scores (ties: the longer piece).
* BPE models: a prefix has exactly one encoding, and a piece can be its last if it and
  the last piece before it are what merging makes of the two alone. Sums of a BPE
  model's scores would give other pieces than its merges do, so they aren't used there.

Characters without a piece become byte pieces, or the unknown piece if a model has
none. Decoding is exact: a literal ``▁`` in a text is encoded in bytes so that it
comes back as itself. Null and empty texts have no pieces. Repeated rows get equal
results; extra columns are ignored, or kept by ``encode_rows``.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.llm.common import free_name, small, table, tidy, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LITERAL = "\ud800"  # stands for a literal mark inside a word: no text in UTF-8 has it
CACHE, PAIRS = 90_000, 90_000


class Vocabulary:
    """Pieces of a model, small enough (32,000 pieces) to go to every task."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], bpe: bool, dummy_prefix: bool = True):
        self.bpe, self.dummy_prefix = bpe, dummy_prefix
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "normal"}
        self.scores = scores
        self.unk = kinds.index("unknown") if "unknown" in kinds else 0
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "byte"}
        self.longest = max(map(len, self.ids), default=1)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a mark inside")
        self.unk_score = min([scores[i] for i in self.ids.values()], default=0.0) - 10
        raw = {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.raw = [raw.get(i, b"\xef\xbf\xbd" if i == self.unk else b"") for i in range(len(pieces))]
        self._setup()

    def _setup(self) -> None:
        self.pairs: dict[tuple[str, str], bool] = {}
        #: No piece has a line feed, so that lines encode independently.
        self.lines = not any("\n" in p for p in self.ids)
        #: Pieces that merging can make of their own characters.
        self.whole = {p for p in self.ids if not self.bpe or self.merged(p) == [p]}
        #: Their endings: a walk back from a place stops where no piece ends so.
        self.endings = {p[k:] for p in self.whole for k in range(len(p))}
        self.encoder: Encoder | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pairs": {}, "encoder": None}

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        import sentencepiece.sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces:
            raise ValueError("this model changes texts before it encodes them")
        names = {1: "normal", 2: "unknown", 3: "control", 4: "normal", 5: "unused", 6: "byte"}
        return cls([p.piece for p in m.pieces], [p.score for p in m.pieces], [names[p.type] for p in m.pieces], m.trainer_spec.model_type == 2, n.add_dummy_prefix)

    def merged(self, word: str) -> list[str]:
        """Pieces of a short word by merging: best score first, leftmost among equals."""
        parts = list(word)
        while True:
            best = None
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best[0]):
                    best = (self.scores[i], k)
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def fit_together(self, a: str, b: str) -> bool:
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return ok

    def units(self, text: str) -> list[str]:
        """Marked words of a text."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, LITERAL)
        if self.dummy_prefix and "  " not in text and text[0] != " ":
            if not self.lines or "\n" not in text:
                return [MARK + w for w in text.split(" ")]
            out = []
            for k, line in enumerate(text.split("\n")):
                words = line.split(" ")
                if k:
                    out.append("\n")
                    if words[0]:
                        out.append(words[0])
                    out += [MARK + w for w in words[1:]]
                else:
                    out += [MARK + w for w in words]
            return out
        if self.dummy_prefix:
            text = " " + text
        text = text.replace(" ", MARK)
        return re.findall(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if self.lines else f"{MARK}*[^{MARK}]+|{MARK}+", text)

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words in sorted order, by one walk through their trie."""
        ids, whole, endings, longest, scores, pairs = self.ids, self.whole, self.endings, self.longest, self.scores, self.pairs
        last: list[str] = [""]  # of each prefix of the walk, its last piece
        total: list[float] = [0.0]
        before = ""
        out = []
        for word in words:
            n = len(word)
            common = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                common += 1
            del last[common + 1 :], total[common + 1 :]
            for i in range(common + 1, n + 1):
                if self.bpe:
                    found = word[i - 1]  # alone unless a longer piece fits; also a character without a piece
                    j = i - 2
                    while j >= 0 and (t := word[j:i]) in endings:
                        if t in whole:
                            if j == 0:
                                found = t
                                break
                            ok = pairs.get((last[j], t))
                            if ok if ok is not None else self.fit_together(last[j], t):
                                found = t
                                break
                        j -= 1
                    last.append(found)
                else:
                    best, found = total[i - 1] + (scores[ids[word[i - 1]]] if word[i - 1] in ids else self.unk_score), word[i - 1]
                    for j in range(i - 2, max(0, i - longest) - 1, -1):
                        k = ids.get(word[j:i])
                        if k is not None and total[j] + scores[k] >= best:
                            best, found = total[j] + scores[k], word[j:i]
                    last.append(found)
                    total.append(best)
            before = word
            parts: list[int] = []
            i = n
            while i:
                p = last[i]
                i -= len(p)
                k = ids.get(p)
                if k is not None:
                    parts.append(k)
                elif self.bytes:
                    parts.extend(self.bytes[c] for c in reversed((MARK if p == LITERAL else p).encode()))
                else:
                    parts.append(self.unk)
            out.append(parts[::-1])
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids, in UTF-8."""
        out = b"".join(map(self.raw.__getitem__, ids))
        return out[1:] if self.dummy_prefix and out[:1] == b" " else out


class Encoder:
    """Encodes batches; words seen before are kept, up to ``CACHE``."""

    @classmethod
    def of(cls, vocabulary: Vocabulary) -> "Encoder":
        """One for all tasks of a worker."""
        if vocabulary.encoder is None:
            vocabulary.encoder = cls(vocabulary)
        return vocabulary.encoder

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.flat, self.begin, self.uses = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def shrink(self) -> None:
        """Keeps the half of the words that was used most."""
        words, keep = list(self.number), np.sort(np.argsort(-self.uses, kind="stable")[: CACHE // 2])
        size = self.begin[keep + 1] - self.begin[keep]
        end = np.cumsum(size)
        flat, uses = self.flat[np.repeat(self.begin[keep] - (end - size), size) + np.arange(int(size.sum()))], self.uses[keep] // 2
        self.clear()
        self.flat, self.begin, self.uses = flat, np.r_[0, end], uses
        for k in keep.tolist():
            self.number[words[k]]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        if len(self.number) > CACHE:
            self.shrink()
        have = len(self.number)
        docs = [np.fromiter(map(self.number.__getitem__, self.vocabulary.units(t)), np.int64) for t in texts]
        if len(self.number) > have:
            fresh = list(self.number)[have:]
            order = sorted(range(len(fresh)), key=fresh.__getitem__)
            coded: list = [None] * len(fresh)
            for k, ids in zip(order, self.vocabulary.encode_sorted([fresh[k] for k in order])):
                coded[k] = ids
            self.flat = np.concatenate([self.flat, np.fromiter((i for c in coded for i in c), np.int32)])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(c) for c in coded])])
        w = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        used = np.bincount(w, minlength=len(self.number))
        used[: len(self.uses)] += self.uses
        self.uses = used
        size = self.begin[w + 1] - self.begin[w]
        end = np.cumsum(size)
        ids = self.flat[np.repeat(self.begin[w] - (end - size), size) + np.arange(int(size.sum()))]
        ends = np.r_[0, end][np.cumsum([0, *map(len, docs)])]
        return ids, ends


def encode_rows(docs: DataFrame, vocabulary: Vocabulary, name: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the array of ids in a new column, and the text decoded from it in another if ``decoded`` names one; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    text, out = docs.columns.index("text"), free_name(docs, name)
    fields = [*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]
    if decoded:
        fields.append(T.StructField(free_name(docs, decoded), T.StringType()))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        encoder = Encoder.of(v)
        for b in small(batches, text):
            ids, ends = encoder([t.decode("utf-8", "replace") for t in utf8(b.column(text))])
            columns = [*b.columns, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))]
            if decoded:
                columns.append(pa.array([v.decode(ids[x:y].tolist()).decode("utf-8", "replace") for x, y in zip(ends[:-1], ends[1:])], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(tidy(run), T.StructType(fields))


def decode_rows(rows: DataFrame, vocabulary: Vocabulary, ids: str = "token_ids", name: str = "decoded") -> DataFrame:
    """``rows`` with the text of an array of ids in a new column."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    at, out = rows.columns.index(ids), free_name(rows, name)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in (w.slice(k, 100) for w in batches for k in range(0, w.num_rows, 100)):
            texts = [v.decode(x or []).decode("utf-8", "replace") for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, out])

    return rows.mapInArrow(tidy(run), schema)


def round_trips(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, exact): encodes and decodes each whole text in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        encoder = Encoder.of(v)
        for b in small(batches, 1):
            raw, rows = utf8(b.column(1)), []
            ids, ends = encoder([t.decode("utf-8", "replace") for t in raw])
            for text, x, y in zip(raw, ends[:-1], ends[1:]):
                own = ids[x:y]
                back = v.decode(own.tolist())
                rows.append((len(own), hashlib.sha256(own.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), back == text))
            n, h, d, ok = zip(*rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h, pa.string()), pa.array(d, pa.string()), pa.array(ok, pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")


def op8_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"), Vocabulary.load(model))
