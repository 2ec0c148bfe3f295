"""Repeated passages by a depth-limited radix sort of suffixes.

A byte is removed if a string of ``n`` bytes that covers it also starts earlier
(smaller doc_id, or earlier in the same document). Ordering all suffixes through
their first n bytes and looking at equal groups gives exactly those strings. Digits
are taken most significant first, and a suffix that is alone after a digit leaves.

First digit. Every window of n bytes has a key, the least hash among its grams of
``GRAM`` bytes: equal windows have equal keys, and neighbours mostly share one. The
neighbours with one key make a run of bytes, and since keys come from the content,
a copied passage falls into the same runs wherever it stands, all but those at its
ends. Runs are counted first, by key: how many, and whether all are equal (least and
greatest digest). Keys that occur once leave. What is known of the others goes to the
tasks as bit sets of bounded size (full ones would let more pass, never less):

* runs of a key whose runs are all equal are dealt as a digest of 128 bits, without
  their bytes: the earliest stays, the others go;
* runs of a key whose runs differ, and runs in which the key's gram stands twice, are
  dealt with their bytes;
* where such a key occurs very often, its windows are dealt one by one, by a digest of
  128 bits, so that the windows around a passage that a third of the documents have
  spread over all tasks.

Equal runs of a batch are folded before the shuffle: the earliest goes on, the bytes
of the others are removed at once.

Further digits, eight bytes each, are sorted within a key in numpy through byte n;
what is then still together are equal windows, compared byte by byte.

A document is known by (doc_id, hash of its text): rows that repeat both count as one
document and get equal results. A null doc_id comes after all others; of documents
that repeat only the doc_id, the smaller hash comes first. Null texts are empty; an
empty or short text keeps all. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import bit_filter, table, tidy, with_maybe
from tidemark.sources.shared import written

N, GRAM = 100, 32
BLOCK = 1 << 18
#: Bits of the key sets that go to tasks: 16 MB at most, and 1 MB.
MAX_BITS, HOT_BITS = 1 << 27, 1 << 23
#: Occurrences from which a key whose runs differ is dealt window by window. A task can hold as many.
HOT = 20_000
#: Runs that a task holds at once.
HELD = 60_000
#: What a row of a segment stands for: spans to remove, a digest, bytes.
GONE, DIGEST, BYTES = 0, 1, 2
LAST_ID = (1 << 63) - 1
_RNG = np.random.default_rng(7)
_TABLE = _RNG.integers(0, 1 << 64, 256, np.uint64)
_R = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP = _powers(int(_R), BLOCK + 4096)
_DOWN = _powers(pow(int(_R), -1, 1 << 64), BLOCK + 4096)


def _prefixes(data: np.ndarray) -> np.ndarray:
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _UP[: len(data)], out=p[1:])
    return p


def _between(p: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice, down: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes from each start to its end."""
    h = (p[end] - p[start]) * down
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def gram_hashes(p: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each ``gram`` bytes."""
    return _between(p, slice(None, -gram), slice(gram, None), _DOWN[: len(p) - gram]) | np.uint64(1)


def sliding(x: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f over each w neighbours, by doubling."""
    m, have = x, 1
    while have * 2 <= w:
        m = f(m[:-have], m[have:])
        have *= 2
    return f(m[: len(m) - (w - have)], m[w - have :]) if have < w else m


class Block:
    """Pieces of documents side by side. key[s]: the least gram hash of the window at s, 0 if no window starts there."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, n: int, gram: int):
        self.data, self.n = data, n
        self.p = _prefixes(data)
        self.h = gram_hashes(self.p, gram)
        self.w = n - gram + 1
        key = sliding(self.h, self.w, np.minimum)
        for e in ends[:-1]:
            key[max(0, e - n + 1) : e] = 0
        self.key = key

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, windows, key, 64-bit digest) of the runs of neighbours with one key."""
        start = np.flatnonzero(np.r_[True, self.key[1:] != self.key[:-1]])
        size = np.diff(np.r_[start, len(self.key)])
        some = np.flatnonzero(self.key[start] != 0)
        start, size = start[some], size[some]
        digest = _between(self.p, start, start + size + self.n - 1, _DOWN[start]) + size.astype(np.uint64)
        return start, size, self.key[start], digest

    def twice(self, start: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Whether the key's gram stands more than once in each run; only then can windows of one run be equal."""
        pad = np.zeros(self.w - 1, np.uint64)
        at = np.flatnonzero(sliding(np.concatenate([pad, self.key, pad]), self.w, np.maximum) == self.h)
        order = np.lexsort((at, self.h[at]))
        at, h = at[order], self.h[at[order]]
        some = np.isin(key, h[1:][(h[1:] == h[:-1]) & (at[1:] - at[:-1] <= self.w)])
        for r in np.flatnonzero(some).tolist():
            some[r] = np.count_nonzero(self.h[start[r] : start[r] + size[r] + self.w - 1] == key[r]) > 1
        return some


def blocks(texts: pa.Array, n: int, gram: int) -> Iterator[tuple[Block, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, document, place in it, place in the block) of the pieces of a column of texts."""
    texts = texts.cast(pa.binary())
    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    held: list[tuple[int, int, int]] = []
    total = 0

    def built() -> tuple[Block, np.ndarray, np.ndarray, np.ndarray]:
        parts = [data[off[d] + a : off[d] + b] for d, a, b in held]
        ends = np.cumsum([len(p) for p in parts])
        return Block(np.concatenate(parts), ends, n, gram), np.array([d for d, _, _ in held]), np.array([a for _, a, _ in held]), np.r_[0, ends[:-1]]

    for d in range(len(texts)):
        size = int(off[d + 1] - off[d])
        for a in range(0, size - n + 1, BLOCK // 2):
            b = min(size, a + BLOCK // 2 + n - 1)
            if held and total + b - a > BLOCK:
                yield built()
                held, total = [], 0
            held.append((d, a, b))
            total += b - a
    if held:
        yield built()


def _keys(n: int, gram: int):
    """First digit: (key, how often, least and greatest digest of its runs, whether a run has the gram twice)."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        key, digest, twice = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((digest, key))
        key, digest, twice = key[order], digest[order], twice[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[first, len(key)])
        columns = [key[first].view(np.int64), count.astype(np.int64), digest[first].view(np.int64), digest[first + count - 1].view(np.int64), np.logical_or.reduceat(twice, first)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "n", "lo", "hi", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for block, *_ in blocks(b.column(0), n, gram):
                start, windows, key, digest = block.runs()
                held.append((key, digest >> np.uint64(1), block.twice(start, windows, key)))  # 63 bits, so that their order is that of signed numbers
                size += len(key)
                if size > 1_000_000:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


SEGMENT = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("form", pa.int8()), ("bytes", pa.binary())])


def _segments(n: int, gram: int, again, mixed, hot):
    """Runs of windows whose keys are repeated; equal ones of a batch are folded. Removed runs have no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, differ, often = again.value, mixed.value, hot.value
        bit = lambda bits, k: (bits[(k & np.uint64(len(bits) * 64 - 1)) >> np.uint64(6)] >> (k & np.uint64(63))) & np.uint64(1) == 1
        first: dict[bytes, tuple[int, int, int, int, int, int]] = {}
        gone: list[tuple[int, int, int, int]] = []

        def offer(raw: bytes, at: tuple[int, int, int], key: int, size: int, form: int) -> None:
            old = first.get(raw)
            if old is None or at < old[:3]:
                first[raw] = (*at, key, size, form)
                if old is not None:
                    gone.append((*old[:3], size + n - 1))
            elif at != old[:3]:
                gone.append((*at, size + n - 1))

        def out() -> Iterator[pa.RecordBatch]:
            at = list(first.values())
            columns = [[v[3] for v in at], [v[0] for v in at], [v[1] for v in at], [v[2] for v in at], [v[4] for v in at], [v[5] for v in at], list(first)]
            for i, t, s, size in merge(gone):
                for c, v in zip(columns, (i ^ t, i, t, s, size, GONE, None)):
                    c.append(v)
            first.clear()
            gone.clear()
            yield from pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SEGMENT)], schema=SEGMENT).to_batches(max_chunksize=10_000)

        for b in batches:
            ids, ties = b.column(0).to_numpy(), b.column(1).to_numpy()
            for block, docs, places, bases in blocks(b.column(2), n, gram):
                if len(first) + len(gone) > HELD:
                    yield from out()
                at, size, key, _ = block.runs()
                ok = bit(repeated, key)
                at, size, key = at[ok], size[ok], key[ok]
                piece = np.searchsorted(bases, at, "right") - 1
                doc = docs[piece]
                start = at - bases[piece] + places[piece]
                whole = bit(differ, key)
                raw, heavy = block.data.tobytes(), bit(often, key)
                rows = zip(at.tolist(), size.tolist(), key.view(np.int64).tolist(), ids[doc].tolist(), ties[doc].tolist(), start.tolist(), whole.tolist(), heavy.tolist())
                for a, m, k, i, t, s, full, split in rows:
                    if split:
                        for j in range(m):
                            d = xxhash.xxh3_128_digest(raw[a + j : a + j + n])
                            offer(d, (i, t, s + j), int.from_bytes(d[:8], "big", signed=True), 1, DIGEST)
                    elif full:
                        for j in range(0, m, 256):
                            z = min(256, m - j)
                            offer(raw[a + j : a + j + z + n - 1], (i, t, s + j), k, z, BYTES)
                    else:
                        offer(xxhash.xxh3_128_digest(raw[a : a + m + n - 1]), (i, t, s), k, m, DIGEST)
        yield from out()

    return run


def merge(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(id, tie, start, size) joined where they touch."""
    out: list[tuple[int, int, int, int]] = []
    for i, t, s, z in sorted(spans):
        if out and out[-1][0] == i and out[-1][1] == t and s <= out[-1][2] + out[-1][3]:
            o = out[-1]
            out[-1] = (i, t, o[2], max(o[3], s + z - o[2]))
        else:
            out.append((i, t, s, z))
    return out


def later_windows(group: np.ndarray, size: np.ndarray, rows: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, window in the row) that equal an earlier window of the same group.

    Rows come in order within a group. Most-significant-digit passes over n bytes.
    """
    data = np.frombuffer(b"".join(rows) + bytes(8), np.uint8)
    base = np.r_[0, np.cumsum([len(r) for r in rows])[:-1]]
    row = np.repeat(np.arange(len(rows)), size)
    j = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    pos = base[row] + j
    words = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    at, g = np.arange(len(row)), group[row].astype(np.int64)
    for d in range(0, n, 8):
        if not len(at):
            break
        digit = np.ascontiguousarray(words[pos[at] + d]).view(">u8").ravel().astype(np.uint64)
        if d + 8 > n:
            digit >>= np.uint64(8 * (d + 8 - n))
        order = np.lexsort((digit, g))  # stable: rows stay in order within equal digits
        at, g, digit = at[order], g[order], digit[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (digit[1:] != digit[:-1])]
        g = np.cumsum(new)
        alone = new & np.r_[new[1:], True]
        at, g = at[~alone], g[~alone]
    first = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
    lead = at[first][np.cumsum(first) - 1] if len(g) else at
    late = at[at != lead]
    return row[late], j[late]


def _radix(n: int):
    """Further digits within a key; gives removed runs (id, tie, start, size)."""

    def solve(cols: list) -> list[tuple[int, int, int, int]]:
        key, ids, ties, start, size, form, raw = cols
        out: list[tuple[int, int, int, int]] = []
        seen: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        rows: list[int] = []
        for r in range(len(key)):  # equal runs: the first is the earliest
            if form[r] == GONE:
                out.append((ids[r], ties[r], start[r], size[r]))
                continue
            at = (ids[r], ties[r], start[r])
            lead = seen.setdefault((key[r], raw[r]), at)
            if lead is at:
                if form[r] == BYTES:
                    rows.append(r)
            elif lead != at:
                out.append((*at, size[r] + n - 1))
        group = np.array([key[r] for r in rows], np.int64)
        sizes = np.array([size[r] for r in rows], np.int64)
        if len(rows):
            peers = np.r_[False, group[1:] == group[:-1]] | np.r_[group[1:] == group[:-1], False] | (sizes > 1)
            rows, group, sizes = [r for r, p in zip(rows, peers) if p], group[peers], sizes[peers]
        if len(rows):
            row, j = later_windows(group, sizes, [raw[r] for r in rows], n)
            out += [(ids[rows[a]], ties[rows[a]], start[rows[a]] + b, n) for a, b in zip(row.tolist(), j.tolist())]
        return merge(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in SEGMENT]
        done = lambda spans: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*spans)) or [[]] * 4)], ["id", "tie", "start", "size"])
        for b in batches:
            for c, col in zip(held, b.columns):
                c.extend(col.to_pylist())
            if len(held[0]) < HELD // 3:
                continue
            cut = len(held[0])
            while cut and held[0][cut - 1] == held[0][-1]:
                cut -= 1
            if cut:
                yield done(solve([c[:cut] for c in held]))
                held = [c[cut:] for c in held]
        if held[0]:
            yield done(solve(held))

    return run


def _bits(keys: DataFrame, bits: int) -> np.ndarray:
    """The bit set of keys; its size does not depend on how many there are."""
    word = F.shiftrightunsigned(F.col("key").bitwiseAND(F.lit(bits - 1)), 6)
    rows = keys.select(word.alias("w"), F.expr("shiftleft(1L, CAST(key & 63 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return out


def _known(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"), F.col("doc_id"))


def repeated_spans(docs: DataFrame, n: int = N, gram: int | None = None) -> DataFrame:
    """(id, tie, start, size): runs of bytes to remove; runs of one document may overlap or touch."""
    gram = gram or max(1, min(GRAM, n // 3))
    spark = docs.sparkSession
    d = _known(docs)
    runs = d.select("text").mapInArrow(tidy(_keys(n, gram)), "key long, n long, lo long, hi long, twice boolean")
    counted = runs.groupBy("key").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("twice").alias("twice")).where("n > 1 OR twice")
    counted = written(counted.select("key", "n", (F.col("twice") | (F.col("lo") != F.col("hi"))).alias("mixed")), "suffix-keys")
    size = counted.agg(F.count("*"), F.count_if("mixed")).first()
    share = lambda df, bits: spark.sparkContext.broadcast(_bits(df, bits))
    bits = [min(MAX_BITS, 1 << max(16, (many * 16).bit_length())) for many in size]
    sets = [share(counted, bits[0]), share(counted.where("mixed"), bits[1]), share(counted.where(F.col("mixed") & (F.col("n") >= HOT)), HOT_BITS)]
    seg = d.select("id", "tie", "text").mapInArrow(tidy(_segments(n, gram, *sets)), "key long, id long, tie long, start long, size long, form byte, bytes binary")
    return seg.repartition("key").sortWithinPartitions("key", "id", "tie", "start").mapInArrow(tidy(_radix(n)), "id long, tie long, start long, size long")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (w.slice(k, 1000) for w in batches for k in range(0, w.num_rows, 1000)):
        kept, removed, spans = [], [], []
        for t, starts, sizes in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            runs = merge([(0, 0, s, z) for s, z in zip(starts, sizes)])
            parts, at = [], 0
            for _, _, s, z in runs:
                parts.append(t[at:s])
                at = s + z
            kept.append(b"".join([*parts, t[at:]]))
            removed.append(sum(r[3] for r in runs))
            spans.append(len(runs))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(k) + r for k, r in zip(kept, removed)], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_repeats(docs: DataFrame, n: int = N, gram: int | None = None) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept (bytes that stay).

    Only documents that lose bytes are shuffled with their text.
    """
    spans = written(repeated_spans(docs, n, gram), "suffix-spans")
    d = _known(docs)
    marked = with_maybe(d, bit_filter(spans, F.struct("id", "tie")), F.struct("id", "tie"), "_maybe")
    lists = spans.groupBy("id", "tie").agg(F.collect_list("start").alias("starts"), F.collect_list("size").alias("sizes"))
    none = F.expr("CAST(array() AS array<bigint>)")
    near = marked.where("_maybe").join(lists, ["id", "tie"], "left").select("doc_id", "text", F.coalesce("starts", none).alias("starts"), F.coalesce("sizes", none).alias("sizes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = near.mapInArrow(tidy(_cut), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    whole = marked.where("NOT _maybe").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.encode("text", "UTF-8").alias("kept"))
    return whole.unionByName(cut)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: For tables without repeated or null doc_ids.
OP7_SQL = r"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS rn FROM w) WHERE rn > 1),
k AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM k GROUP BY doc_id, run),
e AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prior FROM s),
t AS (SELECT e.doc_id, count(*) AS n, sum(z - a) AS gone, max(z) AS last, string_agg(substr(h, 2 * prior + 1, 2 * (a - prior)), '' ORDER BY a) AS kept FROM e JOIN d USING (doc_id) GROUP BY e.doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""
