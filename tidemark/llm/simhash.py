"""SimHash near-dedup with a Gray-order hierarchical index.

A fingerprint has 64 bits over hashed word shingles; fingerprints link at ``radius``
or fewer differing bits, and documents that links connect form a component.

Search. Two fingerprints within radius r agree in one of r+1 disjoint blocks. The
fingerprints, each distinct one once, are dealt r+1 times, rotated so that another
block stands on top, and sorted by Gray rank: equal top blocks are contiguous, and
neighbours differ in few bits. Over each such group a hierarchical index is built
bottom-up: a node holds the bits that all its members share (mask and pattern), a
child only those its parent has not factored out. A search descends from the root,
adds up the differences on each node's own bits, and drops a whole node once the sum
passes r; at a leaf the sum is the exact distance. All groups of a batch are searched
together, level by level, in numpy.

A group larger than a few average groups is split by the other bits' blocks in the
same way, and only what is then still larger is cut into chunks by hash, each pair of
chunks a unit of its own, so that no task holds more than two chunks. Units return
the edges of a spanning forest, fewer than their rows, never all pairs.
Components are found by alternating large-star and small-star steps on the edges,
with a reliable checkpoint per round, or in one task where edges are few.

Defined results: null and empty texts have fingerprint zero, like all texts without
words; repeated rows get equal results; a document with a null doc_id links and
connects others like any other, and only its id is left out of the component's least,
which is null where no document has an id. Extra columns are ignored. An empty table
gives no rows. ``keep_one`` keeps the least doc_id of a group, a null one last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.common import bit_filter, small, table, tidy, utf8, with_maybe, wrapped
from tidemark.sources.shared import cut_lineage, written

SEED, RADIUS, SHINGLE = 42, 3, 3
FAN = 8
#: Least size of a chunk; larger where an average group is large.
CHUNK = 2048
#: Most edges whose components one task finds.
FEW = 500_000
#: Pairs of query and node that are held at once.
FRONTIER = 2_000_000


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text in UTF-8; shingles are taken in slices, so memory is bounded by the text."""
    words = text.lower().split()  # of bytes: A-Z only, and white space is [\x20\x09-\x0D]
    if not words:
        return 0
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= k:
        return h(join(words), SEED)
    n, ones = len(words) - k + 1, np.zeros(64, np.int64)
    for a in range(0, n, 65536):
        part = words[a : a + 65536 + k - 1]
        hashes = np.array([h(join(s), SEED) for s in zip(*(part[i:] for i in range(k)))], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 1, 4 << 20):
            fp = np.array([fingerprint(t, k) for t in utf8(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, fp long")


def gray_rank(x: Column) -> Column:
    """Position of a 64-bit pattern in the Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x


def rotated(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by else x


def turned(fp: Column, radius: int) -> list[Column]:
    """The fingerprint rotated so that each of radius + 1 disjoint blocks stands on top once."""
    width = 64 // (radius + 1)
    return [rotated(fp, i * width) for i in range(radius + 1)]


def _units(fps: DataFrame, radius: int, chunk: int | None) -> DataFrame:
    """(bucket, a, b, side, rank, fp): side 2 queries and is searched, 0 only queries, 1 only is searched.

    A bucket of more than ``chunk`` rows is split by the pigeonhole again: its rows agree on a whole block, so
    that links agree in one of radius + 1 blocks of the other bits, too. Only what then still is larger,
    fingerprints that agree in two blocks, is dealt in pairs of chunks.
    """
    width = 64 // (radius + 1)
    inner = (64 - width) // (radius + 1)
    if chunk is None:
        chunk = max(CHUNK, 4 * fps.count() // (1 << width))
    turn = lambda x: gray_rank(x)
    dealt = fps.select("fp", F.posexplode(F.array(*turned(F.col("fp"), radius))).alias("turn", "x"))
    dealt = dealt.withColumn("bucket", F.shiftleft(F.col("turn").cast("long"), 32) + F.shiftrightunsigned("x", 64 - width))
    large = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("bucket", F.lit(True).alias("_large"))
    dealt = dealt.join(large, "bucket", "left")
    blocks = F.array(*(F.shiftrightunsigned(rotated(F.col("x"), width + i * inner), 64 - inner) for i in range(radius + 1)))
    small_ = dealt.where("_large IS NULL").select("bucket", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(2).cast("byte").alias("side"), "x", "fp")
    split = dealt.where("_large").select("bucket", "x", "fp", F.posexplode(blocks).alias("j", "block"))
    split = split.select(F.xxhash64("bucket", "j", "block").alias("bucket"), "x", "fp", F.lit(0).alias("cls"))
    again = _dealt(split.withColumn("node", F.col("fp")), "bucket", chunk).select("bucket", "a", "b", "side", "x", "fp")
    return small_.unionByName(again).select("bucket", "a", "b", "side", turn(F.col("x")).alias("rank"), "fp")


def _dealt(rows: DataFrame, by: str, most: int, weight: str | None = None) -> DataFrame:
    """Adds (a, b, side): rows (node, cls) of a group ``by`` in units of about 2 * ``most`` rows, or of their weight, at most.

    Each pair of rows of different cls meets in a unit, and each pair at all where a group has one cls only or is
    small. Of a large group the largest cls, whose rows need not meet each other, is cut in chunks, and the other
    rows in chunks that go to each of those and, by pairs, to each other: with few others the rows dealt grow in
    proportion.
    """
    w = F.sum(weight) if weight else F.count("*")
    large = rows.groupBy(by).agg(w.alias("_n")).where(F.col("_n") > most).select(by)
    per = rows.join(large, by, "left_semi").groupBy(by, "cls").agg(w.alias("_c"))
    per = per.groupBy(by).agg(F.max_by("cls", F.struct("_c", "cls")).alias("_top"), F.max("_c").alias("_ntop"), F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    per = per.select(
        by, F.when(F.col("_k") > 1, F.col("_top")).alias("_top"), F.lit(True).alias("_large"), F.ceil(F.col("_ntop") / most).cast("int").alias("_sA"),
        F.greatest(F.lit(1), F.ceil(F.when(F.col("_k") > 1, F.col("_n") - F.col("_ntop")).otherwise(F.col("_n")) / most)).cast("int").alias("_sB"),
    )
    j = rows.join(per, by, "left").withColumns({"_a": F.pmod(F.xxhash64("node"), F.col("_sA")).cast("int"), "_b": F.pmod(F.xxhash64("node", F.lit(1)), F.col("_sB")).cast("int")})
    unit = lambda a, b, side: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), side.cast("byte").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    own = F.transform(
        upto(F.col("_sB")),
        lambda o: unit(-1 - F.least(F.col("_b"), o), F.greatest(F.col("_b"), o), F.when(F.col("_b") == o, 2).when(F.col("_b") < o, 0).otherwise(1)),
    )
    deals = (
        F.when(F.col("_large").isNull(), F.array(unit(F.lit(0), F.lit(0), F.lit(2))))
        .when(F.col("cls") == F.col("_top"), F.transform(upto(F.col("_sB")), lambda o: unit(F.col("_a"), o, F.lit(1))))
        .when(F.col("_top").isNull(), own)
        .otherwise(F.concat(F.transform(upto(F.col("_sA")), lambda o: unit(o, F.col("_b"), F.lit(0))), own))
    )
    return j.select(*rows.columns, F.explode(deals).alias("_u")).select(*rows.columns, "_u.a", "_u.b", "_u.side")


def links(unit: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int | np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers within ``radius`` in the same unit.

    Rows are sorted by unit and Gray rank; ``fp`` has one or more words of 64 bits a row.
    ``radius`` may differ by row: that of the querying row holds.
    """
    fp = fp.reshape(len(fp), -1)
    radius = np.broadcast_to(radius, len(fp))
    rows_i = np.flatnonzero(side >= 1)
    rows_q = np.flatnonzero(side != 1)
    if not len(rows_i) or not len(rows_q):
        return
    differ = lambda q, k, node: np.bitwise_count((fp[q] ^ pats[k][node]) & masks[k][node]).sum(axis=1, dtype=np.int32)
    # Bottom-up: level 0 are the fingerprints.
    own, masks, pats, spans = unit[rows_i], [np.full((len(rows_i), fp.shape[1]), 0xFFFFFFFFFFFFFFFF, np.uint64)], [fp[rows_i]], []
    while True:
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        if spans and len(first) == len(own):
            break
        size = np.diff(np.r_[first, len(own)])
        within = np.arange(len(own)) - np.repeat(first, size)
        start = np.flatnonzero(within % FAN == 0)
        lo, hi = np.bitwise_and.reduceat(pats[-1], start, axis=0), np.bitwise_or.reduceat(pats[-1], start, axis=0)
        mask = np.bitwise_and.reduceat(masks[-1], start, axis=0) & ~(lo ^ hi)
        spans.append((start, np.r_[start[1:], len(own)]))
        own = own[start]
        masks.append(mask)
        pats.append(lo & mask)
    # Each level keeps the bits that its parent does not have.
    for k in range(len(spans)):
        parent = np.repeat(np.arange(len(spans[k][0])), spans[k][1] - spans[k][0])
        masks[k] = masks[k] & ~masks[k + 1][parent]
    members = np.bincount(np.searchsorted(own, unit[rows_i]), minlength=len(own))
    root = np.searchsorted(own, unit[rows_q])
    there = (root < len(own)) & (own[np.minimum(root, len(own) - 1)] == unit[rows_q])
    rows_q, root = rows_q[there], root[there]
    work = np.cumsum(members[root])
    most = FRONTIER // fp.shape[1]
    at = 0
    while at < len(rows_q):
        base = work[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(work, base + most, "right")))
        q, node = rows_q[at:upto], root[at:upto]
        acc = differ(q, len(spans), node)
        at = upto
        for k in range(len(spans) - 1, -1, -1):
            ok = acc <= radius[q]
            q, node, acc = q[ok], node[ok], acc[ok]
            lo, hi = spans[k][0][node], spans[k][1][node]
            n = hi - lo
            node = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else n
            q, acc = np.repeat(q, n), np.repeat(acc, n)
            acc = acc + differ(q, k, node)
        found = rows_i[node]
        ok = (acc <= radius[q]) & ((q < found) | (side[q] == 0) | (side[found] == 1))
        yield q[ok], found[ok]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least row number that links connect each of n rows to."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                break
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def _unit_of(cols: list[np.ndarray]) -> np.ndarray:
    """Number of the unit of each row; rows of a unit stand together."""
    new = np.zeros(len(cols[0]), bool)
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _whole_units(frames: Iterator[pd.DataFrame], by: list[str], least: int) -> Iterator[pd.DataFrame]:
    """Frames joined and cut so that no unit (equal ``by``, rows in order) is split, of ``least`` rows or more where there are."""
    held: list[pd.DataFrame] = []
    rows = 0
    for f in frames:
        held.append(f)
        rows += len(f)
        if rows < least:
            continue
        one = pd.concat(held, ignore_index=True)
        unit = _unit_of([one[c].to_numpy() for c in by])
        cut = int(np.searchsorted(unit, unit[-1])) if len(unit) else 0  # the last unit may go on
        held, rows = [one.iloc[cut:]], len(one) - cut
        if cut:
            yield one.iloc[:cut]
    if held and rows:
        yield pd.concat(held, ignore_index=True)


def _edges(units: DataFrame, words: list[str], radius: int | None, node: str) -> DataFrame:
    """(u, v), u > v: edges of a spanning forest of each unit's links between rows of different ``node``.

    Without a radius, ``size`` bounds it, rows of one ``cls`` aren't linked, and links are all pairs that may be similar.
    """
    columns = ["bucket", "a", "b", "side", "rank", *dict.fromkeys([node, *words]), *(["size", "cls"] if radius is None else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _whole_units(batches, ["bucket", "a", "b"], 32768):
            unit = _unit_of([f[c].to_numpy() for c in ("bucket", "a", "b")])
            some = np.bincount(unit)[unit] > 1
            unit, f = unit[some], f[some]
            if not len(f):
                continue
            side, fp, name = f["side"].to_numpy(), np.stack([f[w].to_numpy() for w in words], axis=1).view(np.uint64), f[node].to_numpy()
            if radius is None:
                size, cls = f["size"].to_numpy(), f["cls"].to_numpy()
                label = forest(len(unit), alike(links(unit, side, fp, reach(size)), size, cls))
            else:
                label = forest(len(unit), links(unit, side, fp, radius))
            linked = np.flatnonzero(label != np.arange(len(label)))
            x, y = name[linked], name[label[linked]]
            yield pd.DataFrame({"u": np.maximum(x, y), "v": np.minimum(x, y)})

    dealt = units.select(*columns).repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "rank")
    return dealt.mapInPandas(tidy(run), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (u, v), u > v; component is the least node reachable.

    Up to ``FEW`` edges, 16 bytes each, are solved in one task; more are contracted in rounds.
    """
    now = cut_lineage(edges.where("u <> v").select("u", "v").distinct())
    if now.count() <= FEW:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            one = pd.concat([pd.DataFrame({"u": [], "v": []}, dtype=np.int64), *batches])
            names, at = np.unique(one[["u", "v"]].to_numpy(), return_inverse=True)
            at = at.reshape(-1, 2)
            label = forest(len(names), iter([(at[:, 0], at[:, 1])]))
            some = np.flatnonzero(label != np.arange(len(label)))
            yield pd.DataFrame({"node": names[some], "component": names[label[some]]})

        return cut_lineage(now.coalesce(1).mapInPandas(tidy(run), "node long, component long"))
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if tuple(state) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = tuple(state)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut_lineage(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut_lineage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def classes(fps: DataFrame, radius: int = RADIUS, chunk: int | None = None) -> DataFrame:
    """(fp, component, size of the fingerprint's group) for rows (doc_id, fp) in a table."""
    reps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-reps")
    comp = components(_edges(_units(reps.select("fp"), radius, chunk), ["fp"], radius, "fp"))
    known = reps.join(comp, reps["fp"] == comp["node"], "left").select("fp", "rep", "n", F.coalesce("component", "fp").alias("_c"))
    least = known.groupBy("_c").agg(F.min("rep").alias("component"))  # null only if no document that is reachable has a doc_id
    return known.join(least, "_c").select("fp", "component", "n")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, chunk: int | None = None) -> DataFrame:
    """A row per document: doc_id, fingerprint (16 hex digits), component_id."""
    fps = written(fingerprints(docs, k), "simhash-fps")
    c = classes(fps, radius, chunk).select("fp", "component")
    return fps.join(c, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


# Similar texts -------------------------------------------------------------
#
# Texts are similar at a Jaccard index of their sets of word shingles of 0.8 or
# more, so that of n and m shingles 9 * common >= 4 * (n + m). Every link is
# decided on the sets themselves; estimates only choose what is compared:
#
# 1. Each set gets a wide SimHash fingerprint and BANDS keys, each of two least
#    hashes, whatever its size or the table's. Texts of similarity 0.8 share none with
#    a probability of (1 - 0.8^2)^BANDS, 1.3e-9, and fingerprints of such texts lie
#    further apart than ``reach`` with less than that.
# 2. Sets that share one of the first FIRST keys are compared; what is similar forms
#    classes. A large group is cut in chunks by hash, another cut for each key.
# 3. Groups of a key that has one class only are done. In the others the Gray index
#    searches the fingerprints for pairs of different classes within ``reach``.
# 4. Texts that such pairs connect meet again, and sets of different classes are
#    compared, all of them. Large groups are dealt in units of bounded size.

WIDE, WIDE_SHINGLE = 2, 5
BANDS, FIRST = 20, 2
PRINTS = [f"f{i}" for i in range(WIDE)]
#: Shingles of a unit: 8 bytes each.
UNIT = 1_000_000
_MIX = np.random.default_rng(11).integers(0, 1 << 64, (2 * BANDS, 2), np.uint64) | np.uint64(1)
_SALTS = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)[:WIDE]
_STEP = 0x9E3779B97F4A7C15


class _Words(dict):
    """Hashes of words seen before; emptied when it holds a hundred thousand."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


_KNOWN = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, k: int = WIDE_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; one of the whole text if it has k words or fewer."""
    words = text.lower().split()
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED + len(words))], np.uint64)
    w = np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))
    n = len(w) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(_STEP) + w[i : i + n]
    return np.unique(_mixed(h))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingles, in words of 64 bits. An estimate only: it decides no link."""
    ones = np.zeros(64 * WIDE, np.int64)
    for a in range(0, len(hashes), 16384):
        part = _mixed(hashes[a : a + 16384, None] ^ _SALTS)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8 * WIDE), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits((ones * 2 > len(hashes)).astype(np.uint8), bitorder="little").view(np.int64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of two least hashes each."""
    least = np.full(2 * BANDS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for a in range(0, len(hashes), 4096):
        x = (hashes[a : a + 4096] ^ _MIX[:, :1]) * _MIX[:, 1:]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, x.min(axis=1))
    return _mixed(least[::2] * np.uint64(_STEP) + least[1::2] + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def reach(size: np.ndarray) -> np.ndarray:
    """Bits of WIDE * 64 that fingerprints of similar sets may differ in. At a similarity of 0.8, 15 % of the bits differ, a few more in small sets: those are not pruned."""
    return np.where(size < 32, 64 * WIDE, 46)


def alike(pairs: Iterator[tuple[np.ndarray, np.ndarray]], size: np.ndarray, cls: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different classes whose sizes allow similar sets."""
    for q, r in pairs:
        ok = (cls[q] != cls[r]) & (5 * np.minimum(size[q], size[r]) >= 4 * np.maximum(size[q], size[r]))
        yield q[ok], r[ok]


def similar_sets(sets: list[np.ndarray], side: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Least row number that similar pairs, or a common cls, connect each set to. Pairs are of two rows of side 2, or of sides 0 and 1.

    Exact: of n shingles, rare ones first, similar sets have one in common among the first n - ceil(4n / 5) + 1.
    """
    first = {c: i for i, c in reversed(list(enumerate(cls.tolist())))}
    label = [first[c] for c in cls.tolist()]

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    def join(x: int, y: int) -> None:
        a, b = root(x), root(y)
        if a != b and 9 * len(np.intersect1d(sets[x], sets[y], assume_unique=True)) >= 4 * (len(sets[x]) + len(sets[y])):
            label[max(a, b)] = min(a, b)

    if len(sets) == 2:
        n, m = sorted((len(sets[0]), len(sets[1])))
        if 5 * n >= 4 * m and (side[0] == 2 or side[0] != side[1]):
            join(0, 1)
        return np.array([root(0), root(1)])
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(counts), np.int64)
    place[np.argsort(counts, kind="stable")] = np.arange(len(counts))  # rare ones first
    ranks = [np.sort(r) for r in np.split(place[inverse], np.cumsum([len(x) for x in sets])[:-1])]
    index: dict[int, list[int]] = {}
    for x in sorted(range(len(ranks)), key=lambda i: len(ranks[i])):
        n = len(ranks[x])
        head = ranks[x][: n - (4 * n + 4) // 5 + 1].tolist()
        near = np.array([y for r in head for y in index.get(r, ())], np.int64)
        if len(near):
            near, times = np.unique(near, return_counts=True)
            for y in near[np.argsort(-times, kind="stable")].tolist():
                if 5 * len(ranks[y]) >= 4 * n and (side[x] == 2 or side[x] != side[y]):
                    join(x, y)
        for r in head:
            index.setdefault(r, []).append(x)
    return np.array([root(x) for x in range(len(label))])


def _sketched(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, tie, size, d0, d1, fingerprint, keys, node): digests of the set, its fingerprint and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 2, 4 << 20):
            size, digests, prints, keys = [], [], [], []
            for t in utf8(b.column(2)):
                s = shingles(t, k)
                raw = s.tobytes()
                size.append(len(s))
                digests.append((xxhash.xxh64_intdigest(raw, 1), xxhash.xxh64_intdigest(raw, 2)))
                prints.append(wide_fingerprint(s))
                keys.append(band_keys(s))
            d, f = np.array(digests, np.uint64).view(np.int64), np.stack(prints)
            ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS)
            columns = [pa.array(size, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), *(pa.array(f[:, i]) for i in range(WIDE)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["doc_id", "tie", "size", "d0", "d1", *PRINTS, "keys"])
        _KNOWN.clear()  # the worker lives on

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text"))
    schema = "doc_id long, tie long, size long, d0 long, d1 long, " + ", ".join(f"{w} long" for w in PRINTS) + ", keys array<long>"
    return written(d.mapInArrow(tidy(run), schema).withColumn("node", F.monotonically_increasing_id()), "similar-sketches")


def _candidates(reps: DataFrame, chunk: int) -> DataFrame:
    """(node, component) of sets that pairs of different classes which may be similar connect."""
    dealt = reps.select(F.explode("keys").alias("bucket"), F.col("rep").alias("node"), "cls", "size", *PRINTS)
    mixed = dealt.groupBy("bucket").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("bucket")
    rows = written(dealt.join(mixed, "bucket"), "similar-mixed")
    units = _dealt(rows, "bucket", chunk).withColumn("rank", gray_rank(F.col(PRINTS[0])))
    comp = components(_edges(units, PRINTS, None, "node"))
    return comp.unionByName(comp.select(F.col("component").alias("node"), "component")).distinct()


def _picked(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, Column]:
    """(docs wrapped, with the column ``_maybe``; condition to join ``keys`` on): only marked rows can be among the keys (doc_id and hash of the text)."""
    own = F.col("d.doc_id").cast("long"), F.xxhash64("d.text")
    marked = with_maybe(wrapped(docs), bit_filter(keys, F.struct(F.col("_i").alias("a"), F.col("_t").alias("b"))), F.struct(own[0].alias("a"), own[1].alias("b")), "_maybe")
    return marked, own[0].eqNullSafe(F.col("_i")) & (own[1] == F.col("_t"))


def _similar_edges(docs: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """(u, v), u > v: edges of a spanning forest of each unit's similar pairs of different cls, for units (bucket, a, b, side, node, cls, _i, _t)."""
    by = ["bucket", "a", "b"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _whole_units(batches, by, 1):
            f = f.drop_duplicates([*by, "node"])
            unit = _unit_of([f[c].to_numpy() for c in by])
            ends = np.flatnonzero(np.r_[unit[1:] != unit[:-1], True]) + 1
            node, side, cls, text = f["node"].to_numpy(), f["side"].to_numpy(), f["cls"].to_numpy(), f["text"].to_numpy()
            u, v = [], []
            for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()):
                if b - a < 2:
                    continue
                label = a + similar_sets([shingles(t, k) for t in text[a:b]], side[a:b], cls[a:b])
                linked = a + np.flatnonzero(label != np.arange(a, b))
                u.append(np.maximum(node[linked], node[label[linked - a]]))
                v.append(np.minimum(node[linked], node[label[linked - a]]))
            if u:
                yield pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)})
        _KNOWN.clear()

    marked, on = _picked(docs.select("doc_id", "text"), units)
    texts = marked.where("_maybe").join(units, on).select(*by, "side", "node", "cls", F.coalesce("d.text", F.lit("")).cast("binary").alias("text"))
    return texts.repartition(*by).sortWithinPartitions(*by, "node").mapInPandas(tidy(run), "u long, v long")


def similar(docs: DataFrame, k: int = WIDE_SHINGLE, chunk: int = CHUNK, unit: int = UNIT) -> DataFrame:
    """(doc_id, tie, keeper): a row per distinct document (doc_id and hash of the text); keeper marks the one of each group that stays, the least."""
    rows = _sketched(docs, k)
    same = ["d0", "d1", "size"]  # never null, so that equal sets meet
    reps = written(rows.groupBy(*same).agg(F.min("node").alias("rep"), *(F.first(c).alias(c) for c in ("keys", *PRINTS))), "similar-reps")
    named = rows.select("node", F.col("doc_id").alias("_i"), F.col("tie").alias("_t"))
    # Classes of sets that share one of the first keys.
    dealt = reps.select(F.explode(F.slice("keys", 1, FIRST)).alias("bucket"), "rep", "size")
    shared = dealt.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("w")).where("n > 1").select("bucket", F.ceil(F.col("w") / unit).cast("int").alias("_s"))
    asked = dealt.join(shared, "bucket").select("bucket", F.pmod(F.xxhash64("rep", "bucket"), F.col("_s")).cast("int").alias("a"), F.lit(0).alias("b"), F.lit(2).cast("byte").alias("side"), F.col("rep").alias("node"), F.col("rep").alias("cls"))
    asked = written(asked.join(named, "node"), "similar-first")
    first = components(_similar_edges(docs, asked, k))
    known = written(reps.join(first, reps["rep"] == first["node"], "left").select(*reps.columns, F.coalesce("component", "rep").alias("cls")), "similar-known")
    # Pairs of different classes.
    comp = _candidates(known, chunk)
    asked = comp.join(known.select(F.col("rep").alias("node"), "cls", "size"), "node").join(named, "node").withColumnRenamed("component", "bucket")
    asked = written(_dealt(written(asked, "similar-asked"), "bucket", unit, "size"), "similar-units")
    edges = _similar_edges(docs, asked, k).unionByName(first.select(F.col("node").alias("u"), F.col("component").alias("v")))
    # A unit's edges lie between rows of classes, which the first edges connect.
    linked = components(edges)
    known = known.join(linked, known["rep"] == linked["node"], "left").select(*same, F.coalesce("component", "rep").alias("component"))
    rows = written(rows.select("doc_id", "tie", *same).join(known, same).select("doc_id", "tie", "component"), "similar-classes")
    least = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "tie")).alias("m"), F.count("*").alias("n")).where("n > 1")
    least = least.select("component", F.col("m.doc_id").alias("_d"), F.col("m.tie").alias("_t"))
    keeper = F.col("_t").isNull() | (F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tie") == F.col("_t")))
    return rows.join(least, "component", "left").groupBy("doc_id", "tie").agg(F.max(keeper).alias("keeper"))


def keep_one(docs: DataFrame, k: int = WIDE_SHINGLE, chunk: int = CHUNK, unit: int = UNIT) -> DataFrame:
    """``docs`` with one document of each group of similar texts. Only rows near a dropped one are shuffled with their text.

    Rows that repeat both doc_id and text count as one document and stay or go together.
    """
    gone = written(similar(docs, k, chunk, unit).where("NOT keeper").select(F.col("doc_id").alias("_i"), F.col("tie").alias("_t")), "similar-gone")
    marked, on = _picked(docs, gone)
    return marked.where("NOT _maybe").select("d.*").unionByName(marked.where("_maybe").join(gone, on, "left_anti").select("d.*"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
