"""Benchmark decontamination with a broadcast set of test n-grams. DataFrame functions only.

Words are maximal runs of digits, letters a-z (A-Z lower-cased) and characters
beyond ASCII. A window is ``n`` consecutive words of a benchmark item; an item of
fewer words is one window. A document is scanned once: every position whose first
and last word could bound a window (a broadcast bit set, sized by the windows and
bounded) becomes a candidate, candidates are joined with the whole windows, word for word,
and hits give spans, which are removed alone or with their document.

The windows are broadcast while they are at most ``MAX_BROADCAST``; a larger set is
joined by a shuffle. Nothing but the windows' lengths and the bit set of the benchmark
reaches the driver.

Defined results: null and empty texts have no words; items without words have no
windows; rows that repeat an item_id count once; a null item_id counts as the empty
id. Rows that repeat a doc_id are judged one by one. Empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.common import bit_filter, table, with_maybe, wrapped
from tidemark.sources.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))  # after lower-casing
WORD_AND_GAP = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+[^0-9A-Za-z\x{80}-\x{10FFFF}]*"
#: Windows of about 100 bytes: 20 MB at most.
MAX_BROADCAST = 200_000
#: Most words of 64 bits of the set: 8 MB, which holds four million windows at 16 bits each.
MAX_BIT_WORDS = 1 << 20


def words(text: Column) -> Column:
    """Lower-cased words in order."""
    t = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(t) == F.length(t)
    low = F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Distinct windows with their items: (gram, len, items)."""
    b = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.lit(n), F.size("w"))
    at = b.select("item", "w", length.alias("len"), F.explode(F.sequence(F.lit(0), F.size("w") - length)).alias("i"))
    return at.groupBy(F.expr("array_join(slice(w, i + 1, len), ' ')").alias("gram"), "len").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _ends(first: str, last: str) -> str:
    return f"xxhash64({first}, {last})"


def _bits(grams: DataFrame, count: int) -> tuple[DataFrame, int]:
    """One row with an array<bigint> ``_b`` over the windows' (first, last) word, and its number of bits."""
    size = 1 << min(MAX_BIT_WORDS.bit_length() - 1, max(6, (max(1, count) * 16 // 64).bit_length()))
    g = grams.select(F.split("gram", " ").alias("g"))
    pos = F.expr(f"pmod({_ends('xxhash64(g[0])', 'xxhash64(element_at(g, -1))')}, {size * 64})")
    rows = g.select(pos.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits")).collect()  # at most ``size`` rows
    full = [0] * size
    for r in rows:
        full[r["word"]] = r["bits"]
    return grams.sparkSession.createDataFrame([(0, full)], "_one int, _b array<bigint>"), size * 64


def annotate(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """A row per document: doc_id, text_key, n_words, spans of hit words [start, end), items."""
    grams = written(windows(benchmark, n), "benchmark-windows")
    facts = grams.groupBy("len").count().collect()  # at most n rows
    count = sum(r["count"] for r in facts)
    d = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.monotonically_increasing_id().alias("_row"), words(F.col("text")).alias("_w"))
    d = d.withColumn("n_words", F.size("_w").cast("long"))
    if not count:
        return d.select("doc_id", "text_key", "n_words", F.expr("CAST(array() AS array<struct<start: int, end: int>>)").alias("spans"), F.expr("CAST(array() AS array<string>)").alias("items"))
    bits, n_bits = _bits(grams, count)
    d = d.withColumn("_h", F.expr("transform(_w, x -> xxhash64(x))")).withColumn("_one", F.lit(0)).join(F.broadcast(bits), "_one")
    found = []
    for r in sorted(r["len"] for r in facts):
        p = f"pmod({_ends('_h[i]', f'_h[i + {r - 1}]')}, {n_bits})"
        at = f"filter(sequence(0, size(_w) - {r}), i -> getbit(_b[CAST(shiftright({p}, 6) AS INT)], CAST({p} & 63 AS INT)) = 1)"
        found.append(f"IF(size(_w) < {r}, CAST(array() AS array<struct<pos: int, len: int>>), transform({at}, i -> struct(i AS pos, {r} AS len)))")
    d = d.withColumn("_at", F.expr(f"concat({', '.join(found)})"))
    d = d.select("doc_id", "text_key", "_row", "n_words", F.expr("transform(_at, a -> struct(a.pos AS pos, a.len AS len, array_join(slice(_w, a.pos + 1, a.len), ' ') AS gram))").alias("_c"))
    e = d.select("doc_id", "text_key", "_row", "n_words", F.explode_outer("_c").alias("c")).select("doc_id", "text_key", "_row", "n_words", "c.pos", "c.len", "c.gram")
    side = grams.select("gram", F.col("len").alias("_len"), "items")
    j = e.join(F.broadcast(side) if count <= MAX_BROADCAST else side, (F.col("len") == F.col("_len")) & e["gram"].eqNullSafe(side["gram"]), "left")
    hit = F.when(F.col("items").isNotNull(), F.struct("pos", "len"))
    out = j.groupBy("_row", "doc_id", "text_key", "n_words").agg(F.array_sort(F.collect_list(hit)).alias("_hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # Places that hits cover, in order; a span begins where the place before it is not covered.
    out = out.withColumn("_c", F.expr("array_sort(array_distinct(flatten(transform(_hits, h -> sequence(h.pos, h.pos + h.len - 1)))))"))
    spans = F.expr(
        "zip_with(filter(_c, (x, i) -> i = 0 OR _c[i - 1] <> x - 1), filter(_c, (x, i) -> i = size(_c) - 1 OR _c[i + 1] <> x + 1), (a, z) -> struct(a AS start, z + 1 AS end))"
    )
    return out.select("doc_id", "text_key", "n_words", spans.alias("spans"), "items")


def verdicts(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    a = annotate(docs, benchmark, n)
    hit = F.expr("aggregate(spans, 0L, (t, s) -> t + s.end - s.start)")
    return a.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "document") -> DataFrame:
    """``docs`` without contaminated documents (mode "document") or without the hit words and the gaps behind them ("span").

    Only documents that may be contaminated are shuffled with their text.
    """
    if mode not in ("document", "span"):
        raise ValueError("mode is document or span")
    bad = annotate(docs, benchmark, n).where(F.size("spans") > 0).select(F.col("doc_id").alias("_i"), F.col("text_key").alias("_k"), F.col("spans").alias("_spans")).dropDuplicates(["_i", "_k"])
    bad = written(bad, "contaminated")  # read twice below
    marked = with_maybe(wrapped(docs), bit_filter(bad, F.col("_k")), F.xxhash64("d.text"), "_maybe")
    clear, near = marked.where("NOT _maybe").select("d.*"), marked.where("_maybe")
    on = F.col("d.doc_id").eqNullSafe(F.col("_i")) & (F.xxhash64("d.text") == F.col("_k"))
    if mode == "document":
        return clear.unionByName(near.join(bad, on, "left_anti").select("d.*"))
    tokens = F.regexp_extract_all("d.text", F.lit(WORD_AND_GAP), F.lit(0))
    head = F.regexp_extract("d.text", r"^[^0-9A-Za-z\x{80}-\x{10FFFF}]*", 0)
    cut = near.join(bad, on, "left").withColumn("_t", tokens).withColumn("_head", head)
    kept = F.expr("concat(_head, array_join(filter(_t, (t, i) -> NOT exists(_spans, s -> i >= s.start AND i < s.end)), ''))")
    cut = cut.withColumn("_new", F.when(F.col("_spans").isNull(), F.col("d.text")).otherwise(kept))
    return clear.unionByName(cut.select(*[F.col("_new").alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns]))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = rf"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(10, len(w)) AS l FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
g AS (SELECT DISTINCT item, l, array_to_string(w[i:i + l - 1], ' ') AS gram FROM (SELECT item, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM b)),
pos AS (SELECT doc_id, l, w, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM g)),
h AS (SELECT a.doc_id, a.i, a.l, g.item FROM (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS gram FROM pos) a JOIN g ON g.l = a.l AND g.gram = a.gram),
p AS (SELECT doc_id, CAST(count(DISTINCT p) AS BIGINT) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(s.n_items, 0) AS n_items,
  coalesce(s.items_sha256, sha256('')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN s ON d.doc_id = s.doc_id"""
