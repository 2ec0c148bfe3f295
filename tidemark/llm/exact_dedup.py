"""Exact dedup over a log-structured merge index of digests. DataFrame functions only.

* memtable: the rows of one scan task, sorted by digest and flushed as one Parquet
  file without a shuffle; its footer holds min/max and a bloom filter of the digest;
* compaction: runs are merged per digest and keep the smallest identifier by
  (most code points first, then doc_id, then row). Merging is associative, so runs
  may be compacted in any order; partial aggregation folds a hot digest, such as a
  third of all rows, inside each task before the shuffle;
* hits (digests with several rows) receive byte verification: per digest the least
  and the greatest normalised text must be the same bytes. Only hits are read again
  with their text; a bit filter of bounded size, broadcast, finds them. Digests whose
  bytes differ are grouped by the text itself.

Defined results: null text counts as empty. Rows that repeat a doc_id are separate
rows; of rows that tie in code points and doc_id one (the first row read) stays.
A null doc_id comes after all others. An empty table gives an empty result. Extra
columns are ignored by ``verdicts`` and kept by ``keep_unique``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.common import bit_filter, table, with_maybe, wrapped
from tidemark.sources.fs import Files
from tidemark.sources.shared import scratch, written

BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without white space of ``[\\x20\\x09-\\x0D]``."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DigestIndex:
    """Runs under ``root``: level0 files are flushed memtables, level1 the compacted index."""

    RANK = "struct<less: bigint, id_null: boolean, doc_id: bigint, row: bigint>"

    def __init__(self, spark: SparkSession, root: str, digest: Callable[[Column], Column] = sha256, fanout: int = 8):
        self.spark, self.root, self.digest, self.fanout = spark, root, digest, fanout
        self.files = Files(spark, root)
        self.generation = max([0, *(int(n.split("=")[1]) for n in self.files.names("level1"))])

    def _write(self, df: DataFrame, name: str) -> None:
        df.sortWithinPartitions("digest").write.mode("overwrite").option("parquet.bloom.filter.enabled#digest", "true").parquet(f"{self.root}/{name}")

    def flush(self, docs: DataFrame, batch: int) -> None:
        """One sorted run per task; a repeated batch overwrites itself, and no batch may be flushed again once compacted."""
        text = F.coalesce("text", F.lit(""))
        rows = docs.select(
            self.digest(normalised(F.col("text"))).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("chars"),
            (F.monotonically_increasing_id() + F.lit(batch << 52)).alias("row"),
        )
        self._write(rows, f"level0/batch={batch}")

    def flushed(self) -> DataFrame:
        """All rows of all memtables."""
        schema = "digest binary, doc_id bigint, chars bigint, row bigint"
        names = self.files.names("level0")
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/level0/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def compact(self, batches: list[int]) -> None:
        """Merges flushed batches with the index into a new generation; the old one stays until the new is whole."""
        rank = F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("id_null"), "doc_id", "row")
        runs = self.spark.read.schema("digest binary, doc_id bigint, chars bigint, row bigint").parquet(*[f"{self.root}/level0/batch={b}" for b in batches])
        fresh = runs.select("digest", rank.alias("keep"), F.lit(1).cast("long").alias("n"))
        merged = fresh.unionByName(self.index()).groupBy("digest").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))
        self._write(merged, f"level1/gen={self.generation + 1}")
        self.generation += 1
        if self.generation > 1:
            self.files.delete(f"level1/gen={self.generation - 1}")

    def index(self) -> DataFrame:
        """(digest, keep, n): the identifier that stays and the number of rows."""
        schema = f"digest binary, keep {self.RANK}, n bigint"
        return self.spark.read.schema(schema).parquet(f"{self.root}/level1/gen={self.generation}") if self.generation else self.spark.createDataFrame([], schema)

    def collisions(self, docs: DataFrame, hits: DataFrame) -> DataFrame:
        """Byte verification: digests that stand for more than one text."""
        bits = bit_filter(hits, F.col("doc_id"))
        cand = with_maybe(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), bits, F.col("doc_id"), "_maybe").where("_maybe")
        norm = normalised(F.col("text"))
        t = cand.select(self.digest(norm).alias("digest"), norm.alias("norm"))
        return t.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).where("lo <> hi").select("digest")


def _judged(docs: DataFrame, digest: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame | None]:
    """(rows with keep and n, joined per row; rows of colliding digests grouped by text, if there are any)."""
    spark = docs.sparkSession
    ix = DigestIndex(spark, scratch(spark, "exact"), digest)
    ix.flush(docs, 0)
    ix.compact([0])
    rows = ix.flushed().join(ix.index(), "digest")
    bad = ix.collisions(docs, rows.where("n > 1"))
    bad = written(bad, "exact-apart")
    if bad.isEmpty():
        return rows, None
    # Texts that share a digest: the whole text is the key; rows are found again by (digest, doc_id, chars).
    norm = normalised(F.col("text"))
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), norm.alias("norm"), digest(norm).alias("digest"))
    path = scratch(spark, "exact-collisions")
    t.join(bad, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    t = spark.read.parquet(path)
    rank = F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("id_null"), "doc_id", "row")
    g = t.groupBy("norm").agg(F.min(rank).alias("keep"), F.count("*").alias("n"))
    return rows.join(bad, "digest", "left_anti"), t.join(g, "norm")


def verdicts(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chars."""
    rows, apart = _judged(docs, digest)
    out = lambda df, sha: df.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("keep.row")).alias("kept"), sha.alias("text_sha256"), F.col("chars").alias("n_chars")
    )
    first = out(rows, F.lower(F.hex("digest")) if digest is sha256 else F.lit(None).cast("string"))
    return first if apart is None else first.unionByName(out(apart, F.sha2("norm", 256)))


def keep_unique(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows of ``docs`` that stay, all columns. Rows that are not near a dropped one are passed without a shuffle."""
    rows, apart = _judged(docs, digest)
    lost = rows.where(F.col("row") != F.col("keep.row")).select("doc_id")
    if apart is not None:
        lost = lost.unionByName(apart.where(F.col("row") != F.col("keep.row")).select("doc_id"))
    own = F.col("d.doc_id").cast("long")
    marked = with_maybe(wrapped(docs), bit_filter(lost, F.col("doc_id")), own, "_maybe")
    clear = marked.where("NOT _maybe").select("d.*")
    near = marked.where("_maybe").withColumn("_digest", digest(normalised(F.col("d.text")))).withColumn("_chars", F.length(F.coalesce("d.text", F.lit(""))).cast("long"))
    stays = lambda df, key: df.where(F.col("row") == F.col("keep.row")).select(F.col(key).alias("_d"), F.col("keep.doc_id").alias("_k"), (-F.col("keep.less")).alias("_c"))
    same = (F.col("_digest") == F.col("_d")) & (F.col("_chars") == F.col("_c")) & own.eqNullSafe(F.col("_k"))
    # Rows repeated with one doc_id and text: one of them.
    one = lambda df, keep: df.join(keep, same).groupBy("_digest").agg(F.first("d").alias("d")).select("d.*")
    out = clear.unionByName(one(near, stays(rows, "digest")))
    if apart is not None:  # the whole text is the key
        hard = near.join(apart.select(F.col("digest").alias("_d")).distinct(), F.col("_digest") == F.col("_d"), "left_semi")
        out = out.unionByName(one(hard.withColumn("_digest", normalised(F.col("d.text"))), stays(apart, "norm")))
    return out


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))


OP4_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
k AS (SELECT doc_id, t, norm, first_value(doc_id) OVER w AS keep_id, CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size FROM d
  WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256, CAST(length(t) AS BIGINT) AS n_chars FROM k"""
