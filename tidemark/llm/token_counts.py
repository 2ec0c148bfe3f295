"""Token counts as delta-maintained rollups.

A ledger keeps signed rows per document: an insert adds its count, a delete takes the
recorded count away, and a revised count does both. Each batch also writes its sums by
source, language and tokenizer version; totals are the sums of these deltas and never
read the documents again. A batch is visible once its commit file is published by
rename; applying a committed batch again changes nothing, and a batch that broke off
overwrites its own files when it is run again. Compaction folds what is committed into a
base batch, which stands for all before it; a ledger has one writer at a time.

Defined results: a null text has no tokens; null source and language are groups of
their own; a null doc_id is an ordinary id. Of rows that repeat a doc_id within a
batch the greatest (version, source, lang, tokens) counts; a document that a batch
both writes and deletes is deleted. Deletes of unknown documents do nothing. Groups
without documents left are not reported. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import small, table, tidy, utf8
from tidemark.sources.fs import Files
from tidemark.sources.shared import scratch, written

FOLDER = "/opt/tokenizers"
#: The split of texts that the public byte-level vocabularies were made with (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENTRY = "doc_id long, source string, lang string, version string, tokens long, sign int"
DELTA = "source string, lang string, version string, docs long, tokens long"


class RankCounter:
    """Counts by a public rank file; the ranks (under 1 MB) travel with the tasks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.raw = f.read()
        self.encoding = None

    def __getstate__(self) -> dict:
        return {"raw": self.raw, "encoding": None}

    def __call__(self, texts: list[str]) -> list[int]:
        if self.encoding is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.raw.splitlines())}
            self.encoding = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return [len(self.encoding.encode_ordinary(t)) for t in texts]


def count_tokens(docs: DataFrame, version: str, counter: Callable[[list[str]], list[int]]) -> DataFrame:
    """(doc_id, source, lang, version, tokens) of every whole text; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(counter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 3):
            n = shared.value([t.decode("utf-8", "replace") for t in utf8(b.column(3))])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64())], ["doc_id", "source", "lang", "tokens"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text")
    return d.mapInArrow(tidy(run), "doc_id long, source string, lang string, tokens long").withColumn("version", F.lit(version))


class Ledger:
    """``entries/batch=``: signed rows; ``deltas/batch=``: their sums; ``commits/``: what counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def commits(self) -> list[str]:
        return [n.removesuffix(".json") for n in self.files.names("commits") if n.endswith(".json")]

    def _read(self, kind: str, schema: str, batches: list[str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{kind}/batch={b}" for b in batches])

    def _live(self) -> list[str]:
        """Batches that totals read: the last compaction and what came after it."""
        done = self.commits()
        covered: set[str] = set()
        for b in done:
            if b.startswith("base-"):
                covered |= set(json.loads(self.files.read(f"commits/{b}.json"))["covers"])
        return [b for b in done if b not in covered]

    def current(self) -> DataFrame:
        """Documents that are counted now: signed rows of one document and count cancel out."""
        e = self._read("entries", ENTRY, self._live())
        return e.groupBy("doc_id", "source", "lang", "version", "tokens").agg(F.sum("sign").alias("n")).where("n > 0").drop("n")

    def apply(self, batch: str, writes: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Writes (doc_id, source, lang, version, tokens) and deletes (doc_id) in one commit. False if it was committed before."""
        if batch.startswith("base-") or "/" in batch:
            raise ValueError("a batch name has no slash and doesn't begin with base-")
        if batch in self.commits():
            return False
        writes = self.spark.createDataFrame([], ENTRY).drop("sign") if writes is None else writes
        value = F.struct("version", "source", "lang", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
        new = writes.groupBy("doc_id").agg(F.max(value).alias("v"), F.lit(False).alias("gone"))
        if deletes is not None:
            drop = deletes.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().select("doc_id", F.lit(None).cast(new.schema["v"].dataType).alias("v"), F.lit(True).alias("gone"))
            new = new.unionByName(drop).groupBy("doc_id").agg(F.max("v").alias("v"), F.max("gone").alias("gone"))
        new = written(new, "tokens-batch")
        plus = new.where("NOT gone").select("doc_id", "v.source", "v.lang", "v.version", "v.tokens", F.lit(1).alias("sign"))
        rows = plus
        if self.commits():
            old = self.current()
            minus = old.alias("o").join(new.select(F.col("doc_id").alias("_id")), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(*[c for c in old.columns], F.lit(-1).alias("sign"))
            rows = plus.unionByName(minus)
        rows.write.mode("overwrite").parquet(f"{self.root}/entries/batch={batch}")
        entries = self._read("entries", ENTRY, [batch])
        sums = entries.groupBy("source", "lang", "version").agg(F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens"))
        sums.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/deltas/batch={batch}")
        return self.files.publish(f"commits/{batch}.json", json.dumps({"batch": batch}))

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens)."""
        d = self._read("deltas", DELTA, self._live())
        return d.groupBy("source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """Folds all deltas into one, and all entries into a row per document that is counted now; later batches read no older ones."""
        live = self._live()
        name = f"base-{len(self.commits()):09d}"
        self.current().withColumn("sign", F.lit(1)).write.mode("overwrite").parquet(f"{self.root}/entries/batch={name}")
        self.totals().coalesce(1).write.mode("overwrite").parquet(f"{self.root}/deltas/batch={name}")
        self.files.publish(f"commits/{name}.json", json.dumps({"covers": [*live, *[b for b in self.commits() if b not in live]]}))


def op1_token_counts(spark: SparkSession, sf_dir: str, folder: str = FOLDER) -> DataFrame:
    """All documents are counted; texts that aren't English get a revised count by another tokenizer; labelled toxic
    documents are deleted; the first batch is sent twice. No batch shuffles texts."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ledger = Ledger(spark, scratch(spark, "tokens"))
    first = count_tokens(docs, "byte_bpe_50k", RankCounter(f"{folder}/byte_bpe_50k.tiktoken"))
    ledger.apply("load", first)
    other = docs.where("lang <> 'en'")
    ledger.apply("recount", count_tokens(other, "byte_bpe_multi_50k", RankCounter(f"{folder}/byte_bpe_multi_50k.tiktoken")))
    ledger.apply("takedown", deletes=labels.where("toxic = 1").select("doc_id"))
    ledger.apply("load", first)
    ledger.compact()
    return ledger.totals()
