"""Immutable sorted runs as Parquet, and the manifest that says which are live.

A run holds one version per key. Its files are range-partitioned and sorted by
key, so footers have disjoint min/max ranges, and they carry a Parquet bloom
filter for point reads. A manifest is one JSON file per version, published by
rename; readers take the highest version and keep a consistent snapshot.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.fold import latest
from tidemark.schema import COLUMNS, MANIFEST, MUTATION
from tidemark.sources.fs import Files


def sorted_run(df: DataFrame) -> DataFrame:
    return latest(df).select(*COLUMNS).repartitionByRange("key").sortWithinPartitions("key")


def run_stats(df: DataFrame, by: str = "run_id") -> DataFrame:
    """count, min, max of keys and sequences per run."""
    return df.groupBy(by).agg(
        F.count("*").alias("key_count"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq")
    )


def prune(manifest: list[dict], start: str | None = None, end: str | None = None) -> list[dict]:
    """Runs that can hold a key of ``[start, end)``. A run without range is kept."""
    out = []
    for r in manifest:
        if r["min_key"] is None or ((end is None or r["min_key"] < end) and (start is None or r["max_key"] >= start)):
            out.append(r)
    return out


class RunStore:
    """Runs under ``root/runs/run=<id>``, manifests under ``root/manifest/<version>.json``."""

    def __init__(self, spark: SparkSession, root: str, bloom_fpp: float = 0.01):
        self.spark, self.root, self.fpp = spark, root.rstrip("/"), bloom_fpp
        self.files = Files(spark, self.root)

    # manifest -------------------------------------------------------------
    def version(self) -> int:
        names = [n for n in self.files.names("manifest") if n.endswith(".json")]
        return int(names[-1].split(".")[0]) if names else 0

    def snapshot(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        return json.loads(self.files.read(f"manifest/{v:012d}.json")) if v else {"runs": [], "flushed_seq": -1, "counters": {}, "compaction": {}}

    def publish(self, state: dict, expected: int) -> int:
        if not self.files.publish(f"manifest/{expected + 1:012d}.json", json.dumps(state)):
            raise RuntimeError("another writer has published this manifest version")
        return expected + 1

    def manifest(self) -> DataFrame:
        names = [f.name for f in MANIFEST.fields]
        return self.spark.createDataFrame([tuple(r[n] for n in names) for r in self.snapshot()["runs"]], MANIFEST)

    # runs -----------------------------------------------------------------
    def write_run(self, df: DataFrame, run_id: int, level: int) -> dict | None:
        """Folds, sorts and writes a run; overwriting makes a repeated batch harmless. None if it is empty."""
        path = f"{self.root}/runs/run={run_id}"
        (
            sorted_run(df)
            .write.mode("overwrite")
            .option("parquet.bloom.filter.enabled#key", "true")
            .option("parquet.bloom.filter.fpp#key", str(self.fpp))
            .parquet(path)
        )
        s = self.spark.read.schema(MUTATION).parquet(path).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.min("seq").alias("s0"), F.max("seq").alias("s1")).first()
        if not s["n"]:
            self.files.delete(f"runs/run={run_id}")
            return None
        return {"run_id": run_id, "level": level, "key_count": s["n"], "file_size": self.files.size(f"runs/run={run_id}"), "min_key": s["lo"], "max_key": s["hi"], "min_seq": s["s0"], "max_seq": s["s1"]}

    def read(self, runs: list[dict]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], MUTATION)
        return self.spark.read.schema(MUTATION).parquet(*[f"{self.root}/runs/run={r['run_id']}" for r in runs])

    def delete_runs(self, runs: list[dict]) -> None:
        for r in runs:
            self.files.delete(f"runs/run={r['run_id']}")
