"""Counters and gauges of the store, as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.encoding import memory_estimate
from tidemark.operators.mutate import delete_effective


def level_counts(manifest: DataFrame, levels: int = 7) -> DataFrame:
    """Runs and bytes per level, zero-filled."""
    grid = manifest.sparkSession.range(levels).select(F.col("id").cast("int").alias("level"))
    per = manifest.groupBy("level").agg(F.count("*").alias("runs"), F.sum("file_size").alias("bytes"))
    return grid.join(F.broadcast(per), "level", "left").select(  # at most one row per level
        "level", F.coalesce("runs", F.lit(0)).cast("long").alias("runs"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes")
    )


def log_counters(log: DataFrame) -> DataFrame:
    """puts, effective deletes and delete attempts of a mutation log, in one row."""
    attempts = log.agg(
        F.sum((~F.col("is_tombstone")).cast("long")).alias("puts"), F.sum(F.col("is_tombstone").cast("long")).alias("delete_attempts"), F.countDistinct("key").alias("distinct_keys")
    )
    done = delete_effective(log).agg(F.coalesce(F.sum(F.col("effective").cast("long")), F.lit(0)).alias("deletes"))
    return attempts.join(done).select(  # one row each
        F.coalesce("puts", F.lit(0)).cast("long").alias("puts"),
        F.coalesce("delete_attempts", F.lit(0)).cast("long").alias("delete_attempts"),
        F.col("distinct_keys").cast("long").alias("distinct_keys"),
        F.col("deletes").cast("long").alias("deletes"),
    )


def memtable_stats(folded: DataFrame) -> DataFrame:
    """Entries and approximate bytes of a folded batch."""
    return folded.agg(F.count("*").cast("long").alias("memtable_size"), F.coalesce(F.sum(memory_estimate("key", "value")), F.lit(0)).cast("long").alias("memtable_memory"))
