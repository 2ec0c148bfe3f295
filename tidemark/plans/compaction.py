"""Compaction: which level, which runs, and the merge.

The manifest is a few rows per run, so planning is driver arithmetic; the same
rules as DataFrame expressions are in ``pick_level`` and ``select_inputs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.operators.fold import latest

LEVELS, L0_RUNS, BASE_BYTES, MULTIPLIER = 7, 4, 10 * 1024 * 1024, 10


def pick_level(manifest: DataFrame, base_bytes: int = BASE_BYTES, l0_runs: int = L0_RUNS, multiplier: int = MULTIPLIER) -> DataFrame:
    """One row: the level to compact, or null. Level 0 by run count, others by bytes."""
    per = manifest.groupBy("level").agg(F.count("*").alias("n"), F.sum("file_size").alias("b"))
    due = F.when(F.col("level") == 0, F.col("n") > l0_runs).otherwise(F.col("b") > F.pow(F.lit(float(multiplier)), F.col("level")) * base_bytes)
    return per.where(due).agg(F.min("level").alias("level"))


def select_inputs(manifest: DataFrame) -> DataFrame:
    """Runs to merge per level: all of level 0; of others the larger half, and a lone run moves down."""
    w = Window.partitionBy("level")
    n = F.count("*").over(w)
    rank = F.row_number().over(w.orderBy(F.desc("file_size"), "run_id"))
    return (
        manifest.withColumn("_n", n).withColumn("_r", rank).where((F.col("level") == 0) | (F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 2)))).drop("_n", "_r")
    )


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of runs with common key range; both sides are manifest rows."""
    x, y = a.alias("a"), b.alias("b")
    return x.join(y, (F.col("a.min_key") <= F.col("b.max_key")) & (F.col("b.min_key") <= F.col("a.max_key"))).select(
        F.col("a.run_id").alias("run_a"), F.col("b.run_id").alias("run_b")
    )


def merge(runs: DataFrame, bottom: bool = False) -> DataFrame:
    """Newest version per key; tombstones stay unless nothing older can lie below."""
    out = latest(runs)
    return out.where(~F.col("is_tombstone")) if bottom else out


def plan(runs: list[dict], base_bytes: int = BASE_BYTES, l0_runs: int = L0_RUNS, multiplier: int = MULTIPLIER, level: int | None = None) -> dict | None:
    """The next step for a manifest: inputs, overlapping targets, target level, bottom flag.

    Targets that overlap are merged in, never dropped. The last level compacts
    into itself. ``level`` forces a level.
    """
    at = {i: [r for r in runs if r["level"] == i] for i in range(LEVELS)}
    if level is None:
        due = [i for i in range(LEVELS) if (len(at[0]) > l0_runs if i == 0 else sum(r["file_size"] for r in at[i]) > multiplier**i * base_bytes)]
        if not due:
            return None
        level = due[0]
    own = at[level]
    if not own:
        return None
    last = level == LEVELS - 1
    if level == 0 or last:
        inputs = sorted(own, key=lambda r: r["run_id"])
    else:
        inputs = sorted(own, key=lambda r: (-r["file_size"], r["run_id"]))[: max(1, len(own) // 2)]
    if last and len(inputs) == 1:
        return None
    target = level if last else level + 1
    meets = lambda r, some: r["min_key"] <= max(x["max_key"] for x in some) and min(x["min_key"] for x in some) <= r["max_key"]
    below = [] if last else [r for r in at[target] if meets(r, inputs)]
    merged = [*inputs, *below]
    taken = {r["run_id"] for r in merged}
    # The targets' tombstones are merged, too: their whole range decides whether anything older lies below.
    deeper = [r for r in runs if r["run_id"] not in taken and r["level"] >= level and meets(r, merged)]
    return {"level": level, "target": target, "inputs": inputs, "below": below, "bottom": not deeper}
