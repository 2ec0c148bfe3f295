"""The latest-version fold and the reads built on it. Pure DataFrame functions, no I/O.

Key predicates may be applied before the fold (Catalyst moves them below the
aggregate and into the Parquet scan). Tombstone and value predicates are applied
after it, or an older version would surface again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def latest(log: DataFrame) -> DataFrame:
    """One row per key, the one with the greatest ``seq``; tombstones stay.

    ``max_by`` has partial and final aggregation, so a key that holds a third of
    all mutations is combined before the shuffle. Equal ``seq`` values for one key
    are ordered by (is_tombstone, value) so that the result is always the same.
    """
    pick = F.max_by(
        F.struct("value", "is_tombstone"),
        F.struct("seq", "is_tombstone", F.coalesce("value", F.lit(""))),
    )
    folded = log.groupBy("key").agg(pick.alias("_v"), F.max("seq").alias("seq"))
    return folded.select("key", "_v.value", "_v.is_tombstone", "seq")


def live(log: DataFrame) -> DataFrame:
    """Newest versions that are not tombstones."""
    return latest(log).where(~F.col("is_tombstone"))


def merge_sources(*sources: DataFrame) -> DataFrame:
    """Bag union of memtable and runs; recency is in ``seq``, not in the position."""
    cols = ["key", "value", "is_tombstone", "seq"]
    return reduce(DataFrame.unionByName, [s.select(*cols) for s in sources])


def in_range(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Half-open range ``start <= key < end``; None leaves a side open; start >= end is empty."""
    if start is not None:
        df = df.where(F.col("key") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("key") < F.lit(end))
    return df


def range_scan(log: DataFrame, start: str | None, end: str | None, include_tombstones: bool = False, ordered: bool = True) -> DataFrame:
    """Range read in key order. Deleted keys are hidden, or shown with a null value."""
    out = latest(in_range(log, start, end))
    if not include_tombstones:
        out = out.where(~F.col("is_tombstone"))
    return out.orderBy("key") if ordered else out


def get(log: DataFrame, key: str) -> DataFrame:
    """Zero or one live row of ``key``."""
    return live(log.where(F.col("key") == F.lit(key)))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """A row per distinct requested key: value, found, and status 200 or 404.

    The semi join cuts the log to the requested keys before the fold; Spark turns
    it into a broadcast only if the key list is small.
    """
    wanted = keys.select("key").distinct()
    state = live(log.join(wanted, "key", "left_semi"))
    return wanted.join(state.select("key", "value", F.lit(True).alias("_hit")), "key", "left").select(
        "key",
        "value",
        F.coalesce("_hit", F.lit(False)).alias("found"),
        F.when(F.col("_hit"), 200).otherwise(404).alias("status"),
    )
