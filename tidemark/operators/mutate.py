"""Writes as DataFrames of mutations: put, batch put, delete-if-exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.operators.fold import live
from tidemark.operators.ordered import ranged


def put(rows: DataFrame) -> DataFrame:
    """Rows (key, value, seq) as upserts; a null value is stored as empty text, not as a tombstone."""
    return rows.select(
        F.col("key"), F.coalesce("value", F.lit("")).alias("value"), F.lit(False).alias("is_tombstone"), F.col("seq").cast("long").alias("seq")
    )


def batch_put(batches: DataFrame) -> DataFrame:
    """Batches (keys ARRAY, values ARRAY, seq base) as mutations; a later duplicate wins.

    Lengths are compared first, because ``arrays_zip`` would pad with nulls: a
    batch of unequal lengths raises.
    """
    checked = batches.where(
        F.when(
            F.coalesce(F.size("keys"), F.lit(-1)) != F.coalesce(F.size("values"), F.lit(-1)),
            F.raise_error(F.lit("keys and values must have the same length")).cast("boolean"),
        ).otherwise(F.lit(True))
    )
    zipped = checked.select("seq", F.posexplode(F.arrays_zip("keys", "values")).alias("pos", "kv"))
    return put(zipped.select(F.col("kv.keys").alias("key"), F.col("kv.values").alias("value"), (F.col("seq") + F.col("pos")).alias("seq")))


def delete_if_exists(log: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (key, seq): returns (tombstones to append, result per key with ``deleted``).

    Only keys that are live get a tombstone; the others are answered with False.
    """
    wanted = requests.groupBy("key").agg(F.max("seq").alias("seq"))
    alive = live(log.join(wanted.select("key"), "key", "left_semi")).select("key")
    hit = wanted.join(alive, "key", "left_semi")
    tombs = hit.select("key", F.lit(None).cast("string").alias("value"), F.lit(True).alias("is_tombstone"), "seq")
    result = wanted.join(hit.select("key", F.lit(True).alias("deleted")), "key", "left").select("key", F.coalesce("deleted", F.lit(False)).alias("deleted"))
    return tombs, result


def delete_effective(log: DataFrame) -> DataFrame:
    """For each delete in a log, whether the key was live just before it.

    The row before a delete in (key, seq) order also shows earlier operations of the
    same batch. Rows are dealt by ranges of (key, seq), so that the history of a key
    that holds a third of all rows is cut; one row per range carries what came before.
    """
    r = ranged(log.select("key", "seq", "is_tombstone"), ["key", "seq"])
    w = Window.partitionBy("_pid").orderBy("key", "seq")
    last = r.groupBy("_pid").agg(F.max_by(F.struct("key", "is_tombstone"), F.struct("key", "seq")).alias("_top"))
    prior = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    carry = last.select("_pid", F.last("_top").over(prior).alias("_carry"))
    before = F.coalesce(F.lag(F.struct("key", "is_tombstone")).over(w), F.col("_carry"))
    was = r.join(F.broadcast(carry), "_pid").withColumn("_before", before).where("is_tombstone")  # as many rows as partitions
    live_ = (F.col("_before.key") == F.col("key")) & ~F.col("_before.is_tombstone")
    return was.select("key", "seq", F.coalesce(live_, F.lit(False)).alias("effective"))
