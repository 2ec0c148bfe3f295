"""Global order without a single task: ranks, running sums and as-of seek.

An unpartitioned window sends every row to one task. Here rows are dealt by key
range, windows run inside each range, and one small row per range carries what
came before it. The ranged rows are checkpointed because both steps must see the
same range bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.sources.shared import cut_lineage


def ranged(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` dealt by ranges of ``by``, with the number of the range in ``_pid``."""
    return cut_lineage(df.repartitionByRange(*by).withColumn("_pid", F.spark_partition_id()))


def ranked(df: DataFrame, by: list[str], amount: Column | None = None) -> DataFrame:
    """Adds ``rn`` (0-based rank by unique ``by``) and ``before`` (sum of amount in earlier rows)."""
    r = ranged(df.withColumn("_amt", (amount if amount is not None else F.lit(0)).cast("long")), by)
    w = Window.partitionBy("_pid").orderBy(*by)
    local = r.withColumn("_rn", F.row_number().over(w) - 1).withColumn(
        "_sum", F.coalesce(F.sum("_amt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    ranges = r.groupBy("_pid").agg(F.count("*").alias("_n"), F.sum("_amt").alias("_s"))
    prior = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    carry = ranges.select("_pid", F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(prior), F.lit(0)).alias("_s0"))
    return (
        local.join(F.broadcast(carry), "_pid")  # as many rows as partitions
        .withColumn("rn", (F.col("_rn") + F.col("_n0")).cast("long"))
        .withColumn("before", (F.col("_sum") + F.col("_s0")).cast("long"))
        .drop("_pid", "_amt", "_rn", "_sum", "_n0", "_s0")
    )


def sparse_index(df: DataFrame, key: str, size: Column, interval: int = 16) -> DataFrame:
    """Every ``interval``-th record by key with its byte offset."""
    out = ranked(df.select(key, size.cast("long").alias("_size")), [key], F.col("_size"))
    return out.where(F.col("rn") % interval == 0).select(F.col(key).alias("key"), F.col("rn"), F.col("before").alias("offset"))


def seek(index: DataFrame, probes: DataFrame) -> DataFrame:
    """As-of seek: for each probe key the greatest index key <= it (null before the first).

    index (key, offset), probes (key, plus columns) -> probes plus index_key, index_offset.
    """
    extra = [c for c in probes.columns if c != "key"]
    i = index.select("key", F.lit(0).alias("_side"), F.struct(F.col("key").alias("k"), F.col("offset").alias("o")).alias("_at"), *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in extra])
    p = probes.select("key", F.lit(1).alias("_side"), F.lit(None).cast(i.schema["_at"].dataType).alias("_at"), *extra)
    # The last column cuts the probes of a key that many ask for.
    r = ranged(i.unionByName(p).withColumn("_tie", F.monotonically_increasing_id()), ["key", "_side", "_tie"])
    w = Window.partitionBy("_pid").orderBy("key", "_side").rowsBetween(Window.unboundedPreceding, 0)
    local = r.withColumn("_last", F.last("_at", ignorenulls=True).over(w)).where("_side = 1")
    tops = r.groupBy("_pid").agg(F.max("_at").alias("_top"))
    prior = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    carry = tops.select("_pid", F.last("_top", ignorenulls=True).over(prior).alias("_carry"))
    at = F.coalesce("_last", "_carry")
    return local.join(F.broadcast(carry), "_pid").select("key", *extra, at["k"].alias("index_key"), at["o"].alias("index_offset"))
