"""Bloom filter arithmetic in SQL expressions.

Reads of stored runs use Parquet's own bloom filters. These functions give exact
bits where a filter itself is the data: seed-suffixed SHA-256, first eight bytes
as an unsigned integer, modulo the number of bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def bits_for(n: int, fpr: float = 0.01) -> int:
    return int(-n * math.log(fpr) / math.log(2) ** 2)


def hashes_for(n: int, m: int) -> int:
    return max(1, int(m / n * math.log(2)))


def sizing(n: Column, fpr: float = 0.01) -> tuple[Column, Column, Column]:
    """(bits, hash count, expected false positive rate) for a column of counts."""
    m = F.floor(-n * F.lit(math.log(fpr)) / F.lit(math.log(2) ** 2))
    k = F.greatest(F.lit(1), F.floor(m / n * F.lit(math.log(2))))
    return m.cast("long"), k.cast("long"), F.pow(1 - F.exp(-k * n / m), k)


def bit_index(key: Column, seed: Column, m: int) -> Column:
    salted = F.concat(key.cast("binary"), F.unhex(F.lpad(F.hex(seed.cast("long")), 8, "0")))
    head = F.conv(F.substring(F.sha2(salted, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % F.lit(m)).cast("long")


def probes(df: DataFrame, key: str, m: int, k: int) -> DataFrame:
    """A row per key and hash: (key, bit)."""
    return df.select(F.col(key).alias("key"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("seed")).select("key", bit_index(F.col("key"), F.col("seed"), m).alias("bit"))


def filter_bits(df: DataFrame, key: str, m: int, k: int) -> DataFrame:
    """The set bits of a filter over ``df``; at most m rows."""
    return probes(df, key, m, k).select("bit").distinct()


def might_contain(bits: DataFrame, asked: DataFrame, key: str, m: int, k: int) -> DataFrame:
    """Per asked key whether all its bits are set; members are never missed."""
    p = probes(asked.select(key).distinct(), key, m, k).distinct()
    hit = p.join(bits.select("bit", F.lit(1).alias("_set")), "bit", "left")
    return hit.groupBy("key").agg((F.count("_set") == F.count("*")).alias("maybe"))
