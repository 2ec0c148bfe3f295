"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words of 64 bits in a broadcast filter: 16 bytes a row, so 16 MB of rows at most. It tells some six million keys
#: apart; with more it fills and lets more rows pass, at most all of them once.
MAX_WORDS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def wrapped(df: DataFrame) -> DataFrame:
    """All columns as one struct ``d``, so that no name in ``df`` clashes with a join's own; ``d.*`` unwraps it."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("d"))


def bit_filter(keys: DataFrame, key: Column, words: int = MAX_WORDS) -> DataFrame:
    """A bit set over hashed keys as rows (word, bits): at most ``words`` rows, whatever the input.

    A full filter only passes more; it never drops a key that is in the set.
    """
    words = min(words, MAX_WORDS)
    pos = F.pmod(F.xxhash64(key), F.lit(words * 64))
    return keys.select(pos.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits"))


def with_maybe(df: DataFrame, bits: DataFrame, key: Column, name: str, words: int = MAX_WORDS) -> DataFrame:
    """Adds the boolean ``name``: false means that the key is not in the set. The set is broadcast; its size is bounded."""
    words = min(words, MAX_WORDS)
    pos = F.pmod(F.xxhash64(key), F.lit(words * 64))
    b = bits.select(F.col("word").alias("_fw"), F.col("bits").alias("_fb"))
    j = df.withColumn("_fp", pos).join(F.broadcast(b), F.shiftright(F.col("_fp"), 6) == F.col("_fw"), "left")
    hit = F.coalesce(F.expr("getbit(_fb, CAST(_fp & 63 AS INT))") == 1, F.lit(False))
    return j.withColumn(name, hit).drop("_fp", "_fw", "_fb")


def utf8(texts: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as bytes; null is empty."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


#: A-Z lower-cased; ASCII other than letters and digits becomes a blank; other bytes stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def split_words(text: bytes) -> list[bytes]:
    """Lower-cased words of letters, digits and characters beyond ASCII, in UTF-8."""
    return text.translate(_FOLD).split()


def small(batches: Iterator[pa.RecordBatch], text: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of batches with about ``size`` bytes in column ``text``; one row at least. Bounds what a task makes of its rows at once."""
    for b in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(total):
            upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right")))
            yield b.slice(at, upto - at)
            at = upto


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow and mapInPandas that hands freed memory back before and after its task: workers are reused, and share an executor's memory."""

    def release() -> None:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    def wrapped(batches: Iterator) -> Iterator:
        release()  # what the worker's last task and its broadcasts have left
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
