"""Row shapes of the store and the encodings that keep byte order equal to key order.

State rule used everywhere: the state of a key is its mutation with the greatest
``seq``; a tombstone means the key is absent; keys order by unsigned bytes, which
is how Spark compares STRING (UTF8_BINARY) and BINARY.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

MUTATION = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.StringType(), True),
        T.StructField("is_tombstone", T.BooleanType(), False),
        T.StructField("seq", T.LongType(), False),
    ]
)
MANIFEST = T.StructType(
    [
        T.StructField("run_id", T.LongType(), False),
        T.StructField("level", T.IntegerType(), False),
        T.StructField("key_count", T.LongType(), False),
        T.StructField("file_size", T.LongType(), False),
        T.StructField("min_key", T.StringType(), True),
        T.StructField("max_key", T.StringType(), True),
        T.StructField("min_seq", T.LongType(), True),
        T.StructField("max_seq", T.LongType(), True),
    ]
)
COLUMNS = [f.name for f in MUTATION.fields]


def pad_key(number: Column, width: int = 12) -> Column:
    """A non-negative integer as text whose byte order is the numeric order."""
    return F.lpad(number.cast("string"), width, "0")


def mutations(df: DataFrame, key: Column, value: Column, seq: Column, tombstone: Column | None = None) -> DataFrame:
    """Rows of any table as mutations. A tombstone never carries a value."""
    dead = F.coalesce(tombstone, F.lit(False)) if tombstone is not None else F.lit(False)
    return df.select(
        key.cast("string").alias("key"),
        F.when(~dead, value.cast("string")).alias("value"),
        dead.alias("is_tombstone"),
        seq.cast("long").alias("seq"),
    )
