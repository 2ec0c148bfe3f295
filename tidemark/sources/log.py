"""The append-only mutation log: checksummed Parquet batches in sequence order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.schema import COLUMNS, MUTATION
from tidemark.sources.fs import Files

LOGGED = T.StructType([*MUTATION.fields, T.StructField("crc", T.LongType())])


def record_crc() -> Column:
    """CRC-32 of a record; null and empty values differ by the flag in front."""
    return F.crc32(
        F.concat_ws("\x1f", F.col("seq").cast("string"), F.col("is_tombstone").cast("string"), F.hex(F.encode("key", "UTF-8")), F.coalesce(F.hex(F.encode("value", "UTF-8")), F.lit("-")))
    )


def framed(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS).withColumn("crc", record_crc())


def valid(df: DataFrame) -> DataFrame:
    """Records whose checksum holds; damaged ones are skipped, the rest is replayed."""
    return df.where(F.coalesce(F.col("crc") == record_crc(), F.lit(False))).select(*COLUMNS)


def replay(logged: DataFrame, flushed_seq: int = -1) -> DataFrame:
    """Mutations that no run holds yet."""
    return valid(logged.where(F.col("seq") > F.lit(flushed_seq)))


class MutationLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def _batches(self) -> list[str]:
        return [n for n in self.files.names("log") if n.startswith("first=") and self.files.exists(f"log/{n}/_SUCCESS")]

    def append(self, df: DataFrame, first_seq: int) -> None:
        """One commit per batch: a batch without its success marker is not read, and one with it is never overwritten."""
        if self.files.exists(f"log/first={first_seq:020d}/_SUCCESS"):
            raise RuntimeError("another writer has appended at this sequence")
        framed(df).write.mode("overwrite").parquet(f"{self.root}/log/first={first_seq:020d}")

    def read(self, flushed_seq: int = -1) -> DataFrame:
        names = self._batches()
        if not names:
            return self.spark.createDataFrame([], MUTATION)
        return replay(self.spark.read.schema(LOGGED).parquet(*[f"{self.root}/log/{n}" for n in names]), flushed_seq)

    def clear(self, flushed_seq: int) -> None:
        """Retires batches that are wholly in runs."""
        names = self._batches()
        for n, following in zip(names, [*names[1:], None]):
            nxt = int(following.split("=")[1]) if following else None
            if (nxt is not None and nxt - 1 <= flushed_seq) or (nxt is None and int(n.split("=")[1]) <= flushed_seq):
                self.files.delete(f"log/{n}")

    def size(self) -> int:
        return self.files.size("log")
