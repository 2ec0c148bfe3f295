"""Size arithmetic, checksums and time stamps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def varint_len(n: Column) -> Column:
    """Bytes of a LEB128 integer: seven bits a byte; a negative number raises."""
    out = F.lit(9)
    for width in range(8, 0, -1):
        out = F.when(n < F.lit(1 << (7 * width)), width).otherwise(out)
    return F.when(n < 0, F.raise_error(F.lit("varint needs a non-negative integer")).cast("int")).otherwise(out)


def encoded_size(key: Column, value: Column) -> Column:
    """Bytes of ``varint klen, key, varint vlen, value``; a null value counts as empty."""
    k = F.octet_length(key)
    v = F.coalesce(F.octet_length(value), F.lit(0))
    return (varint_len(k) + k + varint_len(v) + v).cast("long")


def memory_estimate(key: str, value: str, pointer_bytes: int = 16) -> Column:
    """Bytes of an in-memory entry, with the expected size of its links."""
    return F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)) + pointer_bytes


def checksum(payload: Column) -> Column:
    """CRC-32 of a binary or of a text in UTF-8, unsigned."""
    return F.crc32(payload.cast("binary"))


def pack(payload: Column) -> Column:
    """(crc, payload)."""
    return F.struct(checksum(payload).alias("crc"), payload.alias("payload"))


def unpack(packed: Column) -> Column:
    """The payload, or null if its checksum is wrong."""
    return F.when(checksum(packed["payload"]) == packed["crc"], packed["payload"])


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time stamp without zone, which counts as UTC whatever the session's zone."""
    return F.unix_micros(F.concat(ts.cast("timestamp_ntz").cast("string"), F.lit("Z")).cast("timestamp"))
