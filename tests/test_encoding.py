import datetime
import zlib

from pyspark.sql import functions as F

from tidemark.functions import encoding as x


def test_checksum_is_crc32(spark):
    texts = ["", "a", "é" * 300, "\x00\x01", "123456789"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(x.checksum(F.col("t"))).collect()]
    assert got == [zlib.crc32(t.encode()) for t in texts] and got[-1] == 0xCBF43926


def test_frames(spark):
    df = spark.createDataFrame([("a",), ("",), (None,)], "t string").select(x.pack(F.col("t")).alias("p"))
    assert [r[0] for r in df.select(x.unpack(F.col("p"))).collect()] == ["a", "", None]
    bad = df.select(F.struct(F.col("p.crc"), F.concat("p.payload", F.lit("!")).alias("payload")).alias("p"))
    assert [r[0] for r in bad.select(x.unpack(F.col("p"))).collect()] == [None, None, None]


def test_varint_lengths(spark):
    n = [0, 127, 128, 16383, 16384, 2097151, 2097152, (1 << 31) - 1]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in n], "n long").select(x.varint_len(F.col("n"))).collect()]
    assert got == [max(1, -(-v.bit_length() // 7)) for v in n]


def test_micros_in_any_zone(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 7, 1, 2, 3, 4, 567891),), (None,)], "ts timestamp_ntz").select(x.micros(F.col("ts")).alias("m"))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [r[0] for r in df.collect()] == [1719799384567891, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
