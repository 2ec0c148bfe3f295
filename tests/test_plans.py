"""Plans that must hold at any size."""

from pyspark.sql import functions as F

from tidemark.operators import fold, ordered
from tidemark.sources.runs import RunStore, prune
from tidemark.streaming.flush import flush_stream, folded_stream, stream_state
from tidemark.schema import MUTATION


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def log(spark, n=500):
    return spark.range(n).select(F.lpad((F.col("id") % 50).cast("string"), 4, "0").alias("key"), F.col("id").cast("string").alias("value"), (F.col("id") % 7 == 0).alias("is_tombstone"), F.col("id").alias("seq"))


def test_key_range_reaches_the_scan_below_the_fold(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/s")
    run = store.write_run(log(spark), 1, 0)
    text = plan(fold.range_scan(store.read([run]), "0010", "0020", ordered=False))
    assert "GreaterThanOrEqual(key,0010)" in text and "LessThan(key,0020)" in text
    assert "partial_max_by" in text
    assert "EqualTo(key,0010)" in plan(fold.get(store.read([run]), "0010"))


def test_runs_outside_the_range_are_not_read():
    runs = [{"run_id": 1, "min_key": "a", "max_key": "c"}, {"run_id": 2, "min_key": "d", "max_key": "f"}, {"run_id": 3, "min_key": "", "max_key": "b"}, {"run_id": 4, "min_key": None, "max_key": None}]
    assert [r["run_id"] for r in prune(runs, "c", "d")] == [1, 4]
    assert [r["run_id"] for r in prune(runs, None, "a")] == [3, 4]
    assert [r["run_id"] for r in prune(runs)] == [1, 2, 3, 4]


def test_rank_over_many_ranges(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    got = ordered.ranked(df, ["k"], F.col("k")).collect()
    assert {(r["k"], r["rn"], r["before"]) for r in got} == {(k, k, k * (k - 1) // 2) for k in range(1000)}


def test_seek_before_first_and_across_ranges(spark):
    index = spark.createDataFrame([(f"{k:04d}", k) for k in range(10, 1000, 100)], "key string, offset long")
    probes = spark.createDataFrame([(f"{k:04d}", k) for k in range(0, 1200, 7)], "key string, tag long")
    for r in ordered.seek(index, probes).collect():
        want = max((k for k in range(10, 1000, 100) if k <= r["tag"]), default=None)
        assert r["index_offset"] == want


def test_stream_restarts_and_equals_batch(spark, tmp_path):
    source, root = f"{tmp_path}/in", f"file://{tmp_path}/store"
    everything = log(spark)
    for part in range(3):
        everything.where(F.col("seq") % 3 == part).coalesce(1).write.mode("append").parquet(source)
        s = spark.readStream.schema(MUTATION).option("maxFilesPerTrigger", 1).parquet(source)
        flush_stream(s, root, f"{tmp_path}/cp", compact_every=2).awaitTermination()
    want = sorted(map(tuple, fold.live(everything).collect()))
    assert sorted(map(tuple, fold.live(stream_state(spark, root)).collect())) == want


def test_native_fold_of_a_stream(spark, tmp_path):
    source = f"{tmp_path}/in"
    log(spark).write.parquet(source)
    s = spark.readStream.schema(MUTATION).option("maxFilesPerTrigger", 2).parquet(source)
    q = folded_stream(s).writeStream.format("memory").queryName("folded").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("folded").collect())) == sorted(map(tuple, fold.latest(log(spark)).collect()))
