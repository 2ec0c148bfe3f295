import random

import pytest
from pyspark.sql import Row

from tidemark.operators import fold, mutate
from tidemark.plans import compaction
from tidemark.schema import MUTATION
from tidemark.sources import log as wal
from tidemark.store import Store


def rows(spark, *r):
    return spark.createDataFrame(list(r), MUTATION)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/kv", auto_compact=False)


def content(s):
    return {r["key"]: r["value"] for r in s.state().collect()}


def test_put_get_overwrite_delete(store):
    store.put("test_key", "value1")
    store.put("test_key", "value2")
    assert store.get("test_key") == "value2"
    assert store.delete("test_key") is True
    assert store.get("test_key") is None
    assert store.delete("nonexistent_key") is False
    store.put("empty", "")
    assert store.get("empty") == ""
    store.put("marker", "__TOMBSTONE__")
    store.flush()
    assert store.get("marker") == "__TOMBSTONE__"


def test_range_half_open_and_ordered(store):
    store.batch_put([f"key{i}" for i in (3, 1, 5, 2, 4)], [f"value{i}" for i in (3, 1, 5, 2, 4)])
    store.delete("key3")
    assert [r["key"] for r in store.range_scan("key2", "key5").collect()] == ["key2", "key4"]
    assert [(r["key"], r["value"]) for r in store.range_scan("key2", "key4", include_tombstones=True).collect()] == [("key2", "value2"), ("key3", None)]
    assert store.range_scan("key5", "key2").count() == 0


def test_batch_lengths_and_last_duplicate(store, spark):
    with pytest.raises(ValueError):
        store.batch_put(["a", "b"], ["1"])
    store.batch_put(["a", "a"], ["1", "2"])
    assert store.get("a") == "2"
    bad = spark.createDataFrame([Row(keys=["a", "b"], values=["1"], seq=0)])
    with pytest.raises(Exception, match="same length"):
        mutate.batch_put(bad).collect()


def test_restart_flush_and_replay(store, spark):
    store.put("flushed", "1")
    store.flush()
    store.put("logged", "2")
    again = Store(spark, store.root, auto_compact=False)
    assert content(again) == {"flushed": "1", "logged": "2"}
    again.put("flushed", "3")
    again.close()
    assert content(Store(spark, store.root)) == {"flushed": "3", "logged": "2"}
    assert Store(spark, store.root).log.read().count() == 0


def test_entry_limit_flushes(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/kv", memtable_entries=50)
    s.batch_put([f"k{i:03d}" for i in range(60)], ["v"] * 60)
    assert s.counters["flushes"] == 1 and s.stats()["engine"]["sstable_counts"][0] == 1
    assert s.get("k000") == "v" and s.get("k059") == "v"


def test_random_operations_match_a_dict(spark, tmp_path):
    rng = random.Random(5)
    s, model = Store(spark, f"file://{tmp_path}/kv", auto_compact=False), {}
    for step in range(6):
        batch = []
        for i in range(30):
            k = rng.choice(["", "ä", "z", *[f"k{j}" for j in range(12)]])
            if rng.random() < 0.3:
                batch.append((k, None, True, i))
                model.pop(k, None)
            else:
                model[k] = f"{step}-{i}"
                batch.append((k, model[k], False, i))
        s.write(rows(spark, *batch))
        s.flush()
        if step % 2:
            s.compact(rng.choice([0, 1, 2]))
        assert content(s) == model
    s.force_compaction()
    assert content(Store(spark, s.root)) == model


def test_compaction_keeps_overlapping_targets_and_gc(store, spark):
    store.batch_put(["a", "m", "z"], ["1", "1", "1"])
    store.flush()
    store.compact(0)
    store.delete("m")
    store.put("a", "2")
    store.flush()
    store.compact(0)
    assert content(store) == {"a": "2", "z": "1"}
    state = store.runs.snapshot()
    assert [r["level"] for r in state["runs"]] == [1] and state["runs"][0]["key_count"] == 2


def test_tombstones_of_targets_stay_above_deeper_runs(store):
    """A target's range may be wider than the inputs': its tombstones must not go while a deeper run meets it."""
    store.batch_put(["w", "x", "z"], ["1", "1", "1"])
    store.flush()
    store.compact(0)
    store.compact(1)
    store.delete("x")
    store.batch_put(["a", "z"], ["2", "2"])
    store.flush()
    store.compact(0)
    assert store.get("x") is None
    store.batch_put(["a", "b", "c"], ["3", "3", "3"])
    store.flush()
    store.compact(0)
    assert store.get("x") is None
    assert content(store) == {"a": "3", "b": "3", "c": "3", "w": "1", "z": "2"}


def test_random_operations_on_apart_ranges_and_levels(spark, tmp_path):
    rng = random.Random(11)
    s, model = Store(spark, f"file://{tmp_path}/kv", auto_compact=False), {}
    for step in range(12):
        lo = rng.choice("aceg")
        keys = [f"{c}{i}" for c in (lo, chr(ord(lo) + rng.randrange(3))) for i in range(3)]
        batch = []
        for i, k in enumerate(keys):
            if rng.random() < 0.5:
                batch.append((k, None, True, i))
                model.pop(k, None)
            else:
                model[k] = f"{step}-{i}"
                batch.append((k, model[k], False, i))
        s.write(rows(spark, *batch))
        s.flush()
        for _ in range(rng.randrange(3)):
            s.compact(rng.choice([0, 0, 1, 2, 3]))
        if step % 3 == 2:
            assert content(s) == model
    assert len({r["level"] for r in s.runs.snapshot()["runs"]}) > 1
    assert content(s) == model


def test_counters_survive_and_never_shrink(store, spark, monkeypatch):
    store.put("a", "1")
    store.get("a")
    store.flush()
    for i in range(3):
        store.put("b", str(i))
        store.flush()
        store.compact(0)
    store.get("b")
    before = store.stats()
    store.close()
    after = Store(spark, store.root).stats()
    assert after["engine"]["gets"] == 2 and after["engine"]["puts"] == 4 and after["engine"]["compactions"] == 3
    assert after["compaction"] == before["compaction"] and after["compaction"]["compactions_completed"] == 3 and after["compaction"]["sstables_merged"] == 4 + 2


def test_second_writer_is_refused(store, spark):
    other = Store(spark, store.root, auto_compact=False)
    store.put("a", "1")
    with pytest.raises(RuntimeError, match="another writer"):
        other.put("b", "2")
    version = store.runs.version()
    store.flush()
    with pytest.raises(RuntimeError, match="another writer"):
        store.runs.publish(store.runs.snapshot(version), version)
    assert content(Store(spark, store.root)) == {"a": "1"}


def test_log_is_cleared_and_sized(store):
    assert store.log.size() == 0
    store.put("a", "1")
    assert store.log.size() > 0
    store.flush()
    assert store.log.size() == 0 and store.log.read().count() == 0


def test_deletes_of_a_hot_key(spark):
    data = [("hot", None if i % 3 == 0 else str(i), i % 3 == 0, i) for i in range(400)] + [("cold", None, True, 1000)]
    got = {(r["key"], r["seq"]): r["effective"] for r in mutate.delete_effective(rows(spark, *data)).collect()}
    assert got == {("hot", i): i > 0 for i in range(0, 400, 3)} | {("cold", 1000): False}


def test_shared_folder_is_needed_on_a_cluster():
    from tidemark.sources import shared

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(dict)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
    Context.getCheckpointDir = staticmethod(lambda: "hdfs://x/y/")
    assert shared.shared_dir(Session()) == "hdfs://x/y"


def test_plan_levels():
    run = lambda i, level, size, lo="a", hi="z": {"run_id": i, "level": level, "file_size": size, "min_key": lo, "max_key": hi}
    assert compaction.plan([run(i, 0, 1) for i in range(4)]) is None
    assert compaction.plan([run(i, 0, 1) for i in range(5)])["target"] == 1
    lone = compaction.plan([run(1, 1, 10**9)])
    assert [r["run_id"] for r in lone["inputs"]] == [1] and lone["target"] == 2
    last = compaction.plan([run(1, 6, 10**15), run(2, 6, 10**15)])
    assert last["target"] == 6 and last["bottom"]
    apart = compaction.plan([*[run(i, 0, 1, "a", "c") for i in range(5)], run(9, 1, 1, "d", "f")])
    assert apart["below"] == []


def test_checksums_skip_damaged_records(spark):
    framed = wal.framed(rows(spark, ("a", "1", False, 1), ("b", None, True, 2), ("c", "", False, 3)))
    assert wal.valid(framed).count() == 3
    assert wal.valid(framed.selectExpr("key", "'x' AS value", "is_tombstone", "seq", "crc")).count() == 0


def test_fold_is_invariant_under_splits(spark):
    rng = random.Random(1)
    data = [(f"k{rng.randrange(20)}", str(i), rng.random() < 0.2, i) for i in range(200)]
    data = [(k, None if d else v, d, i) for k, v, d, i in data]
    whole = sorted(map(tuple, fold.latest(rows(spark, *data)).collect()))
    for cut in (1, 77, 150):
        parts = [fold.latest(rows(spark, *p)) for p in (data[:cut], data[cut:])]
        assert sorted(map(tuple, fold.latest(fold.merge_sources(*parts)).collect())) == whole


def test_multi_get_and_bulk_delete(store, spark):
    store.batch_put(["a", "b"], ["1", "2"])
    keys = spark.createDataFrame([("a",), ("x",), ("a",)], "key string")
    assert sorted((r["key"], r["status"]) for r in store.multi_get(keys).collect()) == [("a", 200), ("x", 404)]
    assert sorted((r["key"], r["deleted"]) for r in store.delete_all(keys).collect()) == [("a", True), ("x", False)]
    assert content(store) == {"b": "2"}
