"""The store: put, get, delete, range scan, batch put, stats, close, recovery.

Sequences come from the log, not from a clock. A flush writes a run, publishes a
manifest, then retires the log; a crash between any two steps loses nothing,
because replay skips what ``flushed_seq`` covers. One writer at a time has a root: a
second one is refused when it appends or publishes what the first has committed, and
opens the store anew. Any number of readers may read meanwhile: each read takes the
newest manifest, whose runs are never changed. Counters of writes and reads are kept
with the manifest.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.encoding import memory_estimate
from tidemark.operators import fold, mutate
from tidemark.operators.stats import memtable_stats
from tidemark.plans import compaction
from tidemark.schema import MUTATION
from tidemark.sources.log import MutationLog
from tidemark.sources.runs import RunStore, prune
from tidemark.sources.shared import cut_lineage

MEMTABLE_BYTES, MEMTABLE_ENTRIES = 5 * 1024 * 1024, 100_000


def sizes() -> tuple:
    """Rows and bytes of a batch, as a memtable counts them."""
    return F.count("*"), F.coalesce(F.sum(memory_estimate("key", "value")), F.lit(0))


def totals(state: dict) -> dict:
    """Counters of all compactions so far; they are kept with the manifest."""
    return dict.fromkeys(("compactions_completed", "sstables_merged", "bytes_compacted", "last_compaction_time"), 0) | state["compaction"]


class Store:
    def __init__(self, spark: SparkSession, root: str, memtable_bytes: int = MEMTABLE_BYTES, memtable_entries: int = MEMTABLE_ENTRIES, base_bytes: int = compaction.BASE_BYTES, auto_compact: bool = True):
        self.spark, self.root = spark, root.rstrip("/")
        self.runs, self.log = RunStore(spark, root), MutationLog(spark, root)
        self.memtable_bytes, self.memtable_entries, self.base_bytes, self.auto_compact = memtable_bytes, memtable_entries, base_bytes, auto_compact
        state = self.runs.snapshot()
        self.counters = dict.fromkeys(("puts", "gets", "deletes", "range_scans", "flushes", "compactions"), 0) | state["counters"]
        unflushed = self.log.read(state["flushed_seq"]).agg(F.max("seq"), *sizes()).first()
        self._next = max([state["flushed_seq"], -1 if unflushed[0] is None else unflushed[0], *(r["run_id"] for r in state["runs"])]) + 1
        #: At least the entries and bytes of the memtable: repeated keys count each time.
        self._entries, self._bytes = unflushed[1], unflushed[2]

    def __enter__(self) -> "Store":
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    # reads ----------------------------------------------------------------
    def mutations(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """All visible versions: unflushed log and the live runs that can hold the range."""
        state = self.runs.snapshot()
        return fold.merge_sources(self.log.read(state["flushed_seq"]), self.runs.read(prune(state["runs"], start, end)))

    def get(self, key: str) -> str | None:
        self.counters["gets"] += 1
        row = fold.get(self.mutations(key, key + "\x00"), key).select("value").first()
        return row["value"] if row else None

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return fold.multi_get(self.mutations(), keys)

    def range_scan(self, start: str | None, end: str | None, include_tombstones: bool = False) -> DataFrame:
        self.counters["range_scans"] += 1
        return fold.range_scan(self.mutations(start, end), start, end, include_tombstones)

    def state(self) -> DataFrame:
        return fold.live(self.mutations())

    # writes ---------------------------------------------------------------
    def write(self, df: DataFrame, seq: str = "seq") -> None:
        """Appends mutations with offsets from 0 in ``seq``; they are moved behind what is there."""
        n, entries, size = df.agg(F.max(seq), *sizes()).first()
        if n is None:
            return
        self.log.append(df.withColumn("seq", F.col(seq).cast("long") + F.lit(self._next)), self._next)
        self._next += n + 1
        self._entries, self._bytes = self._entries + entries, self._bytes + size
        self._maybe_flush()

    def _rows(self, rows: list[tuple[str, str | None, bool]]) -> DataFrame:
        return self.spark.createDataFrame([(k, v, d, i) for i, (k, v, d) in enumerate(rows)], MUTATION)

    def put(self, key: str, value: str) -> None:
        self.counters["puts"] += 1
        self.write(self._rows([(key, value, False)]))

    def batch_put(self, keys: list[str], values: list[str]) -> None:
        if len(keys) != len(values):
            raise ValueError("keys and values must have the same length")
        self.counters["puts"] += len(keys)
        if keys:
            self.write(self._rows([(k, v, False) for k, v in zip(keys, values)]))

    def delete(self, key: str) -> bool:
        if self.get(key) is None:
            return False
        self.counters["deletes"] += 1
        self.write(self._rows([(key, None, True)]))
        return True

    def delete_all(self, keys: DataFrame) -> DataFrame:
        """Bulk delete-if-exists; returns (key, deleted) and appends one commit of tombstones."""
        tombs, result = mutate.delete_if_exists(self.mutations(), keys.select("key", F.lit(0).alias("seq")))
        result, tombs = cut_lineage(result), cut_lineage(tombs)  # both answer for the state before the write
        self.write(tombs)
        return result

    # maintenance ----------------------------------------------------------
    def memtable(self) -> DataFrame:
        return fold.latest(self.log.read(self.runs.snapshot()["flushed_seq"]))

    def _maybe_flush(self) -> None:
        if self._bytes <= self.memtable_bytes and self._entries <= self.memtable_entries:
            return  # without repeated keys it can only be less
        s = memtable_stats(self.memtable()).first()
        if s["memtable_memory"] > self.memtable_bytes or s["memtable_size"] > self.memtable_entries:
            self.flush()
        else:
            self._entries, self._bytes = s["memtable_size"], s["memtable_memory"]

    def flush(self) -> bool:
        """Unflushed mutations become a level-0 run; False if there are none."""
        version = self.runs.version()
        state = self.runs.snapshot(version)
        run_id = self._next  # unique: sequences only grow, and compaction takes the next one
        self._next += 1
        stats = self.runs.write_run(self.log.read(state["flushed_seq"]), run_id, 0)
        if stats is None:
            return False
        self.counters["flushes"] += 1
        self.runs.publish(state | {"runs": [*state["runs"], stats], "flushed_seq": run_id, "counters": self.counters}, version)
        self.log.clear(run_id)
        self._entries = self._bytes = 0
        if self.auto_compact:
            while self.compact():
                pass
        return True

    def compact(self, level: int | None = None) -> bool:
        """One compaction step; readers of the old manifest keep a consistent view until it is swapped."""
        version = self.runs.version()
        state = self.runs.snapshot(version)
        step = compaction.plan(state["runs"], self.base_bytes, level=level)
        if step is None:
            return False
        old = [*step["inputs"], *step["below"]]
        run_id = self._next
        self._next += 1
        new = self.runs.write_run(compaction.merge(self.runs.read(old), step["bottom"]), run_id, step["target"])
        gone = {r["run_id"] for r in old}
        kept = [r for r in state["runs"] if r["run_id"] not in gone] + ([new] if new else [])
        self.counters["compactions"] += 1
        done = totals(state)
        done = {
            "compactions_completed": done["compactions_completed"] + 1, "sstables_merged": done["sstables_merged"] + len(old),
            "bytes_compacted": done["bytes_compacted"] + sum(r["file_size"] for r in old), "last_compaction_time": int(time.time() * 1e6),
        }
        self.runs.publish(state | {"runs": kept, "compaction": done, "counters": self.counters}, version)
        self.runs.delete_runs(old)
        return True

    def force_compaction(self) -> int:
        """Each non-empty level once, from the top."""
        return sum(self.compact(level) for level in range(compaction.LEVELS))

    def stats(self) -> dict:
        state = self.runs.snapshot()
        m = memtable_stats(self.memtable()).first()
        return {
            "engine": self.counters | {"memtable_size": m["memtable_size"], "memtable_memory": m["memtable_memory"], "wal_size": self.log.size(), "sstable_counts": [sum(r["level"] == i for r in state["runs"]) for i in range(compaction.LEVELS)]},
            "compaction": totals(state),
        }

    def close(self) -> None:
        """Flushes; counters of reads since the last commit are published, too."""
        if not self.flush():
            version = self.runs.version()
            state = self.runs.snapshot(version)
            if state["counters"] != self.counters:
                self.runs.publish(state | {"counters": self.counters}, version)
