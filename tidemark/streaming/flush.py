"""The store as a stream: micro-batches flush into runs, or state is kept natively."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.fold import latest
from tidemark.plans import compaction
from tidemark.sources.runs import RunStore

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def flush_stream(mutations: DataFrame, root: str, checkpoint: str, compact_every: int = 4, in_order: bool = False) -> StreamingQuery:
    """Each micro-batch becomes run ``batch id``.

    ``foreachBatch`` is at-least-once: a repeated batch overwrites its own run and
    is not listed twice. Flushing follows the trigger's size limits
    (``maxFilesPerTrigger``, ``maxBytesPerTrigger``). Late mutations are merged by
    ``seq``, so tombstones are dropped at the bottom only where ``in_order`` promises
    that no older mutation follows.
    """
    spark = mutations.sparkSession
    runs = RunStore(spark, root)

    def batch(df: DataFrame, batch_id: int) -> None:
        version = runs.version()
        state = runs.snapshot(version)
        run_id = 2 * batch_id  # odd ids are compactions
        if batch_id in state.get("batches", []):
            return
        stats = runs.write_run(df, run_id, 0)
        state = state | {"runs": [*state["runs"], *([stats] if stats else [])], "batches": [*state.get("batches", []), batch_id][-1000:]}
        version = runs.publish(state, version)
        if (batch_id + 1) % compact_every == 0 and (step := compaction.plan(state["runs"], l0_runs=compact_every - 1)):
            old = [*step["inputs"], *step["below"]]
            new = runs.write_run(compaction.merge(runs.read(old), step["bottom"] and in_order), run_id + 1, step["target"])
            gone = {r["run_id"] for r in old}
            runs.publish(state | {"runs": [r for r in state["runs"] if r["run_id"] not in gone] + ([new] if new else [])}, version)
            runs.delete_runs(old)

    return mutations.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_state(spark: SparkSession, root: str) -> DataFrame:
    """All versions in the runs of a flush stream."""
    runs = RunStore(spark, root)
    return runs.read(runs.snapshot()["runs"])


def folded_stream(mutations: DataFrame) -> DataFrame:
    """Native stateful fold: one state row per key; use complete or update mode."""
    return latest(mutations)
