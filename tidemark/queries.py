"""Queries over the driver's tables and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import bloom
from tidemark.functions.encoding import encoded_size, memory_estimate, micros, pack, unpack
from tidemark.operators import fold, mutate, ordered, stats
from tidemark.plans import compaction, requests
from tidemark.schema import mutations, pad_key
from tidemark.sources import log as wal, runs
from tidemark.sources.shared import scratch

RUN_ROWS = 1000  # events per flushed run
LO, HI = "000000000020", "000000000080"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a mutation log: key user, order event_id, an 'error' event deletes."""
    e = table(spark, sf_dir, "events")
    return mutations(e, pad_key(F.col("user_id")), F.concat_ws("|", "event_type", "props"), F.col("event_id"), F.col("event_type") == "error")


EVENT_LOG = """log AS (SELECT lpad(CAST(user_id AS VARCHAR), 12, '0') AS key,
  CASE WHEN event_type = 'error' THEN NULL ELSE concat_ws('|', event_type, props) END AS value,
  event_type = 'error' AS is_tombstone, event_id AS seq FROM events)"""
FOLD = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM {0}) WHERE rn = 1)"
LATEST = FOLD.format("log")


def live_state(spark, d):
    return fold.live(event_log(spark, d)).select("key", "value", "seq")


def range_live(spark, d):
    return fold.range_scan(event_log(spark, d), LO, HI, ordered=False).select("key", "value")


def range_with_tombstones(spark, d):
    return fold.range_scan(event_log(spark, d), LO, HI, include_tombstones=True, ordered=False).select("key", "value", "is_tombstone")


def point_get(spark, d):
    return fold.get(event_log(spark, d), "000000000042").select("key", "value")


def multi_get(spark, d):
    asked = table(spark, d, "customer").select(pad_key(F.col("c_custkey")).alias("key"))
    return fold.multi_get(event_log(spark, d), asked)


def delete_effective(spark, d):
    return mutate.delete_effective(event_log(spark, d))


def delete_if_exists(spark, d):
    asked = table(spark, d, "customer").select(pad_key(F.col("c_custkey")).alias("key"), F.lit(10**12).alias("seq"))
    return mutate.delete_if_exists(event_log(spark, d), asked)[1]


def batch_put_last_wins(spark, d):
    """One batch per order: arrays of (line, quantity); a repeated line keeps its last quantity."""
    li = table(spark, d, "lineitem").withColumn("key", F.concat_ws("-", pad_key(F.col("l_orderkey")), F.col("l_linenumber").cast("string")))
    item = F.struct("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "key")
    b = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    b = b.select((F.col("l_orderkey") * 10_000).alias("seq"), F.col("items.key").alias("keys"), F.expr("transform(items, i -> concat(i.l_partkey, '/', i.l_suppkey))").alias("values"))
    return fold.live(mutate.batch_put(b)).select("key", "value")


def upsert_two_sources(spark, d):
    o = table(spark, d, "orders")
    base = mutations(o, pad_key(F.col("o_orderkey")), F.col("o_orderstatus"), F.lit(0))
    newer = mutations(o.where("o_orderpriority IN ('1-URGENT', '2-HIGH')"), pad_key(F.col("o_orderkey")), F.col("o_orderpriority"), F.lit(1), F.col("o_orderstatus") == "F")
    return fold.live(fold.merge_sources(base, newer)).select("key", "value")


def get_all_sorted(spark, d):
    return ordered.ranked(table(spark, d, "pages").select(F.col("url").alias("key"), "page_id"), ["key", "page_id"]).select("key", "page_id", "rn")


def with_run(spark, d):
    return event_log(spark, d).withColumn("run_id", F.floor(F.col("seq") / RUN_ROWS).cast("long"))


def flushed(spark, d):
    """The log cut into runs, one version per key and run."""
    pick = F.max_by(F.struct("value", "is_tombstone"), "seq")
    f = with_run(spark, d).groupBy("run_id", "key").agg(pick.alias("v"), F.max("seq").alias("seq"))
    return f.select("run_id", "key", "v.value", "v.is_tombstone", "seq")


def flush_runs(spark, d):
    return flushed(spark, d)


def run_manifest(spark, d):
    return runs.run_stats(flushed(spark, d))


def pruned_range(spark, d):
    """Range read over the runs whose [min, max] meets the range."""
    f = flushed(spark, d)
    m = runs.run_stats(f).where((F.col("min_key") < HI) & (F.col("max_key") >= LO)).select("run_id")
    return fold.range_scan(f.join(m, "run_id", "left_semi"), LO, HI, ordered=False).select("key", "value")


def sparse_index(spark, d):
    docs = table(spark, d, "documents").select(pad_key(F.col("doc_id")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return ordered.sparse_index(docs, "key", encoded_size(F.col("key"), F.col("text")))


def index_seek(spark, d):
    """Each customer's number is sought in the sparse index of all orders."""
    o = table(spark, d, "orders").select(pad_key(F.col("o_orderkey")).alias("key"), F.coalesce("o_orderpriority", F.lit("")).alias("value"))
    index = ordered.sparse_index(o, "key", encoded_size(F.col("key"), F.col("value"))).select("key", "offset")
    p = table(spark, d, "customer").select(pad_key(F.col("c_custkey")).alias("key"))
    return ordered.seek(index, p)


def _bloom(spark, d) -> tuple[DataFrame, int, int]:
    """All customers' names with the bits and hashes for their number."""
    names = table(spark, d, "customer").select("c_name")
    n = max(1, names.distinct().count())
    return names, bloom.bits_for(n), bloom.hashes_for(n, bloom.bits_for(n))


def bloom_bits(spark, d):
    names, m, k = _bloom(spark, d)
    return bloom.filter_bits(names, "c_name", m, k)


def bloom_contains(spark, d):
    """Customers, which are in the filter, and suppliers, most of which are not."""
    names, m, k = _bloom(spark, d)
    asked = names.unionByName(table(spark, d, "supplier").select(F.col("s_name").alias("c_name")))
    return bloom.might_contain(bloom.filter_bits(names, "c_name", m, k), asked, "c_name", m, k)


def bloom_sizing(spark, d):
    n = flushed(spark, d).groupBy("run_id").agg(F.count("*").alias("n"))
    m, k, p = bloom.sizing(F.col("n"))
    return n.select("run_id", "n", m.alias("bits"), k.alias("hashes"), F.round(p, 9).alias("fpr"))


def run_overlap(spark, d):
    m = runs.run_stats(flushed(spark, d))
    return compaction.overlaps(m, m)


def _manifest(spark, d):
    """Manifest with derived levels and sizes: 7 runs in each of the levels 0 to 2."""
    size = F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).cast("long")
    f = flushed(spark, d).groupBy("run_id").agg(size.alias("file_size"))
    return f.select("run_id", (F.floor(F.col("run_id") / 7) % 3).cast("int").alias("level"), "file_size")


MANIFEST_SQL = f"""runs AS (SELECT CAST(floor(seq / {RUN_ROWS}) AS BIGINT) AS run_id, * FROM log),
folded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY seq DESC) AS rn FROM runs) WHERE rn = 1)"""
LEVELS_SQL = "manifest AS (SELECT run_id, CAST((run_id // 7) % 3 AS INTEGER) AS level, CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS file_size FROM folded GROUP BY run_id)"


def compaction_merge(spark, d):
    """All runs into one; tombstones stay, since an older run could lie below."""
    return compaction.merge(flushed(spark, d))


def compaction_bottom(spark, d):
    return compaction.merge(flushed(spark, d), bottom=True)


def compaction_pick(spark, d):
    return compaction.pick_level(_manifest(spark, d), base_bytes=1000)


def compaction_select(spark, d):
    return compaction.select_inputs(_manifest(spark, d))


def level_counts(spark, d):
    return stats.level_counts(_manifest(spark, d))


def wal_replay(spark, d):
    """Three runs are flushed, the rest is replayed from the checksummed log."""
    log = event_log(spark, d)
    cut = 3 * RUN_ROWS - 1
    return fold.live(fold.merge_sources(flushed(spark, d).where("run_id < 3"), wal.replay(wal.framed(log), cut))).select("key", "value", "seq")


def wal_checksum(spark, d):
    """Every fifth record is damaged after framing; replay keeps the others."""
    damaged = wal.framed(event_log(spark, d)).withColumn("value", F.when(F.col("seq") % 5 == 0, F.concat(F.coalesce("value", F.lit("")), F.lit("!"))).otherwise(F.col("value")))
    return wal.valid(damaged)


def engine_stats(spark, d):
    return stats.log_counters(event_log(spark, d))


def memtable_stats(spark, d):
    return stats.memtable_stats(fold.latest(event_log(spark, d)))


def record_sizes(spark, d):
    docs = table(spark, d, "documents")
    k, v = pad_key(F.col("doc_id")), F.coalesce("text", F.lit(""))
    return docs.select("doc_id", encoded_size(k, v).alias("encoded"), memory_estimate(k, v).cast("long").alias("memory"))


def record_frames(spark, d):
    """Events as framed records; the payload of errors is damaged after framing and doesn't come back."""
    e = table(spark, d, "events")
    framed = e.select("event_id", "event_type", pack(F.concat_ws("|", "event_type", "props")).alias("f"))
    damaged = F.struct(F.col("f.crc").alias("crc"), F.when(F.col("event_type") == "error", F.concat("f.payload", F.lit("!"))).otherwise(F.col("f.payload")).alias("payload"))
    return framed.withColumn("f", damaged).select("event_id", unpack(F.col("f")).alias("payload"))


def event_micros(spark, d):
    return table(spark, d, "events").select("event_id", micros(F.col("ts")).alias("micros"))


def _requests(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("req_id"), "conv_id", "turn")
    kind = F.col("turn") % 4
    key = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    body = (
        F.when(kind == 0, F.concat(F.lit('{"key": "'), key, F.lit('", "value": "v"}')))
        .when(kind == 1, F.concat(F.lit('{"key": "'), key, F.lit('"}')))
        .when(kind == 2, F.concat(F.lit('{"key": "'), key))
        .otherwise(F.concat(F.lit('{"key": '), F.col("conv_id").cast("string"), F.lit(', "value": "v"}')))
    )
    path = F.when(F.col("conv_id") % 10 == 9, "/kv/none").otherwise("/kv/put")
    return c.select("req_id", F.lit("PUT").alias("method"), path.alias("path"), body.alias("body"))


def request_validate(spark, d):
    return requests.validate(_requests(spark, d)).select("req_id", "status_code")


def request_writes(spark, d):
    return fold.live(requests.apply_writes(requests.validate(_requests(spark, d)))).select("key", "value")


def request_gets(spark, d):
    """A GET for each user id up to the number of customers, answered from the live state."""
    c = table(spark, d, "customer")
    r = c.select(F.col("c_custkey").alias("req_id"), F.lit("GET").alias("method"), F.lit("/kv/get").alias("path"), F.concat(F.lit('{"key": "'), pad_key(F.col("c_custkey")), F.lit('"}')).alias("body"))
    return requests.answer_gets(requests.validate(r), event_log(spark, d)).select("req_id", "status_code")


def get_body(spark, d):
    """The whole answers of the same requests."""
    c = table(spark, d, "customer")
    r = c.select(F.col("c_custkey").alias("req_id"), F.lit("GET").alias("method"), F.lit("/kv/get").alias("path"), F.to_json(F.struct(pad_key(F.col("c_custkey")).alias("key"))).alias("body"))
    return requests.answer_gets(requests.validate(r), event_log(spark, d))


def range_response(spark, d):
    return requests.answer_range(event_log(spark, d), LO, HI).select("count")


def range_body(spark, d):
    return requests.answer_range(event_log(spark, d), LO, HI).select("body")


def request_errors(spark, d):
    return requests.answer_errors(requests.validate(_requests(spark, d)))


def _batches(spark, d):
    """A batch per conversation with the roles of its turns as values; conversations without a fourth turn send one value less, and one more request sends none."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    c = c.select("conv_id", F.expr("transform(t, x -> concat('c', conv_id, '-', x.turn % 3))").alias("k"), F.col("t.role").alias("v"))
    c = c.unionByName(spark.sql("SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(array() AS array<string>) AS k, CAST(array() AS array<string>) AS v"))
    short = F.when(F.size("k") < 4, F.slice("v", 1, F.greatest(F.size("v") - 1, F.lit(0)))).otherwise(F.col("v"))
    return c.select(F.col("conv_id").alias("req_id"), F.lit("POST").alias("method"), F.lit("/kv/batch").alias("path"), F.to_json(F.struct(F.col("k").alias("keys"), short.alias("values"))).alias("body"))


def request_batches(spark, d):
    """Answers of batches of equal and unequal lengths and of none."""
    v = requests.validate(_batches(spark, d))
    return requests.answer_writes(v).unionByName(requests.answer_errors(v))


def request_batch_writes(spark, d):
    """What the batches leave: a repeated key keeps the batch's last value."""
    return fold.live(requests.apply_writes(requests.validate(_batches(spark, d)))).select("key", "value")


def request_deletes(spark, d):
    """Each customer's number is deleted from the live state, and each nation's once more."""
    one = lambda t, c, base: table(spark, d, t).select((F.col(c) + base).cast("long").alias("req_id"), pad_key(F.col(c)).alias("key"))
    r = one("customer", "c_custkey", 0).unionByName(one("nation", "n_nationkey", 10**9))
    r = r.select("req_id", F.lit("DELETE").alias("method"), F.lit("/kv/delete").alias("path"), F.to_json(F.struct("key")).alias("body"))
    return requests.answer_deletes(requests.validate(r), event_log(spark, d))


def health(spark, d):
    return requests.health(spark)


def stream_live_state(spark, d):
    """The log, cut into files by event, streamed in a micro-batch a file into runs with compaction on the way, then folded."""
    from tidemark.streaming.flush import flush_stream, stream_state

    root = scratch(spark, "stream")
    events = table(spark, d, "events")
    events.repartitionByRange(9, "event_id").write.parquet(f"{root}/in")
    e = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    m = mutations(e, pad_key(F.col("user_id")), F.concat_ws("|", "event_type", "props"), F.col("event_id"), F.col("event_type") == "error")
    flush_stream(m, f"{root}/store", f"{root}/checkpoint").awaitTermination()
    return fold.live(stream_state(spark, f"{root}/store")).select("key", "value", "seq")


def _store(spark, name, **options):
    from tidemark.store import Store

    return Store(spark, scratch(spark, name), **options)


def store_round_trip(spark, d):
    """Bulk load, flush, bulk delete, flush and compaction in a store; its live state."""
    with _store(spark, "store") as s:
        s.write(event_log(spark, d))
        s.flush()
        s.delete_all(table(spark, d, "customer").where("c_mktsegment IN ('BUILDING', 'MACHINERY')").select(pad_key(F.col("c_custkey")).alias("key")))
        s.flush()
        s.force_compaction()
        return s.state().select("key", "value")


def store_reopen(spark, d):
    """Orders in flushed runs of one status each, customers in a log that is not flushed; a second store reads both."""
    from tidemark.store import Store

    s = _store(spark, "reopen", auto_compact=False, memtable_entries=1 << 40, memtable_bytes=1 << 50)
    o = table(spark, d, "orders")
    for status in ("F", "O", "P"):
        s.write(mutations(o.where(F.col("o_orderstatus") == status), F.concat(F.lit(status), pad_key(F.col("o_orderkey"))), F.col("o_orderpriority"), F.col("o_orderkey")))
        s.flush()
    s.write(mutations(table(spark, d, "customer"), pad_key(F.col("c_custkey")), F.col("c_mktsegment"), F.col("c_custkey")))
    return Store(spark, s.root).state().select("key", "value")


def store_range(spark, d):
    """A range read of the orders of one status over stored runs: the manifest leaves one run, and its files are read with the range."""
    s = _store(spark, "range", auto_compact=False, memtable_entries=1 << 40, memtable_bytes=1 << 50)
    o = table(spark, d, "orders")
    for status in ("F", "O", "P"):
        s.write(mutations(o.where(F.col("o_orderstatus") == status), F.concat(F.lit(status), pad_key(F.col("o_orderkey"))), F.col("o_orderpriority"), F.col("o_orderkey")))
        s.flush()
    return s.range_scan("O", "P").select("key", "value")


def store_levels(spark, d):
    """Tombstones of customers are compacted above a deeper level that still holds their values: nobody comes back."""
    s = _store(spark, "levels", auto_compact=False, memtable_entries=1 << 40, memtable_bytes=1 << 50)
    key = lambda c, mark: F.concat(F.lit(mark), pad_key(F.col(c)))
    c = table(spark, d, "customer")
    s.write(mutations(c, key("c_custkey", "m"), F.col("c_mktsegment"), F.col("c_custkey")))
    s.flush()
    s.compact(0)
    s.compact(1)
    s.write(mutations(c, key("c_custkey", "m"), F.col("c_name"), F.col("c_custkey"), F.col("c_mktsegment") == "BUILDING"))
    s.write(mutations(table(spark, d, "nation"), key("n_nationkey", "a"), F.col("n_name"), F.col("n_nationkey")))
    s.flush()
    s.compact(0)
    s.write(mutations(table(spark, d, "region"), key("r_regionkey", "a"), F.col("r_name"), F.col("r_regionkey")))
    s.flush()
    s.compact(0)
    return s.state().select("key", "value")


def stats_response(spark, d):
    """Counters after puts, reads and deletes by name, a flush and a reopen."""
    from tidemark.store import Store

    s = _store(spark, "stats", auto_compact=False)
    names = [r["n_name"] for r in table(spark, d, "nation").select("n_name").collect()]  # 25 rows at any scale
    s.batch_put(names, names)
    s.get(min(names))
    s.delete(max(names))
    s.delete("nobody")
    s.close()
    body = requests.answer_stats(spark, Store(spark, s.root).stats())
    parts = [F.get_json_object("body", f"$.engine.{c}").cast("long").alias(c) for c in ("puts", "gets", "deletes", "flushes", "memtable_size", "wal_size")]
    return body.select("status_code", F.get_json_object("body", "$.status").alias("status"), *parts, F.get_json_object("body", "$.engine.sstable_counts[0]").cast("long").alias("level0"), F.get_json_object("body", "$.compaction.sstables_merged").cast("long").alias("merged"))


QUERIES = {
    f.__name__: f
    for f in (
        live_state, range_live, range_with_tombstones, point_get, multi_get, delete_effective, delete_if_exists, batch_put_last_wins, upsert_two_sources, get_all_sorted,
        flush_runs, run_manifest, pruned_range, sparse_index, index_seek, bloom_bits, bloom_contains, bloom_sizing, run_overlap, compaction_merge, compaction_bottom,
        compaction_pick, compaction_select, level_counts, wal_replay, wal_checksum, engine_stats, memtable_stats, record_sizes, record_frames, event_micros, request_validate, request_writes, request_gets,
        request_errors, request_batches, request_batch_writes, request_deletes, get_body, range_response, range_body, health, stats_response, stream_live_state, store_round_trip,
        store_reopen, store_range, store_levels,
    )
}

_BLOOM = """z AS (SELECT n, m, CAST(greatest(1, floor(m / n * ln(2))) AS BIGINT) AS k FROM (SELECT n, CAST(floor(-n * ln(0.01) / pow(ln(2), 2)) AS BIGINT) AS m FROM (SELECT greatest(1, count(DISTINCT c_name)) AS n FROM customer))),
f AS (SELECT name, member, CAST(('0x' || substr(sha256(name::BLOB || unhex(lpad(hex(s), 8, '0'))), 1, 16))::UBIGINT % CAST(m AS UBIGINT) AS BIGINT) AS bit
  FROM (SELECT DISTINCT c_name AS name, true AS member FROM customer UNION ALL SELECT DISTINCT s_name, false FROM supplier), z, range(64) AS t(s) WHERE s < k)"""
_STATE = f"WITH {EVENT_LOG} SELECT key, value, seq FROM {LATEST} WHERE NOT is_tombstone"
_VARINT = "(CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 ELSE 5 END)"
_REQUESTS = """r AS (SELECT conv_id * 100 + turn AS req_id, conv_id, CASE WHEN conv_id % 10 = 9 THEN '/kv/none' ELSE '/kv/put' END AS path,
  CASE turn % 4 WHEN 0 THEN '{"key": "c' || conv_id || '", "value": "v"}' WHEN 1 THEN '{"key": "c' || conv_id || '"}'
  WHEN 2 THEN '{"key": "c' || conv_id ELSE '{"key": ' || conv_id || ', "value": "v"}' END AS body FROM conversations),
v AS (SELECT *, CAST(CASE WHEN path = '/kv/none' THEN 404 WHEN NOT json_valid(body) THEN 400
  WHEN json_type(CASE WHEN json_valid(body) THEN body END, '$.key') = 'VARCHAR' AND json_type(CASE WHEN json_valid(body) THEN body END, '$.value') = 'VARCHAR' THEN 200 ELSE 400 END AS INTEGER) AS status_code FROM r)"""

ORACLE_SQL = {
    "live_state": _STATE,
    "stream_live_state": _STATE,
    "wal_replay": _STATE,
    "range_live": f"WITH {EVENT_LOG} SELECT key, value FROM {LATEST} WHERE NOT is_tombstone AND key >= '{LO}' AND key < '{HI}'",
    "pruned_range": f"WITH {EVENT_LOG} SELECT key, value FROM {LATEST} WHERE NOT is_tombstone AND key >= '{LO}' AND key < '{HI}'",
    "range_with_tombstones": f"WITH {EVENT_LOG} SELECT key, value, is_tombstone FROM {LATEST} WHERE key >= '{LO}' AND key < '{HI}'",
    "point_get": f"WITH {EVENT_LOG} SELECT key, value FROM {LATEST} WHERE NOT is_tombstone AND key = '000000000042'",
    "multi_get": f"WITH {EVENT_LOG}, s AS (SELECT * FROM {LATEST} WHERE NOT is_tombstone), a AS (SELECT DISTINCT lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS key FROM customer) SELECT a.key, s.value, s.key IS NOT NULL AS found, CAST(CASE WHEN s.key IS NULL THEN 404 ELSE 200 END AS INTEGER) AS status FROM a LEFT JOIN s ON a.key = s.key",
    "delete_effective": f"WITH {EVENT_LOG} SELECT key, seq, coalesce(NOT was, false) AS effective FROM (SELECT *, lag(is_tombstone) OVER (PARTITION BY key ORDER BY seq) AS was FROM log) WHERE is_tombstone",
    "delete_if_exists": f"WITH {EVENT_LOG}, s AS (SELECT * FROM {LATEST} WHERE NOT is_tombstone), a AS (SELECT DISTINCT lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS key FROM customer) SELECT a.key, s.key IS NOT NULL AS deleted FROM a LEFT JOIN s ON a.key = s.key",
    "batch_put_last_wins": "SELECT key, value FROM (SELECT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || l_linenumber AS key, l_partkey || '/' || l_suppkey AS value, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_shipdate DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC) AS rn FROM lineitem) WHERE rn = 1",
    "upsert_two_sources": "SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM (SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS key, o_orderstatus AS value, false AS dead, 0 AS seq FROM orders UNION ALL SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0'), o_orderpriority, o_orderstatus = 'F', 1 FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))) WHERE rn = 1 AND NOT dead",
    "get_all_sorted": "SELECT url AS key, page_id, CAST(row_number() OVER (ORDER BY url, page_id) - 1 AS BIGINT) AS rn FROM pages",
    "flush_runs": f"WITH {EVENT_LOG}, {MANIFEST_SQL} SELECT run_id, key, value, is_tombstone, seq FROM folded",
    "run_manifest": f"WITH {EVENT_LOG}, {MANIFEST_SQL} SELECT run_id, CAST(count(*) AS BIGINT) AS key_count, min(key) AS min_key, max(key) AS max_key, min(seq) AS min_seq, max(seq) AS max_seq FROM folded GROUP BY run_id",
    "sparse_index": f"SELECT key, rn, \"offset\" FROM (SELECT key, CAST(row_number() OVER (ORDER BY key) - 1 AS BIGINT) AS rn, CAST(coalesce(sum(sz) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS key, 13 + {_VARINT.format("strlen(coalesce(text, ''))")} + strlen(coalesce(text, '')) AS sz FROM documents)) WHERE rn % 16 = 0",
    "index_seek": f"WITH o AS (SELECT key, CAST(row_number() OVER (ORDER BY key) - 1 AS BIGINT) AS rn, CAST(coalesce(sum(sz) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM (SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS key, 13 + {_VARINT.format("strlen(coalesce(o_orderpriority, ''))")} + strlen(coalesce(o_orderpriority, '')) AS sz FROM orders)), i AS (SELECT * FROM o WHERE rn % 16 = 0), p AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS key FROM customer) SELECT p.key, i.key AS index_key, i.off AS index_offset FROM p ASOF LEFT JOIN i ON p.key >= i.key",
    "bloom_bits": f"WITH {_BLOOM} SELECT DISTINCT bit FROM f WHERE member",
    "bloom_contains": f"WITH {_BLOOM}, b AS (SELECT DISTINCT bit FROM f WHERE member), p AS (SELECT DISTINCT name, bit FROM f) SELECT p.name AS key, count(b.bit) = count(*) AS maybe FROM p LEFT JOIN b ON p.bit = b.bit GROUP BY p.name",
    "bloom_sizing": f"WITH {EVENT_LOG}, {MANIFEST_SQL}, n AS (SELECT run_id, CAST(count(*) AS BIGINT) AS n FROM folded GROUP BY run_id), m AS (SELECT *, CAST(floor(-n * ln(0.01) / pow(ln(2), 2)) AS BIGINT) AS bits FROM n), k AS (SELECT *, CAST(greatest(1, floor(bits / n * ln(2))) AS BIGINT) AS hashes FROM m) SELECT run_id, n, bits, hashes, round(pow(1 - exp(-hashes * n / bits), hashes), 9) AS fpr FROM k",
    "run_overlap": f"WITH {EVENT_LOG}, {MANIFEST_SQL}, m AS (SELECT run_id, min(key) AS lo, max(key) AS hi FROM folded GROUP BY run_id) SELECT a.run_id AS run_a, b.run_id AS run_b FROM m a JOIN m b ON a.lo <= b.hi AND b.lo <= a.hi",
    "compaction_merge": f"WITH {EVENT_LOG}, {MANIFEST_SQL}, c AS (SELECT key, value, is_tombstone, seq FROM folded) SELECT key, value, is_tombstone, seq FROM {FOLD.format('c')}",
    "compaction_bottom": f"WITH {EVENT_LOG} SELECT key, value, is_tombstone, seq FROM {LATEST} WHERE NOT is_tombstone",
    "compaction_pick": f"WITH {EVENT_LOG}, {MANIFEST_SQL}, {LEVELS_SQL}, p AS (SELECT level, count(*) AS n, sum(file_size) AS b FROM manifest GROUP BY level) SELECT CAST(min(level) AS INTEGER) AS level FROM p WHERE CASE WHEN level = 0 THEN n > 4 ELSE b > pow(10, level) * 1000 END",
    "compaction_select": f"WITH {EVENT_LOG}, {MANIFEST_SQL}, {LEVELS_SQL} SELECT run_id, level, file_size FROM (SELECT *, count(*) OVER (PARTITION BY level) AS n, row_number() OVER (PARTITION BY level ORDER BY file_size DESC, run_id) AS r FROM manifest) WHERE level = 0 OR r <= greatest(1, n // 2)",
    "level_counts": f"WITH {EVENT_LOG}, {MANIFEST_SQL}, {LEVELS_SQL} SELECT CAST(l AS INTEGER) AS level, CAST(count(run_id) AS BIGINT) AS runs, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS bytes FROM range(7) AS t(l) LEFT JOIN manifest ON level = l GROUP BY l",
    "wal_checksum": f"WITH {EVENT_LOG} SELECT key, value, is_tombstone, seq FROM log WHERE seq % 5 <> 0",
    "engine_stats": f"WITH {EVENT_LOG}, h AS (SELECT *, lag(is_tombstone) OVER (PARTITION BY key ORDER BY seq) AS was FROM log) SELECT CAST(sum(CASE WHEN NOT is_tombstone THEN 1 ELSE 0 END) AS BIGINT) AS puts, CAST(sum(CASE WHEN is_tombstone THEN 1 ELSE 0 END) AS BIGINT) AS delete_attempts, CAST(count(DISTINCT key) AS BIGINT) AS distinct_keys, CAST(sum(CASE WHEN is_tombstone AND NOT was THEN 1 ELSE 0 END) AS BIGINT) AS deletes FROM h",
    "memtable_stats": f"WITH {EVENT_LOG} SELECT CAST(count(*) AS BIGINT) AS memtable_size, CAST(sum(strlen(key) + coalesce(strlen(value), 0) + 16) AS BIGINT) AS memtable_memory FROM {LATEST}",
    "record_sizes": f"SELECT doc_id, CAST(13 + {_VARINT.format("strlen(coalesce(text, ''))")} + strlen(coalesce(text, '')) AS BIGINT) AS encoded, CAST(12 + strlen(coalesce(text, '')) + 16 AS BIGINT) AS memory FROM documents",
    "record_frames": "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE concat_ws('|', event_type, props) END AS payload FROM events",
    "event_micros": "SELECT event_id, epoch_us(ts) AS micros FROM events",
    "request_validate": f"WITH {_REQUESTS} SELECT req_id, status_code FROM v",
    "request_writes": f"WITH {_REQUESTS} SELECT DISTINCT 'c' || conv_id AS key, 'v' AS value FROM v WHERE status_code = 200",
    "request_gets": f"WITH {EVENT_LOG}, s AS (SELECT * FROM {LATEST} WHERE NOT is_tombstone) SELECT c_custkey AS req_id, CAST(CASE WHEN s.key IS NULL THEN 404 ELSE 200 END AS INTEGER) AS status_code FROM customer LEFT JOIN s ON s.key = lpad(CAST(c_custkey AS VARCHAR), 12, '0')",
    "range_response": f"WITH {EVENT_LOG} SELECT CAST(count(*) AS BIGINT) AS count FROM {LATEST} WHERE NOT is_tombstone AND key >= '{LO}' AND key < '{HI}'",
    "health": "SELECT 'healthy' AS status, 'kv-store' AS service",
    "store_round_trip": f"WITH {EVENT_LOG} SELECT key, value FROM {LATEST} WHERE NOT is_tombstone AND key NOT IN (SELECT lpad(CAST(c_custkey AS VARCHAR), 12, '0') FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))",
    "store_reopen": "SELECT o_orderstatus || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS key, o_orderpriority AS value FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') UNION ALL SELECT lpad(CAST(c_custkey AS VARCHAR), 12, '0'), c_mktsegment FROM customer",
    "store_range": "SELECT 'O' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS key, o_orderpriority AS value FROM orders WHERE o_orderstatus = 'O'",
    "store_levels": "SELECT 'm' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS key, c_name AS value FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 'a' || lpad(CAST(n_nationkey AS VARCHAR), 12, '0'), coalesce(r_name, n_name) FROM nation LEFT JOIN region ON n_nationkey = r_regionkey",
    "stats_response": "SELECT CAST(200 AS INTEGER) AS status_code, 'success' AS status, CAST(count(*) AS BIGINT) AS puts, CAST(3 AS BIGINT) AS gets, CAST(1 AS BIGINT) AS deletes, CAST(1 AS BIGINT) AS flushes, CAST(0 AS BIGINT) AS memtable_size, CAST(0 AS BIGINT) AS wal_size, CAST(1 AS BIGINT) AS level0, CAST(0 AS BIGINT) AS merged FROM nation",
    "get_body": f"WITH {EVENT_LOG}, s AS (SELECT * FROM {LATEST} WHERE NOT is_tombstone), a AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS k FROM customer) SELECT c_custkey AS req_id, CAST(CASE WHEN s.key IS NULL THEN 404 ELSE 200 END AS INTEGER) AS status_code, CASE WHEN s.key IS NULL THEN '{{\"status\":\"not_found\",\"key\":\"' || k || '\",\"message\":\"Key not found\"}}' ELSE '{{\"status\":\"success\",\"key\":\"' || k || '\",\"value\":' || CAST(to_json(s.value) AS VARCHAR) || '}}' END AS body FROM a LEFT JOIN s ON s.key = k",
    "range_body": f"WITH {EVENT_LOG} SELECT '{{\"status\":\"success\",\"count\":' || count(*) || ',\"results\":[' || coalesce(string_agg('{{\"key\":\"' || key || '\",\"value\":' || CAST(to_json(value) AS VARCHAR) || '}}', ',' ORDER BY key), '') || ']}}' AS body FROM {LATEST} WHERE NOT is_tombstone AND key >= '{LO}' AND key < '{HI}'",
    "request_errors": f"WITH {_REQUESTS} SELECT req_id, status_code, '{{\"status\":\"error\",\"code\":' || status_code || ',\"message\":\"' || CASE WHEN status_code = 404 THEN 'Not found' WHEN NOT json_valid(body) THEN 'Invalid JSON' ELSE 'key and value are required' END || '\"}}' AS body FROM v WHERE status_code <> 200",
    "request_batches": """WITH n AS (SELECT conv_id, count(*) AS k FROM conversations GROUP BY conv_id UNION ALL SELECT -1, 0) SELECT conv_id AS req_id, CAST(CASE WHEN k BETWEEN 1 AND 3 THEN 400 ELSE 200 END AS INTEGER) AS status_code,
      CASE WHEN k BETWEEN 1 AND 3 THEN '{"status":"error","code":400,"message":"keys and values arrays must have the same length"}' ELSE '{"status":"success","message":"Batch put completed for ' || k || ' items"}' END AS body FROM n""",
    "request_batch_writes": "SELECT key, value FROM (SELECT 'c' || conv_id || '-' || (turn % 3) AS key, role AS value, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id, turn % 3 ORDER BY turn DESC, role DESC) AS rn FROM conversations) WHERE n >= 4 AND rn = 1",
    "request_deletes": f"""WITH {EVENT_LOG}, s AS (SELECT key FROM {LATEST} WHERE NOT is_tombstone), r AS (SELECT CAST(c_custkey AS BIGINT) AS req_id, c_custkey AS k FROM customer UNION ALL SELECT CAST(n_nationkey + 1000000000 AS BIGINT), n_nationkey FROM nation),
      w AS (SELECT req_id, s.key IS NOT NULL AND (req_id < 1000000000 OR k NOT IN (SELECT c_custkey FROM customer)) AS hit FROM r LEFT JOIN s ON s.key = lpad(CAST(k AS VARCHAR), 12, '0'))
      SELECT req_id, CAST(CASE WHEN hit THEN 200 ELSE 404 END AS INTEGER) AS status_code, CASE WHEN hit THEN '{{"status":"success","message":"Key deleted successfully"}}' ELSE '{{"status":"not_found","message":"Key not found"}}' END AS body FROM w""",
}
