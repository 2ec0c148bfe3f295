"""The request surface as DataFrames: (req_id, method, path, body) to (req_id, status_code, body).

All malformed input is answered with 400. Bodies are parsed as VARIANT, because
``from_json`` would turn a number into text. A table of requests is answered in the
order of ``req_id``, which is unique: reads see the given log, and a delete also sees
the writes before it. A repeated key in a batch keeps its last value.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.fold import live, merge_sources, range_scan
from tidemark.operators.mutate import delete_effective
from tidemark.operators.ordered import ranked

MAX_BODY = 10 * 1024 * 1024
ROUTES = [("PUT", "/kv/put"), ("GET", "/kv/get"), ("GET", "/kv/range"), ("POST", "/kv/batch"), ("DELETE", "/kv/delete"), ("GET", "/health"), ("GET", "/stats")]


def _kind(doc: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(doc, f"$.{name}", "variant"))


def _field(doc: Column, name: str, *kinds: str) -> Column:
    return F.coalesce(_kind(doc, name).isin(*kinds), F.lit(False))


def _reply(status: str, **fields: Column) -> Column:
    return F.to_json(F.struct(F.lit(status).alias("status"), *(c.alias(k) for k, c in fields.items())))


def validate(requests: DataFrame) -> DataFrame:
    """Adds ``status_code`` (200, 400, 404 unknown route, 413 too large), ``message`` of an error and the parsed fields."""
    path = F.split_part(F.col("path"), F.lit("?"), F.lit(1))
    r = requests.withColumn("_doc", F.try_parse_json("body")).withColumn("_route", F.concat_ws(" ", "method", path))
    doc, route = F.col("_doc"), F.col("_route")
    known = route.isin([f"{m} {p}" for m, p in ROUTES])
    texts = lambda name: _field(doc, name, "ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(F.coalesce(F.try_variant_get(doc, f"$.{name}", "array<string>"), F.array()), lambda x: x.isNull())  # noqa: E731  an empty array has no other kind
    size = lambda name: F.size(F.try_variant_get(doc, f"$.{name}", "array<string>"))
    one = F.when(route == "PUT /kv/put", _field(doc, "key", "STRING") & _field(doc, "value", "STRING"))
    one = one.when(route.isin("GET /kv/get", "DELETE /kv/delete"), _field(doc, "key", "STRING"))
    one = one.when(route == "GET /kv/range", _field(doc, "start", "STRING") & _field(doc, "end", "STRING"))
    one = one.when(route == "POST /kv/batch", texts("keys") & texts("values"))
    needs = F.when(route == "PUT /kv/put", "key and value are required").when(route == "GET /kv/range", "start and end keys are required")
    needs = needs.when(route == "POST /kv/batch", "keys and values arrays are required").otherwise("key is required")
    plain = route.isin("GET /health", "GET /stats")
    message = (
        F.when(~known, "Not found").when(F.octet_length(F.coalesce("body", F.lit(""))) > MAX_BODY, "Request too large").when(plain, None).when(doc.isNull(), "Invalid JSON")
        .when(~one, needs).when((route == "POST /kv/batch") & (size("keys") != size("values")), "keys and values arrays must have the same length")
    )
    r = r.withColumn("message", message)
    code = F.when(F.col("message").isNull(), 200).when(F.col("message") == "Not found", 404).when(F.col("message") == "Request too large", 413).otherwise(400)
    return r.select(
        "req_id", F.col("_route").alias("route"), code.alias("status_code"), "message",
        *[F.try_variant_get("_doc", f"$.{c}", "string").alias(c) for c in ("key", "value", "start", "end")],
        F.try_variant_get("_doc", "$.keys", "array<string>").alias("keys"), F.try_variant_get("_doc", "$.values", "array<string>").alias("values"),
    )


def answer_errors(validated: DataFrame) -> DataFrame:
    """Requests that are no valid ones: 400, 404 and 413."""
    return validated.where("status_code <> 200").select("req_id", "status_code", _reply("error", code=F.col("status_code"), message=F.col("message")).alias("body"))


def answer_writes(validated: DataFrame) -> DataFrame:
    """PUT and batch requests; ``apply_writes`` has their effect."""
    done = F.when(F.col("route") == "PUT /kv/put", "Key stored successfully").otherwise(F.concat(F.lit("Batch put completed for "), F.size("keys"), F.lit(" items")))
    ok = validated.where("status_code = 200 AND route IN ('PUT /kv/put', 'POST /kv/batch')")
    return ok.select("req_id", "status_code", _reply("success", message=done).alias("body"))


def answer_gets(validated: DataFrame, log: DataFrame) -> DataFrame:
    """Point reads: 200 with value, or 404 ``not_found``."""
    asked = validated.where((F.col("route") == "GET /kv/get") & (F.col("status_code") == 200)).select("req_id", "key")
    state = live(log.join(asked.select("key").distinct(), "key", "left_semi")).select("key", F.col("value").alias("v"), F.lit(True).alias("hit"))
    j = asked.join(state, "key", "left")
    body = F.when(F.col("hit"), _reply("success", key=F.col("key"), value=F.col("v"))).otherwise(_reply("not_found", key=F.col("key"), message=F.lit("Key not found")))
    return j.select("req_id", F.when(F.col("hit"), 200).otherwise(404).alias("status_code"), body.alias("body"))


def answer_deletes(validated: DataFrame, log: DataFrame) -> DataFrame:
    """Deletes: 200 if the key was live just before, by the log or by an earlier write of the table; else 404."""
    writes = apply_writes(validated)
    base = log.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_top"))
    after = writes.join(F.broadcast(base)).withColumn("seq", F.col("seq") + F.col("_top") + 1)  # one row
    touched = log.join(writes.where("is_tombstone").select("key").distinct(), "key", "left_semi")
    was = delete_effective(merge_sources(touched, after)).join(after.select("seq", "req_id"), "seq")
    body = F.when(F.col("effective"), _reply("success", message=F.lit("Key deleted successfully"))).otherwise(_reply("not_found", message=F.lit("Key not found")))
    return was.select("req_id", F.when(F.col("effective"), 200).otherwise(404).alias("status_code"), body.alias("body"))


def answer_range(log: DataFrame, start: str, end: str) -> DataFrame:
    """One range response, a single row by its nature: count and the ordered results. Large ranges are read with ``range_scan``."""
    rows = range_scan(log, start, end, ordered=False)
    out = rows.agg(F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct("key", "value"))).alias("results"))
    return out.select(_reply("success", count=F.col("count"), results=F.col("results")).alias("body"), "count")


def apply_writes(validated: DataFrame) -> DataFrame:
    """PUT, batch and DELETE requests as mutations with their ``req_id``; sequences count the items in the order of the requests."""
    ok = validated.where("status_code = 200 AND route IN ('PUT /kv/put', 'POST /kv/batch', 'DELETE /kv/delete')")
    many = F.col("route") == "POST /kv/batch"
    pair = F.struct(F.col("key").alias("keys"), F.col("value").alias("values"))
    items = F.when(many, F.arrays_zip("keys", "values")).otherwise(F.array(pair))
    placed = ranked(ok.select("req_id", (F.col("route") == "DELETE /kv/delete").alias("is_tombstone"), items.alias("items")), ["req_id"], F.size("items"))
    each = placed.select("req_id", "is_tombstone", "before", F.posexplode("items").alias("pos", "kv"))
    return each.select(F.col("kv.keys").alias("key"), F.when(~F.col("is_tombstone"), F.col("kv.values")).alias("value"), "is_tombstone", (F.col("before") + F.col("pos")).alias("seq"), "req_id")


def health(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("healthy").alias("status"), F.lit("kv-store").alias("service"))


def answer_stats(spark: SparkSession, stats: dict) -> DataFrame:
    """The response to GET /stats, for the counters of a store."""
    return spark.range(1).select(F.lit(200).alias("status_code"), F.lit(json.dumps({"status": "success"} | stats)).alias("body"))
