import json

from tidemark.operators import fold
from tidemark.plans import requests
from tidemark.schema import MUTATION


def ask(spark, *r):
    return requests.validate(spark.createDataFrame([(i, *x) for i, x in enumerate(r)], "req_id long, method string, path string, body string"))


def test_codes(spark):
    cases = [
        ("POST", "/kv/batch", '{"keys": [], "values": []}', 200), ("POST", "/kv/batch", '{"keys": ["a"], "values": []}', 400), ("POST", "/kv/batch", '{"keys": ["a", 1], "values": ["b", "c"]}', 400),
        ("POST", "/kv/batch", '{"keys": [null], "values": ["b"]}', 400), ("POST", "/kv/batch", '{"keys": "a", "values": "b"}', 400), ("POST", "/kv/batch", '{"keys": ["a"], "values": ["b"]}', 200),
        ("POST", "/kv/batch", '{"keys": ["a"]}', 400), ("PUT", "/kv/put", '{"key": "a", "value": 1}', 400), ("PUT", "/kv/put", "{}", 400), ("PUT", "/kv/put", "no json", 400), ("PUT", "/kv/put", None, 400),
        ("PUT", "/kv/put", '{"key": "a", "value": ""}', 200), ("GET", "/kv/get", '{"key": "a"}', 200), ("GET", "/kv/put", "{}", 404), ("GET", "/health", None, 200), ("GET", "/stats?x=1", "", 200),
        ("GET", "/kv/range", '{"start": "a", "end": "b"}', 200), ("GET", "/kv/range", '{"start": "a"}', 400), ("DELETE", "/kv/delete", "{}", 400),
        ("PUT", "/kv/put", '{"key": "a", "value": "' + "x" * requests.MAX_BODY + '"}', 413),
    ]
    v = ask(spark, *(c[:3] for c in cases))
    assert {r["req_id"]: r["status_code"] for r in v.collect()} == {i: c[3] for i, c in enumerate(cases)}
    errors = {r["req_id"]: json.loads(r["body"]) for r in requests.answer_errors(v).collect()}
    assert set(errors) == {i for i, c in enumerate(cases) if c[3] != 200}
    assert errors[1] == {"status": "error", "code": 400, "message": "keys and values arrays must have the same length"} and errors[9]["message"] == "Invalid JSON"
    done = {r["req_id"]: json.loads(r["body"])["message"] for r in requests.answer_writes(v).collect()}
    assert done == {0: "Batch put completed for 0 items", 5: "Batch put completed for 1 items", 11: "Key stored successfully"}


def test_writes_and_deletes_in_order(spark):
    log = spark.createDataFrame([("old", "1", False, 5), ("gone", None, True, 9)], MUTATION)
    many = json.dumps({"keys": [f"k{i % 7}" for i in range(50)], "values": [str(i) for i in range(50)]})
    v = ask(
        spark, ("DELETE", "/kv/delete", '{"key": "old"}'), ("DELETE", "/kv/delete", '{"key": "old"}'), ("POST", "/kv/batch", many), ("DELETE", "/kv/delete", '{"key": "k1"}'),
        ("PUT", "/kv/put", '{"key": "k2", "value": "z"}'), ("DELETE", "/kv/delete", '{"key": "gone"}'), ("PUT", "/kv/put", '{"key": "old", "value": "2"}'), ("DELETE", "/kv/delete", '{"key": "nobody"}'),
    )
    got = {r["req_id"]: (r["status_code"], json.loads(r["body"])["status"]) for r in requests.answer_deletes(v, log).collect()}
    assert got == {0: (200, "success"), 1: (404, "not_found"), 3: (200, "success"), 5: (404, "not_found"), 7: (404, "not_found")}
    state = {r["key"]: r["value"] for r in fold.live(requests.apply_writes(v)).collect()}
    assert state == {"k0": "49", "k2": "z", "k3": "45", "k4": "46", "k5": "47", "k6": "48", "old": "2"}
