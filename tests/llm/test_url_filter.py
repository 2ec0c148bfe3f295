import pytest

from tests.oracle import same
from tidemark.llm import url_filter as x

SF = "/root/testdata/sf0.01"
URLS = [
    "https://EXAMPLE.com/en/7?x#y", "http://a.example.com/en/8", "http://notexample.com/en/7", "ftp://com/en/", "http://x.net/de", "http://example.net/de/81", "nothing", None, "",
    "http://x.org?/es/", "http://x.org#/es/", "http://h.io/a/ads/1.js", "http://h.io/b", "//h.io/a", "http://x.com:80/en/", "http://x.com/EN/", "a://b://com/en/", "http://é.org/es/ü", "http://" + "a" * 50_000 + ".com/en/" + "b" * 50_000,
]
RULES = [*x.RULES, ("block", "h.io", "/*/ads/"), ("allow", "h.io", ""), ("allow", "com", "/en/"), ("block", None, "/"), ("odd", "com", "/"), ("block", "é.org", "/es/ü")]


def brute(url, rules):
    import re

    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = []
    for v, h, p in rules:
        if v in ("allow", "block") and h and (host == h or host.endswith("." + h)) and re.match(".*".join(map(re.escape, p.split("*"))), path, re.S):
            fit.append((len(h + p), v == "block", h + p, v))
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_query_equals_sql(spark):
    assert same(x.op5_url_filter(spark, SF), x.OP5_SQL, SF) == 250


@pytest.mark.parametrize("most", [None, 0])
def test_against_brute_force(spark, most):
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate([*URLS, *URLS[:3]])], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in x.judge(pages, rules, max_rules=most).collect()}
    assert got == {i: brute(u, RULES) for i, u in enumerate([*URLS, *URLS[:3]])}


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([], "verdict string, host string, path string")
    assert x.judge(pages, rules).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert x.judge(one, rules, default="block").first()["verdict"] == "block"
    assert x.judge(one, rules, max_rules=-1).first()["verdict"] == "allow"


def test_literal_tokens():
    assert x.literal_tokens("example.com", "/en/7") == ["com", "en", "example"]
    assert x.literal_tokens("h.io", "/ad*s/x*/img/") == ["h", "img", "io"]


@pytest.mark.parametrize("most", [None, 0, 1, 2])
def test_rules_without_tokens_all_judge(spark, most):
    """However small the blocks, every rule judges every URL."""
    rules = [("block", "+", "-/"), ("block", "-", "-/"), ("block", "+", "/"), ("allow", "-", "/*"), ("block", "~", ""), ("block", "example.com", "/x")]
    urls = ["http://-.-/y", "http://+/", "http://+/-", "http://-/a", "http://a.~/b", "http://~", "http://example.com/x/-", "http://=/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in x.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), max_rules=most).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}
