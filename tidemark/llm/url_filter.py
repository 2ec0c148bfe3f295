"""URL rules indexed by their rarest literal token.

A rule is ``host/path`` with a verdict; it fits its host and all subdomains if the
URL's path starts with the rule's path, in which ``*`` stands for any characters.
Each rule is filed under the one of its complete literal tokens that the corpus has
least often (counted over all URLs). A URL's tokens fetch candidate rules, and only
those run their regular expression. The longest fitting rule wins; of equal length,
block wins. Without a rule the default verdict holds.

Rule lists of at most ``MAX_RULES`` go to the tasks as an index; a larger list is
joined by token, by a shuffle, and its rules without any literal token, which nothing
can look up, are tried in blocks of about ``MAX_RULES``, each sent to all tasks in its
turn: every rule judges every URL either way. Defined results: a null URL, or one without ``://``,
has empty host and path and gets the default; rules with a null or empty host or an
unknown verdict are ignored; repeated rules and rows do no harm; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.common import table
from tidemark.sources.shared import written

#: About 100 bytes a rule: 20 MB.
MAX_RULES = 200_000
TOKEN = r"[0-9a-z\x80-\U0010ffff]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = str.maketrans(UPPER, LOWER)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1)


def pattern(rule_host: str, rule_path: str) -> str:
    """Over host and path joined; no host holds a slash."""
    body = ".*".join(map(re.escape, rule_path.split("*")))
    return rf"(?s)^(?:[^/]*\.)?{re.escape(rule_host)}" + (body if rule_path.startswith("/") else rf"(?=/|$){body}")


def literal_tokens(rule_host: str, rule_path: str) -> list[str]:
    """Tokens that every fitting URL has whole: those that no wildcard and no open end touches."""
    found = re.findall(TOKEN, rule_host)
    for m in re.finditer(TOKEN, low := rule_path.translate(_LOW)):
        if m.end() < len(low) and "*" not in (low[m.end()], low[m.start() - 1 : m.start()]):
            found.append(m[0])
    return sorted(set(found))


def _rules(rules: DataFrame) -> DataFrame:
    r = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    return r.where("verdict in ('allow', 'block') AND host <> ''").distinct()


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(r"[0-9a-z\x{80}-\x{10FFFF}]+"), F.lit(0)))


def _parsed_rules(rules: DataFrame) -> DataFrame:
    """Rules with their text, pattern and literal tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = list(zip(b["host"], b["path"]))
            yield pd.DataFrame({"verdict": b["verdict"], "rule": [h + p for h, p in pairs], "pattern": [pattern(*x) for x in pairs], "toks": [literal_tokens(*x) for x in pairs]})

    return _rules(rules).mapInPandas(run, "verdict string, rule string, pattern string, toks array<string>")


def _filed(rules: DataFrame, parsed: DataFrame) -> DataFrame:
    """(verdict, rule, pattern, token): token null if the rule has no literal token."""
    r = _parsed_rules(rules)
    named = r.select(F.explode("toks").alias("token")).distinct()
    seen = parsed.select(F.explode(tokens(F.concat("host", "path"))).alias("token"))
    seen = seen.join(named, "token", "left_semi")  # only tokens that a rule has are counted
    counts = seen.groupBy("token").count().join(named, "token", "right").select("token", F.coalesce("count", F.lit(0)).alias("count"))
    ranked = r.select("verdict", "rule", "pattern", F.explode("toks").alias("token")).join(counts, "token")
    rare = ranked.groupBy("verdict", "rule", "pattern").agg(F.min(F.struct("count", "token")).alias("m")).select("verdict", "rule", "pattern", F.col("m.token").alias("token"))
    return rare.unionByName(r.where("size(toks) = 0").select("verdict", "rule", "pattern", F.lit(None).cast("string").alias("token")))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", max_rules: int | None = None) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict."""
    parsed = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    filed = written(_filed(rules, parsed), "url-rules")
    most = MAX_RULES if max_rules is None else max_rules
    if filed.count() <= most:
        return _mapped(parsed, _collected(filed), default)
    return _joined(parsed, filed, default, max(1, most))


def _collected(filed: DataFrame) -> list[tuple]:
    """Rules on the driver: the caller bounds their number."""
    return [tuple(r) for r in filed.select("verdict", "rule", "pattern", "token").collect()]


def _mapped(parsed: DataFrame, filed: list[tuple], default: str) -> DataFrame:
    """The index in each task: no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index: dict[str | None, list[tuple]] = {}
        for verdict, rule, pat, token in filed:
            index.setdefault(token, []).append((len(rule), verdict == "block", rule, verdict, pat))
        token_of, compiled = re.compile(TOKEN), {}
        always = index.get(None, [])

        def fits(pat: str, text: str) -> bool:
            if (p := compiled.get(pat)) is None:
                p = compiled[pat] = re.compile(pat)
            return p.match(text) is not None

        for b in batches:
            rule, verdict = [], []
            for h, p in zip(b["host"], b["path"]):
                text = h + p
                cand = [*always, *(c for t in set(token_of.findall(text.translate(_LOW))) for c in index.get(t, ()))]
                best = max((c for c in cand if fits(c[4], text)), default=None)
                rule.append(best and best[2])
                verdict.append(best[3] if best else default)
            yield pd.DataFrame({"page_id": b["page_id"], "host": b["host"], "path": b["path"], "rule": rule, "verdict": verdict})

    return parsed.mapInPandas(run, f"page_id {parsed.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")


def _joined(parsed: DataFrame, filed: DataFrame, default: str, block: int) -> DataFrame:
    """Candidates by a join on tokens; distinct addresses are judged once."""
    url = written(parsed.select("host", "path").distinct(), "url-addresses")
    by = url.select("host", "path", F.explode(tokens(F.concat("host", "path"))).alias("token"))
    fit = by.join(filed, "token").where(F.expr("rlike(concat(host, path), pattern)")).select("host", "path", "verdict", "rule")
    free = filed.where("token IS NULL")
    blocks = -(-free.count() // block)
    for k in range(blocks):
        part = _collected(free.where(F.pmod(F.xxhash64("rule", "verdict"), F.lit(blocks)) == k))
        best_of = _mapped(url.withColumn("page_id", F.lit(0)), part, default).where("rule IS NOT NULL")
        fit = fit.unionByName(best_of.select("host", "path", "verdict", "rule"))
    best = fit.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("b"), "rule", "verdict")).alias("m"))
    return parsed.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.verdict", F.lit(default)).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "verdict string, host string, path string"))


OP5_SQL = rf"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
r(verdict, h, p) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
f AS (SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS rn
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN f ON u.page_id = f.page_id AND rn = 1"""
