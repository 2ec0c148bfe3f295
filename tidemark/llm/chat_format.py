"""Reply trees to formatted conversations. DataFrame functions only.

Messages (tree_id, node_id, parent_id, role, text, score) form trees. Iterative
self-joins climb them: a jump table gives each node's ancestor at distance 2^k and the
sum of the scores up to it, so a chain of a million replies takes twenty rounds.
Branches are ranked per tree by the sum of their scores, and the first ``top`` are
expanded by the same tables, each of which doubles the part of a path that is known,
and formatted; the other paths are never written out.

Template: ``<|im_start|>role\\n text <|im_end|>\\n`` per turn (without the blanks).
Escapes are reversible: ``\\`` is written ``\\0``, ``<`` as ``\\1``, ``[`` as ``\\2``
and, in roles, a line feed as ``\\3``. No control string can then stand in a text:
all of them (``<|...|>``, ``</s>``, ``[INST]``) begin with ``<`` or ``[``.

Defined results: null text and role count as empty; a parent that is missing or is
the node itself makes a root; nodes whose ancestors form a cycle have no root and no
path; a null score counts as 0; ties rank by leaf id. node_id is unique within a
tree; of repeated rows the least (by parent, role, text) stays. A null tree_id is a
tree of its own, and a null node_id a node of its own in its tree: it has a parent but
no replies, as a null parent_id makes a root, and ranks before other leaves in ties.
Extra columns are ignored. An empty table gives no conversations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.common import table
from tidemark.sources.shared import cut_lineage

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c, code in (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"), *((("\n", "\\3"),) if role else ())):
        out = F.replace(out, F.lit(c), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    out = text
    for c, code in (("\n", "\\3"), ("[", "\\2"), ("<", "\\1"), ("\\", "\\0")):
        out = F.replace(out, F.lit(code), F.lit(c))
    return out


def _joined(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on null-safe keys that keeps one copy of them; other columns differ."""
    right = b.select(*(F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in b.columns))
    both = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return a.join(right, reduce(lambda x, y: x & y, both), how).drop(*(f"_on_{c}" for c in on))


def _union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both, in no more partitions than a shuffle makes: rounds of unions would add up theirs."""
    return a.unionByName(b).coalesce(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _body(messages: DataFrame) -> DataFrame:
    """A row per node: of repeated rows the least (by parent, role, text), with the greatest score."""
    first = F.struct(F.col("parent_id").isNull().alias("n"), "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = messages.groupBy("tree_id", "node_id").agg(F.min(first).alias("m"), F.max("score").alias("score"))
    return one.select("tree_id", "node_id", "m.parent_id", "m.role", "m.text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))


def _climb(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(jump tables, leaves): table k has each node's ancestor at distance 2^k; a leaf that reaches a root has its branch's score.

    A node's sum up to its jump is joined with the jump's own sum, so that branches are scored without their paths.
    """
    nodes = cut_lineage(_body(messages).select("tree_id", "node_id", "parent_id", "score"))
    known = nodes.select("tree_id", F.col("node_id").alias("up_id"))
    up = nodes.where("parent_id IS NOT NULL AND NOT parent_id <=> node_id").select("tree_id", "node_id", F.col("parent_id").alias("up_id"), "score")
    rest = cut_lineage(_joined(up, known, ["tree_id", "up_id"], "left_semi").select("tree_id", "node_id", "up_id", "score"))
    roots = _joined(nodes.select("tree_id", "node_id", "score"), rest.select("tree_id", "node_id"), ["tree_id", "node_id"], "left_anti")
    done = roots.select("tree_id", "node_id", F.col("score").alias("branch"))
    jumps, total, step = [], None, 1
    while not rest.isEmpty():
        total = nodes.count() if total is None else total
        if step > total:  # only cycles have ancestors this far away
            break
        jumps.append(rest.select("tree_id", "node_id", "up_id"))
        done = cut_lineage(done)
        ends = done.select("tree_id", F.col("node_id").alias("up_id"), F.col("branch").alias("_b"))
        above = rest.select("tree_id", F.col("node_id").alias("up_id"), F.col("up_id").alias("_far"), F.col("score").alias("_s"))
        done = _union(done, _joined(rest, ends, ["tree_id", "up_id"]).select("tree_id", "node_id", (F.col("score") + F.col("_b")).alias("branch")))
        rest = cut_lineage(_joined(rest, above, ["tree_id", "up_id"]).select("tree_id", "node_id", F.col("_far").alias("up_id"), (F.col("score") + F.col("_s")).alias("score")))
        step *= 2
    if jumps:
        done = _joined(done, jumps[0].select("tree_id", F.col("up_id").alias("node_id")).distinct(), ["tree_id", "node_id"], "left_anti")
    return jumps, cut_lineage(done.withColumnRenamed("node_id", "leaf_id"))


def _expanded(leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(tree_id, leaf_id, node_id, up) of the paths of some leaves: each jump table doubles the part that is known."""
    part = leaves.select("tree_id", "leaf_id", F.col("leaf_id").alias("node_id"), F.lit(0).cast("long").alias("up"))
    for k, jump in enumerate(jumps):
        part = cut_lineage(_union(part, _joined(part, jump, ["tree_id", "node_id"]).select("tree_id", "leaf_id", F.col("up_id").alias("node_id"), (F.col("up") + (1 << k)).alias("up"))))
    return part


def paths(messages: DataFrame) -> DataFrame:
    """(tree_id, leaf_id, node_id, up): each leaf's path, ``up`` replies above the leaf."""
    jumps, leaves = _climb(messages)
    return _expanded(leaves, jumps)


def chosen(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree_id, leaf_id, rank, turns): the best branches, turns from the root down. Only their paths are written out."""
    jumps, leaves = _climb(messages)
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("branch"), "leaf_id"))  # cut to ``top`` in each task first
    best = cut_lineage(leaves.withColumn("rank", rank).where(F.col("rank") <= top).select("tree_id", "leaf_id", "rank"))
    p = _joined(_expanded(best, jumps), best, ["tree_id", "leaf_id"])
    turns = _joined(p, _body(messages).select("tree_id", "node_id", "role", "text"), ["tree_id", "node_id"])
    order = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("pos"), "role", "text")))
    return turns.groupBy("tree_id", "leaf_id", "rank").agg(order.alias("turns"))


def formatted(turns: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_spans``, [start, end) code points of assistant texts in it."""
    t = turns.withColumn("_e", F.transform("turns", lambda t: F.struct(escape(t["role"], role=True).alias("r"), escape(t["text"]).alias("t"))))
    parts = F.transform("_e", lambda e: F.concat(F.lit(START), e["r"], F.lit("\n"), e["t"], F.lit(END)))
    head = len(START) + 1
    spans = F.expr(
        f"aggregate(_e, struct(0 AS at, CAST(array() AS array<struct<start: int, end: int>>) AS s), (a, e) -> struct(a.at + {head + len(END)} + length(e.r) + length(e.t) AS at,"
        f" IF(e.r = 'assistant', concat(a.s, array(struct(a.at + {head} + length(e.r) AS start, a.at + {head} + length(e.r) + length(e.t) AS end))), a.s) AS s), a -> a.s)"
    )
    return t.withColumn("formatted", F.array_join(parts, "")).withColumn("loss_spans", spans).drop("_e")


def read_turns(text: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    rows = F.filter(F.split(text, r"\Q" + END + r"\E"), lambda x: x != "")
    body = F.transform(rows, lambda x: F.substring(x, F.lit(len(START) + 1), F.length(x)))
    return F.transform(
        body,
        lambda x: F.struct(
            unescape(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substring(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x))).alias("text")
        ),
    )


def format_trees(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree_id, leaf_id, rank, turns, formatted, loss_spans)."""
    return formatted(chosen(messages, top))


def linear(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees with one branch; each row answers the one before it."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = conversations.select("conv_id", "role", "text", F.row_number().over(w).cast("long").alias("node_id"))
    return n.select(F.col("conv_id").alias("tree_id"), "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    c = c.unionByName(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], c.schema))
    out = format_trees(linear(c))
    back = out.select(F.col("tree_id").alias("conv_id"), "formatted", "loss_spans", read_turns(F.col("formatted")).alias("t"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    digest = F.sha2(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256)
    back = back.select("conv_id", F.size("t").cast("long").alias("n_turns"), digest.alias("turns_sha256"), loss.alias("_loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return back.select("conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars")


_ESC = reduce(lambda s, c: f"replace({s}, '{c}', '~~')", "\\<[", "{0}")
OP3_SQL = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
a AS (SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS t,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS l,
  CAST(sum({len(START) + 1 + len(END)} + length({_ESC.format('role')}) + length({_ESC.format('text')})) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, CAST(length(l) AS BIGINT) AS loss_chars, sha256(l) AS loss_sha256, formatted_chars FROM a"""
