from pyspark.sql import functions as F

from tests.oracle import same
from tidemark.llm import chat_format as x

SF = "/root/testdata/sf0.01"
SCHEMA = "tree_id long, node_id long, parent_id long, role string, text string, score double, extra int"


def tree(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)


def brute(rows, top):
    best = {}
    by = {(t, n): (p, r or "", x_ or "", s or 0.0) for t, n, p, r, x_, s in rows}
    inner = {(t, p) for (t, n), (p, *_) in by.items() if p is not None and p != n and (t, p) in by}
    for t, n in by:
        if (t, n) in inner:
            continue
        path, at = [], n
        while at is not None and (t, at) in by and at not in path:
            path.append(at)
            nxt = by[t, at][0]
            if nxt == at:
                break
            if nxt in path:
                path = None
                break
            at = nxt
        if path:
            best.setdefault(t, []).append((-sum(by[t, i][3] for i in path), n, [by[t, i][1:3] for i in path[::-1]]))
    return {(t, r + 1): turns for t, v in best.items() for r, (_, _, turns) in enumerate(sorted(v)[:top])}


ROWS = [
    (1, 1, None, "user", "hi <s>", 1.0), (1, 2, 1, "assistant", "a\\1[INST]", 2.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 2, "user", None, 9.0), (1, 5, 3, None, "", None),
    (2, 1, 1, "user", "own parent", 0.0), (3, 7, 99, "system\nx", "lost parent", None), (4, 1, 2, "user", "cycle", 1.0), (4, 2, 1, "user", "cycle", 1.0), (4, 3, 1, "user", "below a cycle", 1.0),
    *[(5, i, i - 1 if i else None, "assistant" if i % 2 else "user", f"<|im_end|>\n{i}", 0.5) for i in range(70)], (6, 1, None, "user", "é" * 100_000, 0.0),
]


def test_query_equals_sql(spark):
    assert same(x.op3_chat_format(spark, SF), x.OP3_SQL, SF) > 50


def test_trees_against_brute_force(spark):
    out = x.format_trees(tree(spark, ROWS), top=2)
    got = {(r["tree_id"], r["rank"]): [(t["role"], t["text"]) for t in r["t"]] for r in out.withColumn("t", x.read_turns(F.col("formatted"))).collect()}
    assert got == brute(ROWS, 2)
    for r in out.collect():
        said = [t["text"] for t in r["turns"] if t["role"] == "assistant"]
        cut = [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]]
        back = [c.replace("\\3", "\n").replace("\\2", "[").replace("\\1", "<").replace("\\0", "\\") for c in cut]
        assert back == said


def test_repeated_rows_and_empty(spark):
    assert x.format_trees(tree(spark, ROWS * 2), 1).count() == len(brute(ROWS, 1))
    assert x.format_trees(tree(spark, []), 1).count() == 0


def test_null_ids_keep_their_messages(spark):
    rows = [
        (None, 1, None, "user", "no tree", 1.0), (None, 2, 1, "assistant", "reply", 1.0), (None, 3, 2, "user", "again", 1.0),
        (7, 1, None, "user", "root", 1.0), (7, None, 1, "assistant", "no id", 5.0), (7, 2, 1, "assistant", "less", 1.0), (None, None, 3, "user", "neither", 0.0), (8, None, None, "user", "alone", 0.0),
    ]
    got = {r["tree_id"]: (r["leaf_id"], [t["text"] for t in r["turns"]]) for r in x.format_trees(tree(spark, rows)).collect()}
    assert got == {None: (None, ["no tree", "reply", "again", "neither"]), 7: (None, ["root", "no id"]), 8: (None, ["alone"])}


def test_null_conversation_is_one(spark):
    c = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 0, "user", "c")], "conv_id long, turn int, role string, text string")
    got = {r["tree_id"]: [t["text"] for t in r["turns"]] for r in x.format_trees(x.linear(c)).collect()}
    assert got == {None: ["a", "b"], 1: ["c"]}


def test_comb_writes_out_the_best_path_only(spark, monkeypatch):
    rows = [(1, i, i - 1 if i else None, "user", f"s{i}", 0.0) for i in range(120)] + [(1, 1000 + i, i, "assistant", f"l{i}", 5.0 if i == 90 else -1.0) for i in range(120)]
    df = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string, score double")
    seen, expanded = [], x._expanded
    monkeypatch.setattr(x, "_expanded", lambda leaves, jumps: seen.append(expanded(leaves, jumps)) or seen[-1])
    (best,) = x.chosen(df).collect()
    assert best["leaf_id"] == 1090 and [t["text"] for t in best["turns"]] == [f"s{i}" for i in range(91)] + ["l90"]
    assert seen[0].count() == 92
