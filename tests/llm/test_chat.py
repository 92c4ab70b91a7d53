from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symgraph.llm.chat import chosen_paths, escape, format_paths, op8_reply_trees, read_back, unescape

TEXTS = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "<s>", "[/INST]\\[INST]", "\\\\</s>\\", "", "é😀", "<\\\\/s>"]


def test_escape_is_reversible(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(["<", "\\", "/", "s", ">", "[", "INST", "]", "</s>", "[INST]", "x"]), max_size=8).map("".join), min_size=40, max_size=60))
    def run(texts):
        df = spark.createDataFrame([(t,) for t in texts + TEXTS], "t string").select("t", escape(F.col("t")).alias("e"))
        for r in df.select("t", "e", unescape(F.col("e")).alias("u")).collect():
            assert r.u == r.t
            assert not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]"))

    run()


def brute(nodes, branches):
    by = {(t, n): (p, s or 0.0) for t, n, p, s in nodes}
    parents = {(t, p) for t, n, p, s in nodes}
    found = {}
    for t, n, _, _ in nodes:
        if (t, n) in parents:
            continue
        path, at = [], n
        while at is not None and (t, at) in by and len(path) <= len(nodes):
            path.append(at)
            at = by[t, at][0]
        if len(path) <= len(nodes):
            found.setdefault(t, []).append((-sum(by[t, x][1] for x in path) / len(path), -len(path), n, path[::-1]))
    return {(t, i + 1): x[3] for t, rows in found.items() for i, x in enumerate(sorted(rows)[:branches])}


def test_paths_of_trees(spark):
    nodes = [(1, 0, None, 1.0), (1, 1, 0, 0.5), (1, 2, 0, 2.0), (1, 3, 2, None), (1, 4, 1, 9.0), (1, 5, 99, 0.1), (2, 0, None, 0.0)]
    nodes += [(3, i, i - 1 if i else None, 0.0) for i in range(37)]
    nodes += [(4, 0, 1, 0.0), (4, 1, 0, 0.0), (4, 2, 1, 0.0)]  # a cycle, and a leaf below it
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, score double")
    got = {}
    for r in sorted(chosen_paths(df, 2).collect(), key=lambda r: -r.up):
        got.setdefault((r.tree, r.rank), []).append(r.node)
    assert got == brute(nodes, 2)


def test_format_masks_assistant_texts(spark):
    rows = [(1, i, role, t, "x") for i, (role, t) in enumerate(zip(["system", "user", "assistant", None, "assistant", "us\\er</s>", "assistant", "user", "assistant"], [*TEXTS[:3], None, *TEXTS[4:]]))]
    messages = spark.createDataFrame(rows, "tree long, node long, role string, text string, formatted string")
    paths = spark.createDataFrame([(1, 1, i, len(rows) - i) for i in range(len(rows))], "tree long, rank int, node long, up long")
    r = format_paths(paths, messages).select("formatted", "mask", read_back(F.col("formatted")).alias("turns")).first()
    assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in rows]
    spans = [r.formatted[m.start : m.start + m.length] for m in r["mask"]]
    assert len(spans) == 4 and all(f"[INST]assistant[/INST]{s}</s>" in r.formatted for s in spans)


def test_query_on_odd_tables(spark, tmp_path):
    rows = [(5, 0, "user", None), (5, 0, None, "x"), (5, 0, None, "x"), (None, 1, "assistant", "y"), (6, None, "assistant", "z"), (-1, 7, "user", "own")]
    spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, tree int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((str(r.conv_id), r.n_turns, r.loss_chars) for r in op8_reply_trees(spark, f"file://{tmp_path}").collect())
    assert got == [("-1", 1, 0), ("-1", 2, 21), ("5", 3, 0), ("6", 1, 1), ("None", 1, 1)]


def test_long_texts_and_empty_tables(spark, tmp_path):
    """A text of a million characters, another of control strings only; and no rows at all."""
    import hashlib

    texts = ["wörd </s> \\ " * 80_000, "[INST]" * 100_000]
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", texts[0]), (1, 2, "user", texts[1]), (1, 3, "assistant", texts[1])]
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/conversations.parquet")
    r = next(r for r in op8_reply_trees(spark, f"file://{tmp_path}/a").collect() if r.conv_id == 1)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (r.n_turns, r.turns_sha256) == (4, digest("".join(f"{role}\n{text}\n" for _, _, role, text in rows)))
    assert (r.loss_chars, r.loss_sha256) == (len(texts[0]) + len(texts[1]), digest(texts[0] + texts[1]))
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert [(r.conv_id, r.n_turns) for r in op8_reply_trees(spark, f"file://{tmp_path}/b").collect()] == [(-1, 2)]
