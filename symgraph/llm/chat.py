"""Operator 8: reply trees to conversations, with DataFrame functions only.

Messages form trees (node and parent).  Iterative self-joins double the reach of every node's
pointer towards its root (1, 2, 4, ... steps up) and add up the scores on the way, so trees of
depth d take log2(d) joins.  Leaves are ranked by the mean score of their root-to-leaf path, and
the same pointers, longest first, list the nodes of the chosen paths.  Each path is formatted as
one text.

Template: every turn is ``<s>[INST]role[/INST]text</s>``.  Inside roles and texts a backslash is
doubled and the four control strings get a backslash behind their first character, so they never
occur in a text and can be read back exactly.  The loss mask is a list of spans (start, length in
code points of the formatted text): one for each assistant text.

Defined results: null text and null role count as empty; a parent that does not exist makes its
node a root; messages on a cycle of parents, or below one, are on no root-to-leaf path; rows with
the same turn are ordered by role and text; of repeated rows each is a turn of its own; an empty
table gives no conversations; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remove, table, written

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = r"(<|\[)(/?(?:s>|INST\]))"
_ESCAPED = r"(<|\[)\\(/?(?:s>|INST\]))"


def escape(text: F.Column) -> F.Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescape(text: F.Column) -> F.Column:
    return F.replace(F.regexp_replace(text, _ESCAPED, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def chosen_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """nodes: tree, node, parent, score (null: 0) -> tree, rank, node, up (steps above the leaf).

    (tree, node) must be unique.  The ``branches`` best leaves of each tree are taken.
    """
    nodes = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    spark, scratch = nodes.sparkSession, []
    step = written(
        nodes.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("above"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth")),
        "tree-0",
        scratch,
    )
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jumps = [step]
    while 1 << (len(jumps) - 1) < largest and not jumps[-1].filter("above is not null").isEmpty():
        near, far = jumps[-1], jumps[-1].select("tree", F.col("node").alias("above"), F.col("above").alias("next"), F.col("total").alias("more"), F.col("depth").alias("deeper"))
        doubled = near.filter("above is not null").join(far, ["tree", "above"]).select("tree", "node", F.col("next").alias("above"), (F.col("total") + F.col("more")).alias("total"), (F.col("depth") + F.col("deeper")).alias("depth"))
        jumps.append(written(near.filter("above is null").unionByName(doubled), f"tree-{len(jumps)}", scratch))
    rooted = jumps[-1].filter("above is null")
    leaves = rooted.join(step.filter("above is not null").select("tree", F.col("above").alias("node")), ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node")
    paths = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches).select("tree", "rank", "node", F.lit(0).cast("long").alias("up"))
    for i in reversed(range(len(jumps))):
        higher = paths.join(jumps[i].filter("above is not null").select("tree", "node", "above"), ["tree", "node"]).select("tree", "rank", F.col("above").alias("node"), (F.col("up") + (1 << i)).alias("up"))
        paths = written(paths.unionByName(higher), f"tree-paths-{i}", scratch)
    for folder in scratch[:-1]:  # all but the paths themselves
        remove(spark, folder)
    return paths


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """messages: tree, node, role, text -> tree, rank, formatted, mask (array of start and length).

    Where a turn starts is a running sum over the turns' rows; a path's text is put together once.
    """
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(BEGIN + OPEN), role, F.lit(CLOSE))
    turns = paths.join(messages, ["tree", "node"]).select(
        "tree", "rank", (-F.col("up")).alias("at"), F.concat(head, text, F.lit(END)).alias("turn"), F.length(head).alias("head"), F.length(text).alias("length"), (F.col("role") == "assistant").alias("loss")
    )
    before = F.sum(F.col("head") + F.col("length") + len(END)).over(Window.partitionBy("tree", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    placed = turns.withColumn("start", F.coalesce(before, F.lit(0)) + F.col("head"))
    in_order = placed.groupBy("tree", "rank").agg(
        F.sort_array(F.collect_list(F.struct("at", "turn"))).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("loss"), F.struct("start", "length")))).alias("mask"),
    )
    return in_order.select("tree", "rank", F.array_join(F.col("turns.turn"), "").alias("formatted"), "mask")


def read_back(formatted: F.Column) -> F.Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    turns = F.filter(F.split(formatted, END), lambda t: t != "")
    body = F.transform(turns, lambda t: F.split(F.substring(t, len(BEGIN + OPEN) + 1, 2_000_000_000), r"\[/INST\]", 2))
    return F.transform(body, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def op8_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations (chains: each turn answers the one before) and conversation -1, read back.

    Rows with a null conv_id are one conversation; a conversation -1 of the table stays one of its own.
    """
    own = "</s>[INST] ok [/INST]"
    found = table(spark, sf_dir, "conversations")
    rows = found.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id")), F.lit("null")).alias("tree"), "turn", "role", "text")  # a conversation -1 of the table is no part of the added one
    extra = spark.range(2).select(F.lit("added").alias("tree"), F.col("id").cast(found.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    number = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    messages = written(rows.unionByName(extra).select("tree", number.alias("node"), "role", "text"), "chat")
    paths = chosen_paths(messages.select("tree", "node", (F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score")))
    out = format_paths(paths, messages)
    turns, loss = read_back(F.col("formatted")), unescape(F.array_join(F.transform("mask", lambda m: F.substring(F.col("formatted"), m["start"] + 1, m["length"])), ""))
    return out.select("tree", "formatted", turns.alias("turns"), loss.alias("loss")).select(
        F.when(F.col("tree") == "added", F.lit(-1)).when(F.col("tree") != "null", F.substring("tree", 2, 1000)).cast(found.schema["conv_id"].dataType).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH all_rows AS (
  SELECT conv_id, false AS added, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, true, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, true, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, regexp_replace(replace(role, '\', '\\'), '(<|\[)(/?(?:s>|INST\]))', '\1\\\2', 'g') AS r,
            regexp_replace(replace(text, '\', '\\'), '(<|\[)(/?(?:s>|INST\]))', '\1\\\2', 'g') AS t FROM all_rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(r) + length(t) + 20)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id, added
"""
