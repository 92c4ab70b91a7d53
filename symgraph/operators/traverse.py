"""Bounded traversals: every level is one join, deduplicated, whatever the graph's size.

Up to three levels the plan is unrolled and lazy; deeper ones write each level to the shared
folder, which cuts the lineage.  A start node is not marked as visited, so a cycle returns it.
The edges are read once a level and never copied: give a table, not a costly plan.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written

UNROLLED = 3
#: So many levels are united in a plan before what was seen is written as one table.
REWRITTEN = 16


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    return edges.select("src", "dst") if direction == "OUT" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def impact(edges: DataFrame, starts: list[int], direction: str = "IN", depth: int = 3) -> DataFrame:
    """Distinct nodes within 1..depth hops of ``starts``: id and the least depth."""
    steps = _steps(edges, direction)
    level = steps.filter(F.col("src").isin(starts)).select(F.col("dst").alias("id")).distinct().withColumn("depth", F.lit(1))
    seen = level
    for d in range(2, depth + 1):
        if d > UNROLLED:
            level, seen = written(level, "level"), written(seen, "seen")
            if level.isEmpty():
                break
        level = steps.join(level, steps["src"] == level["id"]).select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(level)
    return seen


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The distinct ids of ``roots`` (id) and of all that can be reached from them: one frontier for all roots."""
    level = written(roots.select("id").distinct(), "frontier")
    seen = level
    for d in count(1):
        level = written(edges.select("src", "dst").join(level, F.col("src") == F.col("id")).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"), "frontier")
        if level.isEmpty():
            return seen
        seen = seen.unionByName(level) if d % REWRITTEN else written(seen.unionByName(level), "seen")


def closure(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All (root, id, depth) reachable from the ids in ``roots``, each once with its least depth.

    Ends when a level is empty, on cycles too, or after ``max_depth`` levels where that is given.  The
    result has a row for each root and node; where the nodes suffice, use :func:`reached`.
    """
    steps = edges.select("src", "dst")
    level = roots.select(F.col("id").alias("root"), "id").withColumn("depth", F.lit(0))
    seen = level
    for d in count(1) if max_depth is None else range(1, max_depth + 1):
        level = written(steps.join(level, steps["src"] == level["id"]).select("root", F.col("dst").alias("id")).distinct().join(seen, ["root", "id"], "left_anti").withColumn("depth", F.lit(d)), "closure")
        if level.isEmpty():
            break
        seen = seen.unionByName(level) if d % REWRITTEN else written(seen.unionByName(level), "seen")
    return seen


def call_paths(edges: DataFrame, src: int, dst: int | None = None, max_len: int | None = None, limit: int | None = None) -> DataFrame:
    """Paths of one edge or more that repeat no edge: dst, length, nodes (array).

    With ``dst`` only edges from which it can still be reached take part, and paths end there.  Without
    ``max_len`` all paths are listed, which on a dense graph are too many for any machine.
    """
    steps = edges.select("src", "dst")
    if dst is not None:
        back = _steps(edges, "IN")
        useful = reached(back, edges.sparkSession.createDataFrame([(dst,)], "id long")) if max_len is None else impact(edges, [dst], "IN", max_len).select("id")
        steps = written(steps.join(useful.select(F.col("id").alias("src")), "src", "left_semi"), "useful")
    key = F.concat_ws(">", "src", "dst")
    paths = steps.filter(F.col("src") == src).select("dst", F.array("src", "dst").alias("nodes"), F.array(key).alias("used"))
    out = paths
    for d in count(2) if max_len is None else range(2, max_len + 1):
        if d > UNROLLED + 1:
            paths = written(paths, "paths")
            if paths.isEmpty():
                break
            out = written(out, "paths")
        open_ends = paths if dst is None else paths.filter(F.col("dst") != dst)
        at = open_ends.select(F.col("dst").alias("src"), "nodes", "used")
        paths = steps.join(at, "src").filter(~F.array_contains("used", key)).select("dst", F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("used", key).alias("used"))
        out = out.unionByName(paths)
    out = out.filter(F.col("dst") == dst) if dst is not None else out
    out = out.select("dst", (F.size("nodes") - 1).alias("length"), "nodes")
    return out if limit is None else out.orderBy("length", "nodes").limit(limit)


def shortest_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, max_hops: int = 10, rels: list[str] | None = None) -> DataFrame:
    """For each start and each other end (columns id) a shortest path of edges of any of ``rels``: src, dst, hops, nodes.

    Of equally short ones the path with the least nodes.
    """
    steps = (edges.filter(F.col("rel").isin(rels)) if rels else edges).select("src", "dst")
    level = written(starts.select("id").distinct().select(F.col("id").alias("root"), F.col("id").alias("at"), F.array("id").alias("nodes"), F.lit(0).alias("hops")), "short")
    seen = level
    for d in range(1, max_hops + 1):
        ahead = steps.join(level, steps["src"] == level["at"]).select("root", F.col("dst").alias("at"), F.array_append("nodes", F.col("dst")).alias("nodes"))
        level = written(ahead.groupBy("root", "at").agg(F.min("nodes").alias("nodes")).join(seen.select("root", "at"), ["root", "at"], "left_anti").withColumn("hops", F.lit(d)), "short")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    found = seen.filter("hops > 0").join(ends.select(F.col("id").alias("at")).distinct(), "at", "left_semi")
    return found.select(F.col("root").alias("src"), F.col("at").alias("dst"), "hops", "nodes")


def overrides(extends: DataFrame, methods: DataFrame, max_depth: int = 3) -> DataFrame:
    """extends: src (sub), dst (super); methods: owner, method, name -> method, overridden, depth (least)."""
    chain = extends.select(F.col("src").alias("sub"), F.col("dst").alias("sup"), F.lit(1).alias("depth"))
    level = chain
    for d in range(2, max_depth + 1):
        level = level.join(extends.select(F.col("src").alias("sup"), F.col("dst").alias("next")), "sup").select("sub", F.col("next").alias("sup"), F.lit(d).alias("depth")).distinct()
        chain = chain.unionByName(level)
    own = methods.select(F.col("owner").alias("sub"), F.col("method"), "name")
    base = methods.select(F.col("owner").alias("sup"), F.col("method").alias("overridden"), "name")
    pairs = chain.filter("sub <> sup").join(own, "sub").join(base, ["sup", "name"]).filter("method <> overridden")
    return pairs.groupBy("method", "overridden").agg(F.min("depth").alias("depth"))
