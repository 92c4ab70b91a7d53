"""Graph state: upserts, cascade deletes, differences, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import graph_name, info_key, is_internal
from ..shared import written


def upsert_nodes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Merge by key: a new row's non-null values win, property maps are merged (new keys win)."""
    values = [c for c in old.columns if c not in keys]
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    latest = [(F.max_by("props", F.when(F.col("props").isNotNull(), F.col("_v"))) if c == "props" else F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_v")))).alias(c) for c in values]
    if "props" not in values:
        return both.groupBy(*keys).agg(*latest)
    before = F.max_by("props", -F.col("_v")).alias("_old")
    merged = both.groupBy(*keys).agg(*latest, before)
    kept = F.map_filter(F.coalesce("_old", F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key("props", k))
    return merged.withColumn("props", F.when(F.col("props").isNotNull(), F.map_concat(kept, "props"))).drop("_old")


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame | None = None, keys: tuple[str, ...] = ("src", "rel", "dst")) -> DataFrame:
    """One edge for each key; edges to unknown ``nodes`` are dropped.

    With a column ``props`` (map) property maps are merged, new ones win, of several new values the
    greatest.  ``keys`` with ``pos`` keep one edge for each call site.
    """
    real = new
    if nodes is not None:
        known = nodes.select("id").distinct()
        real = new.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    if "props" not in old.columns:
        return old.unionByName(real).dropDuplicates([*keys])
    both = old.withColumn("_v", F.lit(0)).unionByName(real.withColumn("_v", F.lit(1))).select(*keys, "_v", "props")
    entries = both.select(*keys, "_v", F.explode_outer("props").alias("_k", "_x")).groupBy(*keys, "_k").agg(F.max(F.struct("_v", "_x")).alias("_x"))
    listed = F.array_compact(F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_k", "_x._x"))))
    return entries.groupBy(*keys).agg(F.map_from_entries(F.array_sort(listed)).alias("props"))


def set_props(nodes: DataFrame, updates: DataFrame) -> DataFrame:
    """nodes: id, props, ...; updates: id, props, one row an id.  The maps are merged, updates win; other ids are ignored."""
    new = updates.select("id", F.col("props").alias("_new"))
    kept = F.map_filter(F.coalesce("props", F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key("_new", k))
    merged = F.when(F.col("_new").isNull(), F.col("props")).otherwise(F.map_concat(kept, "_new"))
    return nodes.join(new, "id", "left").withColumn("props", merged).select(*nodes.columns)


#: Label -> (key columns, other columns): what makes two rows one node.
NODE_KEYS = {
    "File": (("path", "name", "ext"), ()),
    "Decorator": (("name", "path", "line"), ()),
    "Package": (("name",), ("version",)),
    "ExternalFunction": (("name", "module", "path"), ("line",)),
    "Variable": (("name", "path"), ("line",)),
    "HtmlElement": (("name", "path", "start", "end"), ()),
    "HtmlForm": (("name", "path", "start", "end"), ()),
    "FileSystemOp": (("op", "path", "line"), ("tainted",)),
    "MarkdownSection": (("title", "path", "line"), ("level",)),
    "Route": (("method", "path"), ()),
    "Requirement": (("text", "path", "line"), ()),
    "OpenSpecCapability": (("name", "src_file"), ("path", "purpose")),
    "OpenSpecRequirement": (("name", "src_file"), ("text", "line")),
    "OpenSpecScenario": (("name", "src_file", "line"), ("given", "when_clause", "then_clause")),
    "OpenSpecChange": (("name", "path"), ("created", "schema", "skip_specs")),
    "OpenSpecTask": (("src_file", "line"), ("text", "checked", "group", "task_num")),
    "OpenSpecDeltaSpec": (("capability", "change_name", "src_file", "delta_type"), ()),
    "Commit": (("hash",), ("author", "message", "date")),
}


def typed_id(label: str, columns: dict[str, F.Column] | None = None) -> F.Column:
    """The id of a node of ``label``: a hash of the label and its key (columns of these names, or those given)."""
    return F.xxhash64(F.lit(label), *((columns or {}).get(k, F.col(k)).cast("string") for k in NODE_KEYS[label][0]))


def typed_nodes(rows: DataFrame, label: str) -> DataFrame:
    """id, label, props of the nodes that ``rows`` describe, one for each key; of other columns the greatest value stays."""
    keys, values = NODE_KEYS[label]
    found = rows.select(*keys, *(c for c in values if c in rows.columns)).groupBy(*keys).agg(*(F.max(c).alias(c) for c in values if c in rows.columns), F.lit(label).alias("label"))
    named = [x for c in (*keys, *values) if c in found.columns for x in (F.lit(c), F.col(c).cast("string"))]
    return found.select(typed_id(label).alias("id"), "label", F.map_filter(F.create_map(*named), lambda _, v: v.isNotNull()).alias("props"))


def typed_edges(rows: DataFrame, rel: str, src: F.Column, dst: F.Column) -> DataFrame:
    """src, rel, dst: one edge for each pair that ``rows`` describe."""
    return rows.select(src.cast("long").alias("src"), F.lit(rel).alias("rel"), dst.cast("long").alias("dst")).filter("src is not null and dst is not null").distinct()


#: Kind of change of a requirement -> relation; others count as a modification.
DELTA_RELATION = {"ADDED": "CHANGE_ADDS_REQUIREMENT", "MODIFIED": "CHANGE_MODIFIES_REQUIREMENT", "REMOVED": "CHANGE_REMOVES_REQUIREMENT", "RENAMED": "CHANGE_MODIFIES_REQUIREMENT"}


def delta_relation(kind: F.Column) -> F.Column:
    found = F.create_map(*(F.lit(x) for pair in DELTA_RELATION.items() for x in pair))
    return F.coalesce(F.try_element_at(found, F.upper(kind)), F.lit("CHANGE_MODIFIES_REQUIREMENT"))


def delta_rows(deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """deltas: capability, change_name, change_path, src_file, delta_type, requirement, text -> nodes and edges.

    The requirement is keyed by the delta's own file; the change gets an edge to it by the delta's type.
    """
    required = deltas.filter("requirement is not null").withColumn("name", F.col("requirement"))
    change = typed_id("OpenSpecChange", {"name": F.col("change_name"), "path": F.col("change_path")})
    edges = required.select(change.alias("src"), delta_relation(F.col("delta_type")).alias("rel"), typed_id("OpenSpecRequirement").alias("dst")).distinct()
    return typed_nodes(deltas, "OpenSpecDeltaSpec").unionByName(typed_nodes(required.select("name", "src_file", "text"), "OpenSpecRequirement")), edges


def cascade_delete(nodes: DataFrame, edges: DataFrame, roots: DataFrame, rel: str = "DEFINES") -> tuple[DataFrame, DataFrame]:
    """Without ``roots`` (id) and all they define, directly or not, and without the edges there."""
    from .traverse import reached

    gone = reached(edges.filter(F.col("rel") == rel), roots)
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), left


def reindexed(nodes: DataFrame, edges: DataFrame, changed: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, rel: str = "DEFINES") -> tuple[DataFrame, DataFrame]:
    """The graph with the files ``changed`` (id) and all they define replaced by what was found in them now."""
    left, kept = cascade_delete(nodes, edges, changed, rel)
    merged = upsert_nodes(left, new_nodes, ["id"])
    return merged, upsert_edges(kept, new_edges, merged)


def backlog(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """What changed between two snapshots: keys, change (added, removed, changed)."""
    values = [c for c in before.columns if c not in keys]
    state = lambda df, name: df.select(*keys, F.struct(*values).alias(name), F.lit(True).alias(f"has_{name}"))
    both = state(before, "old").join(state(after, "new"), keys, "full")
    change = F.when(F.col("has_old").isNull(), "added").when(F.col("has_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select(*keys, change.alias("change")).filter("change is not null")


def _folder(spark: SparkSession, root: str, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def graph_exists(spark: SparkSession, root: str, name: str) -> bool:
    path, files = _folder(spark, root, name)
    return files.exists(path)


def save_graph(nodes: DataFrame, edges: DataFrame, root: str, name: str) -> None:
    """Writes both tables below ``root``; an error if there is such a graph."""
    if graph_exists(nodes.sparkSession, root, name):
        raise ValueError(f"there is a graph {name}")
    for df, what in ((nodes, "nodes"), (edges, "edges")):
        df.write.parquet(f"{root.rstrip('/')}/{name}/{what}")


def load_graph(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{root.rstrip('/')}/{name}/{what}") for what in ("nodes", "edges"))


def clone_graph(spark: SparkSession, root: str, name: str, to: str) -> None:
    save_graph(*load_graph(spark, root, name), root, to)


def delete_graph(spark: SparkSession, root: str, name: str) -> bool:
    path, files = _folder(spark, root, name)
    return files.delete(path, True)


def rename_graph(spark: SparkSession, root: str, name: str, to: str) -> None:
    if graph_exists(spark, root, to):
        raise ValueError(f"there is a graph {to}")
    path, files = _folder(spark, root, name)
    files.rename(path, _folder(spark, root, to)[0])


def put_info(kv: DataFrame, new: DataFrame) -> DataFrame:
    """key, field, value: the newest value of every field of every key."""
    return upsert_nodes(kv, new, ["key", "field"])


def repo_info(kv: DataFrame, repos: DataFrame) -> DataFrame:
    """repos: project, branch -> project, branch, field, value: of the key of project and branch, else of the project's old key."""
    asked = repos.select("project", "branch", info_key(F.col("project"), F.col("branch")).alias("new_key"), info_key(F.col("project")).alias("old_key"))
    now = asked.join(kv, F.col("new_key") == F.col("key")).select("project", "branch", "field", "value")
    without = asked.join(now.select("project", "branch").distinct(), ["project", "branch"], "left_anti")
    return now.unionByName(without.join(kv, F.col("old_key") == F.col("key")).select("project", "branch", "field", "value"))


def migration_plan(names: DataFrame) -> DataFrame:
    """names: name -> name, new_name of graphs with an old name whose new name is free (so a second run has nothing to do)."""
    old = names.filter(~F.col("name").startswith("code:") & ~is_internal(F.col("name")))
    plan = old.select("name", graph_name(F.col("name"), F.lit(None).cast("string")).alias("new_name"))
    return plan.join(names.select(F.col("name").alias("new_name")), "new_name", "left_anti").select("name", "new_name")


def versions(changes: DataFrame) -> DataFrame:
    """changes: path, pos, change (added, modified, deleted) -> path, valid_from, valid_to (null: still)."""
    w = Window.partitionBy("path").orderBy("pos")
    return changes.withColumn("valid_to", F.lead("pos").over(w)).filter("change <> 'deleted'").select("path", F.col("pos").alias("valid_from"), "valid_to")


def at_commit(rows: DataFrame, pos: int) -> DataFrame:
    """What is there at a position of the history."""
    return rows.filter((F.col("valid_from") <= pos) & (F.col("valid_to").isNull() | (F.col("valid_to") > pos)))


def commit_rows(commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """commits: hash, parent, author, message, date -> Commit nodes; PARENT and CHILD edges between known commits."""
    nodes = typed_nodes(commits, "Commit")
    child, parent = typed_id("Commit"), typed_id("Commit", {"hash": F.col("parent")})
    known = commits.select(F.col("hash").alias("parent")).distinct()
    real = commits.filter("parent is not null").join(known, "parent", "left_semi")
    return nodes, typed_edges(real, "PARENT", child, parent).unionByName(typed_edges(real, "CHILD", parent, child))


def history(commits: DataFrame, head: F.Column) -> DataFrame:
    """hash, pos of the first-parent chain that ends at the commits where ``head`` holds; pos 0 is the head, 1 its parent.

    commits: hash, parent.  Pointers are doubled, so a chain of n commits takes log2(n) joins.
    """
    jump = written(commits.select("hash", F.col("parent").alias("to")), "jump")
    chain = commits.filter(head).select("hash", F.lit(0).cast("long").alias("pos"))
    step = 1
    while True:
        more = chain.join(jump, "hash").filter("to is not null").select(F.col("to").alias("hash"), (F.col("pos") + step).alias("pos"))
        more = more.join(commits.select("hash"), "hash", "left_semi")
        longer = written(chain.unionByName(more), "chain")
        if more.isEmpty():
            return longer
        chain, step = longer, 2 * step
        ahead = jump.select(F.col("hash").alias("to"), F.col("to").alias("next"))
        jump = written(jump.join(ahead, "to", "left").select("hash", F.col("next").alias("to")), "jump")


def diff_classes(deltas: DataFrame, extensions: list[str], ignore: list[str] | None = None) -> DataFrame:
    """deltas: commit, path, status (A, D, M, ...) -> commit, change, path of files with one of the extensions.

    Paths that start with one of ``ignore`` and other statuses are left out.
    """
    kind = F.create_map(*(F.lit(x) for pair in (("A", "added"), ("D", "deleted"), ("M", "modified")) for x in pair))
    found = deltas.withColumn("change", F.try_element_at(kind, F.col("status"))).filter(F.col("change").isNotNull() & F.regexp_extract("path", r"(\.[^./]+)$", 1).isin(extensions))
    for prefix in ignore or []:
        found = found.filter(~F.col("path").startswith(prefix))
    return found.select("commit", "change", "path")


def transitions(history_rows: DataFrame, payloads: DataFrame, start: int, end: int) -> DataFrame:
    """history_rows: repo, hash, pos; payloads: hash, payload -> repo, step, payload between two positions; step is the order of the way.

    Going up from ``start`` to ``end`` (child to parent) a commit's payload counts when it is left, going down when it is reached.
    """
    low, high = sorted((start, end))
    inside = history_rows.filter((F.col("pos") >= low) & (F.col("pos") < high)).join(payloads, "hash").filter("payload is not null")
    step = F.col("pos") - low if start < end else high - 1 - F.col("pos")
    return inside.select("repo", step.alias("step"), "payload")


def coverage(files: DataFrame, lines: DataFrame, functions: DataFrame) -> DataFrame:
    """files: file, found, hit; lines: file, line, hits; functions: id, file, start, end.

    Ratio of each function: its lines in the report, hit or not, over its length; a line counts for the
    first function around it by start (then id).  A file that is wholly covered gives 1.0 to all of its
    functions.  As those before have taken all lines up to their greatest end, each function's lines are
    one interval, and their number is a difference of running counts: no range join.
    """
    earlier = Window.partitionBy("file").orderBy("start", "id").rowsBetween(Window.unboundedPreceding, -1)
    own = functions.withColumn("begin", F.greatest(F.col("start"), F.coalesce(F.max("end").over(earlier), F.col("start") - 1) + 1))
    none = F.lit(None).cast(functions.schema["id"].dataType)
    marks = lines.select("file", F.col("line").alias("at"), F.lit(1).alias("kind"), none.alias("id"))
    for at, kind in (("begin", 0), ("end", 2)):
        marks = marks.unionByName(own.select("file", F.col(at).alias("at"), F.lit(kind).alias("kind"), "id"))
    running = Window.partitionBy("file").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = marks.withColumn("c", F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).over(running)).filter("kind <> 1")
    inside = counted.groupBy("id").agg(F.greatest(F.lit(0), F.max(F.when(F.col("kind") == 2, F.col("c"))) - F.max(F.when(F.col("kind") == 0, F.col("c")))).alias("n"))
    share = files.select("file", (F.col("hit") / F.greatest("found", F.lit(1))).alias("file_coverage"))
    out = functions.join(inside, "id").join(share, "file", "left")
    return out.select("id", "file", F.when(F.col("file_coverage") == 1.0, 1.0).otherwise(F.col("n") / F.greatest(F.lit(1), F.col("end") - F.col("start"))).alias("coverage"))
