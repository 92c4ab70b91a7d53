"""Spec trees as a graph: capability, requirement, scenario; change, task, delta.

nodes: id, label, props, src_file; edges: src, rel, dst, src_file, where ``src_file`` is the file that says so.  Ids are
hashes of label and key, so a file that is indexed again gives the same nodes, and what it no longer says goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.store import delta_relation, typed_id, typed_nodes
from ..shared import written
from . import spectree

CHANGE_FILE = r"^(.*?(?:^|/)openspec/changes/([^/]+))/"


def _nodes(rows: DataFrame, label: str) -> DataFrame:
    """Nodes of rows with the columns of the label's key, and the file that each one comes from (the least)."""
    owned = rows.groupBy(typed_id(label).alias("id")).agg(F.min("said_in").alias("src_file"))
    return typed_nodes(rows, label).join(owned, "id").select("id", "label", "props", "src_file")


def _edges(rows: DataFrame, rel: Column | str, src: Column, dst: Column) -> DataFrame:
    return rows.select(src.alias("src"), (F.lit(rel) if isinstance(rel, str) else rel).alias("rel"), dst.alias("dst"), F.col("said_in").alias("src_file")).filter("src is not null and dst is not null").distinct()


def spec_graph(files: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """files: path, text -> nodes and edges.  ``known`` are nodes of files that are not read again: changes may target their capabilities."""
    c = F.col
    specs = spectree.specs(files)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    capabilities = specs.select("path", "name").join(spectree.capabilities(specs), "path", "left").select("name", c("path").alias("src_file"), folder.alias("path"), F.coalesce("purpose", F.lit("")).alias("purpose"), c("path").alias("said_in"))
    home = specs.select("path", c("name").alias("capability"))
    of_capability = typed_id("OpenSpecCapability", {"name": c("capability"), "src_file": c("said_in")})
    required = written(spectree.requirements(specs).join(home, "path").select("name", c("path").alias("src_file"), "text", "line", "capability", c("path").alias("said_in")), "requirements")
    scenarios = spectree.scenarios(specs).select("name", c("path").alias("src_file"), "line", "given", "when_clause", "then_clause", "req_line", c("path").alias("said_in"))
    above = scenarios.join(required.select(c("src_file"), c("line").alias("req_line"), c("name").alias("requirement")), ["src_file", "req_line"])

    inside = files.filter(c("path").rlike(CHANGE_FILE)).select("path", F.regexp_extract("path", CHANGE_FILE, 1).alias("change_path"), F.regexp_extract("path", CHANGE_FILE, 2).alias("change")).filter(c("change") != spectree.ARCHIVE)
    given = spectree.changes(files).select("path", *(k for k in ("created", "schema", "skip_specs")))
    changes = inside.join(given, "path", "left").select(c("change").alias("name"), c("change_path").alias("path"), "created", "schema", "skip_specs", c("path").alias("said_in"))
    of_change = typed_id("OpenSpecChange", {"name": c("change"), "path": c("change_path")})
    tasks = spectree.tasks(spectree.change_tasks(files)).join(inside, "path").select(c("path").alias("src_file"), "line", "text", "checked", "group", c("num").alias("task_num"), "change", "change_path", c("path").alias("said_in"))
    delta_files = spectree.change_specs(files)
    deltas = spectree.deltas(delta_files).join(inside, "path").join(delta_files.select("path", "capability"), "path")
    deltas = written(deltas.select("capability", c("change").alias("change_name"), c("path").alias("src_file"), "delta_type", c("requirement").alias("name"), "text", "line", "change", "change_path", c("path").alias("said_in")), "deltas")

    nodes = _nodes(capabilities, "OpenSpecCapability")
    named = nodes.select("id", F.col("props")["name"].alias("capability"))
    if known is not None:
        named = named.unionByName(known.filter("label = 'OpenSpecCapability'").select("id", F.col("props")["name"].alias("capability"))).distinct()
    for rows, label in ((required.unionByName(deltas.select("name", "src_file", "text", "line", "capability", "said_in")), "OpenSpecRequirement"), (scenarios, "OpenSpecScenario"), (changes, "OpenSpecChange"), (tasks, "OpenSpecTask"), (deltas, "OpenSpecDeltaSpec")):
        nodes = nodes.unionByName(_nodes(rows, label))
    edges = _edges(required, "DEFINES_REQUIREMENT", of_capability, typed_id("OpenSpecRequirement"))
    edges = edges.unionByName(_edges(above, "HAS_SCENARIO", typed_id("OpenSpecRequirement", {"name": c("requirement")}), typed_id("OpenSpecScenario")))
    edges = edges.unionByName(_edges(tasks, "CHANGE_HAS_TASK", of_change, typed_id("OpenSpecTask")))
    edges = edges.unionByName(_edges(deltas.join(named.withColumnRenamed("id", "target"), "capability"), "CHANGE_TARGETS_CAPABILITY", of_change, c("target")))
    return nodes, edges.unionByName(_edges(deltas, delta_relation(c("delta_type")), of_change, typed_id("OpenSpecRequirement")))


def reindexed_specs(nodes: DataFrame, edges: DataFrame, files: DataFrame, gone: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph after ``files`` (path, text) were indexed again and the paths ``gone`` deleted: what these files said before and do not say now is left out."""
    again = files.select("path") if gone is None else files.select("path").unionByName(gone.select("path"))
    again = again.distinct().withColumnRenamed("path", "src_file")
    kept = nodes.join(again, "src_file", "left_anti")
    new_nodes, new_edges = spec_graph(files, kept)
    new_nodes = written(new_nodes, "spec-nodes")
    both = written(new_nodes.unionByName(kept.join(new_nodes.select("id"), "id", "left_anti").select(*new_nodes.columns)), "spec-graph")
    # edges into a capability that was deleted go with it
    there = both.select("id")
    left = edges.join(again, "src_file", "left_anti").select(*new_edges.columns).unionByName(new_edges).distinct()
    return both, left.join(there.withColumnRenamed("id", "src"), "src", "left_semi").join(there.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*new_edges.columns)
