"""A whole source tree as a graph: files, entities and all edges that static rules give.

Python, Java and C# have static rules (C# has no packages here: a type is looked up in its file, then by its name alone);
uses in JavaScript and Kotlin files stay without edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.traverse import overrides
from ..shared import written
from . import braces as braces  # registers its analysers
from . import code, java

#: Languages whose names are resolved by the rules of :mod:`java`.
NAMED = (".java", ".cs")
#: Kind of an entity -> label; methods of Python files are functions.
LABELS = {"class": "Class", "function": "Function", "method": "Method", "constructor": "Constructor", "interface": "Interface", "enum": "Enum", "struct": "Struct", "object": "Object"}


def nodes_of(rows: DataFrame, files: DataFrame) -> DataFrame:
    """id, label, name, path, full, start, end, doc of the files and of the entities in them."""
    named = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    label = F.when((F.col("kind") == "method") & F.col("path").endswith(".py"), "Function").otherwise(named[F.col("kind")])
    entities = rows.filter(F.col("kind").isin(*LABELS)).select(label.alias("label"), "name", "path", F.col("target").alias("full"), F.col("line").alias("start"), "end", "doc")
    entities = entities.groupBy("label", "name", "path", "full", "start", "end").agg(F.max("doc").alias("doc"))
    own = files.select("path").distinct().select(F.lit("File").alias("label"), F.substring_index("path", "/", -1).alias("name"), "path", F.lit("").alias("full"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("string").alias("doc"))
    both = own.unionByName(entities)
    return both.select(F.xxhash64("label", "name", "path", F.coalesce("start", F.lit(-1)), F.coalesce("end", F.lit(-1))).alias("id"), *both.columns)


def links_of(rows: DataFrame, paths: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """rel, src_path, src, dst_path, dst of all that files link to (IMPORTS have empty names); paths: path of every file.

    ``only`` (path) limits the Python files that are looked at, and leaves Java or C# out unless one of its files is among them.
    """
    python, none = rows.filter(F.col("path").endswith(".py")), F.lit("")
    whole = lambda df: df.select(F.lit("IMPORTS").alias("rel"), F.col("src").alias("src_path"), none.alias("src"), F.col("dst").alias("dst_path"), none.alias("dst"))
    found = whole(code.resolve_imports(python, paths, only)).unionByName(code.resolve_uses(python, only=only))
    there = lambda df, end: not df.filter(F.col("path").endswith(end)).isEmpty()
    for end in NAMED:
        if there(rows if only is None else only, end):
            own = rows.filter(F.col("path").endswith(end))
            found = found.unionByName(java.type_edges(own)).unionByName(java.call_edges(own))
            found = found.unionByName(whole(java.import_edges(own))) if end == ".java" else found
    return found


def assembled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Edges (src, rel, dst) between nodes: DEFINES, the links, and OVERRIDES derived from them."""
    # several entities of one name in a file (overloads, redefinitions) are all ends of a use; the first defines what is in it
    at = lambda path, full, id_: nodes.select(F.col("path").alias(path), F.col("full").alias(full), F.col("id").alias(id_))
    first = nodes.groupBy("path", "full").agg(F.min_by("id", F.struct(F.coalesce("start", F.lit(0)).alias("s"), "id")).alias("src"))
    inner = nodes.filter("full <> ''").select("path", F.regexp_replace(F.when(F.col("full").contains("."), F.col("full")).otherwise(F.lit("")), r"\.[^.]*$", "").alias("full"), F.col("id").alias("dst"))
    defines = inner.join(first, ["path", "full"]).select("src", F.lit("DEFINES").alias("rel"), "dst")
    linked = links.join(at("src_path", "src", "a"), ["src_path", "src"]).join(at("dst_path", "dst", "b"), ["dst_path", "dst"]).select(F.col("a").alias("src"), "rel", F.col("b").alias("dst"))
    edges = written(defines.unionByName(linked).distinct(), "edges")
    functions = nodes.filter("label = 'Function'").select(F.col("id").alias("dst"), "name")
    methods = edges.filter("rel = 'DEFINES'").join(functions, "dst").select(F.col("src").alias("owner"), F.col("dst").alias("method"), "name")
    over = overrides(edges.filter("rel = 'EXTENDS'").select("src", "dst"), methods).select(F.col("method").alias("src"), F.lit("OVERRIDES").alias("rel"), F.col("overridden").alias("dst"))
    return edges.unionByName(over)


def indexed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files: path, text -> nodes; edges (src, rel, dst): DEFINES, IMPORTS, OVERRIDES and the uses."""
    rows = written(code.analyzed(files), "rows")
    nodes = written(nodes_of(rows, files), "nodes")
    return nodes, assembled(nodes, links_of(rows, files))
