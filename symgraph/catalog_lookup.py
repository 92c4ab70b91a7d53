"""Queries of lookups: prefixes and files, places inside definitions, names in C# files, paths of dependencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog_code import _text
from .functions import text
from .operators import context, pattern
from .operators.intervals import enclosing
from .registry import query
from .shared import new_folder, written
from .sources import code, project
from .sources import testgraph as g

_PREFIXES = [f"0000000{i:02d}" for i in range(98)] + ["Cust", "supp"]


@query("""WITH p AS (SELECT '0000000' || lpad(i::VARCHAR, 2, '0') AS prefix FROM range(98) t(i) UNION ALL SELECT unnest(['cust', 'supp'])), n AS (SELECT 3000000000000 + c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 4000000000000 + s_suppkey, s_name FROM supplier)
SELECT prefix, row_number() OVER (PARTITION BY prefix ORDER BY name, id) AS n, id, name FROM p JOIN n ON starts_with(lower(name), prefix) OR len(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9_]+'), lambda w: starts_with(w, prefix))) > 0
QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY name, id) <= 10""")
def prefix_lookup(spark, d):
    """A hundred prefixes at once."""
    folder = new_folder(spark, "prefixes")
    pattern.prefix_index(g.nodes(spark, d, "Customer", "Supplier").select("id", "name"), folder)
    return pattern.prefix_lookup(spark, folder, _PREFIXES).select("prefix", "n", "id", "name")


CSHARP = """namespace N{s} @
    class Outer{s} : Base @
        void Run() @
            Helper();
        #
        class Inner @
            int Go(Outer{s} o) @
                o.Run();
                return Deep();
            #
            int Deep() @ return 1; #
        #
    #
    class Base @ void Helper() @ # #
#
"""


def _csharp(spark, d):
    s = F.col("s_suppkey")
    return g.table(spark, d, "supplier").select(_text("s{s}.cs", s=s).alias("path"), F.translate(_text(CSHARP, s=s), "@#", "{}").alias("text"))


@query("""SELECT 's' || s_suppkey || '.cs' AS path, unnest([4, 8, 9]) AS at, unnest(['Helper', 'Run', 'Deep']) AS called, 'Outer' || s_suppkey || unnest(['.Run', '.Inner.Go', '.Inner.Go']) AS inside FROM supplier""")
def enclosing_definition(spark, d):
    """The method around each call, by the lines of nested types and methods."""
    rows = written(code.analyzed(_csharp(spark, d)), "rows")
    found = rows.filter(F.col("kind").isin("class", "method")).select("path", F.col("target").alias("id"), F.col("line").alias("start"), "end")
    return enclosing(found, rows.filter("kind = 'call'").select("path", F.col("line").alias("at"), F.col("name").alias("called"))).select("path", F.col("at").cast("int").alias("at"), "called", F.col("id").alias("inside"))


@query("""SELECT unnest(['EXTENDS', 'PARAMETERS', 'CALLS', 'CALLS', 'CALLS']) AS rel, 's' || s_suppkey || '.cs' AS src_path, unnest(['Outer' || s_suppkey, 'Outer' || s_suppkey || '.Inner.Go', 'Outer' || s_suppkey || '.Run', 'Outer' || s_suppkey || '.Inner.Go', 'Outer' || s_suppkey || '.Inner.Go']) AS src,
's' || s_suppkey || '.cs' AS dst_path, unnest(['Base', 'Outer' || s_suppkey, 'Base.Helper', 'Outer' || s_suppkey || '.Run', 'Outer' || s_suppkey || '.Inner.Deep']) AS dst FROM supplier""")
def csharp_links(spark, d):
    files = written(_csharp(spark, d), "files")
    return project.links_of(written(code.analyzed(files), "rows"), files)


@query("SELECT 3000000000000 + c_custkey AS id, c_name AS name FROM customer WHERE c_name = (SELECT min(c_name) FROM customer) AND c_mktsegment = (SELECT arg_min(c_mktsegment, c_name) FROM customer)")
def property_seek(spark, d):
    nodes = g.nodes(spark, d, "Customer")
    first = nodes.agg(F.min(F.struct("name", "path")).alias("m")).select("m.*").first()
    return pattern.seek(nodes, label="Customer", name=first["name"], path=first["path"]).select("id", "name")


@query("""WITH f AS (SELECT c_custkey AS id, '/w/proj/n' || c_nationkey || '/c' || c_custkey || '.py' AS path FROM customer) SELECT unnest(['id', 'path', 'relative']) AS by, id, path FROM f WHERE id = (SELECT min(id) FROM f)""")
def file_handle(spark, d):
    """A file by its id, its path, and its path below the project."""
    files = g.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), _text("/w/proj/n{n}/c{c}.py", n=F.col("c_nationkey"), c=F.col("c_custkey")).alias("path"))
    first = files.orderBy("id").first()
    relative = lambda c: text.relative_path(c, "proj")
    handles = {"id": first.id, "path": first.path, "relative": first.path.removeprefix("/w/proj/")}
    found = [pattern.resolve_file(files, handle, relative).select(F.lit(by).alias("by"), "id", "path") for by, handle in handles.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


_DEP = {0: ("app/s{s}.py", False), 1: ("venv/lib/s{s}.py", True), 2: ("web/node_modules/s{s}.js", True), 3: ("web/my_node_modules/s{s}.js", False), 4: ("build/s{s}.kt", True), 5: ("lib/a.jar/s{s}.java", True), 6: ("venv/s{s}.md", False)}


@query("SELECT CASE s_suppkey % 7 " + " ".join(f"WHEN {k} THEN '{p.split('{s}')[0]}' || s_suppkey || '{p.split('{s}')[1]}'" for k, (p, _) in _DEP.items()) + " END AS path, CASE s_suppkey % 7 " + " ".join(f"WHEN {k} THEN {v}" for k, (_, v) in _DEP.items()) + " END AS dependency FROM supplier")
def dependency_paths(spark, d):
    s, path = F.col("s_suppkey"), None
    for k, (template, _) in _DEP.items():
        made = _text(template, s=s)
        path = F.when(s % 7 == k, made) if path is None else path.when(s % 7 == k, made)
    return g.table(spark, d, "supplier").select(path.alias("path")).select("path", code.is_dependency(F.col("path")).alias("dependency"))


@query("""SELECT s_name AS name, 'src/s' || s_suppkey || '.py' AS path, 0 AS n_methods FROM supplier WHERE s_suppkey % 3 = 0""")
def spec_noise(spark, d):
    """Of three classes a supplier two are in folders that hold no own code or are tests."""
    s = F.col("s_suppkey")
    path = F.when(s % 3 == 0, _text("src/s{s}.py", s=s)).when(s % 3 == 1, _text("x/node_modules/s{s}.py", s=s)).otherwise(_text("src/t{s}.py", s=s))
    name = F.when(s % 3 == 2, F.concat(F.lit("Test"), "s_name")).otherwise(F.col("s_name"))
    classes = g.table(spark, d, "supplier").select(s.alias("id"), name.alias("name"), path.alias("path"), F.lit("doc").alias("doc"))
    members = g.table(spark, d, "nation").select((-F.col("n_nationkey") - 1).alias("owner"))
    return context.candidates(classes, members).select("name", "path", F.col("n_methods").cast("int").alias("n_methods"))


@query("""WITH t AS (SELECT source, sum(length(coalesce(text, '')) // 4) AS plain, sum(length(left(coalesce(text, ''), 200)) // 4) AS kept FROM documents GROUP BY source)
SELECT source, plain::BIGINT AS plain, kept::BIGINT AS kept, CASE WHEN plain > 0 THEN round_even((plain - kept) / plain * 100, 1) ELSE 0 END AS reduction FROM t""")
def token_reduction(spark, d):
    """What excerpts of 200 characters save against whole texts, by source."""
    docs = g.table(spark, d, "documents").select("source", text.token_estimate(F.col("text")).alias("p"), text.token_estimate(F.substring("text", 1, 200)).alias("k"))
    added = docs.groupBy("source").agg(F.sum("p").alias("plain"), F.sum("k").alias("kept"))
    return added.select("source", "plain", "kept", text.reduction(F.col("kept"), F.col("plain")).alias("reduction"))


@query("""WITH s AS (SELECT count(*) AS n, count(*) FILTER (s_suppkey % 2 = 0) AS even FROM supplier)
SELECT unnest(['OpenSpecCapability', 'OpenSpecRequirement', 'OpenSpecScenario', 'OpenSpecChange', 'OpenSpecTask', 'OpenSpecDeltaSpec', 'DEFINES_REQUIREMENT', 'HAS_SCENARIO', 'CHANGE_HAS_TASK', 'CHANGE_TARGETS_CAPABILITY', 'CHANGE_ADDS_REQUIREMENT', 'CHANGE_MODIFIES_REQUIREMENT']) AS what,
unnest([n, 3 * n - even + n, n - even, n, 3 * n - even, 2 * n, 2 * n - even, n - even, 3 * n - even, n, n, n]) AS n FROM s""")
def spec_tree_graph(spark, d):
    """A capability and a change a supplier, indexed twice: for every other one a requirement with its scenario and a task are gone the second time."""
    from .catalog import _spec_tree
    from .sources import specgraph

    files = written(_spec_tree(spark, d), "spec-files")
    nodes, edges = (written(df, "spec-first") for df in specgraph.spec_graph(files))
    even = F.regexp_extract("path", r"/[cd](\d+)/", 1).cast("int") % 2 == 0
    fewer = F.regexp_replace(F.regexp_replace("text", r"(?s)### Requirement: Session.*?(?=### Requirement: Bare)", ""), r"- \[X\] test it\n", "")
    again = files.filter(even & ~F.col("path").contains("/archive/")).withColumn("text", fewer)
    nodes, edges = specgraph.reindexed_specs(nodes, edges, written(again, "spec-again"))
    count = lambda df, column: df.groupBy(F.col(column).alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return count(nodes, "label").unionByName(count(edges, "rel"))
