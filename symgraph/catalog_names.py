"""Queries over the catalogue of stored graphs, with names and graphs from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators.catalogue import Catalogue, plan, summary
from .registry import query
from .shared import new_folder
from .sources import testgraph as g

#: Names of customers' graphs and which customers have them: old and new form of graph, information and commits.
_NAMES = (("{n}", "graph", "c_custkey % 7 > 0"), ("code:{n}:_default", "graph", "c_custkey % 4 = 0"), ("code:{n}:main", "graph", "c_custkey % 3 = 0"), ("{{{n}}}_info", "info", "c_custkey % 2 = 0"), ("{{{n}}}:_default_info", "info", "c_custkey % 10 = 0"), ("{{{n}}}_git", "graph", "c_custkey % 3 = 1"), ("{{{n}}}:_default_git", "graph", "c_custkey % 5 = 0"), ("{n}_tmp", "graph", "c_custkey % 11 = 0"))
_SQL = "WITH a AS (" + " UNION ALL ".join(f"SELECT c_custkey AS k, '{name.format(n='@').replace('@', chr(39) + ' || c_name || ' + chr(39))}' AS name, '{kind}' AS kind, {i} AS form FROM customer WHERE {where}" for i, (name, kind, where) in enumerate(_NAMES)) + ")"


def _stored(spark, d) -> Catalogue:
    found = Catalogue(spark, new_folder(spark, "catalogue"))
    customer = g.table(spark, d, "customer").select("c_custkey", "c_name")
    name = lambda form: F.concat(*(F.col("c_name") if p == "@" else F.lit(p) for p in form.format(n="\n@\n").split("\n") if p))
    forms = F.array(*(F.when(F.expr(where), F.struct(name(form).alias("name"), F.lit(kind).alias("kind"), F.concat(F.lit(f"{i}/"), F.col("c_custkey").cast("string")).alias("folder"))) for i, (form, kind, where) in enumerate(_NAMES)))
    rows = customer.select(F.explode(F.array_compact(forms)).alias("r")).select("r.*", F.lit(None).cast("string").alias("target"))
    found.commit(lambda old: old.unionByName(rows))
    return found


@query(_SQL + """, old AS (SELECT k FROM a WHERE form = 0)
SELECT CASE WHEN k IN (SELECT k FROM old) AND form IN (0, 3, 5) AND NOT (form = 3 AND k % 10 = 0) THEN CASE form WHEN 0 THEN 'code:' || name || ':_default' WHEN 3 THEN replace(name, '}_', '}:_default_') ELSE replace(name, '}_', '}:_default_') END ELSE name END AS name, kind, form || '/' || k AS folder
FROM a WHERE NOT (k IN (SELECT k FROM old) AND (form = 0 AND k % 4 = 0 OR form = 5 AND k % 5 = 0))""")
def migration_resumed(spark, d):
    """A migration that is staged, stopped after one part of three and taken up again by another session's catalogue."""
    first = _stored(spark, d)
    first.stage()
    first.move(0, 3)
    second = Catalogue(spark, first.root)
    second.migrate(parts=2)
    return second.rows().select("name", "kind", "folder")


@query(_SQL + """, old AS (SELECT k FROM a WHERE form = 0)
SELECT CASE form WHEN 0 THEN 'graph' WHEN 3 THEN 'info' ELSE 'git' END AS kind, count(*) FILTER (form = 0 AND k % 4 > 0 OR form = 3 OR form = 5 AND k % 5 > 0) AS renamed, count(*) FILTER (form = 0 AND k % 4 = 0 OR form = 5 AND k % 5 = 0) AS dropped
FROM a WHERE k IN (SELECT k FROM old) AND form IN (0, 3, 5) AND NOT (form = 3 AND k % 10 = 0) GROUP BY 1""")
def migration_dry_run(spark, d):
    return summary(plan(_stored(spark, d).rows()))


@query("""SELECT 'main' AS branch, 3 AS version, 'Customer' AS label, count(*) AS n FROM customer WHERE c_nationkey % 2 = 0 UNION ALL SELECT 'main', 3, 'Nation', count(*) FROM nation
UNION ALL SELECT unnest(['feat/x', 'main']), unnest([3, 1]), 'Customer', count(*) FROM customer UNION ALL SELECT unnest(['feat/x', 'main']), unnest([3, 1]), 'Nation', count(*) FROM nation""")
def catalogue_swap(spark, d):
    """A graph with a clone is replaced: the clone and the older version still read what was there."""
    found = Catalogue(spark, new_folder(spark, "catalogue"))
    nodes, edges = g.nodes(spark, d, "Nation", "Customer"), g.edges(spark, d, "DEFINES")
    found.put("code:shop:main", nodes, edges)
    found.clone("code:shop:main", "code:shop:feat/x")
    even = g.table(spark, d, "customer").filter("c_nationkey % 2 = 0").select(g.node_id("Customer", F.col("c_custkey")).alias("id"))
    kept = nodes.filter("label = 'Nation'").unionByName(nodes.filter("label = 'Customer'").join(even, "id", "left_semi"))
    last = found.put("code:shop:main", kept, edges, replace=True)
    counted = lambda branch, version: found.load(f"code:shop:{branch}", version)[0].groupBy("label").count().select(F.lit(branch).alias("branch"), F.lit(version).alias("version"), "label", F.col("count").alias("n"))
    return counted("main", last).unionByName(counted("feat/x", last)).unionByName(counted("main", 1))
