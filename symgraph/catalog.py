"""The graph queries and their SQL, as the driver registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalog_code, catalog_history as catalog_history, catalog_lookup as catalog_lookup, catalog_names as catalog_names, catalog_security as catalog_security, catalog_stream as catalog_stream
from .functions import text
from .operators import pattern, security, store, traverse
from .plans import fixtures
from .registry import oracle_sql, queries, query, register
from .shared import new_folder, written
from .sources import code, spectree
from .sources import testgraph as g

PART = 5 * g.STEP
__all__ = ["oracle_sql", "queries"]
_WITH, _WITH_RECURSIVE, _WEB = f"WITH {g.SQL}", f"WITH RECURSIVE {g.SQL}", f"WITH {fixtures.WEB_SQL}"
RELS = ("CALLS", "DEFINES", "CONTAINS", "SUPPLIED_BY", "EXTENDS")


@query(f"{_WITH} SELECT 'nodes' AS what, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges")
def graph_stats(spark, d):
    count = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return count(g.nodes(spark, d), "nodes").unionByName(count(g.edges(spark, d, *RELS), "edges"))


@query(f"{_WITH} SELECT label, count(*) AS n FROM nodes GROUP BY label")
def label_counts(spark, d):
    return g.nodes(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_WITH} SELECT rel, count(*) AS n FROM edges GROUP BY rel")
def rel_counts(spark, d):
    return g.edges(spark, d, *RELS).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_WITH} SELECT id, label, name, path FROM nodes WHERE label IN ('Part', 'Supplier', 'Customer')
AND (starts_with(lower(name), 'cust') OR len(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9_]+'), lambda w: starts_with(w, 'cust'))) > 0) ORDER BY name, id LIMIT 10""")
def prefix_search(spark, d):
    return pattern.prefix_search(g.nodes(spark, d, "Part", "Supplier", "Customer"), "Cust")


@query(f"""{_WITH}, t AS (SELECT name AS x, path AS f FROM nodes WHERE id = {PART + 7})
SELECT id, label, name, path, contains(path, f) AS in_file FROM nodes, t WHERE label = 'Part' AND name = x ORDER BY contains(path, f) DESC, path, name, id LIMIT 20""")
def find_symbol(spark, d):
    nodes = g.nodes(spark, d, "Part")
    asked = nodes.filter(F.col("id") == PART + 7).select(F.concat(F.lit("module."), "name").alias("name"), F.col("path").alias("file"))
    return pattern.find_symbols(nodes, asked).drop("asked", "n")


def _hop(near: str, far: str, direction: str) -> str:
    return f"SELECT e.{near} AS origin, rel, '{direction}' AS direction, id, label, name, path FROM edges e JOIN nodes ON id = e.{far} WHERE e.{near} BETWEEN {PART} AND {PART + 9} AND rel = 'CALLS'"


def _expand(spark, d, direction):
    return pattern.expand(g.edges(spark, d, "CALLS"), g.nodes(spark, d, "Part"), [PART + i for i in range(10)], ["CALLS"], direction)


@query(f"{_WITH} {_hop('src', 'dst', 'OUT')}")
def neighbors_out(spark, d):
    return _expand(spark, d, "OUT")


@query(f"{_WITH} {_hop('dst', 'src', 'IN')}")
def neighbors_in(spark, d):
    return _expand(spark, d, "IN")


@query(f"{_WITH} SELECT DISTINCT id, label, name, path, rel, direction FROM ({_hop('src', 'dst', 'OUT')} UNION ALL {_hop('dst', 'src', 'IN')}) ORDER BY id, rel, direction LIMIT 50")
def neighbors_both(spark, d):
    return pattern.neighbors(g.edges(spark, d, "CALLS"), g.nodes(spark, d, "Part"), [PART + i for i in range(10)], ["CALLS"], limit=50)


@query(f"""{_WITH} SELECT rel, id, label, name, path, CASE rel WHEN 'CALLS' THEN 0 ELSE 1 END AS rank
FROM (SELECT DISTINCT rel, dst FROM edges WHERE src = {PART + 3} AND rel IN ('CALLS', 'SUPPLIED_BY')) JOIN nodes ON id = dst ORDER BY rank, id LIMIT 50""")
def dependencies_ranked(spark, d):
    return pattern.dependencies(g.edges(spark, d, "CALLS", "SUPPLIED_BY"), g.nodes(spark, d, "Part", "Supplier"), [PART + 3], ["CALLS", "SUPPLIED_BY"])


@query(f"{_WITH} SELECT src AS origin, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM calls JOIN nodes ON id = dst GROUP BY src")
def callees_collect(spark, d):
    return pattern.collect_neighbors(g.edges(spark, d, "CALLS"), g.nodes(spark, d, "Part"), "CALLS").drop("found")


@query(f"{_WITH} SELECT dst AS origin, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM calls JOIN nodes ON id = src GROUP BY dst")
def callers_collect(spark, d):
    return pattern.collect_neighbors(g.edges(spark, d, "CALLS"), g.nodes(spark, d, "Part"), "CALLS", "IN").drop("found")


@query(f"{_WITH} SELECT id, name, CASE WHEN dst IS NULL THEN NULL ELSE 'CALLS' END AS rel, dst FROM nodes LEFT JOIN calls ON id = src WHERE label = 'Part'")
def subgraph_optional(spark, d):
    return pattern.optional_match(g.nodes(spark, d, "Part"), g.edges(spark, d, "CALLS"))


@query(f"{_WITH} SELECT id, label, name, path FROM nodes WHERE label = 'Part' AND id NOT IN (SELECT dst FROM calls)")
def unreachable(spark, d):
    return pattern.unreachable(g.nodes(spark, d, "Part"), g.edges(spark, d, "CALLS"), "Part", "CALLS")


def _impact_sql(near: str, far: str, depth: int) -> str:
    return f"""{_WITH_RECURSIVE}, r AS (SELECT {far} AS id, 1 AS depth FROM calls WHERE {near} = {PART} UNION SELECT c.{far}, depth + 1 FROM r JOIN calls c ON c.{near} = r.id WHERE depth < {depth})
SELECT id, min(depth) AS depth FROM r GROUP BY id"""


@query(_impact_sql("src", "dst", 3))
def impact_out(spark, d):
    return traverse.impact(g.edge_table(spark, d, "CALLS"), [PART], "OUT", 3)


@query(_impact_sql("dst", "src", 3))
def impact_in(spark, d):
    return traverse.impact(g.edge_table(spark, d, "CALLS"), [PART], "IN", 3)


@query(_impact_sql("src", "dst", 6))
def impact_deep(spark, d):
    return traverse.impact(g.edge_table(spark, d, "CALLS"), [PART], "OUT", 6)


@query(f"""{_WITH_RECURSIVE}, p AS (SELECT dst, [src, dst] AS nodes, [src || '>' || dst] AS used FROM calls WHERE src = {PART} UNION ALL
SELECT c.dst, list_append(nodes, c.dst), list_append(used, c.src || '>' || c.dst) FROM p JOIN calls c ON c.src = p.dst WHERE len(used) < 4 AND NOT list_contains(used, c.src || '>' || c.dst))
SELECT dst, len(nodes) - 1 AS length, array_to_string(nodes, '>') AS path FROM p""")
def call_paths(spark, d):
    return traverse.call_paths(g.edge_table(spark, d, "CALLS"), PART, max_len=4).select("dst", "length", F.array_join(F.transform("nodes", lambda n: n.cast("string")), ">").alias("path"))


@query(f"""{_WITH_RECURSIVE}, r AS (SELECT {PART} AS src, {PART} AS id, 0 AS hops UNION SELECT r.src, c.dst, hops + 1 FROM r JOIN calls c ON c.src = r.id WHERE hops < 5)
SELECT src, id AS dst, min(hops) AS hops FROM r WHERE hops > 0 AND id <> src GROUP BY ALL""")
def shortest_path(spark, d):
    start = spark.createDataFrame([(PART,)], "id long")
    return traverse.shortest_paths(g.edge_table(spark, d, "CALLS"), start, g.nodes(spark, d, "Part"), 5).drop("nodes")


@query("""WITH m AS (SELECT DISTINCT 2000000000000 + c_nationkey AS owner, n_regionkey, c_mktsegment AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT owner || '.' || name AS method, (1000000000000 + n_regionkey) || '.' || name AS overridden, 1 AS depth FROM m""")
def overrides(spark, d):
    read = lambda t: g.table(spark, d, t)
    own = read("customer").select(g.node_id("Nation", "c_nationkey").alias("owner"), F.col("c_mktsegment").alias("name")).distinct()
    base = own.join(g.edges(spark, d, "EXTENDS"), F.col("owner") == F.col("src")).select(F.col("dst").alias("owner"), "name").distinct()
    methods = own.unionByName(base).withColumn("method", F.concat_ws(".", "owner", "name"))
    return traverse.overrides(g.edges(spark, d, "EXTENDS"), methods)


@query(f"""{_WITH_RECURSIVE}, r AS (SELECT id AS root, id, 0 AS depth FROM nodes WHERE label = 'Region' UNION ALL SELECT root, dst, depth + 1 FROM r JOIN defines ON src = r.id)
SELECT root, depth, count(*) AS n FROM r GROUP BY ALL""")
def define_closure(spark, d):
    return traverse.closure(g.edge_table(spark, d, "DEFINES"), g.nodes(spark, d, "Region")).groupBy("root", "depth").agg(F.count(F.lit(1)).alias("n"))


_ACROSS = "across AS (SELECT src, dst, a.path AS sp, b.path AS dp FROM calls JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE a.path <> b.path)"


@query(f"""{_WITH}, {_ACROSS}, b AS (SELECT sp AS file, dp AS neighbour, 'CALLS:OUT' AS how FROM across UNION ALL SELECT dp, sp, 'CALLS:IN' FROM across),
c AS (SELECT file, neighbour, how, count(*) AS c FROM b GROUP BY ALL)
SELECT file, neighbour, sum(c)::BIGINT AS n, string_agg(how || '=' || c, ',' ORDER BY how) AS relations, count(*) OVER (PARTITION BY file) AS total, count(*) OVER (PARTITION BY file) > 3 AS truncated
FROM c GROUP BY file, neighbour QUALIFY row_number() OVER (PARTITION BY file ORDER BY n DESC, neighbour) <= 3""")
def file_coupling(spark, d):
    return pattern.file_coupling(g.edges(spark, d, "CALLS"), g.nodes(spark, d, "Part"), limit=3)


@query(f"""{_WITH}, {_ACROSS}, c AS (SELECT path, count(dst) AS in_degree FROM (SELECT DISTINCT path FROM nodes WHERE label = 'Part') LEFT JOIN across ON dp = path GROUP BY path)
SELECT path, in_degree, round_even((ln(1 + in_degree) - min(ln(1 + in_degree)) OVER ()) / (max(ln(1 + in_degree)) OVER () - min(ln(1 + in_degree)) OVER ()), 4) AS centrality FROM c""")
def centrality(spark, d):
    return pattern.centrality(g.edges(spark, d, "CALLS"), g.nodes(spark, d, "Part"))


@query(f"{_WITH} SELECT path, arg_min(name, name || lpad(id::VARCHAR, 20, '0')) AS name, min(id) FILTER (id = r) AS id FROM (SELECT *, first_value(id) OVER (PARTITION BY path ORDER BY name, id) AS r FROM nodes WHERE label = 'Part') GROUP BY path")
def representative_symbol(spark, d):
    return pattern.representative(g.nodes(spark, d, "Part"))


@query("SELECT 2000000000000 + n_nationkey AS id, n_name AS name, count(c_custkey) AS n_methods FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL HAVING count(c_custkey) >= 3")
def spec_candidates(spark, d):
    members = g.table(spark, d, "customer").select(g.node_id("Nation", "c_nationkey").alias("owner"))
    return pattern.members_per_class(g.nodes(spark, d, "Nation").select("id", "name"), members, 3)


@query(f"""{_WITH} SELECT rank, id, name FROM (SELECT 1 AS rank, id, name FROM nodes WHERE label = 'Nation' AND name = 'ASIA' UNION ALL
SELECT 2, id, name FROM nodes WHERE label = 'Region' AND name = 'ASIA' UNION ALL SELECT 3, id, name FROM nodes WHERE label = 'Nation' AND contains(name, 'IA')) ORDER BY rank, id LIMIT 1""")
def resolve_cascade(spark, d):
    nations, regions = g.nodes(spark, d, "Nation"), g.nodes(spark, d, "Region")
    branches = (nations.filter("name = 'ASIA'"), regions.filter("name = 'ASIA'"), nations.filter(F.col("name").contains("IA")))
    ranked = [b.select(F.lit(i).alias("rank"), "id", "name") for i, b in enumerate(branches, 1)]
    return ranked[0].unionByName(ranked[1]).unionByName(ranked[2]).orderBy("rank", "id").limit(1)


QUERY_WORDS = ["the", "der", "idiot", "the", "erthat"]
#: The sub-tokens of an identifier x: a break before the last capital of a run stands for the look-ahead that SQL's patterns lack.
_SUB = r"list_append(list_transform(flatten(list_transform(string_split(x, '_'), lambda p: regexp_extract_all(regexp_replace(p, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '[A-Z]?[a-z0-9]+|[A-Z]+'))), lambda t: lower(t)), lower(x))"
TOKENS_SQL = f"flatten(list_transform(regexp_extract_all(TEXT, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: {_SUB}))"
_TOKENS = f"toks AS (SELECT doc_id AS id, source, {TOKENS_SQL.replace('TEXT', 'text')} AS t FROM documents)"


@query(f"WITH {_TOKENS} SELECT w AS token, count(*) AS tf, count(DISTINCT id) AS df FROM (SELECT id, unnest(t) AS w FROM toks) GROUP BY w")
def doc_tokens(spark, d):
    per_doc = text.token_counts(g.table(spark, d, "documents"), "doc_id")
    return per_doc.groupBy("token").agg(F.sum("c").alias("tf"), F.count(F.lit(1)).alias("df"))


_BM25 = f"""{_TOKENS}, q AS (SELECT DISTINCT unnest({QUERY_WORDS}) AS w), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
tf AS (SELECT id, w, len([x for x in t if x = w]) AS tf, len(t) AS dl FROM toks, q), df AS (SELECT w, count(*) AS df FROM tf WHERE tf > 0 GROUP BY w),
bm AS (SELECT id, sum(coalesce(ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)), 0)) AS score FROM tf LEFT JOIN df USING (w), st GROUP BY id)"""


@query(f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 20")
def bm25_topk(spark, d):
    return text.bm25_texts(g.table(spark, d, "documents"), QUERY_WORDS, "doc_id").orderBy(F.desc("score"), "id").limit(20).select("id", F.round("score", 6).alias("score"))


_IDENTIFIER = "'_x' || p_partkey || 'HTTPServer' || replace(p_brand, '#', '_') || 'yZ'"


@query(f"SELECT p_partkey AS id, array_to_string({TOKENS_SQL.replace('TEXT', _IDENTIFIER)}, ',') AS parts FROM part")
def sub_tokens(spark, d):
    name = F.concat(F.lit("_x"), F.col("p_partkey"), F.lit("HTTPServer"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("yZ"))
    return g.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.filter(text.sub_tokens(name), lambda t: t != ""), ",").alias("parts"))


@query("SELECT page_id, lower(tag) AS tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages) GROUP BY ALL")
def html_elements(spark, d):
    return code.html_tags(g.table(spark, d, "pages"))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def page_links(spark, d):
    return g.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


def _web(rule, **options):
    return lambda spark, d: rule(*fixtures.web_tables(spark, d), **options)


register("xss", _web(security.xss), f"""{_WEB} SELECT v.name AS "UnsafeVariable", h.name AS "TargetElement", v.path AS "SourceFile", v.line AS "SourceLine" FROM e JOIN n v ON v.id = e.src AND v.label = 'Variable'
JOIN n h ON h.id = e.dst AND h.label = 'HtmlElement' WHERE e.rel = 'INJECTED_INTO' AND v.id NOT IN (SELECT src FROM e WHERE rel = 'PROCESSED_BY')""")
_DRIFT = f"""{_WEB}, guarded AS (SELECT src FROM e JOIN n ON n.id = dst WHERE rel = 'HAS_DECORATOR' AND name = 'login_required'),
f AS (SELECT * FROM n WHERE label = 'Function' AND id NOT IN (SELECT src FROM guarded)), g AS (SELECT route FROM n WHERE label = 'Function' AND id IN (SELECT src FROM guarded))
SELECT s.name AS "DocumentedSection", r.path AS "UnsecuredRoute", r.name AS "Method", coalesce(f.name, 'no handler found') AS "HandlerFunction", f.id AS "HandlerSymbolId"
FROM e JOIN n s ON s.id = e.src JOIN n r ON r.id = e.dst LEFT JOIN f ON f.route = r.path WHERE e.rel = 'DEFINES_ROUTE'"""
register("auth_drift", _web(security.auth_drift), _DRIFT)
register("auth_drift_strict", _web(security.auth_drift, strict=True), f"{_DRIFT} AND r.path NOT IN (SELECT route FROM g)")
for _name, _need, _kind in (("path_traversal", True, "JOIN"), ("path_traversal_all", False, "LEFT JOIN")):
    register(_name, _web(security.path_traversal, need_caller=_need), f"""{_WEB} SELECT o.name AS "Operation", o.path AS "SourceFile", o.line AS "SourceLine", coalesce(f.name, 'unknown') AS "CallerFunction", f.id AS "CallerSymbolId"
FROM n o {_kind} e ON e.dst = o.id AND e.rel = 'HAS_FS_OP' {_kind} n f ON f.id = e.src WHERE o.label = 'FileSystemOp' AND o.tainted = 'true'""")
register("cve", _web(security.cve, package=fixtures.PACKAGE), f"""{_WEB} SELECT f.name AS "CallerFunction", f.path AS "CallerFile", x.name AS "VulnerableFunction", x.module AS "Module", f.id AS "CallerSymbolId"
FROM e c JOIN n f ON f.id = c.src AND f.label = 'Function' JOIN n x ON x.id = c.dst AND x.label = 'ExternalFunction' JOIN e b ON b.src = x.id AND b.rel = 'BELONGS_TO' JOIN n p ON p.id = b.dst WHERE c.rel = 'CALLS' AND p.name = '{fixtures.PACKAGE}'""")
register("template_vars", _web(security.template_vars), f"""{_WEB} SELECT v.name AS variable, v.path AS var_src_file, v.line AS var_src_line, h.name AS element, h.path AS element_file, h.line AS element_line, f.id IS NOT NULL AS sanitized, f.name AS sanitizer
FROM e JOIN n v ON v.id = e.src JOIN n h ON h.id = e.dst AND h.label = 'HtmlElement' LEFT JOIN e s ON s.src = v.id AND s.rel = 'PROCESSED_BY' LEFT JOIN n f ON f.id = s.dst WHERE e.rel = 'INJECTED_INTO'""")
register("fs_ops", _web(security.fs_ops, tainted_only=False), f"""{_WEB} SELECT o.name AS op, o.tainted = 'true' AS tainted, o.path AS src_file, o.line AS src_line, f.name AS caller, f.id AS caller_symbol_id
FROM n o LEFT JOIN e ON e.dst = o.id AND e.rel = 'HAS_FS_OP' LEFT JOIN n f ON f.id = e.src WHERE o.label = 'FileSystemOp'""")
register("decorators", _web(security.decorators, function_id=fixtures.FUNCTION), f"{_WEB} SELECT name, path AS src_file, line AS src_line FROM e JOIN n ON id = dst WHERE src = {fixtures.FUNCTION} AND rel = 'HAS_DECORATOR'")
register("mark_vulnerability", lambda spark, d: security.mark_vulnerability(*fixtures.web_tables(spark, d), fixtures.PACKAGE).select("id", F.col("props")["status"].alias("status"), F.col("props")["module"].alias("module")),
          f"{_WEB} SELECT id, CASE WHEN id IN (SELECT src FROM e JOIN n p ON p.id = dst WHERE rel = 'BELONGS_TO' AND p.name = '{fixtures.PACKAGE}') THEN 'vulnerable' ELSE status END AS status, module FROM n")


@query("""SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN p_name || '!' ELSE p_name END AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS path FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0
UNION ALL SELECT p_partkey, p_name || '!', CASE WHEN p_partkey % 2 = 0 THEN p_brand END FROM part WHERE p_partkey % 3 = 0""")
def upsert_nodes(spark, d):
    part = g.table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("path"))
    new = part.filter("key % 3 = 0").select("key", F.concat("name", F.lit("!")).alias("name"), F.lit(None).cast("string").alias("path"))
    return store.upsert_nodes(part.filter("key % 2 = 0"), new, ["key"])


@query(f"""{_WITH_RECURSIVE}, r AS (SELECT id FROM nodes WHERE label = 'Region' AND name = 'ASIA' UNION SELECT dst FROM r JOIN defines ON src = r.id)
SELECT label, count(*) AS n FROM nodes WHERE label IN ('Region', 'Nation', 'Customer', 'Order') AND id NOT IN (SELECT id FROM r) GROUP BY label""")
def cascade_delete(spark, d):
    nodes = g.nodes(spark, d, "Region", "Nation", "Customer", "Order")
    left, _ = store.cascade_delete(nodes, g.edges(spark, d, "DEFINES"), nodes.filter("label = 'Region' and name = 'ASIA'"))
    return left.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey AS key, CASE WHEN p_partkey % 5 = 0 THEN 'removed' WHEN p_partkey % 7 = 0 THEN 'added' ELSE 'changed' END AS change FROM part
WHERE (p_partkey % 5 = 0 AND p_partkey % 7 <> 0) OR (p_partkey % 7 = 0 AND p_partkey % 5 <> 0) OR (p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 = 0)""")
def backlog_diff(spark, d):
    part = g.table(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_name")
    after = part.filter("key % 5 <> 0").withColumn("p_name", F.when(F.col("key") % 11 == 0, F.lit("new")).otherwise(F.col("p_name")))
    return store.backlog(part.filter("key % 7 <> 0"), after, ["key"])


@query("""WITH v AS (SELECT 'p' || o_custkey % 50 AS path, o_orderkey AS valid_from, lead(o_orderkey) OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS valid_to, o_orderstatus AS s FROM orders),
a AS (SELECT unnest([max(o_orderkey) // 2, max(o_orderkey)]) AS pos FROM orders) SELECT path, valid_from, pos FROM v, a WHERE s <> 'O' AND valid_from <= pos AND (valid_to IS NULL OR valid_to > pos)""")
def switch_commit(spark, d):
    """Fifty files that every order adds, modifies or deletes; what is there half way and at the end."""
    kind = F.when(F.col("o_orderstatus") == "F", "added").when(F.col("o_orderstatus") == "O", "deleted").otherwise("modified")
    changes = g.table(spark, d, "orders").select(F.concat(F.lit("p"), F.col("o_custkey") % 50).alias("path"), F.col("o_orderkey").alias("pos"), kind.alias("change"))
    rows, last = store.versions(changes), changes.agg(F.max("pos")).first()[0]
    at = lambda pos: store.at_commit(rows, pos).select("path", "valid_from", F.lit(pos).cast("long").alias("pos"))
    return at(last // 2).unionByName(at(last))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, max((l_returnflag = 'R' OR l_linestatus = 'F')::INT) AS h FROM lineitem GROUP BY ALL),
o AS (SELECT l_orderkey, count(*) AS found, sum(h) AS hit, count(*) FILTER (l_linenumber <= 4) AS n FROM l GROUP BY l_orderkey)
SELECT o_orderkey AS id, 'src/o' || o_orderkey || '.py' AS file, CASE WHEN hit = found THEN 1.0 ELSE coalesce(n, 0) / 3 END::DOUBLE AS coverage FROM orders LEFT JOIN o ON l_orderkey = o_orderkey""")
def lcov_coverage(spark, d):
    """Reports of two tests for each order, written as text files and read back record by record; a fully covered file gives 1.0 to its function."""
    lines = g.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(F.array(F.struct(F.lit("a").alias("t"), (F.col("l_returnflag") == "R").alias("h")), F.struct(F.lit("b").alias("t"), (F.col("l_linestatus") == "F").alias("h")))).alias("x"))
    hit = lines.groupBy("l_orderkey", "x.t", "l_linenumber").agg(F.max(F.col("x.h").cast("int")).alias("h"))
    records = hit.groupBy("l_orderkey", "t").agg(F.array_join(F.collect_list(F.concat(F.lit("DA:"), "l_linenumber", F.lit(","), "h")), "\n").alias("da"), F.count(F.lit(1)).alias("lf"), F.sum("h").alias("lh"))
    report = F.concat(F.lit("TN:"), "t", F.lit("\nSF:src/o"), "l_orderkey", F.lit(".py\n"), "da", F.lit("\nLF:"), "lf", F.lit("\nLH:"), "lh", F.lit("\nend_of_record"))
    folder = new_folder(spark, "lcov")
    records.select(report.alias("value")).write.text(folder)
    found, counted = code.lcov_merged(code.lcov(code.lcov_reports(spark, folder)))
    orders = g.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("src/o"), "o_orderkey", F.lit(".py")).alias("file"), F.lit(1).alias("start"), F.lit(4).alias("end"))
    return store.coverage(found, counted, orders)


@query("""WITH l AS (SELECT l_orderkey, l_linenumber FROM lineitem), o AS (SELECT o_orderkey, count(l_linenumber) FILTER (l_linenumber BETWEEN 1 AND 4) AS n FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT o_orderkey AS id, o_orderkey::VARCHAR AS file, n / 3 AS coverage FROM o""")
def order_coverage(spark, d):
    rows = g.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("file"), F.col("l_linenumber").alias("line"))
    orders = g.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("file"))
    return store.coverage(orders.select("file", F.lit(4).alias("found"), F.lit(1).alias("hit")), rows, orders.select("id", "file", F.lit(1).alias("start"), F.lit(4).alias("end")))


def _chain(spark, d):
    """A module a part, whose function calls that of the next part's module; its class extends that one's class."""
    p, q = F.col("p_partkey").cast("string"), (F.col("p_partkey") + 1).cast("string")
    body = F.concat(F.lit("from pkg.m"), q, F.lit(" import f"), q, F.lit(", K"), q, F.lit("\n\ndef f"), p, F.lit("():\n    return f"), q, F.lit("()\n\nclass K"), p, F.lit("(K"), q, F.lit("):\n    pass\n"))
    return g.table(spark, d, "part").select(F.concat(F.lit("pkg/m"), p, F.lit(".py")).alias("path"), body.alias("text"))


_NEXT = "FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"


@query(f"SELECT 'pkg/m' || a.p_partkey || '.py' AS src, 'pkg/m' || b.p_partkey || '.py' AS dst {_NEXT}")
def import_resolution(spark, d):
    files = written(_chain(spark, d), "files")
    return code.resolve_imports(written(code.python_rows(files), "rows"), files)


@query(f"""SELECT unnest(['CALLS', 'EXTENDS']) AS rel, 'pkg/m' || a.p_partkey || '.py' AS src_path, unnest(['f', 'K']) || a.p_partkey AS src, 'pkg/m' || b.p_partkey || '.py' AS dst_path, unnest(['f', 'K']) || b.p_partkey AS dst {_NEXT}""")
def python_calls_static(spark, d):
    return code.resolve_uses(written(code.python_rows(_chain(spark, d)), "rows"))


def _lines(*columns):
    return F.concat(*(x for c in columns for x in (F.lit(c) if isinstance(c, str) else c.cast("string"),)))


@query("""SELECT 's' || s_suppkey || '.md' AS path, unnest([2, 5, 8]) AS line, unnest([2, 3, 2]) AS level, unnest([s_name, 'Post /s' || s_suppkey || ' list', 'Last']) AS title, unnest([NULL, 'POST', NULL]) AS method,
unnest([NULL, '/s' || s_suppkey, NULL]) AS route, unnest([2, 1, 0]) AS n_requirements FROM supplier""")
def markdown_sections(spark, d):
    text_ = _lines("# Title\n## ", F.col("s_name"), "\n- first\n* second\n### Post /s", F.col("s_suppkey"), " list\n- must page\ntext\n## Last\n")
    return code.markdown_sections(g.table(spark, d, "supplier").select(_lines("s", F.col("s_suppkey"), ".md").alias("path"), text_.alias("text")))


def _spec_tree(spark, d):
    """A capability and a change a supplier."""
    s = F.col("s_suppkey")
    spec = _lines("## Purpose\nFor ", s, ".\n## Requirements\n### Requirement: Session ", s, "\nIt keeps\n", s, " sessions.\n#### Scenario: Known\n- **GIVEN** a user\n- **WHEN** they enter ", s, "\n- **AND** wait\n- **THEN** they are in\n### Requirement: Bare\n")
    tasks = _lines("- [ ] loose ", s, "\n## Build\n- [x] 1.", s, " Write it\n- [X] test it\n")
    delta = _lines("## ADDED Requirements\n### Requirement: New ", s, "\nMust be new.\n## RENAMED Requirements\n- FROM: `### Requirement: Old`\n- TO: `### Requirement: Newer ", s, "`\n")
    files = [(_lines("p/openspec/specs/c", s, "/spec.md"), spec), (_lines("p/openspec/changes/d", s, "/tasks.md"), tasks), (_lines("p/openspec/changes/d", s, "/specs/c", s, "/spec.md"), delta), (_lines("p/openspec/changes/archive/specs/c", s, "/spec.md"), delta)]
    return g.table(spark, d, "supplier").select(F.explode(F.array(*(F.struct(p.alias("path"), t.alias("text")) for p, t in files))).alias("f")).select("f.*")


_SPEC, _CHANGE = "'p/openspec/specs/c' || s_suppkey || '/spec.md' AS path", "'p/openspec/changes/d' || s_suppkey || "


@query(f"SELECT {_SPEC}, unnest([4, 12]) AS line, unnest(['Session ' || s_suppkey, 'Bare']) AS name, unnest(['It keeps ' || s_suppkey || ' sessions.', '']) AS text FROM supplier")
def spec_requirements(spark, d):
    return spectree.requirements(spectree.specs(_spec_tree(spark, d)))


@query(f"SELECT {_SPEC}, 4 AS req_line, 7 AS line, 'Known' AS name, 'a user' AS given, 'they enter ' || s_suppkey || ' | wait' AS when_clause, 'they are in' AS then_clause FROM supplier")
def spec_scenarios(spark, d):
    return spectree.scenarios(spectree.specs(_spec_tree(spark, d)))


@query(f"""SELECT {_CHANGE}'/tasks.md' AS path, unnest([1, 3, 4]) AS line, unnest(['', 'Build', 'Build']) AS "group", unnest(['', '1.' || s_suppkey, '']) AS num, unnest(['loose ' || s_suppkey, 'Write it', 'test it']) AS text, unnest([false, true, true]) AS checked FROM supplier""")
def spec_tasks(spark, d):
    return spectree.tasks(spectree.change_tasks(_spec_tree(spark, d)))


@query(f"""SELECT {_CHANGE}'/specs/c' || s_suppkey || '/spec.md' AS path, unnest([2, 6]) AS line, unnest(['ADDED', 'RENAMED']) AS delta_type, unnest(['CHANGE_ADDS_REQUIREMENT', 'CHANGE_MODIFIES_REQUIREMENT']) AS rel,
unnest(['New ' || s_suppkey, 'Newer ' || s_suppkey]) AS requirement, unnest(['Must be new.', '(renamed from: Old)']) AS text FROM supplier""")
def spec_deltas(spark, d):
    return spectree.deltas(spectree.change_specs(_spec_tree(spark, d)))


@query("""SELECT unnest([n_name, 'code:' || n_name || ':main', 'code:' || n_name || ':feat/x:y']) AS name, n_name AS project, unnest(['_default', 'main', 'feat/x:y']) AS branch FROM nation""")
def list_repos(spark, d):
    """Of five graphs a nation two are helpers of others."""
    named = lambda branch: F.concat(F.lit("code:"), "n_name", F.lit(":" + branch))
    names = g.table(spark, d, "nation").select(F.explode(F.array("n_name", *map(named, ("main", "feat/x:y", "main_git", "main_schema")))).alias("name"))
    return names.filter(~text.is_internal(F.col("name"))).select("name", text.graph_key(F.col("name")).alias("k")).select("name", "k.project", "k.branch")


register("hybrid_rank", catalog_code.hybrid_rank, catalog_code._search_sql())
register("index_search", catalog_code.index_search, " UNION ALL ".join(f"SELECT {i}::INTEGER AS query, * FROM ({catalog_code._search_sql(*asked)})" for i, asked in enumerate(catalog_code._BATCH)))
