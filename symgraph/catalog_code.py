"""Queries over source code, pages, commits and specifications that are made from the driver's tables.

Each one writes text (Python, HTML, Markdown, LCOV ...) with columns of a table, reads it back with the
operators, and has SQL that gives the expected rows from the table itself.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import text
from .operators import context, index, pattern, search, store, timeline, traverse
from .registry import query
from .shared import new_folder, written
from .sources import code, java, project, spectree
from .sources import testgraph as g
from .streaming import files as streaming


def _text(template: str, **columns) -> F.Column:
    """``template`` with {name} replaced by columns."""
    parts = []
    for i, piece in enumerate(template.split("{")):
        name, _, rest = piece.partition("}") if i else ("", "", piece)
        parts += [columns[name].cast("string")] if i else []
        parts += [F.lit(rest)]
    return F.concat(*parts)


def _rows(files):
    """What was found in the files, as a table: the joins of a resolution read it many times."""
    return written(code.analyzed(files), "rows")


# --- Python -----------------------------------------------------------------------------------------


def _python(spark, d):
    """A package a nation with a module ``util`` of its own, a module a customer, and the module ``base``."""
    key = {"n": F.col("c_nationkey"), "c": F.col("c_custkey"), "k": F.col("c_custkey") % 3, "t": F.when(F.col("c_custkey") % 2 == 0, "request.args['f']").otherwise("'fixed'")}
    body = '''from .util import help{k} as h
from ..base import Top, Other
import base

LIMIT = 1

class C{c}(Top):
    """Customer {c}"""
    @login_required
    def run(self, x: base.Other) -> Top:
        clean_text(x)
        f = open({t})
        return h()
'''
    customers = g.table(spark, d, "customer").select(_text("n{n}/c{c}.py", **key).alias("path"), _text(body, **key).alias("text"))
    util = "".join(f"def help{i}():\n    return {i}\n" for i in range(3))
    nations = g.table(spark, d, "nation").select(F.explode(F.array(F.struct(_text("n{n}/util.py", n=F.col("n_nationkey")).alias("path"), F.lit(util).alias("text")), F.struct(_text("n{n}/__init__.py", n=F.col("n_nationkey")).alias("path"), F.lit("").alias("text")))).alias("f")).select("f.*")
    base = spark.range(1).select(F.lit("base.py").alias("path"), F.lit("class Top:\n    def go(self):\n        return 1\nclass Other:\n    pass\n").alias("text"))
    return customers.unionByName(nations).unionByName(base)


_FILE = "'n' || c_nationkey || '/c' || c_custkey || '.py'"


@query(f"SELECT {_FILE} AS src, 'n' || c_nationkey || '/util.py' AS dst FROM customer UNION ALL SELECT {_FILE}, 'base.py' FROM customer")
def relative_imports(spark, d):
    files = _python(spark, d)
    return code.resolve_imports(_rows(files), files)


@query(f"""SELECT 'CALLS' AS rel, {_FILE} AS src_path, 'C' || c_custkey || '.run' AS src, 'n' || c_nationkey || '/util.py' AS dst_path, 'help' || c_custkey % 3 AS dst FROM customer
UNION ALL SELECT unnest(['EXTENDS', 'RETURNS', 'PARAMETERS']), {_FILE}, unnest(['C' || c_custkey, 'C' || c_custkey || '.run', 'C' || c_custkey || '.run']), 'base.py', unnest(['Top', 'Top', 'Other']) FROM customer""")
def python_uses(spark, d):
    return code.resolve_uses(_rows(_python(spark, d)))


@query(f"""SELECT {_FILE} AS path, unnest(['decorator', 'sanitizer_call', 'fs_op']) AS kind, unnest(['login_required', 'clean_text', 'open']) AS name, 'C' || c_custkey || '.run' AS owner,
unnest([NULL, NULL, CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END]) AS target FROM customer""")
def python_security(spark, d):
    return code.python_rows(_python(spark, d)).filter("kind in ('decorator', 'sanitizer_call', 'fs_op')").select("path", "kind", "name", "owner", "target")


@query(f"""SELECT {_FILE} AS path, unnest(['C' || c_custkey, 'C' || c_custkey || '.run', 'LIMIT']) AS entity, unnest(['class', 'method', 'variable']) AS kind,
unnest(['\"\"\"Customer ' || c_custkey || '\"\"\"', 'clean_text(x)', NULL]) AS doc FROM customer""")
def python_entities(spark, d):
    rows = code.python_rows(_python(spark, d)).filter("kind in ('class', 'method', 'variable') and path like '%/c%'")
    return rows.select("path", F.col("target").alias("entity"), "kind", "doc")


# --- Java -------------------------------------------------------------------------------------------


def _java(spark, d):
    """A package a nation with a base class, a helper and a class a customer that uses both, and a package ``lib``."""
    key = {"n": F.col("c_nationkey"), "c": F.col("c_custkey")}
    body = """package p{n};
import lib.Runner;
import lib.tools.*;
import static lib.Strings.trim;

/** Customer {c} */
public class C{c} extends Base implements Runner @
    private Helper help;
    public Helper run(Tool tool) @
        Helper other = help.make();
        tool.use(); trim(); base(); super.base(); other.make();
        return other;
    #
#
"""
    file = lambda path, text_: F.struct(path.alias("path"), F.translate(text_, "@#", "{}").alias("text"))
    customers = g.table(spark, d, "customer").select(file(_text("p{n}/C{c}.java", **key), _text(body, **key)).alias("f")).select("f.*")
    n = {"n": F.col("n_nationkey")}
    base = file(_text("p{n}/Base.java", **n), _text("package p{n};\nclass Base @ void base() @ # #\n", **n))
    helper = file(_text("p{n}/Helper.java", **n), _text("package p{n};\nclass Helper @ Helper make() @ return this; # #\n", **n))
    nations = g.table(spark, d, "nation").select(F.explode(F.array(base, helper)).alias("f")).select("f.*")
    lib = [("lib/Runner.java", "package lib;\npublic interface Runner { }\n"), ("lib/Strings.java", "package lib;\npublic class Strings { static String trim() { return null; } static String other() { return trim(); } }\n"), ("lib/tools/Tool.java", "package lib.tools;\npublic class Tool extends Root { }\nclass Root { void use() { } }\n")]
    return customers.unionByName(nations).unionByName(spark.createDataFrame(lib, "path string, text string"))


_CLASS, _HERE = "'p' || c_nationkey || '/C' || c_custkey || '.java'", "'p' || c_nationkey || '/"


@query(f"""SELECT unnest(['EXTENDS', 'IMPLEMENTS', 'PARAMETERS', 'RETURNS']) AS rel, {_CLASS} AS src_path, 'C' || c_custkey || unnest(['', '', '.run', '.run']) AS src,
unnest([{_HERE}Base.java', 'lib/Runner.java', 'lib/tools/Tool.java', {_HERE}Helper.java']) AS dst_path, unnest(['Base', 'Runner', 'Tool', 'Helper']) AS dst FROM customer
UNION ALL SELECT 'RETURNS', 'p' || n_nationkey || '/Helper.java', 'Helper.make', 'p' || n_nationkey || '/Helper.java', 'Helper' FROM nation UNION ALL SELECT 'EXTENDS', 'lib/tools/Tool.java', 'Tool', 'lib/tools/Tool.java', 'Root'""")
def java_types(spark, d):
    return java.type_edges(_rows(_java(spark, d)))


@query(f"""SELECT 'CALLS' AS rel, {_CLASS} AS src_path, 'C' || c_custkey || '.run' AS src, unnest([{_HERE}Helper.java', {_HERE}Base.java', 'lib/Strings.java', 'lib/tools/Tool.java']) AS dst_path,
unnest(['Helper.make', 'Base.base', 'Strings.trim', 'Root.use']) AS dst FROM customer UNION ALL SELECT 'CALLS', 'lib/Strings.java', 'Strings.other', 'lib/Strings.java', 'Strings.trim'""")
def java_calls(spark, d):
    return java.call_edges(_rows(_java(spark, d)))


@query(f"SELECT {_CLASS} AS src, unnest(['lib/Runner.java', 'lib/tools/Tool.java', 'lib/Strings.java']) AS dst FROM customer")
def java_imports(spark, d):
    return java.import_edges(_rows(_java(spark, d)))


@query("""WITH c AS (SELECT count(*) AS c FROM customer), n AS (SELECT count(*) AS n FROM nation)
SELECT 'File' AS what, 2 * c + 4 * n + 4 AS n FROM c, n UNION ALL SELECT 'Class', 2 * c + 2 * n + 2 + 3 FROM c, n UNION ALL SELECT 'Interface', 1 UNION ALL SELECT 'Function', c + 3 * n + 1 FROM c, n
UNION ALL SELECT 'Method', c + 2 * n + 3 FROM c, n UNION ALL SELECT 'DEFINES', 4 * c + 7 * n + 10 FROM c, n UNION ALL SELECT 'IMPORTS', 5 * c FROM c UNION ALL SELECT 'CALLS', 5 * c + 1 FROM c
UNION ALL SELECT 'EXTENDS', 2 * c + 1 FROM c UNION ALL SELECT 'IMPLEMENTS', c FROM c UNION ALL SELECT 'PARAMETERS', 2 * c FROM c UNION ALL SELECT 'RETURNS', 2 * c + n FROM c, n UNION ALL SELECT 'OVERRIDES', c FROM c""")
def project_index(spark, d):
    python = _python(spark, d).withColumn("text", F.replace("text", F.lit("def run("), F.lit("def go(")))
    nodes, edges = project.indexed(python.unionByName(_java(spark, d)))
    count = lambda df, column: df.groupBy(F.col(column).alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return count(nodes, "label").unionByName(count(edges, "rel"))


@query("SELECT 'c' || s_suppkey AS name, '2024-01-' || s_suppkey % 28 AS created, 'v' || s_suppkey % 3 AS schema, CASE WHEN s_suppkey % 2 = 0 THEN 'true' END AS skip_specs FROM supplier")
def spec_metadata(spark, d):
    s = F.col("s_suppkey")
    body = F.concat(F.lit("created: 2024-01-"), (s % 28).cast("string"), F.lit("\nno pair\nschema: \"v"), (s % 3).cast("string"), F.lit('"\n'), F.when(s % 2 == 0, "skip_specs: true\n").otherwise(""))
    files = g.table(spark, d, "supplier").select(_text("p/openspec/changes/c{s}/.openspec.yaml", s=s).alias("path"), body.alias("text"))
    return spectree.changes(files).select("name", "created", "schema", "skip_specs")


# --- Search -----------------------------------------------------------------------------------------

_SEARCH = "The `doc_7` idiot in src3 and SRC5_x of d11"
_SEARCH_PATH = "'/srv/proj/' || CASE WHEN doc_id % 10 = 3 THEN 'tests/' ELSE 'lib/' END || source || '/d' || doc_id % 40 || '.py'"


def _searched(spark, d):
    docs = g.table(spark, d, "documents")
    folder = F.when(F.col("doc_id") % 10 == 3, "tests/").otherwise("lib/")
    path = F.concat(F.lit("/srv/proj/"), folder, "source", F.lit("/d"), (F.col("doc_id") % 40).cast("string"), F.lit(".py"))
    name = F.concat(F.lit("Doc_"), (F.col("doc_id") % 13).cast("string"))
    symbols = docs.select(F.col("doc_id").alias("id"), path.alias("path"), name.alias("name"), F.col("text").alias("doc"), F.col("doc_id").cast("int").alias("start"), (F.col("doc_id") + 1).cast("int").alias("end"))
    files = symbols.groupBy("path").agg(F.min("id").alias("id"))
    places = symbols.select("id", "path")
    src = g.table(spark, d, "documents").select(F.col("doc_id").alias("s"), (F.col("doc_id") - F.col("doc_id") % 7).alias("e"))
    edges = src.join(places.select(F.col("id").alias("s"), F.col("path").alias("src_path")), "s").join(places.select(F.col("id").alias("e"), F.col("path").alias("dst_path")), "e").select("src_path", "dst_path")
    return files, symbols, edges


def _search_sql(asked: str = _SEARCH, names: str = "'doc_7', 'src5_x'") -> str:
    from .catalog import TOKENS_SQL

    tokens = lambda x: TOKENS_SQL.replace("TEXT", x)
    return f"""WITH sym AS (SELECT doc_id AS id, replace({_SEARCH_PATH}, '/srv/proj/', '') AS file, 'Doc_' || doc_id % 13 AS name, coalesce({tokens("text")}, []) AS t FROM documents),
capped AS (SELECT *, coalesce(sum(len(t)) OVER (PARTITION BY file ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sym),
q AS (SELECT list_distinct({tokens("'" + asked.replace("'", "''") + "'")}) AS w),
body AS (SELECT file, unnest(list_concat({tokens("name")}, t[1:greatest(0, 4000 - before)::BIGINT])) AS w FROM capped UNION ALL SELECT file, unnest({tokens("replace(file, '/', ' ')")}) FROM (SELECT DISTINCT file FROM sym)),
dl AS (SELECT file, count(*) AS dl FROM body GROUP BY file), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT file, b.w, count(*) AS tf FROM body b JOIN (SELECT unnest(w) AS w FROM q) z ON z.w = b.w GROUP BY ALL), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
bm AS (SELECT file, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS body FROM tf JOIN df USING (w) JOIN dl USING (file), st GROUP BY file),
deg AS (SELECT b.file, count(*) AS c FROM sym a JOIN sym b ON b.id = a.id - a.id % 7 WHERE a.file <> b.file GROUP BY b.file),
hits AS (SELECT file, count(*) FILTER (lower(name) IN ({names})) AS name_hits, min(id) AS file_id FROM sym GROUP BY file),
rep AS (SELECT file, name, id AS src_start, id + 1 AS src_end FROM sym QUALIFY row_number() OVER (PARTITION BY file ORDER BY lower(name) IN ({names}) DESC, id) = 1),
r AS (SELECT file, file_id, name_hits, len(list_intersect(list_distinct({tokens("replace(file, '/', ' ')")}), w)) AS ph, coalesce(body, 0) AS body, ln(1 + coalesce(c, 0)) AS cen FROM hits LEFT JOIN bm USING (file) LEFT JOIN deg USING (file), q),
b AS (SELECT min(name_hits) FILTER (name_hits > 0) AS nl, max(name_hits) AS nh, min(ph) AS pl, max(ph) AS ph2, min(body) AS bl, max(body) AS bh, min(cen) AS cl, max(cen) AS ch FROM r)
SELECT file, file_id, round_even(2.0 * CASE WHEN name_hits > 0 AND nh > nl THEN (name_hits - nl) / (nh - nl) ELSE 0 END + 1.5 * CASE WHEN ph2 > pl THEN (ph - pl) / (ph2 - pl) ELSE 0 END
  + 1.5 * (body - bl) / (bh - bl) + 0.5 * (cen - cl) / (ch - cl) - CASE WHEN starts_with(file, 'tests/') THEN 1 ELSE 0 END, 4) AS score, name, src_start::INTEGER AS src_start, src_end::INTEGER AS src_end
FROM r JOIN rep USING (file), b WHERE name_hits > 0 OR ph > 0 OR body > 0 ORDER BY score DESC, file LIMIT 10"""


#: Queries of a batch, and the identifiers that each one mentions.
_BATCH = [(_SEARCH, "'doc_7', 'src5_x'"), ("what does `doc_3` say of src2", "'doc_3'"), ("Doc_11 and Doc_4 and words", "'doc_11', 'doc_4'"), ("nothing zzzz", "''")]


@query("")
def index_search(spark, d):
    folder = new_folder(spark, "index")
    files, symbols, edges = (written(df, "searched") for df in _searched(spark, d))
    index.build(folder, files, symbols, edges, (symbols.count(), edges.count(), "c1"), "proj")
    return index.search(spark, folder, [q for q, _ in _BATCH])


@query("")
def hybrid_rank(spark, d):
    return search.hybrid_rank(*_searched(spark, d), _SEARCH, "proj")


@query("""WITH l AS (SELECT page_id, string_split(replace(html, '<p>', chr(10) || '<p>'), chr(10)) AS t FROM pages),
w AS (SELECT page_id, unnest(range(page_id % 3 + 1, least(page_id % 3 + 7, len(t)) + 1)) AS i, t FROM l), x AS (SELECT page_id, i, t[i] AS s FROM w),
y AS (SELECT *, max((trim(s) <> '' AND NOT starts_with(ltrim(s), '@'))::INT) OVER (PARTITION BY page_id ORDER BY i) AS begun FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k FROM y WHERE begun = 1)
SELECT page_id AS id, string_agg(left(s, 200), chr(10) ORDER BY i) AS snippet FROM z WHERE k <= 4 GROUP BY page_id""")
def page_snippets(spark, d):
    pages = g.table(spark, d, "pages")
    lines = pages.select(F.col("page_id").alias("path"), F.posexplode(F.split(F.replace("html", F.lit("<p>"), F.lit("\n<p>")), "\n")).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line"), "text")
    symbols = pages.select(F.col("page_id").alias("id"), F.col("page_id").alias("path"), (F.col("page_id") % 3 + 1).alias("start"), (F.col("page_id") % 3 + 7).alias("end"))
    return search.snippets(symbols, lines)


@query("SELECT c_mktsegment AS path, min(c_custkey) AS id, min(c_custkey % 1000) AS start FROM (SELECT * FROM customer WHERE c_custkey % 1000 > 3 QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey % 1000, c_custkey) = 1) GROUP BY 1")
def first_symbols(spark, d):
    symbols = g.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("path"), F.when(F.col("c_custkey") % 1000 > 3, F.col("c_custkey") % 1000).alias("start"), F.col("c_custkey").alias("end"))
    return pattern.first_symbol(symbols).drop("end")


@query("SELECT s_suppkey AS id, s_name AS name, 'Function' AS label, 'a/proj/b.py' AS file, s_suppkey % 9 AS line FROM supplier WHERE s_suppkey % 2 = 0")
def node_summaries(spark, d):
    labels = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("Searchable"), F.lit("Function"), F.lit("x"))).otherwise(F.array(F.lit("Searchable")))
    nodes = g.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), labels.alias("labels"), F.col("s_name").alias("name"), F.lit("/root/proj/a/proj/b.py").alias("path"), (F.col("s_suppkey") % 9).alias("start"))
    return pattern.summary(pattern.any_label(nodes, "Function", "Class"), lambda p: text.relative_path(p, "proj"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'Function' ELSE '' END AS labels, s_name AS name FROM supplier")
def node_encoding(spark, d):
    labels = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("Searchable"), F.lit("Function"))).otherwise(F.array(F.lit("Searchable")))
    nodes = g.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), labels.alias("labels"), F.col("s_name").alias("name"))
    return pattern.encoded(nodes).select("id", F.array_join("labels", ",").alias("labels"), "properties.name")


@query("SELECT p_partkey AS id, p_brand AS path FROM part WHERE p_name = (SELECT p_name FROM part WHERE p_partkey = 3) AND p_brand = (SELECT p_brand FROM part WHERE p_partkey = 3) AND p_type = (SELECT p_type FROM part WHERE p_partkey = 3)")
def composite_seek(spark, d):
    part = g.table(spark, d, "part")
    key = part.filter("p_partkey = 3").select("p_name", "p_brand", "p_type")
    return part.join(F.broadcast(key), ["p_name", "p_brand", "p_type"]).select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("path"))  # one row


# --- Graph state ------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT l_orderkey AS src, l_partkey AS dst, l_linenumber >= 3 AS new, l_quantity::INT AS q, l_returnflag AS f FROM lineitem),
k AS (SELECT src, dst, bool_or(new) AS new FROM e GROUP BY ALL)
SELECT src, dst, lpad((max(q) FILTER (e.new = k.new))::VARCHAR, 4, '0') AS quantity, max(f) FILTER (NOT e.new) AS flag FROM e JOIN k USING (src, dst) GROUP BY src, dst""")
def upsert_edge_props(spark, d):
    rows = g.table(spark, d, "lineitem")
    quantity = F.lpad(F.col("l_quantity").cast("int").cast("string"), 4, "0")
    edges = lambda part, props: part.select(F.col("l_orderkey").alias("src"), F.lit("CONTAINS").alias("rel"), F.col("l_partkey").alias("dst"), props.alias("props"))
    old = edges(rows.filter("l_linenumber < 3"), F.create_map(F.lit("quantity"), quantity, F.lit("flag"), F.col("l_returnflag")))
    new = edges(rows.filter("l_linenumber >= 3"), F.create_map(F.lit("quantity"), quantity))
    found = store.upsert_edges(old, new)
    return found.select("src", "dst", F.try_element_at("props", F.lit("quantity")).alias("quantity"), F.try_element_at("props", F.lit("flag")).alias("flag"))


@query("SELECT DISTINCT l_orderkey AS src, -l_partkey AS dst, l_linenumber AS pos FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE p_size < 25")
def upsert_edge_positions(spark, d):
    """Large parts are no nodes, so their edges are dropped, as are those of orders that are not there."""
    order, part = lambda key: g.node_id("Order", key), lambda key: g.node_id("Part", key)
    edges = g.table(spark, d, "lineitem").select(order("l_orderkey").alias("src"), F.lit("CALLS").alias("rel"), part("l_partkey").alias("dst"), F.col("l_linenumber").alias("pos"))
    ids = g.table(spark, d, "part").filter("p_size < 25").select(part("p_partkey").alias("id")).unionByName(g.table(spark, d, "orders").select(order("o_orderkey").alias("id")))
    found = store.upsert_edges(edges.limit(0), edges, ids, ("src", "rel", "dst", "pos"))
    return found.select((F.col("src") - order(F.lit(0))).alias("src"), (part(F.lit(0)) - F.col("dst")).alias("dst"), "pos")


@query("SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE p_brand END AS brand, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS kind FROM part")
def set_properties(spark, d):
    part = g.table(spark, d, "part")
    nodes = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.create_map(F.lit("brand"), F.col("p_brand")).alias("props"))
    updates = part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.create_map(F.lit("brand"), F.lit("new"), F.lit("kind"), F.col("p_type")).alias("props"))
    return store.set_props(nodes, updates).select("id", "name", F.try_element_at("props", F.lit("brand")).alias("brand"), F.try_element_at("props", F.lit("kind")).alias("kind"))


@query("""SELECT 'node' AS what, o_orderpriority AS name, o_custkey % 10 AS line, count(DISTINCT o_custkey % 10) AS n FROM orders GROUP BY ALL
UNION ALL SELECT 'edge', o_orderpriority, o_custkey % 10, count(DISTINCT o_custkey) FROM orders GROUP BY ALL""")
def typed_decorators(spark, d):
    rows = g.table(spark, d, "orders").select(F.col("o_orderpriority").alias("name"), F.lit("a.py").alias("path"), (F.col("o_custkey") % 10).alias("line"), F.col("o_custkey").alias("function"))
    nodes, edges = store.typed_nodes(rows, "Decorator"), store.typed_edges(rows, "HAS_DECORATOR", F.col("function"), store.typed_id("Decorator"))
    named = nodes.select(F.col("id").alias("dst"), F.col("props")["name"].alias("name"), F.col("props")["line"].cast("long").alias("line"))
    count = lambda df, what: df.groupBy("name", "line").agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "name", "line", "n")
    return count(named, "node").unionByName(count(edges.join(named, "dst"), "edge"))


@query("""WITH c AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS pos FROM orders)
SELECT o_orderkey::VARCHAR AS hash, pos FROM c""")
def commit_history(spark, d):
    """Each customer's orders are a chain of commits; the last one is its head."""
    commits = _commits(spark, d)
    return store.history(commits, F.col("is_head"))


def _commits(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return g.table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("hash"), F.lag("o_orderkey").over(w).cast("string").alias("parent"), F.lead("o_orderkey").over(w).isNull().alias("is_head"),
        F.col("o_custkey").cast("string").alias("author"), F.col("o_orderpriority").alias("message"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
    )


@query("""WITH p AS (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent FROM orders)
SELECT 'Commit' AS what, count(*) AS n FROM p UNION ALL SELECT 'PARENT', count(parent) FROM p UNION ALL SELECT 'CHILD', count(parent) FROM p""")
def commit_graph(spark, d):
    nodes, edges = store.commit_rows(_commits(spark, d))
    return nodes.groupBy(F.col("label").alias("what")).agg(F.count(F.lit(1)).alias("n")).unionByName(edges.groupBy(F.col("rel").alias("what")).agg(F.count(F.lit(1)).alias("n")))


@query("""WITH h AS (SELECT o_custkey::VARCHAR AS repo, o_orderpriority AS payload, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS pos FROM orders)
SELECT repo, 'up' AS way, pos AS step, payload FROM h WHERE pos < 3 UNION ALL SELECT repo, 'down', 2 - pos, payload FROM h WHERE pos < 3""")
def commit_transitions(spark, d):
    """Three commits back from every head, and up again."""
    commits = _commits(spark, d)
    chain = written(store.history(commits, F.col("is_head")).join(commits.select("hash", F.col("author").alias("repo")), "hash"), "chain")
    payloads = commits.select("hash", F.col("message").alias("payload"))
    way = lambda name, a, b: store.transitions(chain, payloads, a, b).select("repo", F.lit(name).alias("way"), "step", "payload")
    return way("up", 0, 3).unionByName(way("down", 3, 0))


@query("""SELECT o_custkey AS "commit", CASE o_orderstatus WHEN 'F' THEN 'added' WHEN 'O' THEN 'deleted' END AS change, 'src/o' || o_orderkey || '.py' AS path FROM orders
WHERE o_orderstatus IN ('F', 'O') AND o_orderkey % 3 <> 0 AND NOT starts_with('src/o' || o_orderkey || '.py', 'src/o1')""")
def diff_classes(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "D").otherwise("R")
    path = F.concat(F.lit("src/o"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, ".txt").otherwise(".py"))
    deltas = g.table(spark, d, "orders").select(F.col("o_custkey").alias("commit"), path.alias("path"), status.alias("status"))
    return store.diff_classes(deltas, [".py"], ["src/o1"])


@query("""SELECT p_partkey AS key, CASE WHEN p_partkey % 11 = 0 THEN 'new' ELSE p_name END AS p_name FROM part WHERE p_partkey % 5 <> 0""")
def backlog_replay(spark, d):
    """The log of what changed between two states, carried out on the first one, gives the second."""
    part = g.table(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_name")
    before, after = part.filter("key % 7 <> 0"), part.filter("key % 5 <> 0").withColumn("p_name", F.when(F.col("key") % 11 == 0, F.lit("new")).otherwise(F.col("p_name")))
    return timeline.applied(before, timeline.log_between(before, after, ["key"]), ["key"])


@query("""SELECT n_name AS project, 'main' AS branch, 'url' AS field, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE 'old' END || n_nationkey AS value FROM nation WHERE n_nationkey % 3 < 2""")
def repo_information(spark, d):
    nation = g.table(spark, d, "nation")
    key = lambda branch: text.info_key(F.col("n_name"), branch)
    row = lambda where, k, word: nation.filter(where).select(k.alias("key"), F.lit("url").alias("field"), F.concat(F.lit(word), F.col("n_nationkey").cast("string")).alias("value"))
    kv = store.put_info(row("n_nationkey % 3 < 2", key(None), "old"), row("n_nationkey % 3 = 0", key(F.lit("main")), "new"))
    return store.repo_info(kv, nation.select(F.col("n_name").alias("project"), F.lit("main").alias("branch")))


@query("SELECT n_name AS name, 'code:' || n_name || ':_default' AS new_name FROM nation WHERE n_nationkey % 4 <> 0")
def migration_plan(spark, d):
    nation = g.table(spark, d, "nation").select("n_name", "n_nationkey")
    old = nation.select(F.col("n_name").alias("name"))
    done = nation.filter("n_nationkey % 4 = 0").select(text.graph_name(F.col("n_name"), F.lit("")).alias("name"))
    return store.migration_plan(old.unionByName(done).unionByName(old.select(F.concat("name", F.lit("_git")).alias("name"))))


@query("""WITH RECURSIVE r AS (SELECT 2000000000000 + n_nationkey AS id FROM nation WHERE n_nationkey = 3 UNION SELECT id FROM (SELECT 3000000000000 + c_custkey AS id FROM customer WHERE c_nationkey = 3) )
SELECT 'nodes' AS what, (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer WHERE c_nationkey <> 3) + (SELECT count(*) FROM customer WHERE c_nationkey = 3 AND c_custkey % 2 = 0) AS n
UNION ALL SELECT 'edges', (SELECT count(*) FROM customer WHERE c_nationkey <> 3) + (SELECT count(*) FROM customer WHERE c_nationkey = 3 AND c_custkey % 2 = 0)""")
def reindex(spark, d):
    nodes, edges = g.nodes(spark, d, "Nation", "Customer").select("id", "name"), g.edges(spark, d, "DEFINES").filter("src between 2000000000000 and 2999999999999")
    changed = nodes.filter("id = 2000000000003")
    kept = edges.filter("src = 2000000000003 and dst % 2 = 0")
    again = changed.unionByName(nodes.join(kept.select(F.col("dst").alias("id")), "id", "left_semi"))
    new_nodes, new_edges = store.reindexed(nodes, edges, changed, again, kept)
    count = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return count(new_nodes, "nodes").unionByName(count(new_edges, "edges"))


@query("""WITH f AS (SELECT o_orderkey * 3 + k AS id, o_orderkey, [1, 2, 4][k + 1] AS s, [5, 3, 6][k + 1] AS e FROM orders, (SELECT unnest([0, 1, 2]) AS k)),
l AS (SELECT l_orderkey, l_linenumber, row_number() OVER () AS rn FROM lineitem),
o AS (SELECT rn, arg_min(id, s * 1000000000::BIGINT + id) AS id FROM l JOIN f ON l_orderkey = o_orderkey AND l_linenumber BETWEEN s AND e GROUP BY rn)
SELECT f.id, o_orderkey::VARCHAR AS file, count(o.rn) / greatest(1, e - s) AS coverage FROM f LEFT JOIN o ON o.id = f.id GROUP BY f.id, o_orderkey, e, s""")
def nested_coverage(spark, d):
    rows = g.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("file"), F.col("l_linenumber").alias("line"))
    orders = g.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderkey").cast("string").alias("file"))
    spans = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("start"), F.lit(e).alias("end")) for k, s, e in ((0, 1, 5), (1, 2, 3), (2, 4, 6))))).alias("f")
    functions = orders.select("key", "file", spans).select((F.col("key") * 3 + F.col("f.k")).alias("id"), "file", "f.start", "f.end")
    return store.coverage(orders.select("file", F.lit(4).alias("found"), F.lit(1).alias("hit")), rows, functions)


@query("""SELECT o_orderkey::VARCHAR AS file, 't' || o_orderkey AS test, count(*) AS lines, sum((l_returnflag = 'R')::INT)::BIGINT AS hit, sum(l_quantity::INT)::BIGINT AS calls FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def lcov_records(spark, d):
    line = lambda tag, *columns: F.concat(F.lit(f"{tag}:"), F.concat_ws(",", *(c.cast("string") for c in columns)))
    hit = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    rows = F.array_join(F.collect_list(F.concat_ws("\n", line("DA", F.col("l_linenumber"), hit), line("FNDA", F.col("l_quantity").cast("int"), F.concat(F.lit("f"), F.col("l_partkey").cast("string"))))), "\n")
    reports = g.table(spark, d, "lineitem").groupBy("l_orderkey").agg(rows.alias("rows"), F.count(F.lit(1)).alias("n"), F.sum(hit).alias("h"))
    reports = reports.join(g.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    text_ = F.concat_ws("\n", line("TN", F.concat(F.lit("t"), F.col("l_orderkey").cast("string"))), line("SF", F.col("l_orderkey")), F.col("rows"), line("LF", F.col("n")), line("LH", F.col("h")))
    total = lambda column, field: F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + x[field])
    return code.lcov(reports.select(text_.alias("report"))).select("file", "test", F.size("lines").cast("long").alias("lines"), total("lines", "hits").alias("hit"), total("calls", "hits").alias("calls"))


# --- Pages, templates, Markdown, specifications ------------------------------------------------------


@query("""SELECT page_id AS path, tag AS name, CASE WHEN tag = 'form' THEN 'HtmlForm' ELSE 'HtmlElement' END AS label, count(*) AS n
FROM (SELECT page_id, lower(unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages) GROUP BY ALL""")
def html_structure(spark, d):
    pages = g.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text"))
    return code.html_rows(pages).groupBy(F.col("path").cast("long").alias("path"), "name", "label").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'v' || p_partkey % 50 AS name, 'v' || p_partkey || '.py' AS var_path, e AS element, 's' || s_suppkey || '.html' AS element_path, l AS start
FROM part JOIN (SELECT s_suppkey, unnest(['div#s' || s_suppkey, 'p', 'form']) AS e, unnest([1, 2, 3]) AS l FROM supplier) ON p_partkey % 50 = s_suppkey % 50""")
def template_flow(spark, d):
    source, s_, v_ = g.table(spark, d, "supplier"), F.col("s_suppkey").cast("string"), (F.col("s_suppkey") % 50).cast("string")
    made = F.concat(F.lit('<div id="s'), s_, F.lit('" title="x">\n<p>Hello {{ v'), v_, F.lit(' }}</p>\n<form action="/{{v'), v_, F.lit('}}"><br/>{{ not this }}</form></div>'))
    elements = code.html_rows(source.select(_text("s{s}.html", s=F.col("s_suppkey")).alias("path"), made.alias("text")))
    variables = g.table(spark, d, "part").select(_text("v{p}.py", p=F.col("p_partkey")).alias("path"), _text("v{v}", v=F.col("p_partkey") % 50).alias("name"))
    return code.template_links(variables, elements)


@query("""SELECT 'p' || p_partkey || '.md' AS path, unnest([2, 4]) AS line, unnest([2, 3]) AS level, unnest([p_name, 'Get /p' || p_partkey]) AS title, unnest([NULL, 'GET']) AS method, unnest([NULL, '/p' || p_partkey]) AS route, unnest([1, 2]) AS n_requirements FROM part""")
def markdown_from_parts(spark, d):
    body = "# top\n## {n}\n- first\n### Get /p{p}\n* one\n+ two\ntext\n"
    files = g.table(spark, d, "part").select(_text("p{p}.md", p=F.col("p_partkey")).alias("path"), _text(body, n=F.col("p_name"), p=F.col("p_partkey")).alias("text"))
    return code.markdown_sections(files)


@query("""SELECT 'Supplier ' || s_suppkey AS name, 'It serves ' || s_suppkey || '.' AS text, 'Known ' || s_suppkey AS scenario, 'a' || s_suppkey AS given FROM supplier""")
def spec_from_suppliers(spark, d):
    body = "## Purpose\nx\n## Requirements\n### Requirement: Supplier {s}\nIt serves {s}.\n#### Scenario: Known {s}\n- **GIVEN** a{s}\n- **WHEN** b\n- **THEN** c\n"
    files = spectree.specs(g.table(spark, d, "supplier").select(_text("p/openspec/specs/s{s}/spec.md", s=F.col("s_suppkey")).alias("path"), _text(body, s=F.col("s_suppkey")).alias("text")))
    scenarios = spectree.scenarios(files).select("path", F.col("name").alias("scenario"), "given")
    return spectree.requirements(files).join(scenarios, "path").select("name", "text", "scenario", "given")


@query("""SELECT 'delta' AS what, CASE s_suppkey % 4 WHEN 0 THEN 'CHANGE_ADDS_REQUIREMENT' WHEN 1 THEN 'CHANGE_REMOVES_REQUIREMENT' ELSE 'CHANGE_MODIFIES_REQUIREMENT' END AS rel, count(*) AS n FROM supplier GROUP BY 2
UNION ALL SELECT 'node', unnest(['OpenSpecDeltaSpec', 'OpenSpecRequirement']), count(*) FROM supplier""")
def spec_changes(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("ADDED", "REMOVED", "RENAMED", "other"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    name = F.col("s_suppkey").cast("string")
    rows = g.table(spark, d, "supplier").select(name.alias("capability"), F.lit("c1").alias("change_name"), F.lit("changes/c1").alias("change_path"), F.concat(name, F.lit(".md")).alias("src_file"), kind.alias("delta_type"), F.lit("Session").alias("requirement"), F.lit("Must.").alias("text"))
    nodes, edges = store.delta_rows(rows)
    count = lambda df, what, column: df.groupBy(F.col(column).alias("rel")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "rel", "n")
    return count(edges, "delta", "rel").unionByName(count(nodes, "node", "label"))


def _classes(spark, d):
    """Nations are classes, their customers functions, which call the suppliers of their nation."""
    nodes = g.nodes(spark, d, "Nation", "Customer", "Supplier").select("id", F.when(F.col("label") == "Nation", "Class").otherwise("Function").alias("label"), "name", F.lit("a.py").alias("path"), F.when(F.col("id") % 2 == 0, "doc").alias("doc"))
    customers = g.table(spark, d, "customer").select(g.node_id("Nation", "c_nationkey").alias("n"), g.node_id("Customer", "c_custkey").alias("c"))
    calls = g.table(spark, d, "customer").select(g.node_id("Customer", "c_custkey").alias("src"), g.node_id("Supplier", F.col("c_custkey") % 10).alias("dst"))
    return nodes, customers.select(F.col("n").alias("src"), F.col("c").alias("dst"), F.lit("DEFINES").alias("rel")).unionByName(calls.select("src", "dst", F.lit("CALLS").alias("rel")))


@query("""WITH m AS (SELECT 2000000000000 + c_nationkey AS id, 'methods' AS section, c_name AS item FROM customer), c AS (SELECT DISTINCT 2000000000000 + c_nationkey, 'calls', s_name FROM customer JOIN supplier ON s_suppkey = c_custkey % 10),
r AS (SELECT id, section, row_number() OVER (PARTITION BY id, section ORDER BY item) AS n, item FROM (SELECT * FROM m UNION ALL SELECT * FROM c)) SELECT id, section, n, item FROM r WHERE n <= CASE section WHEN 'methods' THEN 20 ELSE 10 END""")
def spec_context(spark, d):
    nodes, edges = _classes(spark, d)
    return context.items(nodes, edges, nodes.filter("label = 'Class'").select("id", "label", F.col("name").alias("capability"))).drop("doc")


@query("""SELECT w AS capability, CASE WHEN EXISTS (SELECT 1 FROM nation WHERE n_name = w) THEN 1 ELSE 2 END AS rank, (SELECT min(2000000000000 + n_nationkey) FROM nation WHERE contains(n_name, w)) AS id
FROM (SELECT DISTINCT left(n_name, 3) AS w FROM nation)""")
def resolve_capabilities(spark, d):
    nodes, _ = _classes(spark, d)
    wanted = g.table(spark, d, "nation").select(F.left("n_name", F.lit(3)).alias("capability")).distinct()
    return context.resolve(nodes, wanted).select("capability", "rank", "id")


@query("""SELECT lower(replace(n_name, '_', '-')) AS slug, count(c_custkey) AS n_methods, count(c_custkey) >= 3 AND n_nationkey % 2 = 0 AS recommended FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey""")
def spec_recommended(spark, d):
    nodes, edges = _classes(spark, d)
    members = edges.filter("rel = 'DEFINES'").select(F.col("src").alias("owner"))
    return context.candidates(nodes.filter("label = 'Class'"), members).select("slug", "n_methods", "recommended")


@query("""SELECT s_suppkey AS id, 'https://h' || s_suppkey || '.org/o/r' || s_suppkey AS url, 'r' || s_suppkey AS project, 'code:' || s_name || ':' || CASE WHEN s_suppkey % 2 = 0 THEN 'b' ELSE '_default' END AS graph,
'{' || s_name || '}:b_git' AS git, length(s_name) // 4 AS tokens FROM supplier""")
def names_and_addresses(spark, d):
    s = F.col("s_suppkey")
    url = F.when(s % 2 == 0, _text("git@h{s}.org:o/r{s}.git", s=s)).otherwise(_text("https://h{s}.org/o/r{s}.git", s=s))
    branch = F.when(s % 2 == 0, "b").otherwise("")
    return g.table(spark, d, "supplier").select(s.alias("id"), text.https_url(url).alias("url"), text.project_of_url(url).alias("project"), text.graph_name(F.col("s_name"), branch).alias("graph"), text.git_key(F.col("s_name"), F.lit("b")).alias("git"), text.token_estimate(F.col("s_name")).alias("tokens"))


@query("""WITH RECURSIVE e AS (SELECT 1000000000000 + n_regionkey AS src, 2000000000000 + n_nationkey AS dst FROM nation UNION ALL SELECT 2000000000000 + c_nationkey, 3000000000000 + c_custkey FROM customer UNION ALL SELECT 2000000000000 + n_nationkey, 1000000000000 + n_regionkey FROM nation),
s AS (SELECT 2000000000000 + n_nationkey AS id FROM nation)
SELECT s.id AS src, 3000000000000 + c_custkey AS dst, CASE WHEN 2000000000000 + c_nationkey = s.id THEN 1 ELSE 3 END AS hops FROM s JOIN nation a ON 2000000000000 + a.n_nationkey = s.id JOIN nation b ON b.n_regionkey = a.n_regionkey JOIN customer ON c_nationkey = b.n_nationkey""")
def shortest_form_paths(spark, d):
    """From all nations to all customers over two relations."""
    edges = g.edges(spark, d, "DEFINES", "EXTENDS", "CONTAINS")
    starts, ends = g.nodes(spark, d, "Nation"), g.nodes(spark, d, "Customer")
    return traverse.shortest_paths(edges, starts, ends, 10, ["DEFINES", "EXTENDS"]).select("src", "dst", "hops")


@query("""WITH v AS (SELECT p_brand AS path, max(p_partkey) AS version FROM part GROUP BY p_brand) SELECT path, version, sha256(p_name) AS digest FROM v JOIN part ON p_partkey = version""")
def stream_versions(spark, d):
    """Versions of files arrive as a stream of files; the newest of each path stays."""
    folder = new_folder(spark, "stream-input")
    g.table(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("version"), F.col("p_name").alias("text")).write.option("maxRecordsPerFile", 20_000).parquet(folder)
    return streaming.latest_versions(spark, folder)
