"""Small hand-made graphs for the tests, and a web project out of the driver's tables, the same in Spark and in SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = 10**9

#: (id, label, name, path, line, props) of a web project.
NODES = [
    (1, "Function", "show", "web.py", 3, {"route": "/show"}), (2, "Function", "admin", "web.py", 9, {"route": "/admin"}), (3, "Function", "clean", "safe.py", 1, {}),
    (4, "Decorator", "login_required", "web.py", 8, {}), (5, "Decorator", "cached", "web.py", 2, {}),
    (6, "Variable", "title", "web.py", 4, {}), (7, "Variable", "body", "web.py", 5, {}), (8, "Variable", "form_text", "web.py", 6, {}),
    (9, "HtmlElement", "div#main", "page.html", 7, {}), (10, "HtmlForm", "form", "page.html", 9, {}),
    (11, "MarkdownSection", "Show", "api.md", 1, {}), (12, "MarkdownSection", "Admin", "api.md", 5, {}), (13, "MarkdownSection", "Gone", "api.md", 9, {}),
    (14, "Route", "GET", "/show", 1, {}), (15, "Route", "POST", "/admin", 5, {}), (16, "Route", "GET", "/gone", 9, {}),
    (17, "FileSystemOp", "open", "web.py", 11, {"tainted": "true"}), (18, "FileSystemOp", "os.remove", "job.py", 2, {"tainted": "true"}), (19, "FileSystemOp", "open", "web.py", 12, {"tainted": "false"}),
    (20, "Package", "yamlish", None, 0, {}), (21, "ExternalFunction", "load", "yamlish.py", 1, {"module": "yamlish"}), (22, "ExternalFunction", "dump", "yamlish.py", 2, {"module": "yamlish", "status": "ok"}), (23, "Package", "other", None, 0, {}),
]
EDGES = [
    (1, 5, "HAS_DECORATOR"), (2, 4, "HAS_DECORATOR"), (2, 5, "HAS_DECORATOR"), (6, 9, "INJECTED_INTO"), (7, 9, "INJECTED_INTO"), (8, 10, "INJECTED_INTO"), (7, 3, "PROCESSED_BY"),
    (11, 14, "DEFINES_ROUTE"), (12, 15, "DEFINES_ROUTE"), (13, 16, "DEFINES_ROUTE"), (1, 17, "HAS_FS_OP"), (2, 19, "HAS_FS_OP"), (21, 20, "BELONGS_TO"), (22, 20, "BELONGS_TO"), (1, 21, "CALLS"), (2, 22, "CALLS"), (3, 1, "CALLS"),
]
#: path, text of a Python project.
PROJECT = [
    ("python/__init__.py", ""),
    ("python/entrypoint.py", "from .service import service\n\ndef entrypoint():\n    return service()\n"),
    ("python/service.py", "from python.repo import UserRepo, OrderRepo\n\ndef service():\n    u = UserRepo()\n    o = OrderRepo()\n    return u.repo(), o.repo()\n"),
    ("python/repo.py", "from python.db import db\n\nclass BaseRepo:\n    def repo(self):\n        return db()\n\nclass UserRepo(BaseRepo):\n    def repo(self):\n        return super().repo()\n\nclass OrderRepo(BaseRepo):\n    def repo(self):\n        return super().repo()\n"),
    ("python/db.py", "def db():\n    return 1\n"),
    ("README.md", "# Title\n## Use\n- first\n* second\n### GET /items list\n- must page\ntext\n## Last\n"),
    ("broken.py", "def ("),
]
#: path, text of a spec tree.
SPECS = [
    ("p/openspec/specs/login/spec.md", "## Purpose\nUsers log in.\n## Requirements\n### Requirement: Session\nIt keeps a session.\n#### Scenario: Known\n- **GIVEN** a user\n- **WHEN** they enter\n- **AND** wait\n- **THEN** they are in\n### Requirement: Bare\n"),
    ("p/openspec/changes/c1/tasks.md", "- [ ] loose\n## Build\n- [x] 1.1 Write it\n- [X] test it\n"),
    ("p/openspec/changes/c1/specs/login/spec.md", "## ADDED Requirements\n### Requirement: New\nMust be new.\n## RENAMED Requirements\n- FROM: `### Requirement: Old`\n- TO: `### Requirement: Newer`\n"),
    ("p/openspec/changes/archive/tasks.md", "- [ ] done with\n"),
]
COMMITS = [("a.py", 1, "added"), ("a.py", 2, "modified"), ("b.py", 3, "added"), ("c.py", 3, "added"), ("b.py", 4, "deleted")]
LCOV = ["TN:\nSF:src/a.py\nDA:1,1\nDA:2,0\nDA:4,3\nDA:9,null\nLF:4\nLH:2", "SF:src/b.py\nDA:1,1\nDA:2,5\nLF:2\nLH:2", "\n"]
FUNCTIONS = [(1, "src/a.py", 1, 3), (2, "src/a.py", 4, 4), (3, "src/b.py", 1, 9), (4, "src/none.py", 1, 2)]


def web(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(NODES, "id long, label string, name string, path string, line int, props map<string,string>"), spark.createDataFrame(EDGES, "src long, dst long, rel string")


def project(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROJECT, "path string, text string")


def spec_tree(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SPECS, "path string, text string")


def web_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A web project out of the driver's tables: nodes and edges as in NODES and EDGES."""
    read = lambda t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet")
    nothing = F.lit(None).cast("string")

    def node(table, key: str, base: int, label, name, path, line, **props) -> DataFrame:
        found = F.map_filter(F.create_map(*(x for k, v in props.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull()) if props else F.create_map().cast("map<string,string>")
        return read(table).select((F.lit(base * STEP) + F.col(key)).cast("long").alias("id"), label.alias("label"), name.cast("string").alias("name"), path.cast("string").alias("path"), line.cast("int").alias("line"), found.alias("props"))

    def edge(table, where: str, rel: str, src: F.Column, a: int, dst: F.Column, b: int) -> DataFrame:
        return read(table).filter(where).select((F.lit(a * STEP) + src).cast("long").alias("src"), (F.lit(b * STEP) + dst).cast("long").alias("dst"), F.lit(rel).alias("rel"))

    c, lit = F.col, F.lit
    nodes = [
        node("customer", "c_custkey", 1, lit("Function"), c("c_name"), F.concat(lit("web"), c("c_nationkey").cast("string"), lit(".py")), c("c_custkey") % 100, route=F.concat(lit("/r"), (c("c_custkey") % 40).cast("string"))),
        node("supplier", "s_suppkey", 2, lit("Decorator"), F.when(c("s_suppkey") % 3 == 0, "login_required").otherwise("cached"), lit("web.py"), c("s_suppkey")),
        node("part", "p_partkey", 3, lit("Variable"), F.concat(lit("v"), (c("p_partkey") % 50).cast("string")), c("p_brand"), c("p_partkey") % 90),
        node("supplier", "s_suppkey", 4, F.when(c("s_suppkey") % 4 == 0, "HtmlForm").otherwise("HtmlElement"), c("s_name"), lit("page.html"), c("s_suppkey")),
        node("nation", "n_nationkey", 5, lit("MarkdownSection"), c("n_name"), lit("api.md"), c("n_nationkey")),
        node("nation", "n_nationkey", 6, lit("Route"), F.when(c("n_nationkey") % 2 == 0, "GET").otherwise("POST"), F.concat(lit("/r"), (c("n_nationkey") * 2).cast("string")), c("n_nationkey")),
        node("orders", "o_orderkey", 7, lit("FileSystemOp"), F.when(c("o_orderkey") % 2 == 0, "open").otherwise("os.remove"), c("o_orderpriority"), c("o_orderkey") % 70, tainted=F.when(c("o_orderkey") % 5 == 0, "true").otherwise("false")),
        node("region", "r_regionkey", 8, lit("Package"), c("r_name"), nothing, lit(0)),
        node("supplier", "s_suppkey", 9, lit("ExternalFunction"), c("s_name"), lit("x.py"), c("s_suppkey"), module=F.concat(lit("m"), (c("s_suppkey") % 5).cast("string")), status=F.when(c("s_suppkey") % 2 == 0, "ok")),
    ]
    edges = [
        edge("customer", "c_custkey % 3 < 2", "HAS_DECORATOR", c("c_custkey"), 1, c("c_custkey") % 10, 2),
        edge("part", "p_partkey >= 0", "INJECTED_INTO", c("p_partkey"), 3, c("p_partkey") % 10, 4),
        edge("part", "p_partkey % 3 = 0", "PROCESSED_BY", c("p_partkey"), 3, c("p_partkey") % 100, 1),
        edge("nation", "n_nationkey >= 0", "DEFINES_ROUTE", c("n_nationkey"), 5, c("n_nationkey"), 6),
        edge("orders", "o_orderkey % 3 > 0", "HAS_FS_OP", c("o_custkey"), 1, c("o_orderkey"), 7),
        edge("supplier", "s_suppkey >= 0", "BELONGS_TO", c("s_suppkey"), 9, c("s_suppkey") % 5, 8),
        edge("customer", "c_custkey >= 0", "CALLS", c("c_custkey"), 1, c("c_custkey") % 7, 9),
    ]
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    return union(nodes), union(edges)


#: The same in SQL: n(id, label, name, path, line, route, tainted, module, status) and e(src, dst, rel).
WEB_SQL = f"""
n(id, label, name, path, line, route, tainted, module, status) AS (
  SELECT {STEP} + c_custkey, 'Function', c_name, 'web' || c_nationkey || '.py', (c_custkey % 100)::INT, '/r' || c_custkey % 40, NULL, NULL, NULL FROM customer UNION ALL
  SELECT {2 * STEP} + s_suppkey, 'Decorator', CASE WHEN s_suppkey % 3 = 0 THEN 'login_required' ELSE 'cached' END, 'web.py', s_suppkey::INT, NULL, NULL, NULL, NULL FROM supplier UNION ALL
  SELECT {3 * STEP} + p_partkey, 'Variable', 'v' || p_partkey % 50, p_brand, (p_partkey % 90)::INT, NULL, NULL, NULL, NULL FROM part UNION ALL
  SELECT {4 * STEP} + s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'HtmlForm' ELSE 'HtmlElement' END, s_name, 'page.html', s_suppkey::INT, NULL, NULL, NULL, NULL FROM supplier UNION ALL
  SELECT {5 * STEP} + n_nationkey, 'MarkdownSection', n_name, 'api.md', n_nationkey::INT, NULL, NULL, NULL, NULL FROM nation UNION ALL
  SELECT {6 * STEP} + n_nationkey, 'Route', CASE WHEN n_nationkey % 2 = 0 THEN 'GET' ELSE 'POST' END, '/r' || n_nationkey * 2, n_nationkey::INT, NULL, NULL, NULL, NULL FROM nation UNION ALL
  SELECT {7 * STEP} + o_orderkey, 'FileSystemOp', CASE WHEN o_orderkey % 2 = 0 THEN 'open' ELSE 'os.remove' END, o_orderpriority, (o_orderkey % 70)::INT, NULL, CASE WHEN o_orderkey % 5 = 0 THEN 'true' ELSE 'false' END, NULL, NULL FROM orders UNION ALL
  SELECT {8 * STEP} + r_regionkey, 'Package', r_name, NULL, 0, NULL, NULL, NULL, NULL FROM region UNION ALL
  SELECT {9 * STEP} + s_suppkey, 'ExternalFunction', s_name, 'x.py', s_suppkey::INT, NULL, NULL, 'm' || s_suppkey % 5, CASE WHEN s_suppkey % 2 = 0 THEN 'ok' END FROM supplier),
e(src, dst, rel) AS (
  SELECT {STEP} + c_custkey, {2 * STEP} + c_custkey % 10, 'HAS_DECORATOR' FROM customer WHERE c_custkey % 3 < 2 UNION ALL SELECT {3 * STEP} + p_partkey, {4 * STEP} + p_partkey % 10, 'INJECTED_INTO' FROM part UNION ALL
  SELECT {3 * STEP} + p_partkey, {STEP} + p_partkey % 100, 'PROCESSED_BY' FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT {5 * STEP} + n_nationkey, {6 * STEP} + n_nationkey, 'DEFINES_ROUTE' FROM nation UNION ALL
  SELECT {STEP} + o_custkey, {7 * STEP} + o_orderkey, 'HAS_FS_OP' FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT {9 * STEP} + s_suppkey, {8 * STEP} + s_suppkey % 5, 'BELONGS_TO' FROM supplier UNION ALL
  SELECT {STEP} + c_custkey, {9 * STEP} + c_custkey % 7, 'CALLS' FROM customer)
"""
#: A package and a function of those tables.
PACKAGE, FUNCTION = "ASIA", STEP + 7
