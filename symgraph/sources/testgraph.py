"""The driver's tables as a property graph (FIXTURES.md, section 3).

Nodes: id, label, name, path.  Edges: src, dst, rel.  Each node id is a label code times 10^12 plus
the key; each relation is its own DataFrame, so a query reads only the tables it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import written

CODE = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6, "Document": 7}
STEP = 10**12
_NODES = {
    "Region": ("region", "r_regionkey", "r_name", None),
    "Nation": ("nation", "n_nationkey", "n_name", None),
    "Customer": ("customer", "c_custkey", "c_name", "c_mktsegment"),
    "Supplier": ("supplier", "s_suppkey", "s_name", None),
    "Part": ("part", "p_partkey", "p_name", "p_brand"),
    "Order": ("orders", "o_orderkey", "o_orderkey", "o_orderpriority"),
    "Document": ("documents", "doc_id", "doc_id", "source"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def node_id(label: str, key) -> F.Column:
    return (F.lit(CODE[label] * STEP) + (F.col(key) if isinstance(key, str) else key)).cast("long")


def nodes(spark: SparkSession, sf_dir: str, *labels: str) -> DataFrame:
    """id, label, name, path of the nodes with one of ``labels`` (all without any)."""
    out = None
    for label in labels or _NODES:
        source, key, name, path = _NODES[label]
        part = table(spark, sf_dir, source).select(
            node_id(label, key).alias("id"), F.lit(label).alias("label"), F.col(name).cast("string").alias("name"), (F.col(path) if path else F.lit(None)).cast("string").alias("path")
        )
        out = part if out is None else out.unionByName(part)
    return out


def _next_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate"]
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*order))
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_quantity", following.alias("nx")).filter("nx is not null and nx <> l_partkey")


def edges(spark: SparkSession, sf_dir: str, *rels: str) -> DataFrame:
    """src, dst, rel of the given relations; at most one edge for each (src, rel, dst)."""
    read = lambda name: table(spark, sf_dir, name)
    made = {
        "DEFINES": lambda: read("nation").select(node_id("Region", "n_regionkey").alias("src"), node_id("Nation", "n_nationkey").alias("dst"))
        .unionByName(read("customer").select(node_id("Nation", "c_nationkey").alias("src"), node_id("Customer", "c_custkey").alias("dst")))
        .unionByName(read("orders").select(node_id("Customer", "o_custkey").alias("src"), node_id("Order", "o_orderkey").alias("dst"))),
        "EXTENDS": lambda: read("nation").select(node_id("Nation", "n_nationkey").alias("src"), node_id("Region", "n_regionkey").alias("dst")),
        "CONTAINS": lambda: read("lineitem").select(node_id("Order", "l_orderkey").alias("src"), node_id("Part", "l_partkey").alias("dst")).distinct(),
        "SUPPLIED_BY": lambda: read("lineitem").select(node_id("Part", "l_partkey").alias("src"), node_id("Supplier", "l_suppkey").alias("dst")).distinct(),
        "CALLS": lambda: _next_part(spark, sf_dir).filter("l_returnflag = 'R' and l_quantity >= 40").select(node_id("Part", "l_partkey").alias("src"), node_id("Part", "nx").alias("dst")).distinct(),
        "NEXT_PART": lambda: _next_part(spark, sf_dir).select(node_id("Part", "l_partkey").alias("src"), node_id("Part", "nx").alias("dst")).distinct(),
    }
    out = None
    for rel in rels:
        part = made[rel]().withColumn("rel", F.lit(rel))
        out = part if out is None else out.unionByName(part)
    return out


_kept: dict[tuple, DataFrame] = {}


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Time and length of the tables that edges are made of."""
    found = []
    for name in ("nation", "customer", "orders", "lineitem"):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found.append((files.getFileStatus(path).getModificationTime(), files.getContentSummary(path).getLength()))
    return tuple(found)


def edge_table(spark: SparkSession, sf_dir: str, *rels: str) -> DataFrame:
    """:func:`edges` as a table in the shared folder, written once a session and state of its tables: what traversals read a level at a time."""
    key = (spark.sparkContext.applicationId, sf_dir, rels, _stamp(spark, sf_dir))
    if key not in _kept:
        _kept[key] = written(edges(spark, sf_dir, *rels).sortWithinPartitions("src"), "edges")
    return _kept[key]


#: The same projection in SQL, for the oracles.
SQL = """
nodes AS (
  SELECT 1000000000000 + r_regionkey AS id, 'Region' AS label, r_name AS name, NULL AS path FROM region UNION ALL
  SELECT 2000000000000 + n_nationkey, 'Nation', n_name, NULL FROM nation UNION ALL
  SELECT 3000000000000 + c_custkey, 'Customer', c_name, c_mktsegment FROM customer UNION ALL
  SELECT 4000000000000 + s_suppkey, 'Supplier', s_name, NULL FROM supplier UNION ALL
  SELECT 5000000000000 + p_partkey, 'Part', p_name, p_brand FROM part UNION ALL
  SELECT 6000000000000 + o_orderkey, 'Order', o_orderkey::VARCHAR, o_orderpriority FROM orders UNION ALL
  SELECT 7000000000000 + doc_id, 'Document', doc_id::VARCHAR, source FROM documents),
follows AS (SELECT l_partkey, l_returnflag, l_quantity, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
  l_returnflag, l_extendedprice, l_discount, l_tax, l_linestatus, l_shipdate) AS nx FROM lineitem),
calls AS (SELECT DISTINCT 5000000000000 + l_partkey AS src, 5000000000000 + nx AS dst FROM follows
  WHERE nx IS NOT NULL AND nx <> l_partkey AND l_returnflag = 'R' AND l_quantity >= 40),
defines AS (
  SELECT 1000000000000 + n_regionkey AS src, 2000000000000 + n_nationkey AS dst FROM nation UNION ALL
  SELECT 2000000000000 + c_nationkey, 3000000000000 + c_custkey FROM customer UNION ALL
  SELECT 3000000000000 + o_custkey, 6000000000000 + o_orderkey FROM orders),
contains_part AS (SELECT DISTINCT 6000000000000 + l_orderkey AS src, 5000000000000 + l_partkey AS dst FROM lineitem),
supplied AS (SELECT DISTINCT 5000000000000 + l_partkey AS src, 4000000000000 + l_suppkey AS dst FROM lineitem),
edges AS (SELECT src, dst, 'CALLS' AS rel FROM calls UNION ALL SELECT src, dst, 'DEFINES' FROM defines UNION ALL
  SELECT src, dst, 'CONTAINS' FROM contains_part UNION ALL SELECT src, dst, 'SUPPLIED_BY' FROM supplied UNION ALL
  SELECT 2000000000000 + n_nationkey, 1000000000000 + n_regionkey, 'EXTENDS' FROM nation)
"""
