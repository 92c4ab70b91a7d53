"""Queries on tables that the smallest ones have nothing of: keys of two tables that meet, large groups, many rows a key."""

import duckdb
import pytest

from symgraph import catalog
from symgraph.operators import pattern, security, timeline
from symgraph.shared import spread
from symgraph.sources import securitypass


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables (SQL by name) as parquet -> the folder."""

    def write(**queries):
        con = duckdb.connect()
        for name, sql in queries.items():
            con.sql(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        return str(tmp_path)

    return write


def compared(spark, folder, name, *tables):
    """Sorted rows of the query and of its SQL."""
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, expected = catalog.queries()[name](spark, folder), con.sql(catalog.oracle_sql()[name])
    order = [expected.columns.index(c) for c in got.columns]
    return sorted(map(str, map(tuple, got.collect()))), sorted(str(tuple(r[i] for i in order)) for r in expected.fetchall())


def test_a_large_part_with_the_key_of_an_order(spark, tables):
    """Part 0 is large, so it is no node, though order 0 is one; lines of an order that is not there have no edge."""
    folder = tables(
        part="SELECT k::BIGINT AS p_partkey, CASE WHEN k = 0 THEN 30 ELSE 10 END::INT AS p_size FROM range(3) t(k)",
        orders="SELECT k::BIGINT AS o_orderkey FROM range(3) t(k)",
        lineitem="SELECT o::BIGINT AS l_orderkey, p::BIGINT AS l_partkey, 1::INT AS l_linenumber FROM range(4) a(o), range(3) b(p)",
    )
    got, expected = compared(spark, folder, "upsert_edge_positions", "part", "orders", "lineitem")
    assert got == expected == sorted(str((o, -p, 1)) for o in range(3) for p in (1, 2))


def test_states_are_joined_without_a_broadcast_at_any_position(spark):
    """A position asks for as many blocks as the last one has binary digits; Spark takes these for few rows."""
    far = 1 << 33
    events = spark.createDataFrame([(1, 1, "a", "x"), (1, 3, "a", None), (1, far, "b", "y"), (2, 2, "a", "z")], "repo long, pos long, key string, value string")
    found = timeline.at_commits(timeline.item_versions(events), spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, far), (2, 1), (2, far)], "repo long, pos long"))
    assert sorted(map(tuple, found.collect())) == [(1, 1, "a", "x"), (1, 2, "a", "x"), (1, far, "b", "y"), (2, far, "a", "z")]
    few = timeline.at_commits(timeline.item_versions(events), spark.createDataFrame([(1, 5), (2, 5), (2, 7)], "repo long, pos long"))
    assert sorted(map(tuple, few.collect())) == [(2, 5, "a", "z"), (2, 7, "a", "z")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_products_of_large_keys_are_cut_into_parts(spark):
    """Each pair once, whichever side a key is large on, and no task with more of a key than a few parts."""
    left = spark.createDataFrame([(k, i) for k, n in (("a", 300), ("b", 2), ("c", 90), ("d", 1), ("only", 50)) for i in range(n)], "name string, x int")
    right = spark.createDataFrame([(k, i) for k, n in (("a", 40), ("b", 200), ("c", 90), ("d", 1), ("other", 50)) for i in range(n)], "name string, y int")
    found, plain = pattern.met(left, right, "name", 16), left.join(right, "name")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.select(found.columns).collect()))
    tasks = found.filter("name = 'a'").rdd.glom().map(len).collect()
    assert sum(tasks) == 12_000 and max(tasks) < 6_000


def test_rules_on_elements_without_their_edges_written(spark):
    """The ends of INJECTED_INTO give what its edges give; only the ends are written."""
    view = "def v{0}(q):\n    return render('t.html', a=q, b=escape(q))\n"
    files = [(f"v{i}.py", view.format(i)) for i in range(20)] + [(f"t{i}.html", "<p>{{ a }}</p><i>{{ b }}</i><form>{{ a }}</form>") for i in range(20)]
    df = spark.createDataFrame(files, "path string, text string")
    nodes, edges, ends = securitypass.security_pass(df, ("functions", "variables", "sanitisers", "elements"))
    assert edges.filter("rel = 'INJECTED_INTO'").isEmpty() and [e.count() for e in ends] == [40, 60]
    whole = securitypass.secured(df)
    assert whole[1].filter("rel = 'INJECTED_INTO'").count() == 1200
    for rule, n in ((security.xss, 400), (security.template_vars, 800)):
        by_ends, by_edges = sorted(map(str, rule(nodes, edges, ends=ends).collect())), sorted(map(str, rule(*whole).collect()))
        assert by_ends == by_edges and len(by_ends) == n


def test_a_table_is_dealt_out_beside_rows_of_unknown_size(spark, tables):
    """Spark does not know the size of rows that the driver made, nor that of their union with a table of one row group."""
    table = spark.read.parquet(tables(files="SELECT k::VARCHAR AS path FROM range(4000) t(k)") + "/files.parquet")
    rows = spread(table.unionByName(spark.createDataFrame([("x",)], "path string"))).rdd.glom().map(len).collect()
    assert sum(rows) == 4001 and max(rows) < 2000
