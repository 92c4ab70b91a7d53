"""Small hand-made cases whose results are known by reading."""

import pytest
from pyspark.sql import functions as F

from symgraph.functions import text
from symgraph.operators import store
from symgraph.plans import fixtures
from symgraph.shared import new_folder
from symgraph.sources import code, spectree


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str) if columns else sorted((tuple(r) for r in df.collect()), key=str)


def test_parts_of_identifiers(spark):
    names = ["HTTPServer2X", "parse_tokens", "plain", "_x1Y", "getURLName"]
    got = [r.p for r in spark.createDataFrame([(x,) for x in names], "name string").select(text.sub_tokens(F.col("name")).alias("p")).collect()]
    assert [[x for x in p if x] for p in got] == [["http", "server2", "x", "httpserver2x"], ["parse", "tokens", "parse_tokens"], ["plain", "plain"], ["x1", "y", "_x1y"], ["get", "url", "name", "geturlname"]]


def test_versions_of_files(spark):
    found = store.versions(spark.createDataFrame(fixtures.COMMITS, "path string, pos int, change string"))
    at = lambda pos: {(r.path, r.valid_from) for r in store.at_commit(found, pos).collect()}
    assert [at(p) for p in (1, 2, 3, 4)] == [{("a.py", 1)}, {("a.py", 2)}, {("a.py", 2), ("b.py", 3), ("c.py", 3)}, {("a.py", 2), ("c.py", 3)}]


def test_coverage_of_functions(spark):
    files = code.lcov(spark.createDataFrame([(x,) for x in fixtures.LCOV], "report string"))
    lines = files.selectExpr("file", "explode(lines) AS l").selectExpr("file", "l.line AS line", "l.hits AS hits")
    got = store.coverage(files, lines, spark.createDataFrame(fixtures.FUNCTIONS, "id int, file string, start int, end int"))
    assert rows(got, "id", "coverage") == [(1, 1.0), (2, 1.0), (3, 1.0), (4, 0.0)]


@pytest.mark.parametrize("split", ["128m", "64"])
def test_reports_are_cut_at_the_ends_of_records(spark, split):
    """Two report files whose records go over the splits of a scan; a file of both is merged."""
    record = lambda name, *hits: "TN:t\nSF:" + name + "\n" + "".join(f"DA:{i},{h}\n" for i, h in enumerate(hits, 1)) + f"LF:{len(hits)}\nLH:{sum(h > 0 for h in hits)}\nend_of_record\n"
    folder = new_folder(spark, "lcov")
    for part in (record("a.py", 1, 0, 0) + record("b.py", 0), "".join(record(f"c{i}.py", 1) for i in range(40)) + record("a.py", 0, 2, 0)):
        spark.createDataFrame([(part.rstrip("\n"),)], "value string").coalesce(1).write.mode("append").text(folder)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        files, lines = code.lcov_merged(code.lcov(code.lcov_reports(spark, folder)))
        assert rows(files.filter("file in ('a.py', 'b.py')")) == [("a.py", 3, 2), ("b.py", 1, 0)] and files.count() == 42
        assert rows(lines.filter("file = 'a.py'")) == [("a.py", 1, 1), ("a.py", 2, 2), ("a.py", 3, 0)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_python_project(spark):
    files = fixtures.project(spark)
    found = code.python_rows(files)
    py = lambda *names: tuple(f"python/{n}.py" for n in names)
    assert rows(code.resolve_imports(found, files)) == sorted([py("entrypoint", "service"), py("service", "repo"), py("repo", "db")])
    assert {tuple(r) for r in code.resolve_uses(found).collect()} == {
        ("CALLS", "python/entrypoint.py", "entrypoint", "python/service.py", "service"), ("CALLS", "python/service.py", "service", "python/repo.py", "UserRepo"), ("CALLS", "python/service.py", "service", "python/repo.py", "OrderRepo"),
        ("CALLS", "python/repo.py", "BaseRepo.repo", "python/db.py", "db"), ("EXTENDS", "python/repo.py", "UserRepo", "python/repo.py", "BaseRepo"), ("EXTENDS", "python/repo.py", "OrderRepo", "python/repo.py", "BaseRepo"),
    }


def test_headings_and_specs(spark):
    md = code.markdown_sections(fixtures.project(spark).filter("path like '%.md'"))
    assert rows(md, "line", "level", "title", "method", "route", "n_requirements") == [(2, 2, "Use", None, None, 2), (5, 3, "GET /items list", "GET", "/items", 1), (8, 2, "Last", None, None, 0)]
    tree = fixtures.spec_tree(spark)
    assert rows(spectree.requirements(spectree.specs(tree)), "line", "name", "text") == [(11, "Bare", ""), (4, "Session", "It keeps a session.")]
    assert rows(spectree.scenarios(spectree.specs(tree)), "line", "given", "when_clause", "then_clause") == [(6, "a user", "they enter | wait", "they are in")]
    assert rows(spectree.tasks(spectree.change_tasks(tree)), "line", "group", "num", "text", "checked") == [(1, "", "", "loose", False), (3, "Build", "1.1", "Write it", True), (4, "Build", "", "test it", True)]
    assert rows(spectree.deltas(spectree.change_specs(tree)), "line", "delta_type", "requirement", "text") == [(2, "ADDED", "New", "Must be new."), (6, "RENAMED", "Newer", "(renamed from: Old)")]
