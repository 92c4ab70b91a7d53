from pyspark.sql import functions as F

from symgraph.functions import text
from symgraph.operators import pattern, security, store, traverse
from symgraph.plans import fixtures
from symgraph.sources import code
from symgraph.streaming.files import latest_versions

CONTRACT = [("entrypoint", "service"), ("service", "UserRepo"), ("service", "OrderRepo"), ("service", "UserRepo.repo"), ("service", "OrderRepo.repo"), ("UserRepo.repo", "BaseRepo.repo"), ("OrderRepo.repo", "BaseRepo.repo"), ("BaseRepo.repo", "db")]
NAMES = sorted({x for e in CONTRACT for x in e})
ID = {n: i for i, n in enumerate(NAMES)}


def contract(spark):
    nodes = spark.createDataFrame([(i, "Class" if n.endswith("Repo") else "Function", n.rpartition(".")[2], f"{n}.py") for n, i in ID.items()], "id long, label string, name string, path string")
    return nodes, spark.createDataFrame([(ID[a], ID[b], "CALLS") for a, b in CONTRACT], "src long, dst long, rel string")


def test_contract_graph(spark):
    nodes, edges = contract(spark)
    names = lambda df: sorted(r["name"] for r in df.collect())
    assert names(pattern.neighbors(edges, nodes, [ID["service"]], ["CALLS"], "IN")) == ["entrypoint"]
    assert names(pattern.neighbors(edges, nodes, [ID["service"]], ["CALLS"], "OUT")) == ["OrderRepo", "UserRepo", "repo", "repo"]
    assert traverse.call_paths(edges, ID["entrypoint"], ID["db"], 10).count() == 2
    reached = {r.id for r in traverse.impact(edges, [ID["db"]], "IN", 5).collect()}
    assert {ID["service"], ID["entrypoint"]} <= reached


def test_cycle_returns_its_start_once(spark):
    edges = spark.createDataFrame([(1, 2, "CALLS"), (2, 1, "CALLS"), (3, 1, "CALLS")], "src long, dst long, rel string")
    for depth in (2, 5):
        assert sorted(r.id for r in traverse.impact(edges, [1], "IN", depth).collect()) == [1, 2, 3]


def test_cascade_deletes_below_a_hundred_levels(spark):
    n = 104
    nodes = spark.range(n + 1)
    edges = spark.createDataFrame([(i, i + 1, "DEFINES") for i in range(n - 1)], "src long, dst long, rel string").coalesce(1)
    left, kept = store.cascade_delete(nodes, edges, nodes.filter("id = 0"))
    assert [r.id for r in left.collect()] == [n] and kept.count() == 0
    again = edges.unionByName(spark.createDataFrame([(2, 0, "DEFINES")], edges.schema)).filter("src < 3")
    assert traverse.closure(again, nodes.filter("id = 0")).count() == 4
    assert traverse.closure(edges, nodes.filter("id = 0"), 2).count() == 3


def test_upsert_merges_properties(spark):
    old = spark.createDataFrame([("a", "doc", {"x": "1", "y": "2"}), ("b", None, None)], "name string, doc string, props map<string,string>")
    new = spark.createDataFrame([("a", None, {"y": "3"}), ("c", "new", {})], "name string, doc string, props map<string,string>")
    got = {r["name"]: (r.doc, r.props) for r in store.upsert_nodes(old, new, ["name"]).collect()}
    assert got == {"a": ("doc", {"x": "1", "y": "3"}), "b": (None, None), "c": ("new", {})}
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    edges = spark.createDataFrame([(1, 2, "CALLS")], "src long, dst long, rel string")
    more = spark.createDataFrame([(1, 2, "CALLS"), (2, 1, "CALLS"), (1, 9, "CALLS")], "src long, dst long, rel string")
    assert store.upsert_edges(edges, more, nodes).count() == 2


def test_scan_isolates_a_broken_rule(spark):
    nodes, edges = fixtures.web(spark)

    def broken(n, e):
        raise ValueError("broken rule")

    found = security.scan(nodes, edges, rules={"xss": security.xss, "broken": broken})
    assert found["broken"] == "broken rule" and [r.UnsafeVariable for r in found["xss"].collect()] == ["title"]


def test_source_tree_scan(spark, tmp_path):
    for path, body in fixtures.PROJECT:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    (tmp_path / "venv").mkdir()
    (tmp_path / "venv/x.py").write_text("def x(): pass")
    files = code.scan(spark, str(tmp_path), ["venv"]).withColumn("path", text.relative_path(F.col("path"), tmp_path.name))
    assert sorted(r.path for r in files.collect()) == sorted(p for p, t in fixtures.PROJECT if t)
    assert code.python_rows(files).filter("kind = 'class'").count() == 3


def test_query_identifiers(spark):
    row = spark.createDataFrame([("Why does `foo bar_baz` call parseTokens or plain Words in it?",)], "q string").select(text.query_identifiers(F.col("q")).alias("w")).first()
    assert row.w == ["bar_baz", "parsetokens", "words"]


def test_streamed_versions(spark, tmp_path):
    folder = str(tmp_path / "in")
    for rows in ([("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z")], [("b", 0, "old")]):
        spark.createDataFrame(rows, "path string, version long, text string").write.mode("append").parquet(folder)
    got = {r.path: r.version for r in latest_versions(spark, folder, files_per_batch=1).collect()}
    assert got == {"a": 2, "b": 1}


def test_lcov_functions_and_branches(spark):
    record = "TN:unit\nSF:a.js\nFN:3,f\nFN:7,9,g\nFNF:2\nFNH:1\nFNDA:4,f\nFNDA:0,g\nDA:3,4\nLF:1\nLH:1\nBRDA:3,0,0,2\nBRDA:3,0,1,-\nBRF:2\nBRH:1\n"
    r = code.lcov(spark.createDataFrame([(record,)], "report string")).first()
    assert (r.file, r.test, r.found, r.hit, r.fnf, r.fnh, r.brf, r.brh) == ("a.js", "unit", 1, 1, 2, 1, 2, 1)
    assert [tuple(x) for x in r.functions] == [(3, "f"), (7, "g")] and [tuple(x) for x in r.calls] == [("f", 4), ("g", 0)]
    assert [tuple(x) for x in r.branches] == [(3, "0", "0", 2), (3, "0", "1", 0)]


def test_prefixes_are_looked_up_in_the_index(spark, monkeypatch):
    from symgraph.operators import pattern
    from symgraph.shared import new_folder

    names = ["parse_tokens now", "Parse", "é parse", "sparse", "HTTP server", "", None, "parse"]
    nodes = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    folder = new_folder(spark, "prefixes")
    pattern.prefix_index(nodes, folder)
    asked = ["pars", "PARSE_T", "s", "http", "zz", "é", "parse_tokens n"]
    for most in (200, 1):
        monkeypatch.setattr(pattern, "RANGES", most)
        found = pattern.prefix_lookup(spark, folder, asked, 3)
        got = {}
        for r in found.orderBy("prefix", "n").collect():
            got.setdefault(r.prefix, []).append(r.id)
        for p in asked:
            assert got.get(p.lower(), []) == [r.id for r in pattern.prefix_search(nodes, p, 3).collect()]
    assert pattern.prefix_lookup(spark, folder, []).isEmpty()
    monkeypatch.setattr(pattern, "RANGES", 200)
    plan = pattern.prefix_lookup(spark, folder, ["pars"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(token,pars)" in plan and "LessThanOrEqual(token,pars" in plan
