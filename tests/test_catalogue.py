import pytest
from pyspark.sql import functions as F

from symgraph.operators.catalogue import Catalogue, Conflict, plan

OLD = [("a", "graph"), ("{a}_git", "graph"), ("{a}_info", "info"), ("b", "graph"), ("code:b:_default", "graph"), ("{b}_info", "info"), ("{b}:_default_info", "info"), ("code:c:main", "graph"), ("c_tmp", "graph"), ("{c}_git", "graph"), ("{z}_info", "info")]
NEW = {("code:a:_default", "graph", "a"), ("{a}:_default_git", "graph", "{a}_git"), ("{a}:_default_info", "info", "{a}_info"), ("code:b:_default", "graph", "code:b:_default"), ("{b}_info", "info", "{b}_info"), ("{b}:_default_info", "info", "{b}:_default_info"), ("code:c:main", "graph", "code:c:main"), ("c_tmp", "graph", "c_tmp"), ("{c}_git", "graph", "{c}_git"), ("{z}_info", "info", "{z}_info")}


@pytest.fixture
def stored(spark, tmp_path):
    found = Catalogue(spark, f"file://{tmp_path}/graphs")
    rows = spark.createDataFrame(OLD, "name string, kind string").select("*", F.col("name").alias("folder"), F.lit(None).cast("string").alias("target"))
    found.commit(lambda old: old.unionByName(rows))
    return found


def state(found):
    return {(r.name, r.kind, r.folder) for r in found.rows().collect()}


def test_migration_and_a_second_run(stored):
    before = stored.version()
    todo = {r.kind: (r.renamed, r.dropped) for r in stored.migrate(dry_run=True).collect()}
    assert todo == {"graph": (1, 1), "git": (1, 0), "info": (1, 0)} and stored.version() == before
    stored.migrate()
    assert state(stored) == NEW
    last = stored.version()
    assert stored.migrate().isEmpty() and stored.version() == last


@pytest.mark.parametrize("done", [[], [0], [2], [1, 0], [0, 1, 2]])
def test_a_stopped_migration_is_taken_up_again(spark, stored, done):
    stored.stage()
    for part in done:
        stored.move(part, 3)
    at = {r.name for r in stored.rows().collect()}
    assert ("a" in at) == ("{a}_git" in at) == ("{a}_info" in at)  # a project moves as a whole
    Catalogue(spark, stored.root).migrate(parts=2)
    assert state(stored) == NEW and stored.rows().filter("target is not null").isEmpty()


def test_plan_of_no_names(spark):
    assert plan(spark.createDataFrame([], "name string, kind string")).isEmpty()


def graph(spark, n):
    return spark.range(n).withColumnRenamed("id", "node"), spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def test_graphs_are_replaced_cloned_renamed_and_deleted(spark, tmp_path):
    found = Catalogue(spark, f"file://{tmp_path}/graphs")
    assert found.version() == 0 and not found.exists("x") and found.rows().isEmpty()
    size = lambda name, version=None: found.load(name, version)[0].count()
    found.put("code:x:feat/a", *graph(spark, 3))
    with pytest.raises(ValueError, match="there is a graph"):
        found.put("code:x:feat/a", *graph(spark, 4))
    found.clone("code:x:feat/a", "y")
    with pytest.raises(ValueError, match="there is a graph"):
        found.clone("y", "code:x:feat/a")
    with pytest.raises(ValueError, match="there is a graph"):
        found.rename("y", "code:x:feat/a")
    last = found.put("code:x:feat/a", *graph(spark, 5), replace=True)
    assert (size("code:x:feat/a"), size("y"), size("code:x:feat/a", last - 1)) == (5, 3, 3)
    found.rename("y", "z")
    assert not found.exists("y") and size("z") == 3
    found.delete("z")
    with pytest.raises(KeyError):
        found.load("z")
    assert size("z", found.version() - 1) == 3
    assert found.vacuum() == 1 and size("code:x:feat/a") == 5
    assert len(list((tmp_path / "graphs/data").iterdir())) == 1 and len(list((tmp_path / "graphs/tables").iterdir())) == 1
    assert found.vacuum() == 0
    found.put("w", *graph(spark, 2))
    assert size("w") == 2 and size("code:x:feat/a") == 5


def test_of_two_writers_one_starts_again(spark, tmp_path):
    one, two = (Catalogue(spark, f"file://{tmp_path}/graphs") for _ in "ab")
    calls = []

    def slow(rows):
        calls.append(rows.count())
        if len(calls) == 1:
            two.put("fast", *graph(spark, 2))
        return rows.unionByName(one._row("slow", "graph", "f"))

    one.commit(slow)
    assert calls == [0, 1] and {r.name for r in one.rows().collect()} == {"fast", "slow"}
    with pytest.raises(Conflict):
        one._claim(1, "other")
    assert len(list((tmp_path / "graphs/tables").iterdir())) == 2 and not list((tmp_path / "graphs").glob("staged-*"))


def test_a_failed_graph_leaves_nothing(spark, tmp_path):
    found = Catalogue(spark, f"file://{tmp_path}/graphs")
    nodes, edges = graph(spark, 3)
    with pytest.raises(Exception):
        found.put("x", nodes, edges.select(F.raise_error(F.lit("no")).alias("src")))
    assert found.version() == 0 and not list((tmp_path / "graphs/data").iterdir())
