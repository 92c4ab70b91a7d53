import pytest

from symgraph.shared import new_folder
from symgraph.sources import project
from symgraph.streaming import indexing

FIRST = [
    ("app/main.py", 1, "from .util import help\nfrom lib.core import Top\nimport lib.extra\n\nclass Main(Top):\n    def go(self):\n        return help(alone())\n"),
    ("app/util.py", 1, "def help(x):\n    return x\n"), ("app/__init__.py", 1, "BASE = 1\n"), ("lib/core.py", 1, "class Top:\n    def go(self):\n        pass\n"),
    ("lib/solo.py", 1, "def alone():\n    pass\n"), ("other/quiet.py", 1, "def nothing():\n    return 1\n"), ("j/A.java", 1, "package j;\nclass A { void m() { b.n(); } }\n"), ("broken.py", 1, "def ("),
]
SECOND = [
    ("app/util.py", 2, "def help(x, y: 'Other') -> 'Other':\n    return deep(x)\nclass Other:\n    pass\n"), ("lib/second.py", 2, "def alone():\n    pass\n"), ("lib/solo.py", 0, "def stale():\n    pass\n"),
    ("other/quiet.py", 2, "def nothing():\n    return 1\n"), ("j/B.java", 1, "package j;\nclass B { void n() { } }\n"), ("lib/extra.py", 1, "X = 1\n"), ("never.py", 1, None),
]
THIRD = [("lib/core.py", 3, None), ("src/lib/core.py", 1, "class Top:\n    def stop(self):\n        pass\n"), ("lib/second.py", 3, None), ("lib/second.py", 2, "def alone(): pass\n"), ("j/A.java", 4, None), ("app/main.py", 5, "from .util import help\nfrom lib.core import Top\n\nclass Main(Top):\n    def stop(self):\n        return help(alone())\n")]


def last(*batches):
    now = {}
    for batch in batches:
        for path, version, text in batch:
            if path not in now or version > now[path][0]:
                now[path] = (version, text)
    return [(p, t) for p, (_, t) in now.items() if t is not None]


def rows(df):
    return sorted(str(r) for r in df.collect())


def test_graph_after_each_batch_is_that_of_a_full_index(spark):
    source, folder = new_folder(spark, "versions"), indexing.new_state(spark)
    for n, batch in enumerate((FIRST, SECOND, THIRD)):
        spark.createDataFrame(batch, indexing.INPUT).coalesce(1).write.mode("append").parquet(source)
        assert indexing.follow(spark, source, folder) == n
        files = last(*(FIRST, SECOND, THIRD)[: n + 1])
        nodes, edges = project.indexed(spark.createDataFrame(files, "path string, text string"))
        got_nodes, got_edges = indexing.graph(spark, folder)
        assert rows(got_nodes) == rows(nodes) and rows(got_edges) == rows(edges)
    names = {r.id: f"{r.path}:{r.full}" for r in got_nodes.collect()}
    linked = {(names[r.src], r.rel, names[r.dst]) for r in got_edges.collect()}
    assert ("app/main.py:Main", "EXTENDS", "src/lib/core.py:Top") in linked and ("app/main.py:Main.stop", "OVERRIDES", "src/lib/core.py:Top.stop") in linked
    assert ("app/main.py:Main.stop", "CALLS", "lib/solo.py:alone") in linked  # unique again since the second one is gone
    assert indexing.follow(spark, source, folder) == 2  # nothing new
    first = indexing.graph(spark, folder, 0)
    assert rows(first[0]) == rows(project.nodes_of(indexing.state(spark, folder, 0)["rows"], spark.createDataFrame(last(FIRST), "path string, text string")))


def test_only_what_can_have_changed_is_resolved_again(spark):
    folder = indexing.new_state(spark)
    frame = lambda batch: spark.createDataFrame(batch, indexing.INPUT)
    indexing.merge_batch(folder, frame(FIRST), 0)
    again = indexing.merge_batch(folder, frame([(p, v + 10, t) for p, v, t in FIRST]), 1)
    assert again.isEmpty() and rows(indexing.state(spark, folder, 1)["links"]) == rows(indexing.state(spark, folder, 0)["links"])
    found = indexing.merge_batch(folder, frame([("app/util.py", 20, "def help(x):\n    return 2\n")]), 2)
    assert {r.path for r in found.collect()} == {"app/main.py", "app/util.py"}
    one = rows(indexing.state(spark, folder, 2)["links"])
    indexing.merge_batch(folder, frame([("app/util.py", 20, "def help(x):\n    return 2\n")]), 2)  # the same batch once more
    assert rows(indexing.state(spark, folder, 2)["links"]) == one and indexing.last_batch(spark, folder) == 2


@pytest.mark.parametrize("batch", [[], [("gone.py", 1, None)]])
def test_batches_without_anything(spark, batch):
    folder = indexing.new_state(spark)
    assert indexing.merge_batch(folder, spark.createDataFrame(batch, indexing.INPUT), 0).isEmpty()
    assert all(df.isEmpty() for df in indexing.state(spark, folder, 0).values())
    nodes, edges = indexing.graph(spark, folder)
    assert nodes.isEmpty() and edges.isEmpty()
