import pytest
from pyspark.sql import functions as F

from symgraph.functions import text
from symgraph.operators import index, search
from symgraph.shared import new_folder, written

QUERIES = ["where does `parseToken3` read the module_1 stream", "ParseToken3 and parse_token", "stream tests", "", "zzzz", "`runAll`"]


def project(spark, changed=()):
    files = [(i, f"/w/proj/{'tests' if i == 3 else 'src'}/module_{i}.py") for i in range(8) if not (i == 6 and changed)]
    symbols = []
    for i, path in files:
        for k in range(i % 4):
            name = f"parseToken{k}" if i not in changed else f"runAll{k}"
            symbols.append((100 * i + k, path, None if k == 2 else name, f"Reads a stream {'of tokens ' * (k + 1)}HTTPServer{i}" if i not in changed else "rewritten stream", 10 * k + 1, 10 * k + 5))
    edges = [(f"/w/proj/src/module_{a}.py", f"/w/proj/src/module_{b}.py") for a, b in [(0, 1), (2, 1), (4, 1), (4, 5), (5, 5), *((7, 2) for _ in changed)]]
    return (
        written(spark.createDataFrame(files, "id long, path string"), "f"), written(spark.createDataFrame([*symbols, (9000, "/w/proj/gone.py", "parseToken3", "stream", 1, 2)], "id long, path string, name string, doc string, start int, end int"), "s"),
        written(spark.createDataFrame(edges, "src_path string, dst_path string"), "e"),
    )


def scanned(tables):
    prepared = search.corpus(*tables, "proj")
    return sorted((q, *map(str, r)) for q, asked in enumerate(QUERIES) for r in search.rank(*prepared, asked, 5).collect())


def found(spark, folder, **more):
    return sorted((r[0], *map(str, r[1:])) for r in index.search(spark, folder, QUERIES, 5, **more).collect())


def test_same_as_the_scan_also_after_an_update(spark):
    folder, tables = new_folder(spark, "index"), project(spark)
    with pytest.raises(ValueError, match="no index"):
        index.search(spark, folder, QUERIES)
    assert index.build(folder, *tables, (1, 2, "a"), "proj") == 0
    first = scanned(tables)
    assert found(spark, folder) == first and {q for q, *_ in first} == {0, 1, 2}
    later = project(spark, (1, 2, 7))
    paths = spark.createDataFrame([(f"/w/proj/src/module_{i}.py",) for i in (1, 2, 6, 7)], "path string")
    assert index.update(folder, paths, *later, (1, 2, "b"), "proj") == 1
    assert found(spark, folder) == scanned(later) != first
    assert found(spark, folder, version=0) == first  # the version before can still be asked
    written_files = spark.read.parquet(f"{folder}/postings").filter("seq = 1").select("file").distinct().count()
    assert written_files == 3  # the changed files' postings alone
    assert index.build(folder, *later, (1, 2, "c"), "proj") == 2 and found(spark, folder) == scanned(later)


def test_a_changed_stamp_rebuilds(spark):
    folder, made = new_folder(spark, "index"), []
    now = {"stamp": (8, 5, "a")}

    def tables():
        made.append(now["stamp"])
        return project(spark)

    ask = lambda: index.ensure(folder, lambda: now["stamp"], tables, spark, "proj")
    assert [ask(), ask()] == [0, 0] and len(made) == 1
    for stamp in [(9, 5, "a"), (9, 6, "a"), (9, 6, "b")]:  # nodes, edges, commit: each alone
        now["stamp"] = stamp
        assert ask() == ask() == len(made) - 1 and made[-1] == stamp

    def moving():  # the graph changes while it is read
        now["stamp"] = (10, 6, "b")
        return project(spark)

    now["stamp"] = (9, 9, "b")
    torn = index.ensure(folder, lambda: now["stamp"], moving, spark, "proj")
    assert ask() == torn + 1


def test_half_written_versions_do_not_count_and_empty_graphs_work(spark):
    folder, tables = new_folder(spark, "index"), project(spark)
    index.build(folder, *tables, (1, 1, "a"), "proj")
    spark.read.parquet(f"{folder}/files/version=0").limit(0).write.parquet(f"{folder}/files/version=1")
    assert index.version_of(spark, folder) == 0 and found(spark, folder) == scanned(tables)
    empty = new_folder(spark, "index")
    index.build(empty, *(t.limit(0) for t in tables), (0, 0, ""), "proj")
    assert found(spark, empty) == []


def test_only_the_words_postings_are_read(spark):
    folder = new_folder(spark, "index")
    index.build(folder, *project(spark), (1, 1, "a"), "proj")
    plan = index.search(spark, folder, ["stream"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(token,stream)" in plan  # down to the row groups
    rows, _ = index._asked(spark, folder, "postings", index._POSTING, "token", [(0, "stream")], 0)
    place = spark.range(1).select(index.bucket_of(F.lit("stream"))).first()[0]
    assert rows.count() and all(f"/bucket={place}/" in path for path in rows.inputFiles())


@pytest.mark.parametrize("query", [["stream", "http", "httpserver2"], ["a", "nothing"], []])
def test_tokens_as_rows_are_the_same_as_in_arrays(spark, query):
    texts = [None, "", "Stream of HTTPServer2 stream", "a_b aB a _ A __x", "x" * 5000, "plain Plain PLAIN"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    arrays = df.select("id", text.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    counted = arrays.select("id", F.explode("tokens").alias("token")).groupBy("token", "id").count()
    assert sorted(map(tuple, text.token_counts(df).collect())) == sorted(map(tuple, counted.collect()))
    scores = lambda rows: [(r.id, round(r.score, 12)) for r in sorted(rows.collect())]
    assert scores(text.bm25_texts(df, query)) == scores(text.bm25(arrays, query))
