"""Search over a stored inverted index: what :func:`search.rank` gives, reading only the postings of the words asked.

Below a folder lie, as parquet:

* ``postings/seq=S/bucket=B``: token, file, tf, in_path, sorted by token, so that a search reads the buckets
  of its words and in them only the row groups that hold these;
* ``names/seq=S/bucket=B``: the named symbols by their name in lower case;
* ``files/version=V``: every file with the segment S that is its newest, its length, its centrality and the
  symbol that stands for it;
* ``state/version=V``: one row of totals and the stamp (nodes, edges, commit) of the graph that was indexed.

The newest version whose state is complete counts.  An update writes one segment with the changed files'
postings alone and a new table of files; older postings of these files drop out because their segment is no
longer the file's.  The stamp decides whether an index is still valid.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..shared import remove, written
from .search import corpus, representative_key

BUCKETS = 64
#: Postings of a written file at most, about; a bucket with more is split by a hash of the path.
ROWS = 5_000_000
Stamp = tuple[int, int, str]
_POSTING = "token string, file string, tf long, in_path boolean"
_NAME = "lower string, file string, name string, start int, end int"
_FILE = "file string, file_id long, seq int, dl long, centrality double, r struct<other:boolean,at:int,name:string,to:int,src_start:int,src_end:int>"
_STATE = "n long, dl double, central_low double, central_high double, nodes long, edges long, commit string, seq int"


def bucket_of(token: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def version_of(spark: SparkSession, folder: str) -> int | None:
    """The newest complete version of an index; None without one."""
    where, files = _hadoop(spark, f"{folder}/state")
    if not files.exists(where):
        return None
    found = [int(m[1]) for s in files.listStatus(where) if (m := re.fullmatch(r"version=(\d+)", s.getPath().getName())) and files.exists(_hadoop(spark, f"{s.getPath()}/_SUCCESS")[0])]
    return max(found, default=None)


def _state(spark: SparkSession, folder: str, version: int):
    return spark.read.schema(_STATE).parquet(f"{folder}/state/version={version}").first()  # one row


def _write_segment(folder: str, seq: int, by_file: DataFrame, by_symbol: DataFrame, scratch: list[str]) -> DataFrame:
    """Postings and names of the files of a corpus; the rows of these files for the table of files."""
    spark = by_file.sparkSession
    own = by_file.select("file")
    symbols = by_symbol.join(own, "file", "left_semi")
    tokens = by_file.select("file", F.explode("tokens").alias("token"), F.lit(1).alias("p")).unionByName(symbols.select("file", F.explode("tokens").alias("token"), F.lit(0).alias("p")))
    postings = written(tokens.groupBy("file", "token").agg(F.count(F.lit(1)).alias("tf"), (F.max("p") == 1).alias("in_path")).withColumn("bucket", bucket_of(F.col("token"))), "postings", scratch)
    names = symbols.filter("name is not null").select(F.lower("name").alias("lower"), "file", "name", "start", "end").withColumn("bucket", bucket_of(F.col("lower")))
    for df, what, key in ((postings, "postings", "token"), (names, "names", "lower")):
        salts = 1 + (df.count() // (BUCKETS * ROWS) if what == "postings" else 0)
        dealt = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")) * salts, "bucket", F.pmod(F.xxhash64("file"), F.lit(salts)))
        dealt.sortWithinPartitions("bucket", key, "file").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{what}/seq={seq}")
    lengths = postings.groupBy("file").agg(F.sum("tf").alias("dl"))
    stands = symbols.filter("name is not null").groupBy("file").agg(F.min(representative_key(F.lit(False))).alias("r"))
    joined = by_file.select("file", "file_id", "centrality").join(lengths, "file", "left").join(stands, "file", "left")
    return joined.select("file", "file_id", F.lit(seq).alias("seq"), F.coalesce("dl", F.lit(0)).cast("long").alias("dl"), "centrality", "r")


def _write_files(folder: str, version: int, seq: int, rows: DataFrame, stamp: Stamp) -> int:
    """The table of files of a version, and behind it its state, which makes the version count."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{folder}/files/version={version}")
    kept = spark.read.parquet(f"{folder}/files/version={version}")
    totals = kept.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("double").alias("dl"), F.min("centrality").alias("central_low"), F.max("centrality").alias("central_high"))
    nodes, edges, commit = stamp
    totals.select("*", F.lit(nodes).cast("long").alias("nodes"), F.lit(edges).cast("long").alias("edges"), F.lit(commit).cast("string").alias("commit"), F.lit(seq).alias("seq")).write.mode("overwrite").parquet(f"{folder}/state/version={version}")
    return version


def build(folder: str, files: DataFrame, symbols: DataFrame, edges: DataFrame, stamp: Stamp, project: str | None = None) -> int:
    """Index everything anew (tables as for :func:`search.corpus`); the new version."""
    spark, scratch = files.sparkSession, []
    before = version_of(spark, folder)
    seq = 0 if before is None else _state(spark, folder, before).seq + 1
    rows = _write_segment(folder, seq, *corpus(files, symbols, edges, project), scratch)
    version = _write_files(folder, 0 if before is None else before + 1, seq, rows, stamp)
    for path in scratch:
        remove(spark, path)
    return version


def update(folder: str, changed: DataFrame, files: DataFrame, symbols: DataFrame, edges: DataFrame, stamp: Stamp, project: str | None = None) -> int:
    """Index only the files ``changed`` (path; absolute, as in ``files``) anew; those that ``files`` lacks are gone.

    Centrality, which edges of other files change too, is taken from ``edges`` for all files.
    """
    spark, scratch = files.sparkSession, []
    before = version_of(spark, folder)
    if before is None:
        raise ValueError(f"there is no index in {folder}")
    seq = _state(spark, folder, before).seq + 1
    relative = text.relative_path(F.col("path"), project) if project else F.col("path")
    touched = changed.select("path").distinct()
    names = written(touched.select(relative.alias("file")).distinct(), "changed", scratch)
    part = _write_segment(folder, seq, *corpus(files.join(touched, "path", "left_semi"), symbols.join(touched, "path", "left_semi"), edges, project), scratch)
    old = spark.read.parquet(f"{folder}/files/version={before}").join(names, "file", "left_anti")
    at = (lambda c: text.relative_path(F.col(c), project)) if project else F.col
    central = edges.filter("src_path <> dst_path").groupBy("dst_path").agg(F.count(F.lit(1)).alias("c")).groupBy(at("dst_path").alias("file")).agg(F.sum(F.log1p("c")).alias("now"))
    kept = old.join(central, "file", "left").withColumn("centrality", F.coalesce("now", F.lit(0.0))).drop("now")
    version = _write_files(folder, before + 1, seq, kept.unionByName(part), stamp)
    for path in scratch:
        remove(spark, path)
    return version


def ensure(folder: str, stamp: Callable[[], Stamp], tables: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], spark: SparkSession, project: str | None = None) -> int:
    """A version whose stamp is that of the graph: the stored one, else a new one.

    If the graph changes while it is being indexed, the new version is stored with the stamp from before,
    so the next call indexes again.
    """
    now = stamp()
    found = version_of(spark, folder)
    if found is not None:
        row = _state(spark, folder, found)
        if (row.nodes, row.edges, row.commit) == now:
            return found
    return build(folder, *tables(), now, project)


def _local(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A few rows that stay at the driver: what is selected from them needs no job."""
    width = len(rows[0])
    values = ", ".join("(" + ", ".join(f":p{i * width + j}" for j in range(width)) + ")" for i in range(len(rows)))
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})", args={f"p{i}": x for i, x in enumerate(x for r in rows for x in r)})


def queries_of(spark: SparkSession, queries: Iterable[str]) -> list[tuple[int, list[str], list[str]]]:
    """(number, different tokens, identifiers) of each query."""
    asked = list(enumerate(queries))
    if not asked:
        return []
    found = _local(spark, asked, "query, text").select("query", F.array_distinct(text.tokens(F.col("text"))).alias("w"), text.query_identifiers(F.col("text")).alias("i"))
    return [(r.query, r.w, r.i) for r in found.collect()]  # the queries that were handed in


def _asked(spark: SparkSession, folder: str, what: str, schema: str, column: str, pairs: list[tuple[int, str]], last: int) -> tuple[DataFrame, DataFrame]:
    """The stored rows whose ``column`` is one of the words, from these words' buckets alone, with seq; and (query, word) of the pairs."""
    words = sorted({w for _, w in pairs})
    buckets = {r.b for r in _local(spark, [(w,) for w in words or [""]], "w").select(bucket_of(F.col("w")).alias("b")).collect()} if words else set()
    at = [f"{folder}/{what}/seq={seq}/bucket={b}" for seq in range(last + 1) for b in sorted(buckets)]
    there = [path for path in at if (lambda w, fs: fs.exists(w))(*_hadoop(spark, path))]
    read = spark.read.schema(f"{schema}, seq int, bucket int").option("basePath", f"{folder}/{what}")
    rows = (read.parquet(*there) if there else spark.createDataFrame([], f"{schema}, seq int, bucket int")).filter(F.col(column).isin(words))
    return rows, F.broadcast(_local(spark, pairs or [(-1, "")], f"query, {column}"))  # the words that were asked


def search(spark: SparkSession, folder: str, queries: Iterable[str], limit: int = 10, version: int | None = None) -> DataFrame:
    """The best ``limit`` files of each query: query (number), file, file_id, score, name, src_start, src_end, as of :func:`search.rank`."""
    version = version_of(spark, folder) if version is None else version
    if version is None:
        raise ValueError(f"there is no index in {folder}")
    state, asked = _state(spark, folder, version), queries_of(spark, queries)
    files = spark.read.schema(_FILE).parquet(f"{folder}/files/version={version}")
    postings, words = _asked(spark, folder, "postings", _POSTING, "token", [(q, w) for q, found, _ in asked for w in found], state.seq)
    names, exact_words = _asked(spark, folder, "names", _NAME, "lower", [(q, w) for q, _, found in asked for w in found], state.seq)
    hits = postings.join(files.select("file", "seq", "dl"), ["file", "seq"])
    counted = hits.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token")))
    norm = text.K1 * (1 - text.B + text.B * F.col("dl") / F.lit(state.dl / state.n if state.n and state.dl else 1.0))
    gain = F.log(1 + (F.lit(float(state.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (text.K1 + 1) / (F.col("tf") + norm)
    zero = F.lit(None).cast(files.schema["r"].dataType)
    bodies = counted.join(words, "token").select("query", "file", gain.alias("body"), F.col("in_path").cast("double").alias("path_hits"), F.lit(0.0).alias("name_hits"), zero.alias("exact"))
    named = names.join(files.select("file", "seq"), ["file", "seq"], "left_semi").join(exact_words, "lower")
    exact = named.select("query", "file", F.lit(0.0).alias("body"), F.lit(0.0).alias("path_hits"), F.lit(1.0).alias("name_hits"), representative_key(F.lit(True)).alias("exact"))
    added = bodies.unionByName(exact).groupBy("query", "file").agg(*(F.sum(c).alias(c) for c in ("body", "path_hits", "name_hits")), F.min("exact").alias("exact"))
    scored = added.join(files.select("file", "file_id", "centrality", "r"), "file").withColumns({"central_low": F.lit(state.central_low), "central_high": F.lit(state.central_high)})
    whole = Window.partitionBy("query")
    all_hit = F.count(F.lit(1)).over(whole) == state.n  # else some file has no hit, and the least value is 0
    bounds = {f"{c}_{b}": (F.max(c).over(whole) if b == "high" else F.when(all_hit, F.min(c).over(whole)).otherwise(0.0)) for c in ("body", "path_hits") for b in ("low", "high")}
    only = F.when(F.col("name_hits") > 0, F.col("name_hits"))
    bounds |= {"name_hits_low": F.min(only).over(whole), "name_hits_high": F.max(only).over(whole)}
    part = lambda c, where=None: text.scaled(c, f"{c}_low", f"{c}_high", where)
    central = text.scaled("centrality", "central_low", "central_high")
    w = text.WEIGHTS
    score = w[0] * part("name_hits", F.col("name_hits") > 0) + w[1] * part("path_hits") + w[2] * part("body") + w[3] * central - w[4] * F.col("file").rlike(text.PENALISED).cast("double")
    rounded = scored.withColumns(bounds).filter("name_hits > 0 or path_hits > 0 or body > 0").select("query", "file", "file_id", F.bround(score, 4).alias("score"), F.coalesce("exact", "r").alias("r"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "file")
    return rounded.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= limit).select("query", "file", "file_id", "score", "r.name", "r.src_start", "r.src_end")
