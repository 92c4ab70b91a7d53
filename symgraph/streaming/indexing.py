"""Incremental indexing: versions of files arrive as a stream, and only what they can have changed is resolved again.

The state below a folder has a version for each micro-batch: ``files`` (path, version, digest), ``rows`` (what
the analysers found in each file) and ``links`` (what resolution made of them), written last.  A batch is merged in
four steps: the newest version of each path, dropped if its digest is known; the rows of the changed files in
place of the old ones; the files whose links may differ now; their links in place of the old ones.  A batch
that runs again after a failure starts from the version before it and writes the same.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import new_folder, remove, written
from ..sources import code, project

FILE = "path string, version long, digest string"
LINK = "rel string, src_path string, src string, dst_path string, dst string"
INPUT = "path string, version long, text string"
TABLES = {"files": FILE, "rows": code.ROW_SCHEMA, "links": LINK}
_USES = ("call", "base", "implements", "parameters", "return_type", "import", "module_import")


def last_batch(spark: SparkSession, folder: str, before: int | None = None) -> int | None:
    """The newest complete version (below ``before``); None without one."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return None
    done = lambda path: files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/links/_SUCCESS"))
    found = [int(m[1]) for s in files.listStatus(where) if (m := re.fullmatch(r"batch-(\d+)", s.getPath().getName())) and done(s.getPath())]
    return max((n for n in found if before is None or n < before), default=None)


def state(spark: SparkSession, folder: str, batch: int | None) -> dict[str, DataFrame]:
    """files, rows and links of a version; empty ones for None."""
    if batch is None:
        return {k: spark.createDataFrame([], schema) for k, schema in TABLES.items()}
    return {k: spark.read.schema(schema).parquet(f"{folder}/batch-{batch}/{k}") for k, schema in TABLES.items()}


def changed_files(files: DataFrame, batch: DataFrame) -> DataFrame:
    """The newest version of each path of a batch (path, version, text; a null text deletes) if it is newer than the known one and differs from it."""
    newest = batch.groupBy("path").agg(F.max(F.struct("version", "text")).alias("n")).select("path", "n.*").withColumn("digest", F.sha2("text", 256))
    known = files.select("path", F.col("version").alias("old_version"), F.col("digest").alias("old"), F.lit(True).alias("known"))
    both = newest.join(known, "path", "left")
    new = F.col("known").isNull() & F.col("text").isNotNull()
    return both.filter(new | (F.col("known") & (F.col("version") > F.col("old_version")) & ~F.col("digest").eqNullSafe(F.col("old")))).select("path", "version", "text", "digest")


def _names(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Everything by which other files can mean something in these files: names of entities, and parts of the paths."""
    named = rows.filter(F.col("kind").isin("class", "function", "variable", "method")).select(F.col("name").alias("token"))
    places = paths.select(F.explode(F.split(F.regexp_replace("path", r"\.py$", ""), "/")).alias("token"))
    return named.unionByName(places).distinct()


def frontier(rows: DataFrame, links: DataFrame, changed: DataFrame, touched: DataFrame) -> DataFrame:
    """The files (path) whose links may differ after a batch: the changed ones, those that linked to them, and those that
    mention a touched name (in a use, an import or, for relative imports, by their own place).  All Java (C#) files if one of them changed.
    """
    paths = changed.select("path")
    linked = links.join(paths.withColumnRenamed("path", "dst_path"), "dst_path", "left_semi").select(F.col("src_path").alias("path"))
    said = F.concat_ws(".", "name", "target", F.when(F.col("kind") == "import", F.col("doc")))
    place = F.when(F.col("kind").isin("import", "module_import") & F.col("owner").startswith("."), F.split("path", "/")).otherwise(F.array().cast("array<string>"))
    mentions = rows.filter(F.col("kind").isin(*_USES)).select("path", F.explode(F.concat(F.split(said, r"\."), place)).alias("token"))
    found = paths.unionByName(linked).unionByName(mentions.join(touched, "token", "left_semi").select("path"))
    for end in project.NAMED:
        if not changed.filter(F.col("path").endswith(end)).isEmpty():
            found = found.unionByName(rows.filter(F.col("path").endswith(end)).select("path"))
    return found.distinct()


def merge_batch(folder: str, batch: DataFrame, number: int) -> DataFrame:
    """Merge a batch (path, version, text) into the state as version ``number``; the files that were resolved again (path)."""
    spark, scratch = batch.sparkSession, []
    old = state(spark, folder, last_batch(spark, folder, number))
    changed = written(changed_files(old["files"], batch), "changed", scratch)
    out = f"{folder}/batch-{number}"
    write = lambda df, what: df.write.mode("overwrite").parquet(f"{out}/{what}")
    if changed.isEmpty():
        for what, df in old.items():
            write(df, what)
        found = spark.createDataFrame([], "path string")
    else:
        without = lambda df, column="path": df.join(changed.select(F.col("path").alias(column)), column, "left_anti")
        kept = changed.filter("text is not null")
        write(without(old["files"]).unionByName(kept.select("path", "version", "digest")), "files")
        new = written(code.analyzed(kept), "new-rows", scratch)
        write(without(old["rows"]).unionByName(new), "rows")
        files, rows = (spark.read.schema(TABLES[k]).parquet(f"{out}/{k}") for k in ("files", "rows"))
        gone = old["rows"].join(changed.select("path"), "path", "left_semi")
        touched = written(_names(new.unionByName(gone), changed), "touched", scratch)
        found = written(frontier(rows, old["links"], changed, touched), "frontier")
        renewed = project.links_of(rows, files, found)
        rest = old["links"].join(found.select(F.col("path").alias("src_path")), "src_path", "left_anti")
        for end in project.NAMED:  # these are resolved as a whole, or not at all
            if not found.filter(F.col("path").endswith(end)).isEmpty():
                rest = rest.filter(~F.col("src_path").endswith(end))
        write(rest.unionByName(renewed), "links")
    for path in scratch:
        remove(spark, path)
    return found


def follow(spark: SparkSession, source: str, folder: str, files_per_batch: int = 1000) -> int | None:
    """Merge all versions of files that are in ``source`` (parquet: path, version, text) and were not merged yet; the newest version."""

    def merge(batch: DataFrame, number: int) -> None:
        scratch: list[str] = []
        merge_batch(folder, written(batch.select("path", "version", "text"), "batch", scratch), number)
        for path in scratch:
            remove(spark, path)

    stream = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}-log").trigger(availableNow=True).start().awaitTermination()
    return last_batch(spark, folder)


def graph(spark: SparkSession, folder: str, batch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a version (the newest), as :func:`project.indexed` gives them for these files."""
    now = state(spark, folder, last_batch(spark, folder) if batch is None else batch)
    nodes = written(project.nodes_of(now["rows"], now["files"]), "nodes")
    return nodes, project.assembled(nodes, now["links"])


def new_state(spark: SparkSession) -> str:
    """A folder for a new state."""
    return new_folder(spark, "index-state")
