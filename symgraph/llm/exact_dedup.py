"""Operator 7: stateful streaming deduplication of equal texts.

The parquet files of a folder are read as a stream.  A streaming aggregation keeps, for every
digest ever seen, the locator (file and row) and the id of the best text so far and the number of
texts; it has no watermark, so nothing expires, and it lives in RocksDB, so it may outgrow memory.
Partial aggregation comes before the shuffle: a digest that a third of all rows share costs one row
per task.  A hit (a digest with more than one text) is not believed before the full bytes were
compared with those at the locator; texts that only share the digest are told apart by their bytes.

Texts are equal when identical after deleting all of ``[\\x20\\x09-\\x0D]``.  The row with the most
code points stays, then the smallest id.  Defined results: null text counts as empty, and empty
texts are equal to each other; of repeated rows (same id and text) exactly one stays; a null id
comes after all others; ids of any ordered type keep it; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exact_col, new_folder, remove, session_conf, written

WHITE = "[\\x20\\x09-\\x0D]+"
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def place(rows: DataFrame) -> F.Column:
    """Where a row of a scan of files lies: file and row (whatever its columns are called)."""
    hidden = rows.metadataColumn("_metadata")
    return F.struct(hidden["file_path"].alias("file"), hidden["row_index"].alias("row"))


def _keyed(rows: DataFrame, id_col: str, text_col: str, digest_chars: int) -> DataFrame:
    text = F.coalesce(exact_col(text_col), F.lit(""))
    return (
        rows.select(
            exact_col(id_col).alias("id"),
            F.regexp_replace(text, WHITE, "").alias("norm"),
            F.length(text).cast("long").alias("n_chars"),
            place(rows).alias("locator"),
        )
        .withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
        .withColumn("digest", F.substring("text_sha256", 1, digest_chars))
    )


def _as_glob(spark: SparkSession, path: str) -> str:
    """A stream reads folders or globs: a single file becomes a glob that only it matches."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target)
    return f"{path[:-1]}[{path[-1]}]" if status.isFile() else path


def _better() -> F.Column:
    """Orders texts of a group, best first: most code points, then smallest id (null: last), then locator."""
    return F.struct((-F.col("n_chars")).alias("minus"), F.col("id").isNull().alias("no_id"), "id", "locator")


def seen_digests(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int = 1024, digest_chars: int = 64, scratch: list[str] | None = None) -> DataFrame:
    """Stream ``path`` through the keyed state; what the state holds at the end: digest, best, n.

    The folders of the run are added to ``scratch``.
    """
    schema = spark.read.parquet(path).schema
    out, log = new_folder(spark, "dedup-state"), new_folder(spark, "dedup-log")
    if scratch is not None:
        scratch += [out, log]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(_as_glob(spark, path))
    state = _keyed(stream, id_col, text_col, digest_chars).groupBy("digest").agg(F.min(_better()).alias("best"), F.count(F.lit(1)).alias("n"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}-of-run")

    with session_conf(spark, ROCKSDB):
        query = state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", log).trigger(availableNow=True).start()
        query.awaitTermination()
    try:
        updates = spark.read.option("recursiveFileLookup", "true").parquet(out)
    except Exception as error:  # no batch ran: the input has no rows
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        none = _keyed(spark.read.schema(schema).parquet(path), id_col, text_col, digest_chars).limit(0)
        return none.groupBy("digest").agg(F.min(_better()).alias("best"), F.count(F.lit(1)).alias("n"))
    return updates.groupBy("digest").agg(F.max_by(F.struct("best", "n"), "batch").alias("last")).select("digest", "last.best", "last.n")


def dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int = 1024, digest_chars: int = 64) -> DataFrame:
    """One row per row of ``path``: id, locator, keep_id, group_size, kept, text_sha256."""
    scratch: list[str] = []
    groups = written(seen_digests(spark, path, id_col, text_col, files_per_batch, digest_chars, scratch), "dedup-groups", scratch)
    rows = _keyed(spark.read.parquet(path), id_col, text_col, digest_chars)
    found = written(rows.join(groups, "digest").withColumn("norm", F.when(F.col("n") > 1, F.col("norm"))), "dedup-rows")
    hits = found.filter("n > 1")
    keepers = hits.filter("locator = best.locator").select("digest", F.col("norm").alias("keep_norm"))
    compared = hits.join(keepers, "digest").withColumn("same", F.col("norm") == F.col("keep_norm")).drop("keep_norm")
    strange = written(compared.filter("not same").select("digest"), "dedup-strange")
    columns = ["id", "locator", "n_chars", "text_sha256", "best", "n"]
    believed = found.select(*columns)
    if not strange.isEmpty():  # one digest, different bytes: the bytes decide
        doubted = found.join(strange, "digest", "left_semi").withColumn("norm", F.coalesce("norm", F.lit("")))
        own = doubted.groupBy("digest", "norm").agg(F.min(_better()).alias("best"), F.count(F.lit(1)).alias("n"))
        believed = found.join(strange, "digest", "left_anti").select(*columns).unionByName(doubted.drop("best", "n").join(own, ["digest", "norm"]).select(*columns))
    for folder in scratch:  # nothing reads the state any more
        remove(spark, folder)
    return believed.select(
        F.col("id").alias("doc_id"), "locator", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("locator") == F.col("best.locator")).alias("kept"), "text_sha256"
    )


def op7_streaming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, kept and dropped."""
    return dedup(spark, f"{sf_dir.rstrip('/')}/documents.parquet").drop("locator")


SQL = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER best = 1 AS kept, text_sha256
FROM n WINDOW best AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)
"""
