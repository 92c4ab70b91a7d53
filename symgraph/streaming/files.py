"""Incremental indexing: new versions of files arrive as a stream and are merged by path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir


def latest_versions(spark: SparkSession, folder: str, schema: str = "path string, version long, text string", files_per_batch: int = 1000) -> DataFrame:
    """path, version, digest of the newest version of every file ever streamed in."""
    import uuid

    out = f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    newest = stream.groupBy("path").agg(F.max(F.struct("version", F.sha2("text", 256).alias("digest"))).alias("best"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch-{number}")

    query = newest.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start()
    query.awaitTermination()
    updates = spark.read.option("recursiveFileLookup", "true").parquet(out)
    return updates.groupBy("path").agg(F.max_by("best", "batch").alias("best")).select("path", "best.version", "best.digest")
