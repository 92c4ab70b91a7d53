"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session or of its context; a temporary folder only under a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="symgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder (nothing is created yet)."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that was written here."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, what: str, scratch: list[str] | None = None) -> DataFrame:
    """``df`` as a parquet table: computed once, lineage cut, survives lost executors.

    Its path is added to ``scratch``, where given, for :func:`remove` once nothing reads it any more.
    """
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes for each core below which an input counts as small.
SMALL = 32 << 20


#: The optimizer's estimate of an input whose size it does not know, as of rows that the driver made; a union with one has it too.
UNKNOWN = (1 << 63) - 1


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores where it is small (by the optimizer's estimate); a large input is left as it is.

    A small table is often one file with one row group, which a single task would read and work on.  An input of
    unknown size may be such a table as well as a large one; it is dealt out into as many partitions as a shuffle has.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= UNKNOWN:
        return df.repartition(max(cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return df.repartition(cores) if size < cores * SMALL else df
