"""Queries over streams of file versions that are written out of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog_code import _FILE, _python
from .registry import query
from .shared import new_folder
from .streaming import indexing

_KEPT = "SELECT *, c_custkey % 2 = 0 AS changed FROM customer WHERE c_custkey % 5 <> 0"


@query(f"""WITH k AS ({_KEPT}) SELECT 'CALLS' AS rel, {_FILE} AS src_path, 'C' || c_custkey || CASE WHEN changed THEN '.go' ELSE '.run' END AS src, 'n' || c_nationkey || '/util.py' AS dst_path, 'help' || c_custkey % 3 AS dst FROM k WHERE c_custkey % 3 < 2
UNION ALL SELECT unnest(['EXTENDS', 'RETURNS', 'PARAMETERS']), {_FILE}, 'C' || c_custkey || unnest(['', CASE WHEN changed THEN '.go' ELSE '.run' END, CASE WHEN changed THEN '.go' ELSE '.run' END]), 'base.py', unnest(['Top', 'Top', 'Other']) FROM k
UNION ALL SELECT 'IMPORTS', {_FILE}, '', unnest(['n' || c_nationkey || '/util.py', 'base.py']), '' FROM k""")
def stream_index(spark, d):
    """Three batches: all files; half of the customers' with another method; a fifth of them deleted and a function of every ``util`` gone."""
    source, folder = new_folder(spark, "versions"), indexing.new_state(spark)
    files = _python(spark, d)
    number = F.regexp_extract("path", r"/c(\d+)\.py$", 1).try_cast("int")
    changed = files.filter(number % 2 == 0).withColumn("text", F.replace("text", F.lit("def run("), F.lit("def go(")))
    shorter = files.filter(F.col("path").endswith("util.py")).withColumn("text", F.replace("text", F.lit("def help2"), F.lit("def other")))
    gone = files.filter(number % 5 == 0).withColumn("text", F.lit(None).cast("string"))
    for version, part in enumerate((files, changed, gone.unionByName(shorter))):
        part.select("path", F.lit(version).cast("long").alias("version"), "text").coalesce(1).write.mode("append").parquet(source)
        indexing.follow(spark, source, folder)
    return indexing.state(spark, folder, indexing.last_batch(spark, folder))["links"]
