"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes each result as
Parquet in the shared folder and reads it again as the next stage's docs, so a stage's work is done
once and a lost executor costs only tasks; what the stage before wrote is then deleted.  All stages but
the last return the columns of docs, whatever these are called.

1. ``quality``: co-trained classifier; documents that score below 0.5 go.
2. ``toxicity``: counterfactually regularised classifier; documents that score 0.3 or more go.
3. ``exact_dedup``: of texts that are equal but for white space the longest stays.
4. ``near_dedup``: of each class of near duplicates the row with the least id stays.
5. ``packing``: the rest in sequences of 1024 tokens; one row per piece.

Stages 3 and 4 decide on rows, known by their file and place in it, not by their ids: of each group
exactly one row stays, also where ids are null (they come last) or repeat.  Other defined results: null
text counts as empty; an empty table gives an empty result; extra columns pass through to the last
stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from symgraph.llm import bag_minhash, exact_dedup, packing, quality, toxicity
from symgraph.llm.common import exact_col, fresh, new_folder, remove, table

TOXIC = 0.3


def _small_batches(spark: SparkSession) -> None:
    """Texts go to the Python workers 500 at a time from here on: batches of 10,000 long ones fill an executor's memory.

    The plans that a stage returns run after it, so the setting stays; no result depends on it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    model = quality.learn(quality.view_table(docs), table(spark, sf_dir, "labels"))
    score = fresh(docs, "quality_score")
    return quality.scored(docs, model, score).filter(F.col(score) >= quality.THRESHOLD).drop(score)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    toxic = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "toxic_score")
    return docs.withColumn(score, toxic(F.col("text"))).filter(F.col(score) < TOXIC).drop(score)


def _placed(spark: SparkSession, docs: DataFrame, what: str) -> tuple[str, DataFrame, str]:
    """docs in a folder; its rows with their place as one more column; that column's name."""
    path = new_folder(spark, what)
    docs.write.parquet(path)
    rows, place = spark.read.schema(docs.schema).parquet(path), fresh(docs, "place")
    return path, rows.withColumn(place, exact_dedup.place(rows)), place


def _only(rows: DataFrame, kept: DataFrame, columns: list[str], key: str) -> DataFrame:
    return rows.join(kept, key, "left_semi").select(*map(exact_col, columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path, rows, place = _placed(spark, docs, "exact-input")
    kept = exact_dedup.dedup(spark, path).filter("kept").select(F.col("locator").alias(place))
    return _only(rows, kept, docs.columns, place)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _, rows, place = _placed(spark, docs, "near-input")
    name, doc_id = fresh(docs, "row"), F.col("doc_id")
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):  # digits that sort like the numbers
        doc_id = F.lpad(F.hex(doc_id.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    first = F.when(doc_id.isNull(), "1").otherwise(F.concat(F.lit("0"), doc_id.cast("string")))
    named = rows.withColumn(name, F.concat_ws("|", first, F.col(place)["file"], F.lpad(F.col(place)["row"].cast("string"), 19, "0")))
    kept = bag_minhash.near_duplicates(named, name).filter("doc_id = class_id").select(F.col("class_id").alias(name))
    return _only(named, kept, docs.columns, name)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", keep_quality), ("toxicity", drop_toxic), ("exact_dedup", exact), ("near_dedup", near), ("packing", pack)]
#: The two classifiers are trained models, which SQL cannot express; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage makes of ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
