"""Nested stretches of text: which definition a place is in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def enclosing(definitions: DataFrame, places: DataFrame) -> DataFrame:
    """definitions: path, id, start, end; places: path, at, ... -> the places with ``id``, the innermost definition around them (null: none).

    Definitions of a file are nested or apart; both ends belong to them; of two with the same ends the greater id
    is the inner one.  One sweep over each file: the depth at a place is a running count, and the innermost
    definition is the last one that began at that depth.  No pair of a place and a definition is formed.
    """
    extra = [c for c in places.columns if c not in ("path", "at")]
    none = {c: F.lit(None).cast(places.schema[c].dataType) for c in extra}
    mark = lambda df, at, kind, id_, size, **more: df.select("path", at.cast("long").alias("at"), F.lit(kind).alias("kind"), id_.alias("id"), size.cast("long").alias("size"), *((more.get(c) if more else F.col(c)).alias(f"x_{c}") for c in extra))
    size, no_id = F.col("end") - F.col("start"), F.lit(None).cast(definitions.schema["id"].dataType)
    own = definitions.select("path", "id", "start", "end").withColumns({c: none[c] for c in extra if c not in ("path", "id", "start", "end")})
    begins = mark(own, F.col("start"), 0, F.col("id"), -size, **none)
    ends = mark(own, F.col("end"), 2, F.col("id"), size, **none)
    asked = mark(places, F.col("at"), 1, no_id, F.lit(0))
    marks = begins.unionByName(asked).unionByName(ends)
    order = ["at", "kind", "size", "id"]
    step = F.when(F.col("kind") == 0, 1).when(F.col("kind") == 2, -1).otherwise(0)
    depth = F.sum(step).over(Window.partitionBy("path").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    swept = marks.filter("path is not null and at is not null").withColumn("depth", depth).filter("kind < 2")
    begun = F.last("id", ignorenulls=True).over(Window.partitionBy("path", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = swept.withColumn("inner", F.when(F.col("depth") > 0, begun)).filter("kind = 1")
    return found.select("path", "at", *(F.col(f"x_{c}").alias(c) for c in extra if c != "id"), F.col("inner").alias("id"))
