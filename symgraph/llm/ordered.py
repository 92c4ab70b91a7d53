"""Documents dealt out by ranges of their id, with one shuffle and known borders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import exact_col

LOWEST = -(1 << 63)
#: Rows of a part at most, about.
ROWS = 250_000


def id_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[int]]:
    """(id, key, text, part) and the lowest key of each part.

    ``key`` is the id (a null id comes first), a null text is empty.  The borders are ids that occur,
    found with an approximate percentile over the id column alone; there are as many parts as
    shuffle partitions, more if a part would have over ``ROWS`` rows.  Ids must be integers.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"ids must be integers, {id_col} is {docs.schema[id_col].dataType.simpleString()}")
    rows = docs.select(exact_col(id_col).alias("id"), F.coalesce(exact_col(id_col).cast("long"), F.lit(LOWEST)).alias("key"), F.coalesce(exact_col(text_col), F.lit("")).alias("text"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS))
    found = rows.agg(F.min("key"), F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()
    borders = sorted({found[0], *found[1]}) if found[0] is not None else [LOWEST]
    at = np.array(borders, np.int64)

    @F.pandas_udf("int")
    def part(key: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(at, key.to_numpy(np.int64), side="right") - 1, 0).astype(np.int32))

    return rows.withColumn("part", part("key")), borders
