"""What the operators share: reading tables, the shared folder, cutting lineage."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import new_folder, remove, shared_dir, written

__all__ = ["crc_bucket", "exact_col", "fresh", "new_folder", "remove", "session_conf", "shared_dir", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables, through Spark's reader only (any Hadoop path works)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_bucket(column: str, modulus: int) -> F.Column:
    """crc32 of the id written as decimal text, modulo ``modulus`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def exact_col(name: str) -> F.Column:
    """A column by its exact name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextlib.contextmanager
def session_conf(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings of the session for the time of one action; the old ones come back."""
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
