"""Reading the input tables and cutting lineage through the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staged import release_all_but_last, scope, shared_dir
from ..sources.staged import staged as spool

__all__ = ["join_hot", "release_all_but_last", "scope", "shared_dir", "spool", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, parts: int = 1000) -> DataFrame:
    """Inner join of rows with keyed, which has one row a key and in ``n`` the number of rows that
    have it. Keys with over 1/parts of these rows, fewer than ``parts`` whatever the input, are
    broadcast; the others are shuffled, so no task gets all rows of a hot key."""
    total = keyed.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * parts > total
    hot = keyed.where(is_hot).drop("n")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed.where(~is_hot).drop("n"), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)
