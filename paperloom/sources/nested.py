"""Nested papers as JSON lines or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.nested import PAPER


def write(papers: DataFrame, path: str, kind: str = "json") -> None:
    papers.write.format(kind).mode("overwrite").save(path)


def read(spark: SparkSession, path: str, kind: str = "json", schema: str = PAPER) -> DataFrame:
    return spark.read.schema(schema).format(kind).load(path)
