"""Uploaded files, in the order in which they are refused.

Defined results: a null name is no .pdf; a null content is empty; an empty content type counts as
not given; files of equal path are judged each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

MOST_BYTES = 50 << 20
# The content types that are taken for a PDF.
CONTENT_TYPES = ["application/pdf", "application/octet-stream", "binary/octet-stream"]


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def judged(files: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """path, length, status, reason: 201 and null where a file is accepted. files: path, length,
    content and, where it was given, content_type. pages, if they have been read: path, text."""
    kind = F.nullif("content_type", F.lit("")) if "content_type" in files.columns else F.lit(None).cast("string")
    refused = [
        (~F.coalesce(F.lower("path").endswith(".pdf"), F.lit(False)), 400, "name is not .pdf"),
        (~kind.isin(CONTENT_TYPES), 400, "unsupported content type"),
        (F.col("length") > MOST_BYTES, 413, "larger than 50 MiB"),
        ((F.col("length") == 0) | F.col("content").isNull(), 422, "empty"),
        (F.substring("content", 1, 4) != F.lit(b"%PDF"), 422, "not a PDF"),
    ]
    if pages is not None:
        read = pages.groupBy("path").agg(F.count("*").alias("_n"), F.max(F.length(T.strip(F.coalesce("text", F.lit(""))))).alias("_most"))
        files = files.join(read, "path", "left")
        refused += [(F.col("_n").isNull(), 422, "no pages"), (F.col("_most") == 0, 422, "no text")]
    status, reason = F.lit(201), F.lit(None).cast("string")
    for bad, code, why in reversed(refused):
        status, reason = F.when(bad, code).otherwise(status), F.when(bad, why).otherwise(reason)
    return files.select("path", "length", status.alias("status"), reason.alias("reason"))
