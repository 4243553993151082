"""Sharding as vector bin packing: bytes, tokens and rows are balanced jointly.

Equal texts form a group, which is placed whole on the shard whose residual capacity vector has
the largest dot product with the group's own vector, among those that still have room for it, or
at least for its bytes (or, if none has, the one with most), larger groups first. So bytes come
out near equal, and tokens and rows as far as that allows. Only a group that no shard can hold, larger
than a whole shard in some dimension, is cut into blocks by a hash of the row id. There are
fewer than 3*shards of these.

The greedy needs an order, so it runs in two levels: units above ``1/fine`` of a shard in some
dimension (at most 3*shards*fine) are packed first, in one task of that bounded size; the rest
is dealt by hash into buckets of about ``bucket_units``, each of which packs into its part of
the residual capacity with the shards rotated.

Defined results: null text counts as empty, with one byte and no token; null ids are kept and
ordered first; repeated rows are rows of their own; shards that tie go by number, groups that
tie by their digest, and slots by id, then checksum, then size; a very long text is a group like any other;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import spool

SALTS = 64


def place(vectors: np.ndarray, capacity: np.ndarray, slack: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each vector (n x 3, bytes first) by largest dot product with residual capacity
    (shards x 3) where it fits, give or take ``slack`` of the capacity, or where only its bytes
    do, or where most bytes are left; in descending order of the largest component; and what
    remains."""
    left, where, spare = capacity.astype(float).copy(), np.zeros(len(vectors), np.int32), slack * np.abs(capacity)
    for i in np.argsort(-vectors.max(axis=1), kind="stable"):
        room = left >= vectors[i] - spare
        fits = whole if (whole := room.all(axis=1)).any() else room[:, 0]
        where[i] = s = int(np.argmax(np.where(fits, left @ vectors[i], -np.inf) if fits.any() else left[:, 0]))
        left[s] -= vectors[i]
    return where, left


def pack(docs: DataFrame, shards: int = 8, fine: int = 512, bucket_units: int = 2000, chunk_rows: int = 20000) -> DataFrame:
    """doc_id, size, text_crc32, tokens, shard, slot."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.unhex(F.md5(text)).alias("key"),
    ).withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int"))
    rows = spool(rows, "shard-rows")

    sums = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")]
    again = [F.sum(c).alias(c) for c in "btn"]
    salted = spool(rows.groupBy("key", "salt").agg(*sums), "shard-groups")
    total = salted.agg(*again).first()
    if not total["n"]:
        return rows.select("doc_id", "size", "text_crc32", "tokens", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    share = F.greatest(*(F.col(c) / F.lit(float(max(total[c], 1))) for c in "btn"))
    # fewer than 3 * shards keys can pass, whatever the input
    hot = F.broadcast(spool(salted.groupBy("key").agg(*again).where(share * shards > 1).select("key", F.lit(True).alias("hot")), "shard-hot"))
    block = F.when(F.col("hot"), F.col("salt")).otherwise(F.lit(-1)).alias("block")
    units = spool(salted.join(hot, "key", "left").select("key", block, *"btn").groupBy("key", "block").agg(*again), "shard-units")

    whole = np.array([float(max(total[c], 1)) for c in "btn"])

    def packed(room: np.ndarray):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["key", "block"])
            vectors = pdf[list("btn")].to_numpy(float) / whole
            turn = int(key[0]) % len(room)
            mine = np.roll(room, turn, axis=0) * (vectors.sum(axis=0) / np.maximum(room.sum(axis=0), 1e-12))
            where, _ = place(vectors, mine)
            return pdf[["key", "block", *"btn"]].assign(shard=((where - turn) % len(room)).astype("int32"))

        return run

    schema = "key binary, block int, b long, t long, n long, shard int"
    room = np.full((shards, 3), 1.0 / shards)
    large = spool(units.where(share * shards * fine > 1).withColumn("bucket", F.lit(0)).groupBy("bucket").applyInPandas(packed(room), schema), "shard-large")
    for r in large.groupBy("shard").agg(*again).collect():  # one row a shard
        room[r["shard"]] -= np.array([float(r[c]) for c in "btn"]) / whole
    buckets = max(1, math.ceil(units.count() / bucket_units))
    small = units.where(share * shards * fine <= 1).withColumn("bucket", F.pmod(F.xxhash64("key", "block"), F.lit(buckets)).cast("int"))
    small = small.groupBy("bucket").applyInPandas(packed(room), schema).select("key", "block", "shard")
    large = F.broadcast(large.select("key", "block", "shard"))  # at most 3 * shards * fine rows

    chunks = max(1, math.ceil(total["n"] / chunk_rows))
    rows = rows.join(hot, "key", "left").withColumn("block", block)
    put = rows.join(large, ["key", "block"]).unionByName(rows.join(large, ["key", "block"], "left_anti").join(small, ["key", "block"])).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "key"), F.lit(chunks)).cast("int"))
    put = spool(put.select("doc_id", "size", "text_crc32", "tokens", "shard", "chunk"), "shard-put")
    ahead = put.groupBy("shard", "chunk").count().withColumn("ahead", F.sum("count").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)))
    row = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size"))
    return put.withColumn("row", row).join(ahead.drop("count"), ["shard", "chunk"]).select("doc_id", "size", "text_crc32", "tokens", "shard", (F.coalesce("ahead", F.lit(0)) + F.col("row") - 1).alias("slot"))
