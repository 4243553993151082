"""Exact dense top-k: a stated query set against all vectors, block by block.

Where the queries are a fixed part of the vectors, the pairs of blocks grow with the square of the
input; each keeps only its best, so what is exchanged grows with the blocks.

Defined results: null and empty vectors are no candidates and ask nothing; a zero vector has cosine
0; equal scores, to nine digits, go by id; repeated rows are ranked each; all vectors have one
width; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _blocks(vectors: DataFrame, key: str, size: int) -> DataFrame:
    """Rows of up to ``size`` ids with their vectors laid end to end, made within partitions."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for lo in range(0, len(pdf), size):
                cut = pdf.iloc[lo : lo + size]
                yield pd.DataFrame({"ids": [cut["id"].tolist()], "flat": [np.concatenate(cut["v"].to_list()).astype(np.float64)]})

    return vectors.where("v is not null and size(v) > 0").mapInPandas(run, f"ids array<{dict(vectors.dtypes)['id']}>, flat array<double>").withColumnsRenamed({"ids": f"{key}_ids", "flat": f"{key}_flat"})


def dense_top_k(vectors: DataFrame, queries: DataFrame, top_k: int = 10, block: int = 1024) -> DataFrame:
    """query_id, rank, id, score (cosine). vectors and queries: id, v; one width for all.

    Each pair of blocks is one matrix product and keeps its own best ``top_k`` a query, so
    what is ranked afterwards is small."""

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
        for pdf in parts:
            for r in pdf.itertuples():
                q, x = (unit(np.asarray(f).reshape(len(i), -1)) for i, f in ((r.q_ids, r.q_flat), (r.x_ids, r.x_flat)))
                score = q @ x.T
                ids = np.asarray(r.x_ids)
                order = np.stack([np.lexsort((ids, -np.round(s, 9)))[:top_k] for s in score])
                k = order.shape[1]
                yield pd.DataFrame({"query_id": np.repeat(np.asarray(r.q_ids), k), "id": ids[order].ravel(), "score": np.take_along_axis(score, order, axis=1).ravel()})

    # blocks, not rows; the exchange keeps the query blocks from being made anew for each partition
    pairs = _blocks(vectors, "x", block).crossJoin(_blocks(queries, "q", block).repartition(F.hash("q_ids")))
    kind = [dict(df.dtypes)["id"] for df in (queries, vectors)]
    found = pairs.mapInPandas(best, f"query_id {kind[0]}, id {kind[1]}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top_k).select("query_id", "rank", "id", F.round("score", 6).alias("score"))
