"""Target-distribution importance resampling over hashed word runs, with length-bucketed CRC matrices.

Features of a text are its runs of one and two consecutive words; a feature's bucket is the CRC-32 of
its bytes modulo ``buckets``. The distinct features of a block of texts are grouped by length; the
features of a length are rows of one matrix of bytes, whose CRCs are updated together, column by
column, and scattered back to where the features occur.

The source's and the target's bucket counts give each bucket a gain, floor(1000 * ln of the ratio of
the smoothed shares). A text weighs the floored mean of its features' gains. With a Gumbel noise that
comes of a hash of its id, the largest sums of weight and noise are a sample without replacement in
proportion to exp(weight / 1000).

Texts are read once: their buckets, two bytes a feature, are written, and counted and weighed from
there. Ranks come from a range partitioning by score, so no task sorts all rows.

Defined results: null and wordless texts have no features and weight 0; a row without an id draws its
noise as ``7:`` and comes last among equal scores; rows of equal id and score are ranked in some order;
repeated rows are rows of their own; very long texts are read whole, in pieces; an empty target gives
every bucket t = T = 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import scope, spool

BLOCK = 2 << 20
#: Bytes to what stands for them: A-Z in lower case, what is in no word as a space.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = crc_table()


def crc_rows(rows: np.ndarray) -> np.ndarray:
    """The CRC-32 of each row of a matrix of bytes, all rows updated by one column at a time."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in rows.T:
        crc = CRC[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return ~crc


def crcs(pool: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The CRC-32 of features that lie in a pool of bytes as (starts, lengths) of their words: of one
    word, or of two joined by a space."""
    size = sum(n for _, n in parts) + len(parts) - 1
    out = np.zeros(len(size), np.uint32)
    order = np.argsort(size, kind="stable")
    edges = np.flatnonzero(np.diff(size[order], prepend=-1, append=-1))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        width = int(size[order[lo]])
        step = max(1, BLOCK // max(width, 1))  # bounds the matrix
        for a in range(lo, hi, step):
            who = order[a : min(a + step, hi)]
            rows = np.empty((width, len(who)), np.uint8)  # a column of the matrix is contiguous
            (at, n), *rest = [(s[who], n[who]) for s, n in parts]
            for j in range(width):
                first = pool.take(at + j, mode="clip")
                if rest:
                    (at2, _), k = rest[0], j - n - 1
                    first = np.where(j < n, first, np.where(k < 0, np.uint8(0x20), pool.take(at2 + k, mode="clip")))
                rows[j] = first
            out[who] = crc_rows(rows.T)
    return out


def words_of(data: bytes) -> Iterator[list[bytes]]:
    """Words, in pieces that end between words, so that a very long text is never split at once."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + BLOCK)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def feature_buckets(texts: list[list[bytes]], buckets: int) -> list[np.ndarray]:
    """The bucket of every feature of each list of words: its words first, then its pairs of words."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64)
    size = np.fromiter(map(len, number), np.int64, len(number))
    pool = np.frombuffer(b"".join(number) or b"\0", np.uint8)
    start = np.cumsum(size) - size
    ends = np.cumsum([len(t) for t in texts])
    single = (crcs(pool, [(start, size)]) % np.uint32(buckets)).astype(np.uint16)[ids]
    pairs, where = np.unique(ids[:-1] * max(len(number), 1) + ids[1:], return_inverse=True)
    a, b = np.divmod(pairs, max(len(number), 1))
    double = (crcs(pool, [(start[a], size[a]), (start[b], size[b])]) % np.uint32(buckets)).astype(np.uint16)[where]
    return [np.concatenate([single[z - len(t) : z], double[z - len(t) : max(z - 1, z - len(t))]]) for t, z in zip(texts, ends.tolist())]


def hashed(docs: DataFrame, id_col: str, buckets: int) -> DataFrame:
    """id_col, n_words, codes (the features' buckets, two bytes each)."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are numbered in two bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, count = [bytearray() for _ in range(batch.num_rows)], [0] * batch.num_rows
            held, size, first = [], 0, 0  # places of texts and their words; a later piece begins with the last word before it

            def note(held: list[tuple[int, list[bytes]]], codes=codes, count=count) -> None:
                for (k, words), found in zip(held, feature_buckets([w for _, w in held], buckets)):
                    again = count[k] > 0  # a word that two pieces share counts in the first
                    codes[k] += found[again:].tobytes()
                    count[k] += len(words) - again

            for k, text in enumerate(batch.column(1)):
                last: list[bytes] = []
                for words in words_of((text.as_py() or "").encode().translate(LOWER)):
                    if words:
                        held.append((k, last + words))
                        size, last = size + sum(map(len, words)), words[-1:]
                    if size >= BLOCK:
                        note(held)
                        held, size = [], 0
                if k + 1 == batch.num_rows or sum(map(len, codes[first : k + 1])) >= BLOCK:
                    note(held)
                    held, size = [], 0
                    rows = slice(first, k + 1)
                    yield pa.RecordBatch.from_arrays([batch.column(0)[rows], pa.array(count[rows], pa.int64()), pa.array(map(bytes, codes[rows]), pa.binary())], [id_col, "n_words", "codes"])
                    codes[rows], first = [b""] * (k + 1 - first), k + 1

    return docs.select(id_col, "text").mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_words long, codes binary")


def bucket_counts(coded: DataFrame, buckets: int) -> list[int]:
    """How many features each bucket has: a row a task and bucket, added up; ``buckets`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for codes in b.column(0):
                total += np.bincount(np.frombuffer(codes.as_py(), np.uint16), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = [0] * buckets
    for r in coded.select("codes").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) of each bucket."""
    n, s_all, t_all = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source, target)]


def ranked(scored: DataFrame, most: int, id_col: str) -> DataFrame:
    """rank among the ``eligible`` rows by falling score, then id, up to ``most``; null for the others.
    Rows are dealt by ranges of (score, id, row), so equal ones may part; a row's rank is its place in
    its range and the sizes of the ranges before, of which there are as many as tasks."""
    keys = [F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("row")]
    spark = scored.sparkSession
    some = scored.where("eligible").withColumn("row", F.monotonically_increasing_id())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = spool(some.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()), "importance-placed")
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = dict(zip([p for p, _ in sizes], np.cumsum([0, *(n for _, n in sizes)]).tolist()))
    offset = spark.createDataFrame(list(before.items()) or [(0, 0)], "part long, before long")
    whole = placed.withColumn("part", part.cast("long")).withColumn("at", at).join(F.broadcast(offset), "part")
    rank = F.col("before") + F.col("at") + 1
    kept = [c for c in scored.columns if c != "eligible"]
    drawn = whole.select(*kept, F.when(rank <= most, rank).alias("rank"))
    return drawn.unionByName(scored.where("not eligible").select(*kept, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_features, weight, score, rank (of the drawn ``percent`` of the texts with
    ``least_words``; else null)."""
    spark = docs.sparkSession
    with scope(spark):
        coded = spool(hashed(docs, id_col, buckets), "importance-coded")
        wanted = hashed(target.select(F.lit(0).alias("key"), "text"), "key", buckets)
        gain = spark.sparkContext.broadcast(np.array(gains(bucket_counts(coded, buckets), bucket_counts(wanted, buckets)), np.int64))

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [np.frombuffer(c.as_py(), np.uint16) for c in b.column(2)]
                n = [len(f) for f in found]
                weight = [int(gain.value[f].sum()) // len(f) if len(f) else 0 for f in found]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(weight, pa.int64())], [id_col, "n_words", "n_features", "weight"])

        kind = dict(docs.dtypes)[id_col]
        weighed = coded.select(id_col, "n_words", "codes").mapInArrow(weigh, f"`{id_col}` {kind}, n_words long, n_features long, weight long")
        h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
        noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
        scored = spool(weighed.select(id_col, "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score"), (F.col("n_words") >= least_words).alias("eligible")), "importance-scored")
        return spool(ranked(scored, scored.where("eligible").count() * percent // 100, id_col), "importance-drawn")
