"""SimHash near-duplicates with deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Of two fingerprints that differ in at
most two bits, one segment differs in at most one, so both share a one-wildcard variant of
it. Equal variants are met by an equality join and verified by their bit distance.

A variant shared by more than ``crowd`` distinct fingerprints would make many pairs; its
fingerprints are indexed by all 2,016 variants with two wildcards instead. Those that share
one differ in at most two bits, and at most four can, so links stay linear and none is lost.

Defined results: null and wordless texts have fingerprint zero and link like any other; very
long texts are read whole, in pieces; null ids are kept, link like any other and take the
smallest id of their component, null if it has none; repeated rows stay; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .tables import join_hot, spool

BLOCK = 1 << 22
PRINTS = 16_000
SPACE = re.compile(rb"[\x20\x09-\x0D]")
LANES = np.uint64(0x0101010101010101)


def _words(data: bytes) -> Iterator[list[bytes]]:
    """Words in pieces cut at white space, so that a very long text is never split at once."""
    at = 0
    while at < len(data):
        found = SPACE.search(data, at + BLOCK)
        end = found.start() if found else len(data)
        yield data[at:end].split()
        at = end


def _votes(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set: eight lanes of a byte are summed at once,
    255 hashes at a time."""
    h = np.concatenate([h, np.zeros(-len(h) % 255, np.uint64)]).reshape(-1, 255)
    out = np.zeros((8, 8), np.int64)
    for j in range(8):
        lanes = ((h >> np.uint64(j)) & LANES).sum(axis=1, dtype=np.uint64)
        out[:, j] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out.ravel()


def fingerprint(text: str | None, width: int = 3) -> int:
    if not text:
        return 0
    hashed, votes, n, held = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for words in _words(text.encode().lower()):
        words = held + words
        if len(words) >= width:
            h = np.fromiter((hashed(x, 42) for x in map(b" ".join, zip(*(words[i:] for i in range(width))))), np.uint64, len(words) - width + 1)
            votes, n = votes + _votes(h), n + len(h)
        held = words[-(width - 1) :]
    if not n:
        return hashed(b" ".join(held), 42) if held else 0
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _segments() -> list:
    """Both 32-bit segments, the second with bit 37 set."""
    return [F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 37))]


def _variants(one: DataFrame) -> DataFrame:
    """The 64 one-wildcard variants (key, fp) of each fingerprint, dealt by key. Fingerprints are
    distinct, so a group of copies is one of them, and counting before the exchange would save
    nothing; it takes as many tasks as there are tens of thousands of fingerprints."""
    keys = [seg.bitwiseAND(F.lit(~(1 << i))).bitwiseOR(F.lit(i << 32)) for seg in _segments() for i in range(32)]
    spread = one.repartition(max(1, math.ceil(one.count() / PRINTS)), "fp")
    return spread.select(F.explode(F.array(*keys)).alias("key"), "fp").repartition("key")


def links(prints: DataFrame, crowd: int = 32) -> DataFrame:
    """a, b: links between distinct fingerprints (fp) that keep every component whole."""
    one = prints.select("fp")
    met = spool(_variants(one).groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "simhash-met")
    near = F.expr("bit_count(a ^ b) <= 2")
    two = met.where("n = 2").select("a", "b").where(near).distinct()
    # members of the larger variants: by the two whole segments that a variant stands for, so
    # that fingerprints come twice and not 64 times
    bit = F.shiftright("key", 32).bitwiseAND(F.lit(31)).cast("int")
    off = F.col("key").bitwiseAND(F.lit(~(31 << 32)))
    whole = F.array(off, off.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))
    wanted = met.where("n > 2").select("key", "n", F.explode(whole).alias("segment"))
    segments = one.select(F.explode(F.array(*_segments())).alias("segment"), "fp")
    held = spool(wanted.join(segments, "segment").select("key", "n", "fp"), "simhash-held")
    few = held.where(F.col("n") <= crowd).select("key", "fp")
    some = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where("a < b").where(near).select("a", "b").distinct()
    many = held.where(F.col("n") > crowd).select("fp").distinct()
    spread = many.select("fp", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("i")).select("fp", "i", F.explode(F.sequence(F.col("i") + 1, F.lit(63))).alias("j"))
    spread = spread.select((F.col("i") * 64 + F.col("j")).alias("mask"), F.expr("fp & ~(shiftleft(1L, i) | shiftleft(1L, j))").alias("rest"), "fp")
    clique = spread.groupBy("mask", "rest").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    clique = clique.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b").distinct()
    return two.unionByName(some).unionByName(clique)


def _grouped(prints: DataFrame, crowd: int) -> DataFrame:
    """prints(fp, n, and others) with the component of each fingerprint, itself where it is alone."""
    found = connected_components(links(prints, crowd)).select(F.col("node").alias("fp"), "component")
    return spool(prints.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "simhash-grouped")


def near_duplicates(docs: DataFrame, crowd: int = 32) -> DataFrame:
    """doc_id, fp, component_id (the smallest id reachable over links of two bits or fewer; null
    where no row that is reachable has an id).

    Components are made of fingerprints and get their smallest id afterwards, so fingerprints of
    rows without an id link as any others."""
    rows = spool(fingerprints(docs), "simhash-fp")
    prints = spool(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-prints")
    grouped = _grouped(prints, crowd)
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    found = join_hot(grouped.select("fp", "component", F.col("n").alias("copies")), spool(least, "simhash-least"), "component")
    return join_hot(rows, spool(found.select("fp", "component_id", F.col("copies").alias("n")), "simhash-found"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, crowd: int = 32) -> DataFrame:
    """One row of each component, in all its columns: that of the smallest id, a row without an id
    only where none has one; of rows that share it the smallest fingerprint's.

    A digest of id and text stands for a row until the end, so texts are exchanged once, to meet the
    digests that stay; repeated rows share one, and the first of them is taken there."""
    names = docs.columns
    key = next(w for w in ("row_digest" + "_" * k for k in range(len(names) + 1)) if w not in names)
    keyed = docs.withColumn(key, F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), b.column(2)], ["doc_id", "fp", "key"])

    rows = spool(keyed.select("doc_id", "text", key).mapInArrow(run, "doc_id long, fp long, key binary"), "simhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "key")).alias("first")
    grouped = _grouped(spool(rows.groupBy("fp").agg(F.count("*").alias("n"), first), "simhash-prints"), crowd)
    kept = grouped.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.key").alias(key))
    return keyed.join(spool(kept, "simhash-kept"), key, "left_semi").dropDuplicates([key]).select(*(F.col(f"`{c}`") for c in names))
