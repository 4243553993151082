"""Repeated-passage removal with a sparse, range-partitioned suffix array.

A byte goes if a ``window``-byte string that covers it also starts in a document with a
smaller id. Only suffixes that can matter are sorted:

1. Documents are packed into *units* of a few MB, written once to the shared folder.
2. Every window is anchored at its minimal ``lead``-byte string. Units send the hashes of
   their anchors, each once, to hash buckets, which return those met in two units or more.
3. A shared anchor's suffix, with what stands before it, goes to the range of its leading
   tokens; limits are quantiles of a sample of anchors. The sample and the ranges have a fixed
   number at most, which the driver can hold; where the input is larger than so many buckets, a
   hash of the lead parts each range. Equal suffixes of a unit are sent once, with the smallest
   id. Suffixes whose anchor stands in thousands of units are cut into single windows first,
   which are salted over the buckets.
4. A bucket sorts its strings word by word, ties only (multikey quicksort), and compares
   neighbours: the smallest id of an equal run covers the others. A limit never parts equal
   leads, and equal windows have equal leads, so no run crosses a bucket's boundary.
5. Covered spans return to their units, which cut the texts.

Exact copies of a whole text are told by digest and are not taken apart.

Defined results: null text counts as empty; a null id counts as larger than any other; rows
that share an id do not cover each other; texts below ``window`` bytes are kept; repeated rows
stay; a very long text is a unit of its own and taken apart in pieces; of equal strings the
smallest id keeps its own, wherever it stands; an empty table gives no rows; other columns are
ignored, or carried as they are by ``strip_repeats``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import join_hot, spool

WINDOW, LEAD = 50, 24
UNIT_BYTES, BUCKET_BYTES, SAMPLES, RANGES = 2 << 20, 16 << 20, 20_000, 2048
U64 = np.uint64
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9], U64)
NULL = np.iinfo(np.int64).max


def _known(content: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if content else {}


def _pack(*arrays: np.ndarray, known: bytes = b"") -> bytes:
    raw = b"".join(len(b := np.ascontiguousarray(a).tobytes()).to_bytes(8, "little") + b for a in arrays)
    return zstandard.ZstdCompressor(level=3, **_known(known)).compress(raw)


def _unpack(blob: bytes, *kinds: type, known: bytes = b"") -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor(**_known(known)).decompress(blob), 0, []
    for k in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, k, n // np.dtype(k).itemsize, at + 8))
        at += 8 + n
    return out


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    out = np.zeros(len(data), U64)
    for i in range(8):
        out |= padded[i : i + len(data)].astype(U64) << U64(8 * i)
    return out


def anchors(data: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of joined documents (``doc``: number by byte): for each run of windows with one anchor,
    its first window, how many windows, the anchor's position, and the anchor's hash."""
    none = np.zeros(0, np.int64)
    n, span = len(data) - LEAD + 1, WINDOW - LEAD + 1
    if len(data) < WINDOW:
        return none, none, none, none.astype(U64)
    w = _words(data)
    h = (w[:n] ^ (w[8 : 8 + n] * U64(0xC2B2AE3D27D4EB4F))) * U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(29)
    h = (h + w[16 : 16 + n]) * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(32)
    key = (h & ~U64(0xFFFFFF)) | np.arange(n, dtype=U64)
    step = 1
    while step * 2 <= span:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if span - step:
        key = np.minimum(key[: -(span - step)], key[span - step :])
    at = (key & U64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(doc[: len(at)] == doc[WINDOW - 1 :])
    at = at[first]
    if not len(at):
        return none, none, none, none.astype(U64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (first[1:] != first[:-1] + 1)]))
    at = at[new]
    g = h[at] * U64(0x94D049BB133111EB)
    return first[new], np.diff(np.append(new, len(first))), at, g ^ (g >> U64(31))


def ranks(strings: np.ndarray) -> np.ndarray:
    """Numbers of equal rows of a byte matrix, ascending as the rows do. Multikey quicksort:
    rows are split by one eight-byte word, and only those that tie go on to the next."""
    rows, width = strings.shape
    padded = np.zeros((rows, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    words = padded.view(">u8").astype(U64)
    group, open_ = np.zeros(rows, np.int64), np.arange(rows)
    for k in range(words.shape[1]):
        order = open_[np.lexsort((words[open_, k], group[open_]))]
        if not len(order):
            break
        g, v = group[order], words[order, k]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
        start = np.concatenate([[True], g[1:] != g[:-1]])
        place = np.arange(len(order))
        # a group keeps a range as wide as its rows, so that parts can be numbered within it
        group[order] = g + place[new][np.cumsum(new) - 1] - place[start][np.cumsum(start) - 1]
        size = np.diff(np.append(place[new], len(order)))
        open_ = order[np.repeat(size > 1, size)]
    return np.unique(group, return_inverse=True)[1]


def _least(group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.full(int(group.max(initial=-1)) + 1, NULL)
    np.minimum.at(out, group, ids)
    return out[group]


def _several(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether a row's group has two values or more."""
    low = _least(group, value)
    high = -_least(group, -value)
    return low != high


def _cut(data: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Rows of up to ``2 * window - lead`` bytes: ``count`` windows from ``start`` on."""
    width = 2 * WINDOW - LEAD
    at = start[:, None].astype(np.int32 if len(data) < 1 << 30 else np.int64) + np.arange(width, dtype=np.int32)
    out = data[np.minimum(at, len(data) - 1, out=at)]
    out[np.arange(width) >= (count + WINDOW - 1)[:, None]] = 0
    return out


def _ipc(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def units(docs: DataFrame, carry: tuple[str, ...] = (), unit_bytes: int | None = None) -> DataFrame:
    """unit, doc_ids (null as the largest number), digests, lengths, the packed bytes, and in
    ``extra`` the columns ``carry`` as an Arrow stream.

    A document longer than a unit is a unit of its own."""
    unit_bytes = unit_bytes or UNIT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, extra, size = TaskContext.get().partitionId(), 0, [], [], 0

        def out() -> pa.RecordBatch:
            data = b"".join(t for _, t in held)
            return pa.RecordBatch.from_pylist(
                [{"unit": (part << 32) + number, "doc_ids": [i for i, _ in held], "digests": [hashlib.md5(t).digest() for _, t in held], "lengths": [len(t) for _, t in held], "extra": _ipc(extra) if carry else None, "bytes": zstandard.ZstdCompressor(level=1).compress(data)}],
                pa.schema([("unit", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int64())), ("extra", pa.binary()), ("bytes", pa.binary())]),
            )

        for b in batches:
            others = pa.RecordBatch.from_arrays(b.columns[2:], [str(k) for k in range(len(carry))]) if carry else None
            each = others.nbytes // b.num_rows if carry and b.num_rows else 0
            first = 0
            for k, (i, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
                held.append((NULL if i is None else i, (t.as_py() or "").encode()))
                size += len(held[-1][1]) + each
                if size >= unit_bytes:
                    if carry:
                        extra.append(others.slice(first, k + 1 - first))
                    yield out()
                    number, held, extra, size, first = number + 1, [], [], 0, k + 1
            if carry and first < b.num_rows:
                extra.append(others.slice(first))
        if held:
            yield out()

    # columns go by place, so that names can't clash
    return docs.select(F.col("doc_id").cast("long"), F.col("text"), *(F.col(f"`{c}`").alias(f"carried_{k}") for k, c in enumerate(carry))).mapInArrow(run, "unit long, doc_ids array<long>, digests array<binary>, lengths array<long>, extra binary, bytes binary")


class Unit:
    """A unit's joined bytes and, per byte, the document's number in the unit."""

    def __init__(self, row: dict):
        self.unit, self.ids = row["unit"], np.array(row["doc_ids"], np.int64)
        self.lengths = np.array(row["lengths"], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.raw = zstandard.ZstdDecompressor().decompress(row["bytes"], max_output_size=int(self.lengths.sum()) + 1) if self.lengths.sum() else b""
        self.data = np.frombuffer(self.raw, np.uint8)
        self.digests = row["digests"]

    def parts(self, skip: np.ndarray, most: int = 8 << 20) -> Iterator[tuple[np.ndarray, ...]]:
        """Anchors (first window, windows, position, hash, document number) of the documents
        not in ``skip``, in parts of bounded size that overlap by a window less one."""
        keep = np.flatnonzero(~skip & (self.lengths >= WINDOW))
        ends = self.starts + self.lengths
        inside = np.zeros(len(self.ids), bool)
        inside[keep] = True
        for lo in range(0, len(self.data), most):
            hi = min(len(self.data), lo + most + WINDOW - 1)
            doc = np.repeat(np.arange(len(self.ids)), np.maximum(np.minimum(ends, hi) - np.maximum(self.starts, lo), 0))
            first, count, at, g = anchors(self.data[lo:hi], doc)
            of = doc[first]
            ok = inside[of]
            yield first[ok] + lo, count[ok], at[ok] + lo, g[ok], of[ok]

    def copies_inside(self) -> np.ndarray:
        """Documents whose text one of a smaller id in this unit has too. Rows of equal id are each
        taken apart, as they do not cover each other and lose the same passages."""
        least: dict[bytes, int] = {}
        for d, i in zip(self.digests, self.ids.tolist()):
            least[d] = min(least.get(d, i), i)
        return self.ids > np.array([least[d] for d in self.digests], np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _bucket(g: np.ndarray, buckets: int) -> np.ndarray:
    return ((g >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def shared_anchors(packed: DataFrame, buckets: int, every: int, hot_units: int = 2000) -> DataFrame:
    """unit, bucket, keys (low hash words met in another unit), hot (those met in ``hot_units`` units
    or more); unit -1 holds sampled leads."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            u = Unit(row)
            got = list(u.parts(u.copies_inside()))
            g = np.unique(np.concatenate([p[3] for p in got] or [np.zeros(0, U64)]))
            b = _bucket(g, buckets)
            cut = np.searchsorted(b, np.arange(buckets + 1))
            low = g.astype(np.uint32)
            rows = [(u.unit, k, np.sort(low[x:y]).tobytes()) for k, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if x < y]
            at = np.concatenate([p[2][p[3] % U64(every) == 0] for p in got] or [np.zeros(0, np.int64)])
            if len(at):
                rows.append((u.unit, -1, b"".join(u.raw[i : i + LEAD] for i in at.tolist())))
            yield pa.RecordBatch.from_pylist([dict(zip(("unit", "bucket", "keys"), r)) for r in rows], pa.schema([("unit", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary())]))

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return pd.DataFrame({"unit": -1, "bucket": -1, "keys": [b"".join(pdf["keys"])], "hot": [b""]})
        keys = [np.frombuffer(k, np.uint32) for k in pdf["keys"]]
        merged = np.sort(np.concatenate(keys))
        new = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        count, merged = np.diff(np.append(new, len(merged))), merged[new]
        twice, hot = merged[count > 1], merged[count >= hot_units]
        out = [(int(u), int(key[0]), k[np.isin(k, twice, assume_unique=True)].tobytes(), k[np.isin(k, hot, assume_unique=True)].tobytes()) for u, k in zip(pdf["unit"], keys)]
        return pd.DataFrame([r for r in out if r[2]], columns=["unit", "bucket", "keys", "hot"])

    sent = packed.mapInArrow(send, "unit long, bucket long, keys binary")
    return sent.groupBy("bucket").applyInPandas(meet, "unit long, bucket long, keys binary, hot binary")


def _in(keys: list[tuple[int, bytes]], g: np.ndarray, buckets: int) -> np.ndarray:
    """Which hashes are among the keys of their bucket."""
    if not keys:
        return np.zeros(len(g), bool)
    full = np.concatenate([np.frombuffer(k, np.uint32).astype(U64) | (U64(b) << U64(32)) for b, k in keys])
    return np.isin((g & U64(0xFFFFFFFF)) | (_bucket(g, buckets).astype(U64) << U64(32)), full)


def covered(units_shared: DataFrame, buckets: int, limits: list[bytes], known: bytes = b"", parts: int = 1) -> DataFrame:
    """unit, spans: packed (start, end) of covered bytes, from units with ``shared`` (bucket,
    keys, hot) and ``copies`` (numbers of documents that copy a whole smaller one). Each range
    between ``limits`` has ``parts`` buckets. ``known`` is sample text that what is sent is
    compressed against."""
    edges = np.array(limits, f"S{LEAD}")
    places = (len(limits) + 1) * parts

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            u, rows = Unit(row), []
            skip = u.copies_inside()
            skip[row["copies"] or []] = True
            shared = [(s["bucket"], s["keys"]) for s in row["shared"] or []]
            hot = [(s["bucket"], s["hot"]) for s in row["shared"] or [] if s["hot"]]
            got = [np.concatenate(x) for x in zip(*u.parts(skip))] or [np.zeros(0, np.int64)] * 5
            first, count, at, g, doc = got
            if len(g):
                ids = u.ids[doc]
                group = np.unique(g, return_inverse=True)[1]
                out = _in(shared, g, buckets)
                pick = out | _several(group, ids)
                first, count, at, ids, out, hotly = first[pick], count[pick], at[pick], ids[pick], out[pick], _in(hot, g[pick], buckets)
                if hotly.any():  # single windows of anchors that a large part of all units has
                    n = np.where(hotly, count, 1)
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    first, at, ids, out, count = np.repeat(first, n) + step, np.repeat(at, n), np.repeat(ids, n), np.repeat(out, n), np.repeat(np.where(hotly, 1, count), n)
                    hotly = np.repeat(hotly, n)
            if len(first):
                strings = _cut(u.data, first, count)
                same = ranks(np.concatenate([strings, count[:, None].astype(np.uint8)], axis=1))
                done = ids > _least(same, ids)
                rows.append((0, u.unit, _pack(first[done], first[done] + count[done] + WINDOW - 1)))
                lead = u.data[at[:, None] + np.arange(LEAD)]
                go = ~done & (out | _several(ranks(lead), same))
                lead = np.ascontiguousarray(lead[go])
                where = np.searchsorted(edges, lead.view(f"S{LEAD}").ravel(), side="right") * parts
                if parts > 1:
                    where += ((lead.view("<u8").reshape(-1, LEAD // 8) * ODD).sum(axis=1, dtype=U64) * ODD[0] >> U64(33)).astype(np.int64) % parts
                hotly = hotly[go]
                if hotly.any():
                    text = np.ascontiguousarray(strings[go][hotly])
                    words = _words(text.ravel()).reshape(text.shape)[:, [0, 8, 16, 24, 32, 40, 42]]
                    mixed = ((words * U64(0x9E3779B97F4A7C15)) ^ (words >> U64(23))).sum(axis=1, dtype=U64) * U64(0xBF58476D1CE4E5B9) >> U64(33)
                    where[hotly] = (where[hotly] + (mixed % U64(places)).astype(np.int64)) % places
                for b in np.unique(where).tolist():
                    k = np.flatnonzero(go)[where == b]
                    rows.append((b + 1, u.unit, _pack(np.diff(first[k], prepend=0), (at[k] - first[k]).astype(np.uint8), count[k].astype(np.uint8), np.diff(ids[k], prepend=0), strings[k], known=known)))
            yield pa.RecordBatch.from_pylist([{"bucket": b, "unit": i, "blob": x} for b, i, x in rows], pa.schema([("bucket", pa.int64()), ("unit", pa.int64()), ("blob", pa.binary())]))

    width = 2 * WINDOW - LEAD

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(b, np.int64, np.uint8, np.uint8, np.int64, np.uint8, known=known) for b in pdf["blob"]]
        for p in parts:
            p[0], p[3] = np.cumsum(p[0]), np.cumsum(p[3])
        of = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        first, before, count, ids = (np.concatenate([p[i] for p in parts]) for i in range(4))
        strings = np.concatenate([p[4].reshape(-1, width) for p in parts])
        count, before = count.astype(np.int64), before.astype(np.int64)
        lead = strings[np.arange(len(strings))[:, None], before[:, None] + np.arange(LEAD)]
        group = ranks(lead)
        live = _several(group, ids)
        of, first, count, ids, strings, group = of[live], first[live], count[live], ids[live], strings[live], group[live]
        same = ranks(np.concatenate([strings, count[:, None].astype(np.uint8)], axis=1))
        done = ids > _least(same, ids)
        spans = [(of[done], first[done], first[done] + count[done] + WINDOW - 1)]
        rest = _several(group, same)
        of, first, count, ids, strings = of[rest], first[rest], count[rest], ids[rest], strings[rest]
        order = np.argsort(group[rest], kind="stable")
        of, first, count, ids, strings, group = of[order], first[order], count[order], ids[order], strings[order], group[rest][order]
        # equal windows have equal leads: some whole leads at a time bound the memory
        turn = np.cumsum(count) // 50_000
        turn = turn[np.searchsorted(group, group)] if len(turn) else turn
        for t in np.unique(turn).tolist():
            mine = np.flatnonzero(turn == t)
            n = count[mine]
            row, step = np.repeat(mine, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            windows = strings[row[:, None], step[:, None] + np.arange(WINDOW)]
            hit = ids[row] > _least(ranks(windows), ids[row])
            at = first[row[hit]] + step[hit]
            spans.append((of[row[hit]], at, at + WINDOW))
        o, a, z = (np.concatenate(x) for x in zip(*spans))
        out = [(int(pdf["unit"].iloc[k]), _pack(a[o == k], z[o == k])) for k in np.unique(o).tolist()]
        return pd.DataFrame(out, columns=["unit", "spans"])

    sent = units_shared.mapInArrow(send, "bucket long, unit long, blob binary")
    own = F.when(F.col("bucket") > 0, F.col("bucket")).otherwise(-1 - F.pmod("unit", F.lit(places)))

    def either(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:  # what units settled themselves passes through
            return pdf[["unit", "blob"]].rename(columns={"blob": "spans"})
        return meet(key, pdf)

    return sent.withColumn("bucket", own).groupBy("bucket").applyInPandas(either, "unit long, spans binary")


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans that overlap or touch."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]])) if len(start) else np.zeros(0, np.int64)
    return start[new], end[np.append(new[1:], len(end)) - 1] if len(new) else end[:0]


def remove_repeats(docs: DataFrame, outputs: tuple[str, ...] = ("n_bytes", "n_removed", "n_spans", "kept")) -> DataFrame:
    """doc_id and the outputs asked for: n_bytes, n_removed, n_spans, starts and ends (of the
    removed runs), kept (the remaining bytes), kept_sha256."""
    fields = {"doc_id": (pa.int64(), "long"), "n_bytes": (pa.int64(), "long"), "n_removed": (pa.int64(), "long"), "n_spans": (pa.int64(), "long"), "starts": (pa.list_(pa.int64()), "array<long>"), "ends": (pa.list_(pa.int64()), "array<long>"), "kept": (pa.binary(), "binary"), "kept_sha256": (pa.string(), "string")}
    names = ("doc_id", *outputs)

    def rows(unit: Unit, cut: list[tuple[np.ndarray, np.ndarray, bytes]], extra: bytes | None) -> pa.RecordBatch:
        got = []
        for k, (a, z, kept) in enumerate(cut):
            r = {"doc_id": None if unit.ids[k] == NULL else int(unit.ids[k]), "n_bytes": int(unit.lengths[k]), "n_removed": int((z - a).sum()), "n_spans": len(a), "starts": a, "ends": z, "kept": kept}
            if "kept_sha256" in outputs:
                r["kept_sha256"] = hashlib.sha256(kept).hexdigest()
            got.append(r)
        return pa.RecordBatch.from_arrays([pa.array([r[o] for r in got], fields[o][0]) for o in names], list(names))

    return _cut_units(docs, (), rows, ", ".join(f"{o} {fields[o][1]}" for o in names))


def _cut_units(docs: DataFrame, carry: tuple[str, ...], rows: Callable, schema: StructType | str) -> DataFrame:
    """What ``rows`` makes of each unit, of the removed runs and remaining bytes of its documents,
    and of the carried columns."""
    packed = spool(units(docs, carry), "suffix-units")
    total = packed.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_BYTES))
    every = max(1, total // 16 // SAMPLES)
    shared = spool(shared_anchors(packed.drop("extra"), buckets, every), "suffix-shared")
    leads = sorted(r["keys"][i : i + LEAD] for r in shared.where("unit = -1").select("keys").collect() for i in range(0, len(r["keys"]), LEAD))
    ranges = min(buckets, RANGES)
    limits = sorted({leads[len(leads) * i // ranges] for i in range(1, ranges)}) if leads else []
    parts = math.ceil(buckets / (len(limits) + 1))

    each = packed.select("unit", F.posexplode(F.arrays_zip("doc_ids", "digests", "lengths")).alias("k", "d")).select("unit", "k", F.col("d.doc_ids").alias("id"), F.col("d.digests").alias("digest")).where(F.col("d.lengths") >= WINDOW)
    least = each.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n")).where("least < most").drop("most")
    copies = join_hot(each, spool(least, "suffix-least"), "digest").where("id > least").groupBy("unit").agg(F.sort_array(F.collect_list("k")).alias("copies"))
    copies = spool(copies, "suffix-copies")
    hints = shared.where("unit >= 0").groupBy("unit").agg(F.collect_list(F.struct("bucket", "keys", "hot")).alias("shared"))
    spans = covered(packed.drop("extra").join(hints.join(copies, "unit", "full"), "unit", "left"), buckets, limits, b"".join(leads)[: 110 << 10], parts)
    spans = spans.groupBy("unit").agg(F.collect_list("spans").alias("spans"))
    joined = packed.join(spans, "unit", "left").join(copies, "unit", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            u = Unit(row)
            pairs = [_unpack(s, np.int64, np.int64) for s in row["spans"] or []]
            copied = np.array(row["copies"] or [], np.int64)
            start = np.concatenate([*(p[0] for p in pairs), u.starts[copied]])
            end = np.concatenate([*(p[1] for p in pairs), u.starts[copied] + u.lengths[copied]])
            # spans never cross documents, but those of neighbours may touch
            doc = np.searchsorted(u.starts + u.lengths, start, side="right")
            order = np.argsort(doc, kind="stable")
            lows, got = np.searchsorted(doc[order], np.arange(len(u.ids) + 1)), []
            for k in range(len(u.ids)):
                s, base = order[lows[k] : lows[k + 1]], int(u.starts[k])
                a, z = merge_spans(start[s] - base, end[s] - base)
                keep = [0, *np.stack([a, z], axis=1).ravel().tolist(), int(u.lengths[k])]
                got.append((a, z, b"".join(u.raw[base + x : base + y] for x, y in zip(keep[::2], keep[1::2]))))
            yield rows(u, got, row["extra"])

    return joined.mapInArrow(cut, schema)


def strip_repeats(docs: DataFrame) -> DataFrame:
    """The rows, in all their columns, with repeated passages cut from text (and characters that a
    cut has broken) and n_chars, where there is such a column, counted anew. A null text stays
    null; all other columns, of any name and type, are carried as they are."""
    names = docs.columns
    carry = tuple(c for c in names if c != "text")
    schema = docs.schema

    def rows(unit: Unit, cut: list[tuple[np.ndarray, np.ndarray, bytes]], extra: bytes) -> pa.RecordBatch:
        held = pa.ipc.open_stream(extra).read_all().combine_chunks()
        columns = {c: held.column(k) for k, c in enumerate((*carry, None))}
        texts = [kept.decode(errors="ignore") if there else None for (_, _, kept), there in zip(cut, columns[None].to_pylist())]
        columns["text"] = pa.array(texts, pa.string())
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([len(t or "") for t in texts], pa.int64()).cast(columns["n_chars"].type)
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in map(columns.get, names)], names)

    there = "text is there"
    while there in names:
        there += "?"
    return _cut_units(docs.withColumn(there, F.col("text").isNotNull()), (*carry, there), rows, schema)
