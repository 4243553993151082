"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

An item leaks into a document if some window of it has edit similarity of at least
``similarity`` (1 - distance / item length, over lower-cased text with single spaces, in UTF-8
bytes). Item-sized windows are embedded by CGK random walks, which turn a small edit distance
into a small Hamming distance: a walk reads a byte at every step and a random function of step
and byte tells whether it moves on. Every repetition walks anew and samples a few of its steps; a
window and an item that read the same bytes at all of them in any repetition are candidates, and
only those are verified, exactly: many at a time in a band of diagonals, and what is left by a
bit-parallel approximate match. Repetitions are as many as reach ``recall`` for windows whose walks
agree on ``agree`` of their steps. A walk is stopped at its first sampled step where the bytes differ.

To embed every window of every document would take some thousand times longer than reading them.
A window is embedded if, within as many diagonals as the item may have edits, document and item
share enough ``GRAM``-byte strings, whole or parted by one edit: ``SEEDS``, or one for each
``SPREAD`` bytes of a longer item. Windows of one place are ``APART`` bytes from each other.

The items are read in blocks of about ``block_bytes``; each block goes over all documents. Its
index, some sixty times its bytes, is built once and broadcast.

Defined results: null and empty texts and items match nothing; null ids are reported like others;
items shorter than ``SHORT`` bytes are looked for by pieces of which one must be left as it is;
a group of texts whose candidates the walks all refuse has no leaks, so results do not depend on
how rows are partitioned; repeated documents are reported each, repeated items by their smallest id; of several matches of
an item in a document the one of least distance is told, the first of equals; very long texts are
read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM, SEEDS, SPREAD, APART, SHORT = 8, 2, 10, 8, 32
U64 = np.uint64


def normal(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode()


def grams(data: np.ndarray, gap: int) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each position on, with ``gap`` bytes left out amid them."""
    n = max(len(data) - GRAM - gap + 1, 0)
    if not n:
        return np.zeros(0, U64)
    half = np.ndarray((n + GRAM // 2 + gap,), "<u4", np.ascontiguousarray(data), 0, (1,))
    h = (half[:n] | (half[GRAM // 2 + gap :].astype(U64) << U64(32))) * U64(0x9E3779B97F4A7C15)
    return (h ^ (h >> U64(29))) * U64(0xC2B2AE3D27D4EB4F)


def edits(item: bytes, text: bytes) -> tuple[int, int]:
    """The least edit distance of ``item`` to any part of ``text``, and where that part ends."""
    m, masks = len(item), {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, (m, 0)
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        up, down = mh | ~(xv | ph) & full, ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best


def _places(data: bytes, piece: bytes) -> Iterator[int]:
    at = data.find(piece)
    while at >= 0:
        yield at
        at = data.find(piece, at + 1)


def within(items: list[bytes], parts: list[bytes], slack: np.ndarray) -> np.ndarray:
    """Which items are at most ``slack`` edits from a piece of their part. A part is longer than its
    item by the diagonals that the piece may lie on; newlines stand for what is beyond the text."""
    ok = np.zeros(len(items), bool)
    by = sorted(range(len(items)), key=lambda i: ((len(parts[i]) - len(items[i])).bit_length(), len(items[i])))
    lo = 0
    while lo < len(by):
        some = by[lo : lo + 256]
        some = some[: max(1, (1 << 20) // max(len(parts[i]) - len(items[i]) + 1 for i in some))]  # bounds the memory
        who, lo = np.array(some), lo + len(some)
        rows = max(len(items[i]) for i in who.tolist())
        length = np.array([len(items[i]) for i in who.tolist()])
        band = max(len(parts[i]) - len(items[i]) for i in who.tolist()) + 1
        lay = lambda texts, width, fill: np.frombuffer(b"".join(t.ljust(width, fill) for t in texts), np.uint8).reshape(-1, width).T.copy()
        x, y = lay([items[i] for i in who.tolist()], rows, b"\n"), lay([parts[i] for i in who.tolist()], rows + band, b"\n")
        limit, ramp = slack[who], np.arange(band, dtype=np.int16)[:, None]
        d = np.zeros((band + 1, len(who)), np.int16)
        d[band] = np.int16(1 << 14)
        for i in range(rows):
            best = np.minimum(d[:-1] + (y[i : i + band] != x[i]), d[1:] + np.int16(1)) - ramp
            d[:-1] = np.minimum.accumulate(best, axis=0) + ramp
            if i % 16 == 15 or (length == i + 1).any():
                least = d[:-1].min(axis=0)
                ok[who[(length == i + 1) & (least <= limit)]] = True
                live = (length > i + 1) & (least <= limit)
                if not live.all():
                    who, length, limit, x, y, d = who[live], length[live], limit[live], x[:, live], y[:, live], d[:, live]
                    if not len(who):
                        break
    return ok


class Walks:
    """CGK embeddings of byte windows, read at the sampled steps of every repetition."""

    def __init__(self, recall: float, agree: float, sampled: int, seed: int = 7):
        self.times = max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree**sampled)))
        self.seed, self.held = seed, []
        self.share = np.sort(np.random.default_rng(seed).random((self.times, sampled)), axis=1)

    def moves(self, step: int, kept: int = 1024) -> np.ndarray:
        """Whether a walk moves on, by repetition and byte; never past the end of a window. The tables
        of the first steps are kept."""
        if step < len(self.held):
            return self.held[step]
        table = np.random.default_rng((self.seed, step)).integers(0, 2, (self.times, 256), np.uint8)
        table[:, 0] = 0
        if step == len(self.held) < kept:
            self.held.append(table.ravel())
        return table.ravel()

    def steps(self, lengths: np.ndarray, sample: int) -> np.ndarray:
        """The step of a repetition's ``sample``-th reading (rows: lengths; columns: repetitions)."""
        return (self.share[:, sample] * 2 * lengths[:, None]).astype(np.int64)

    def read(self, flat: np.ndarray, at: np.ndarray, times: np.ndarray, step: np.ndarray) -> np.ndarray:
        """The byte that each walk, of a repetition ``times`` from a place ``at``, reads at a step."""
        order = np.argsort(step, kind="stable")
        place, row, step = at[order].astype(np.intp), (times[order] * 256).astype(np.intp), step[order]
        cut = np.searchsorted(step, np.arange(int(step[-1]) + 2)) if len(step) else [0]
        out = np.zeros(len(step), np.uint8)
        cut, spare = [int(c) for c in cut], np.empty_like(row)
        for j in range(len(cut) - 1):
            a, z = cut[j], cut[j + 1]
            byte = flat.take(place[a:], mode="clip")
            out[a:z] = byte[: z - a]
            seen = np.add(row[z:], byte[z - a :], out=spare[z:])
            place[z:] += self.moves(j).take(seen, mode="clip")
        back = np.empty_like(out)
        back[order] = out
        return back

    def samples(self, windows: list[bytes]) -> np.ndarray:
        """What each repetition reads (windows x repetitions x samples)."""
        lengths = np.array([len(w) for w in windows], np.int64)
        flat = np.frombuffer(b"".join(w + b"\0" for w in windows) or b"\0", np.uint8)
        starts = np.cumsum(lengths + 1) - lengths - 1
        n, out = len(windows), np.zeros((len(windows), *self.share.shape), np.uint8)
        times = np.tile(np.arange(self.times), n)
        for k in range(self.share.shape[1]):
            out[:, :, k] = self.read(flat, np.repeat(starts, self.times), times, self.steps(lengths, k).ravel()).reshape(n, self.times)
        return out

    def alike(self, windows: list[bytes], lengths: np.ndarray, item: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which windows read what their item (a row of ``own``) does in some repetition. lengths: of
        the items; a window is as long, or shorter where the text ends."""
        flat = np.frombuffer(b"".join(w + b"\0" for w in windows) or b"\0", np.uint8)
        size = np.array([len(w) + 1 for w in windows], np.int64)
        starts = np.cumsum(size) - size
        who, times = np.repeat(np.arange(len(windows)), self.times), np.tile(np.arange(self.times), len(windows))
        for k in range(self.share.shape[1]):
            step = (self.share[times, k] * 2 * lengths[who]).astype(np.int64)
            same = self.read(flat, starts[who], times, step) == own[item[who], times, k]
            who, times = who[same], times[same]
        out = np.zeros(len(windows), bool)
        out[who] = True
        return out


class Index:
    """Grams and signatures of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]], similarity: float, recall: float, agree: float, sampled: int):
        self.items, self.similarity = items, similarity
        self.lengths = np.array([len(t) for _, t in items], np.int64)
        self.walks = Walks(recall, agree, sampled)
        self.slack = np.floor(self.lengths * (1 - similarity) + 1e-9).astype(np.int64)
        self.seeds = np.where(self.lengths < SHORT, 1, np.maximum(SEEDS, self.lengths // SPREAD))
        hashes, item, offset = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (_, t) in enumerate(items):
            if len(t) >= SHORT:
                for gap in (0, 1):
                    g = grams(np.frombuffer(t, np.uint8), gap)
                    hashes.append(g), item.append(np.full(len(g), k)), offset.append(np.arange(len(g)))
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        h, self.item, self.offset = h[order], np.concatenate(item)[order], np.concatenate(offset)[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        self.hash, self.first, self.count = h[first], first, np.diff(np.append(first, len(h)))
        self.bits = 22
        self.known = np.zeros(1 << self.bits, bool)
        top = self.hash >> U64(64 - self.bits)
        self.known[top] = True
        self.slot = np.zeros(1 << self.bits, np.int32)  # the first hash with these leading bits
        self.slot[top[::-1]] = np.arange(len(top), dtype=np.int32)[::-1]
        self.depth = int(np.unique(top, return_counts=True)[1].max(initial=0))
        self.short = [(k, t) for k, (_, t) in enumerate(items) if 0 < len(t) < SHORT and not self.slack[k]]
        self.pieces = []
        for k, (_, t) in enumerate(items):
            if len(t) < SHORT and (n := int(self.slack[k]) + 1) > 1:  # n - 1 edits leave one of n pieces as it is
                self.pieces += [(k, i * len(t) // n, t[i * len(t) // n : (i + 1) * len(t) // n]) for i in range(n)]
        self.own = self.walks.samples([t for _, t in items])

    def windows(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Item, document number, place and group of each window where enough grams are shared; a
        group is of one item and document on neighbouring diagonals."""
        found = []
        for gap in (0, 1):
            h = grams(np.frombuffer(data, np.uint8), gap)
            top = h >> U64(64 - self.bits)
            at = np.flatnonzero(self.known.take(top))
            h, e = h[at], self.slot.take(top[at]).astype(np.int64)
            for k in range(self.depth):
                ok = (e + k < len(self.hash)) & (self.hash.take(e + k, mode="clip") == h)
                found.append((at[ok], e[ok] + k))
        at, e = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 2, *found))
        n = self.count[e]
        entry = np.repeat(self.first[e], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, place = self.item[entry], np.repeat(at, n) - self.offset[entry]
        at = np.repeat(at, n)
        if self.pieces:
            more = [(k, i, i - o) for k, o, piece in self.pieces for i in _places(data, piece)]
            k, i, o = np.array(more, np.int64).reshape(-1, 3).T
            item, at, place = np.concatenate([item, k]), np.concatenate([at, i]), np.concatenate([place, o])
        # sorted by document, item and place as one number: places begin before a text by an item's length at most
        doc = np.searchsorted(starts, at, side="right") - 1
        least = int(place.min(initial=0))
        wide = int(place.max(initial=0)) - least + 1
        key = np.sort((doc * len(self.items) + item) * wide + (place - least))
        owner, place = np.divmod(key, wide)
        doc, item = np.divmod(owner, len(self.items))
        place += least
        if not len(item):
            return item, doc, place, item
        item, doc, place = self.dense(item, doc, place)
        other = np.concatenate([[True], (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] - place[:-1] > self.slack[item[1:]])])[: len(item)]
        group = np.cumsum(other)
        low = place[np.flatnonzero(other)][group - 1] if len(item) else place
        step = (place - low) // APART
        keep = other | (np.diff(step, prepend=0) != 0)
        return item[keep], doc[keep], place[keep], group[keep]

    def dense(self, item: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted shared strings those with enough others on the diagonals nearby: first in chains,
        then within the slack on either side."""
        far = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] - place[:-1] > self.slack[item[1:]])
        chain = np.cumsum(np.concatenate([[False], far]))
        keep = np.bincount(chain)[chain] >= self.seeds[item]
        item, doc, place, chain = item[keep], doc[keep], place[keep], chain[keep]
        key = chain * (int(place.max(initial=0)) - min(int(place.min(initial=0)), 0) + 2 * int(self.slack.max(initial=0)) + 1) + place
        near = np.searchsorted(key, key + self.slack[item], "right") - np.searchsorted(key, key - self.slack[item])
        keep = near >= self.seeds[item]
        return item[keep], doc[keep], place[keep]

    def leaks(self, texts: list[bytes]) -> dict[tuple[int, int], tuple[int, int]]:
        """(text number, item number) -> (distance, end of the match in the text)."""
        data = b"\n".join(texts) + b"\n"  # no text holds a newline, and so no gram crosses one
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        item, doc, place, group = self.windows(data, starts)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for k, t in self.short:
            for d, text in enumerate(texts):
                if (i := text.find(t)) >= 0:
                    found[d, k] = (0, i + len(t))
        if len(item):
            place -= starts[doc]
            cut = [texts[d][max(p, 0) : max(p, 0) + n] for d, p, n in zip(doc.tolist(), place.tolist(), self.lengths[item].tolist())]
            hit = np.zeros(len(item), bool)
            for lo in range(0, len(item), 2048):
                hit[lo : lo + 2048] = self.walks.alike(cut[lo : lo + 2048], self.lengths[item[lo : lo + 2048]], item[lo : lo + 2048], self.own)
            item, doc, place, group = item[hit], doc[hit], place[hit], group[hit]
            first = np.flatnonzero(np.diff(group, prepend=-1))  # none where the walks refuse all windows
            last = np.append(first[1:], len(group))[: len(first)] - 1
            tries, parts = [], []
            for k, d, p, q in zip(item[first].tolist(), doc[first].tolist(), place[first].tolist(), place[last].tolist()):
                t, slack, text = self.items[k][1], int(self.slack[k]), texts[d]
                if (d, k) in found:
                    continue
                if (i := text.find(t)) >= 0:
                    found[d, k] = (0, i + len(t))
                    continue
                lo = max(0, p - slack)
                part = text[lo : max(0, q + len(t) + slack)]
                tries.append((k, d, lo, part))
                parts.append((b"\n" * max(0, slack - p) + part).ljust(q - p + len(t) + 2 * slack, b"\n"))
            near = within([self.items[x[0]][1] for x in tries], parts, self.slack[[x[0] for x in tries]]) if tries else []
            for (k, d, lo, part), ok in zip(tries, near):
                if ok:
                    distance, end = edits(self.items[k][1], part)
                    if distance <= self.slack[k] and ((d, k) not in found or distance < found[d, k][0]):
                        found[d, k] = (distance, lo + end)
        return found


def _indexes(benchmark: DataFrame, similarity: float, recall: float, agree: float, sampled: int, block_bytes: int) -> Iterator[Broadcast[Index]]:
    """The distinct items, with their smallest ids, as indexes over blocks of bounded size."""
    items = benchmark.where("length(text) > 0").groupBy("text").agg(F.min("item_id").alias("item_id"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for b in range(blocks):
        least: dict[bytes, int] = {}
        for r in sorted(items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0)):
            least.setdefault(normal(r["text"]), r["item_id"])
        yield benchmark.sparkSession.sparkContext.broadcast(Index([(i, t) for t, i in least.items() if t], similarity, recall, agree, sampled))


def _leaks(index: Index, column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, int, int]]:
    """Row, item number, distance and end of each leak; some texts at a time."""
    texts, first, size = [], 0, 0
    for k in range(len(column) + 1):
        if k == len(column) or size > most:
            for (d, i), (n, e) in sorted(index.leaks(texts).items() if texts else []):
                yield first + d, i, n, e
            texts, first, size = [], k, 0
        if k < len(column):
            texts.append(normal(column[k].as_py()))
            size += len(texts[-1])


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.95, agree: float = 0.3, sampled: int = 2, block_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, item_id, distance, similarity, match_end: each document's leaked items."""
    out = None
    for sent in _indexes(benchmark, similarity, recall, agree, sampled, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                got = [(ids[k], *(index.items[i][0], n, 1 - n / len(index.items[i][1]), e)) for k, i, n, e in _leaks(index, batch.column(1))]
                cols = list(zip(*got)) or [()] * 5
                kinds = [batch.column(0).type, pa.int64(), pa.int64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "item_id", "distance", "similarity", "match_end"])

        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, distance long, similarity double, match_end long")
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.95, agree: float = 0.3, sampled: int = 2, block_bytes: int = 2 << 20) -> DataFrame:
    """The rows, in all their columns, that hold no item. Rows are judged where they are, so nothing
    is exchanged and rows without an id are judged like others; a block of items reads what the
    blocks before it have left."""
    where = docs.columns.index("text")
    for sent in _indexes(benchmark, similarity, recall, agree, sampled, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for k, *_ in _leaks(index, batch.column(where)):
                    clean[k] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
