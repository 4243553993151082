"""Byte-level BPE encoding and decoding over a vectorised pre-tokeniser.

Texts of a batch become one array of code points, each mapped to a symbol: its class (letter,
number, other, white space) with one character of look-ahead where the pattern needs it. Ten
states read the symbols. Every symbol is a function from state to state; the functions under
composition form a small monoid whose elements are numbered and whose product is a table. A
two-level scan (within blocks side by side, then over block products) yields the state before
each character, and from it where pre-tokens begin, without a regular expression.

Pre-tokens are merged by rank and cached; byte offsets of the tokens are kept for decoding.

Defined results: null text counts as empty and has no tokens; null ids are kept; a very long
text is cut wherever the pattern has a boundary for certain, so its pieces are bounded but for
a single run of letters, of numbers or of white space, which is one pre-token and taken whole;
of pairs of equal rank the leftmost merges first; repeated rows stay; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DOC, LETTER, NUMBER, OTHER, GLUE, LAST, MID, ONE, TWO = range(9)
START, IN_L, IN_N, IN_O, IN_S, GLUED, WANT1, WANT2, DONE, LONE = range(10)
#: symbol -> (state after, or a state for each state before; states from which no pre-token begins here)
_AFTER = {
    DOC: ({}, START, ()),
    LETTER: ({WANT1: DONE, WANT2: WANT1}, IN_L, (IN_L, GLUED, WANT1, WANT2)),
    NUMBER: ({}, IN_N, (IN_N, GLUED)),
    OTHER: ({}, IN_O, (IN_O, GLUED)),
    GLUE: ({}, GLUED, ()),
    LAST: ({}, LONE, ()),
    MID: ({}, IN_S, (IN_S,)),
    ONE: ({IN_O: IN_O, GLUED: IN_O}, WANT1, (IN_O, GLUED)),
    TWO: ({IN_O: IN_O, GLUED: IN_O}, WANT2, (IN_O, GLUED)),
}
#: White space of Unicode; fixed values.
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WIDTH = 64
NONE = np.int32(2**31 - 1)
LONG = 1 << 20


@functools.cache
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[_SPACES] = MID
    return out


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Element of each symbol, product table, states each element leads to, begins[state, symbol]."""
    step = {s: tuple(own.get(q, to) for q in range(10)) for s, (own, to, _) in _AFTER.items()}
    elements = [tuple(range(10)), *dict.fromkeys(step.values())]
    number = {f: i for i, f in enumerate(elements)}
    for f in elements:  # grows while it is walked, until closed
        for g in step.values():
            fg = tuple(g[q] for q in f)
            if fg not in number:
                number[fg] = len(elements)
                elements.append(fg)
    size = len(elements)
    assert size <= 256
    product = np.zeros((256, 256), np.uint8)
    for i, f in enumerate(elements):
        for j, g in enumerate(elements):
            product[i, j] = number[tuple(g[q] for q in f)]
    begins = np.array([[q not in _AFTER[s][2] for s in range(9)] for q in range(10)])
    return np.array([number[step[s]] for s in range(9)], np.uint8), product.ravel(), np.array(elements, np.uint8), begins


def _times(a: np.ndarray, b: np.ndarray, product: np.ndarray) -> np.ndarray:
    return product[(a.astype(np.uint16) << np.uint16(8)) | b]


def _states(elements: np.ndarray) -> np.ndarray:
    """The state before each symbol, by an associative scan of the symbols' elements."""
    _, product, leads, _ = _monoid()
    n, blocks = len(elements), -(-len(elements) // WIDTH)
    x = np.zeros(blocks * WIDTH, np.uint8)
    x[:n] = elements
    x = np.ascontiguousarray(x.reshape(blocks, WIDTH).T)
    for j in range(1, WIDTH):
        x[j] = _times(x[j - 1], x[j], product)
    total, reach = x[-1].copy(), 1
    while reach < blocks:
        total = np.concatenate([total[:reach], _times(total[:-reach], total[reach:], product)])
        reach *= 2
    into = np.concatenate([[START], leads[total[:-1], START]]).astype(np.uint8)
    after = leads.ravel()[x.astype(np.uint16) * np.uint16(10) + into]
    return np.concatenate([[START], after.T.ravel()[: n - 1]]).astype(np.uint8)


def boundaries(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined, each followed by one separator; where pre-tokens and separators
    begin; and for each text the index of its separator among those."""
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    stops = np.cumsum([len(t) + 1 for t in texts]) - 1
    sym = _classes()[cp]
    sym[stops] = DOC
    space = sym == MID
    follows = np.append(~space[1:] & (sym[1:] != DOC), False)
    last = space & follows
    sym[last & (cp == 32)] = GLUE
    sym[last & (cp != 32)] = LAST
    q = np.flatnonzero((cp == 39) & (sym == OTHER))
    if len(q):
        pad = np.append(np.where(sym == DOC, 0, cp), [0, 0])
        x, y = pad[q + 1], pad[q + 2]
        sym[q[np.isin(x, [ord(c) for c in "stmd"])]] = ONE
        two = np.zeros(len(q), bool)
        for pair in ("re", "ve", "ll"):
            two |= (x == ord(pair[0])) & (y == ord(pair[1]))
        sym[q[two]] = TWO
    of, _, _, begins = _monoid()
    begin = begins.ravel()[_states(of[sym]).astype(np.uint16) * np.uint16(9) + sym]
    where = np.flatnonzero(begin)
    return joined, where, np.searchsorted(where, stops)


def pre_tokens(texts: list[str]) -> Iterator[list[str]]:
    """The pre-tokens of each text."""
    joined, where, stop = boundaries(texts)
    at = where.tolist()
    first = 0
    for s in stop.tolist():
        yield [joined[a:b] for a, b in zip(at[first:s], at[first + 1 : s + 1])]
        first = s + 1


def pieces(text: str, most: int = LONG, look: int = 4096) -> Iterator[str]:
    """The text cut where a pre-token begins whatever stands before: where letters, numbers or other
    characters end, except before a letter that other characters precede (a contraction)."""
    at = 0
    while len(text) - at > most:
        end = at + most
        while end < len(text):
            kind = _classes()[np.frombuffer(text[end - 1 : end + look].encode("utf-32-le", "surrogatepass"), np.uint32)]
            a, b = kind[:-1], kind[1:]
            sure = np.flatnonzero((a != MID) & (a != b) & ~((a == OTHER) & (b == LETTER)))
            if len(sure):
                end += int(sure[0])
                break
            end += len(b)
        yield text[at:end]
        at = end
    yield text[at:]


def batched(texts: list[str], most: int = LONG) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t) + 1
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


class Merges(dict):
    """Pre-token -> ids, filled as it is asked for; emptied when it holds about ``most`` bytes, and
    by its user at the end of a task, as a worker outlives its tasks."""

    def __init__(self, ranks: dict[bytes, int], most: int = 48 << 20):
        super().__init__()
        self.ranks, self.most, self.held = ranks, most, 0
        size = max(ranks.values(), default=0) + 1
        self.numbers = list(range(size))  # one object for each id
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        pairs = {}
        for whole, rank in ranks.items():
            for i in range(1, len(whole)):
                a, b = ranks.get(whole[:i]), ranks.get(whole[i:])
                if a is not None and b is not None:
                    pairs[a * size + b] = rank
        self.size, keys = size, np.array(sorted(pairs), np.int64)
        self.keys, self.merged = np.append(keys, 1 << 62), np.array([*(pairs[k] for k in keys.tolist()), NONE], np.int32)

    def clear(self) -> None:
        super().clear()
        self.held = 0

    def keep(self, piece: str, ids: tuple[int, ...]) -> None:
        self[piece] = ids
        self.held += 240 + len(piece) + 8 * len(ids)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if self.held >= self.most:
            self.clear()
        self.keep(piece, ids := self.merge(piece.encode()))
        return ids

    def learn(self, texts: list[list[str]]) -> None:
        """Merge what these pre-tokens hold that is not cached, many side by side."""
        if self.held >= self.most:
            self.clear()
        new = set().union(*texts).difference(self)
        by: dict[int, list[tuple[str, bytes]]] = {}
        for t in new:
            data = t.encode()
            if (whole := self.ranks.get(data)) is not None:
                self.keep(t, (whole,))
            elif len(data) <= 32:
                by.setdefault(-(-len(data) // 4) * 4, []).append((t, data))
        for width, held in by.items():
            for lo in range(0, len(held), 8_000):
                part = held[lo : lo + 8_000]
                for (t, _), ids in zip(part, self.merge_rows([d for _, d in part], width)):
                    self.keep(t, ids)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.merged[at], NONE)

    def merge_rows(self, rows: list[bytes], width: int) -> list[tuple[int, ...]]:
        """One merge in every row at a time: the pair of least rank, the leftmost of equals."""
        raw = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(-1, width)
        long = np.array([len(r) for r in rows])
        ids = np.full((len(rows), width + 1), -1, np.int32)
        ids[:, :width] = np.where(np.arange(width) < long[:, None], self.single[raw], -1)
        rank = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(rows))
        while True:
            sub = rank[live]
            j = sub.argmin(axis=1)
            least = sub[np.arange(len(live)), j]
            live, j, least = live[least < NONE], j[least < NONE], least[least < NONE]
            if not len(live):
                break
            cols = np.arange(width)
            shift = cols + (cols > j[:, None])
            mine, ranks = ids[live], rank[live]
            tail = np.take_along_axis(mine, shift, axis=1)
            n = np.arange(len(live))
            tail[n, j] = least
            ids[live, :width] = tail
            ids[live, width] = -1
            ranks = np.take_along_axis(np.pad(ranks, ((0, 0), (0, 1)), constant_values=NONE), shift, axis=1)
            full = ids[live]
            ranks[n, j] = self.pair_ranks(least, full[n, j + 1])
            left = j > 0
            ranks[n[left], j[left] - 1] = self.pair_ranks(full[n[left], j[left] - 1], least[left])
            rank[live] = ranks
        count = (ids >= 0).sum(axis=1).tolist()
        return [tuple(map(self.numbers.__getitem__, r[:c])) for r, c in zip(ids.tolist(), count)]

    def merge(self, data: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return (whole,)
        parts = [data[i : i + 1] for i in range(len(data))]
        if len(parts) > 64:
            return self.merge_long(parts)
        pair = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        while pair and (least := min(pair)) < 1 << 60:
            i = pair.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return tuple(ranks[p] for p in parts)

    def merge_long(self, parts: list[bytes]) -> tuple[int, ...]:
        """The same merges with a heap and links, for long pre-tokens."""
        import heapq

        n, ranks = len(parts), self.ranks
        after, ahead, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = a + b, False, after[j]
            if after[j] < n:
                ahead[after[j]] = i
            for x, y in ((ahead[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := ranks.get(parts[x] + parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return tuple(ranks[p] for p, k in zip(parts, alive) if k)


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


@functools.lru_cache(maxsize=1)
def coder(content: bytes) -> tuple[Merges, list[bytes]]:
    """The tables of a rank file, some 20 MB, kept for a worker's later tasks; what the merges
    cache is not."""
    table = parse_ranks(content)
    vocabulary = [b""] * (max(table.values(), default=-1) + 1)
    for k, v in table.items():
        vocabulary[v] = k
    return Merges(table), vocabulary


def read_ranks(path: str) -> bytes:
    """A rank file's content, read by the driver (about 1 MB) and sent to the tasks."""
    with open(path, "rb") as f:
        return f.read()


FIELDS = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "offsets": pa.list_(pa.int32()), "decoded": pa.binary(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
TYPES = {"n_tokens": "long", "ids": "array<int>", "offsets": "array<int>", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}


def decode(ids: list[int], vocabulary: list[bytes]) -> bytes:
    return b"".join(map(vocabulary.__getitem__, ids))


def encode(docs: DataFrame, ranks: bytes, outputs: tuple[str, ...] = ("n_tokens", "ids", "offsets"), id_col: str = "doc_id") -> DataFrame:
    """id_col and the outputs asked for: n_tokens; ids; offsets (byte at which each token
    begins); decoded (the bytes that the ids stand for); ids_sha256 (of the decimal ids joined
    by commas); decoded_sha256."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, vocabulary = coder(sent.value)
        lengths, names = np.array([len(v) for v in vocabulary], np.int64), [str(i) for i in range(len(vocabulary))]

        def ids_of(texts: list[str]) -> list[list[int]]:
            found = list(pre_tokens(texts))
            merges.learn(found)
            return [list(itertools.chain.from_iterable(map(merges.__getitem__, p))) for p in found]

        def results(ids: list[int]) -> dict:
            out = {"n_tokens": len(ids)}
            if "ids" in outputs:
                out["ids"] = np.array(ids, np.int32)
            if "offsets" in outputs:
                out["offsets"] = np.concatenate([[0], np.cumsum(lengths[ids])[:-1]]).astype(np.int32) if ids else []
            if "decoded" in outputs or "decoded_sha256" in outputs:
                decoded = decode(ids, vocabulary)
                out |= {"decoded": decoded if "decoded" in outputs else None, "decoded_sha256": hashlib.sha256(decoded).hexdigest()}
            if "ids_sha256" in outputs:
                out["ids_sha256"] = hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest()
            return out

        try:
            for batch in batches:
                keys = batch.column(0).to_pylist()
                for lo in range(0, batch.num_rows, 512):
                    texts = [t or "" for t in batch.column(1).slice(lo, 512).to_pylist()]
                    rows = []
                    for group in batched(texts):
                        long = group.pop() if len(group[-1]) > LONG else None  # such a text is the last of its group
                        rows += map(results, ids_of(group)) if group else []
                        if long is not None:
                            rows.append(results([i for cut in pieces(long) for i in ids_of([cut])[0]]))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + 512], batch.column(0).type), *(pa.array([r[o] for r in rows], FIELDS[o]) for o in outputs)], [id_col, *outputs])
        finally:
            merges.clear()

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, "text").mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{o} {TYPES[o]}" for o in outputs))


def decode_ids(tokens: DataFrame, ranks: bytes, id_col: str = "doc_id") -> DataFrame:
    """id_col, decoded: the bytes of the ids column; null ids decode to no bytes."""
    sent = tokens.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {v: k for k, v in parse_ranks(sent.value).items()}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b"".join(map(table.__getitem__, i or [])) for i in b.column(1).to_pylist()], pa.binary())], [id_col, "decoded"])

    return tokens.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {dict(tokens.dtypes)[id_col]}, decoded binary")
