"""BPE with word ends: a queue of merge ranks over a doubly linked symbol list.

A pre-token is laid out as a list of symbols with links to both neighbours. Every adjacent pair that
has a merge waits in a priority queue by rank and place; the least is taken, its two symbols become
one, and the pairs that the new symbol makes join the queue. An entry whose symbols have changed
since is stale, which its pair of ids tells, and is skipped. Results of pre-tokens are cached.

The tokenizer's file (JSON of the tokenizers library) gives normaliser, pattern, vocabulary, merges
and added tokens. Special tokens that stand in a text are taken as such, before anything is
normalised. Decoding concatenates vocabulary strings, parted by spaces if the file names no decoder.

Defined results: null text counts as empty and has no tokens; null ids are kept; a very long text is
read whole, its pre-tokens one after another, and a long pre-token takes n log n steps; of pairs of
equal rank the leftmost merges first; symbols outside the vocabulary are left out, as the file has no
unknown token; repeated rows stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed values of the tokenizer's library: white space (without U+001C to U+001F), and what Unicode 16
#: and 17 added to Python's tables as letters, as numbers and as capitals (first, last, first in lower case).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = (
    "\u1c89\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85\U00010ec2-\U00010ec4\U00011380-\U00011389"
    "\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1\U000113d3\U00011bc0-\U00011be0\U00013460-\U000143fa\U00016100-\U0001611d"
    "\U00016d40-\U00016d6c\U00018cff\U0001e5d0-\U0001e5ed\U0001e5f0"
)
NUMBERS = "\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016130-\U00016139\U00016d70-\U00016d79\U0001ccf0-\U0001ccf9\U0001e5f1-\U0001e5fa"
CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
OUT = ("n_tokens", "ids")
FIELDS = {"n_tokens": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte: itself where it has one, else the next free one
    from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs, free = {b: chr(b) for b in own}, 0x100
    for b in range(256):
        if b not in signs:
            signs[b], free = chr(free), free + 1
    return [signs[b] for b in range(256)]


@functools.lru_cache(maxsize=1)
def categories() -> list[str]:
    return [unicodedata.category(chr(c)) for c in range(0x110000)]


def ranges(kind: str) -> str:
    """The code points whose general category begins so, as ranges of a character class."""
    own = [c[0] == kind for c in categories()]
    cut = [0, *(c for c in range(1, 0x110000) if own[c] != own[c - 1]), 0x110000]
    return "".join(f"{chr(a)}-{chr(z - 1)}" for a, z in zip(cut, cut[1:]) if own[a])


class Coder(dict):
    """Pre-token -> its ids as little-endian 32-bit numbers, filled as it is asked for. When it holds
    about ``most`` bytes it becomes the old one, from which what is asked for again comes back."""

    def __init__(self, content: bytes, most: int = 32 << 20):
        super().__init__()
        spec = json.loads(content)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]], [p["type"] for p in spec["pre_tokenizer"]["pretokenizers"]]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["decoder"] or spec["post_processor"] or model["unk_token"]:
            raise ValueError("the file asks for steps that are not built")
        self.most, self.held, self.old = most, 0, {}
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for k, v in [*vocab.items(), *self.special.items()]:
            self.strings[v] = k
        signs = byte_signs()
        self.inner = [vocab.get(s, -1) for s in signs]
        self.last = [vocab.get(s + self.suffix, -1) for s in signs]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.ranks = {a << 32 | b: rank for rank, (a, b, _) in reversed(list(enumerate(self.made)))}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACE)
        self.find = regex.compile(pattern).findall
        self.find_new = re.compile(pattern.replace(r"\p{L}", ranges("L") + LETTERS).replace(r"\p{N}", ranges("N") + NUMBERS)).findall
        self.new = np.frombuffer(bytearray(k == "Cn" for k in categories()), bool)
        self.lower_new = {a + k: low + k for a, z, low in CAPITALS for k in range(z - a + 1)}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else lambda t: [t]

    def pre_tokens(self, text: str) -> list[str]:
        """Composed, in lower case, which goes by the character (a final sigma is as any), and cut by the
        pattern. White space is not made alike first, as no pre-token holds any. Texts with characters
        that Python's tables lack go by the longer classes above."""
        if text.isascii():
            return self.find(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if self.new.take(np.frombuffer(text.encode("utf-32-le"), np.uint32)).any():
            return self.find_new(text.translate(self.lower_new))
        return self.find(text)

    def merge(self, data: bytes) -> list[int]:
        """The ids of a pre-token's bytes."""
        ids = [self.inner[b] for b in data]
        ids[-1:] = [self.last[b] for b in data[-1:]]
        if -1 in ids:
            ids = [i for i in ids if i >= 0]
        n, rank_of, made = len(ids), self.ranks.get, self.made
        before, after, queue = list(range(-1, n)), list(range(1, n + 2)), []
        for i in range(n - 1):
            if (rank := rank_of(ids[i] << 32 | ids[i + 1])) is not None:
                queue.append(rank << 32 | i)
        heapq.heapify(queue)
        ids.append(-1)  # beyond the end: no pair has it
        while queue:
            entry = heapq.heappop(queue)
            i, (a, b, new) = entry & 0xFFFFFFFF, made[entry >> 32]
            j = after[i]
            if ids[i] != a or ids[j] != b:
                continue  # stale: one of the two is another symbol by now, or gone
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            before[k] = i
            if (rank := rank_of(new << 32 | ids[k])) is not None:
                heapq.heappush(queue, rank << 32 | i)
            h = before[i]
            if h >= 0 and (rank := rank_of(ids[h] << 32 | new)) is not None:
                heapq.heappush(queue, rank << 32 | h)
        return [i for i in ids if i >= 0]

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            out = struct.pack(f"<{len(ids := self.merge(piece.encode()))}I", *ids)
        if len(piece) < 500:
            if self.held >= self.most:
                self.old, self.held = dict(self), 0
                super().clear()
            self[piece] = out
            self.held += 190 + len(piece) + len(out)
        return out

    def clear(self) -> None:
        super().clear()
        self.held, self.old = 0, {}

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        out = []
        for part in self.cut(text):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out += map(self.__getitem__, self.pre_tokens(part))
        return b"".join(out)


@functools.lru_cache(maxsize=1)
def coder(content: bytes) -> Coder:
    """The tables of a tokenizer's file, kept for a worker's later tasks; what the cache holds is not."""
    return Coder(content)


def read_tokenizer(path: str) -> bytes:
    """The file's content, read by the driver (under 2 MB) and sent to the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, content: bytes, outputs: tuple[str, ...] = OUT, id_col: str = "doc_id") -> DataFrame:
    """id_col and the outputs asked for: n_tokens; ids; decoded (the text that the ids decode to);
    ids_sha256 (of the ids as little-endian unsigned 32-bit numbers); decoded_sha256 (of UTF-8)."""
    sent = docs.sparkSession.sparkContext.broadcast(content)
    make = {
        "n_tokens": lambda ids, said: len(ids) // 4,
        "ids": lambda ids, said: np.frombuffer(ids, "<i4"),
        "decoded": lambda ids, said: said,
        "ids_sha256": lambda ids, said: hashlib.sha256(ids).hexdigest(),
        "decoded_sha256": lambda ids, said: hashlib.sha256(said.encode()).hexdigest(),
    }
    speaks = "decoded" in outputs or "decoded_sha256" in outputs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = coder(sent.value)
        try:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    rows = []
                    for t in part.column(1):
                        ids = words.encode(t.as_py() or "")
                        said = words.decode(np.frombuffer(ids, "<u4").tolist()) if speaks else ""
                        rows.append([make[o](ids, said) for o in outputs])
                    cols = [pa.array([r[k] for r in rows], FIELDS[o][1]) for k, o in enumerate(outputs)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *cols], [id_col, *outputs])
        finally:
            words.clear()

    return docs.select(id_col, "text").mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, " + ", ".join(f"{o} {FIELDS[o][0]}" for o in outputs))


def decode_ids(tokens: DataFrame, content: bytes, id_col: str = "doc_id") -> DataFrame:
    """id_col, decoded: the vocabulary strings of the ids column; null ids decode to nothing."""
    sent = tokens.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = coder(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([words.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], [id_col, "decoded"])

    return tokens.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {dict(tokens.dtypes)[id_col]}, decoded string")
