"""Token counts under a unigram model by trie-shared dynamic programming.

The pieces of a public vocabulary get the weight -ln(rank + 2) in millionths (Zipf's
law; nothing is trained). A text's count is the number of pieces in the heaviest segmentation of each of its
pre-tokens, the fewest pieces on a tie. A batch's distinct pre-tokens are put in a trie: the
forward score of a node, the best weight with which its path from the root can be cut, is
computed once for all pre-tokens that share the prefix, and the count is stored where a
pre-token ends.

Defined results: null and empty texts have 0 tokens; null ids are kept; a very long text is cut
only where a pre-token begins, and a very long pre-token takes time in proportion to its length;
of segmentations of equal weight the one of fewest pieces counts; repeated rows stay; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe


class Unigram:
    """Weights by piece; the longest piece bounds how far back a score looks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.weight = {p: -round(1e6 * math.log(r + 2)) for p, r in ranks.items()}
        self.longest = max(map(len, self.weight), default=1)

    def step(self, word: bytes, end: int, scores: list[tuple[int, int]]) -> tuple[int, int]:
        """The forward score (weight, minus the number of pieces) of the first ``end`` bytes from
        those at all shorter lengths."""
        best = (-(1 << 62), 0)
        for at in range(max(0, end - self.longest), end):
            w = self.weight.get(word[at:end])
            if w is not None:
                weight, pieces = scores[at]
                new = (weight + w, pieces - 1)
                if new > best:
                    best = new
        return best


@functools.lru_cache(maxsize=1)
def unigram(content: bytes) -> Unigram:
    return Unigram(bpe.parse_ranks(content))


def count_pieces(words: set[bytes], model: Unigram) -> dict[bytes, int]:
    """Pieces of each distinct pre-token. The trie is walked depth first by sorting: what a
    pre-token shares with the one before keeps its forward scores."""
    out: dict[bytes, int] = {}
    scores, before = [(0, 0)], b""
    for word in sorted(words):
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        del scores[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            scores.append(model.step(word, end, scores))
        out[word], before = -scores[-1][1], word
    return out


def count_tokens(docs: DataFrame, ranks: bytes, cache: int = 200_000, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_pre_tokens, n_tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = unigram(sent.value), {}
        for b in batches:
            pre, tokens = np.zeros((2, b.num_rows), np.int64)
            cuts = [(k, c) for k, t in enumerate(b.column(1)) if t.is_valid for c in bpe.pieces(t.as_py())]
            at = 0
            for group in bpe.batched([c for _, c in cuts]):
                found = list(bpe.pre_tokens(group))
                new = set().union(*found).difference(known)
                if len(known) + len(new) > cache:
                    known, new = {}, set().union(*found)
                coded = {t: t.encode() for t in new}
                got = count_pieces(set(coded.values()), model)
                known.update((t, got[d]) for t, d in coded.items())
                for (k, _), p in zip(cuts[at : at + len(group)], found):
                    pre[k] += len(p)
                    tokens[k] += sum(map(known.__getitem__, p))
                at += len(group)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pre), pa.array(tokens)], [id_col, "n_pre_tokens", "n_tokens"])

    return docs.select(id_col, "text").mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_pre_tokens long, n_tokens long")
