"""Quality classifier: regularised quadratic discriminant analysis on document statistics.

Each text becomes a vector of transformed statistics. Per class, mean and covariance are
summed by Spark over all labelled rows of the training folds; the covariance is shrunk first
to the pooled one, then to its diagonal. Cholesky factors are computed once and sent to the
tasks; a score is the logistic of the difference of log densities (Mahalanobis distance and
log determinant) plus the log prior ratio.

Defined results: null texts count as empty, which is scored like any text; a very long text is
measured whole; null ids are kept, have no label and are never held out; a class without rows
falls back to the pooled statistics; without labels every score is the prior 0.5; of several
labels of an id the lower one counts; equal texts have equal scores; repeated rows stay; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import spool

NAMES = ("log_bytes", "log_words", "mean_word", "upper", "digits", "symbols", "marks", "other_ascii", "high_bytes", "distinct_words", "top_word", "next_equal", "dup_lines", "line_words")


def _set(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars.encode())] = 1
    return out


KINDS = np.stack([_set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _set("0123456789"), _set("#*$%&|<>"), _set(".,;:!?"), _set("\"'()[]{}+-=/\\@^_`~"), (np.arange(256) > 127).astype(np.int64)])


def vector(text: str | None) -> np.ndarray:
    """Statistics of the whole text, shares as logits so that small ones are told apart."""
    data = (text or "").encode()
    n = len(data)
    kinds = KINDS @ np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    total = len(words)
    if total:
        counts: dict[bytes, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        distinct, top = len(counts), max(counts.values())
        equal = sum(map(bytes.__eq__, words, words[1:]))
    else:
        distinct = top = equal = 0
    logit = lambda a, b: np.log((a + 0.5) / (b - a + 0.5)) if b >= a else 0.0
    out = [np.log1p(n), np.log1p(total), n / total if total else 0.0, *(logit(k, n) for k in kinds), logit(distinct, total) - 0.5 * np.log1p(total), logit(top, total), logit(equal, max(total - 1, 0)), logit(len(lines) - len(set(lines)), len(lines)), np.log1p(total / max(len(lines), 1))]
    return np.clip(np.array(out), -20, 20)


def vectors(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col and x, the statistics of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.concatenate([vector(t.as_py()) for t in b.column(1)] or [np.zeros(0)])
            x = pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * len(NAMES), pa.array(flat, pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), x], [id_col, "x"])

    return docs.select(id_col, "text").mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, x array<double>")


class Discriminant:
    """Cached factors of both classes; ``score`` takes an n x d array."""

    def __init__(self, count: np.ndarray, total: np.ndarray, outer: np.ndarray, to_pooled: float = 0.2, to_diagonal: float = 0.1):
        d = total.shape[1]
        self.parts = []
        n = max(count.sum(), 1.0)
        mean = total.sum(axis=0) / n
        within = sum((outer[k] - np.outer(total[k], total[k]) / max(count[k], 1.0) for k in (0, 1)), np.zeros((d, d))) / n
        self.logit = float(np.log((count[1] + 1) / (count[0] + 1)))
        for k in (0, 1):
            m = total[k] / count[k] if count[k] else mean
            own = outer[k] / count[k] - np.outer(m, m) if count[k] else within
            cov = (1 - to_pooled) * own + to_pooled * within
            cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov)) + 1e-2 * np.eye(d)
            low = np.linalg.cholesky(cov)
            self.parts.append((m, np.linalg.inv(low), -np.log(np.diag(low)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        density = [const - 0.5 * (((x - m) @ inverse.T) ** 2).sum(axis=1) for m, inverse, const in self.parts]
        return 1.0 / (1.0 + np.exp(-np.clip(density[1] - density[0] + self.logit, -700, 700)))


def fit(rows: DataFrame) -> Discriminant:
    """From rows(x, y): one row of sums a class comes to the driver."""
    d = len(NAMES)
    x = [F.get("x", F.lit(i)) for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]
    count, total, outer = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in rows.where("y in (0, 1)").groupBy("y").agg(F.count("*").alias("n"), *sums).collect():
        k = int(r["y"])
        count[k], total[k] = r["n"], [r[f"s{i}"] for i in range(d)]
        for i, j in pairs:
            outer[k, i, j] = outer[k, j, i] = r[f"p{i}_{j}"]
    return Discriminant(count, total, outer)


def score(features: DataFrame, model: Discriminant, id_col: str = "doc_id") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], [id_col, "score"])

    return features.select(id_col, "x").mapInArrow(run, f"`{id_col}` {dict(features.dtypes)[id_col]}, score double")


def classify(docs: DataFrame, labels: DataFrame, fold: int = 4, held: int = 2, at: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted. Labels are read only of rows whose crc32(doc_id)
    mod ``fold`` is not ``held``."""
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(fold)) == held
    known = labels.where(~out).where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    x = spool(vectors(docs), "quality-x")
    model = fit(x.join(known, "doc_id"))
    got = score(x, model)
    return got.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))
