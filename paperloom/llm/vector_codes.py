"""Vector codes from member-resident Lloyd iterations.

Vectors of integers are cut into equal consecutive parts; each position has a codebook of ``entries``
parts. A part is a row that lives with its owner, the partition of (position, entry, salt). In a round
every owner adds up its resident members, the sums of all owners become the new codebooks, which are
small and are broadcast, and the owners judge their members anew. Members whose entry has not changed
stay in the files that their owner writes, without an exchange; only those that have changed are
exchanged, to their new owners, and are read beside the resident ones in the next round.

An entry with many members has as many salts as keep its owners near the mean, so one vector that fills
a third of the table does not fill one task. Sums are of integers, and distances are exact: products of
matrices where they stay below 2^53, else 64-bit integers. The driver sees the codebooks and a row an
entry, never members.

Defined results: vectors that are null or hold null or non-finite components are dropped, and so are
those with a component of 2^16 or more, as 64 bits hold the squared distances of the others, and those whose length is not
that of the vector of the smallest id; a vector that the positions do not divide is cut as evenly as
can be; of fewer vectors than entries every one begins an entry; ids that repeat begin one entry, with
the least of their vectors, and null ids come last; ties go to the lower entry; an entry without members
stays as it is; repeated rows are rows of their own; null labels are one label; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import join_hot, release_all_but_last, scope, spool

SCALE, LIMIT, ROWS = 1024, 1 << 26, 4096
Books = list[np.ndarray]


def edges(length: int, positions: int) -> list[int]:
    return [length * p // positions for p in range(positions + 1)]


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, the lowest of equals, and its squared distance, exactly."""
    most = int(max(np.abs(parts).max(initial=0), np.abs(book).max(initial=0)))
    entry, far = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    if 4 * most * most * max(parts.shape[1], 1) < 1 << 53:
        x, c = parts.astype(np.float64), book.astype(np.float64)
        own, norm = (x * x).sum(axis=1), (c * c).sum(axis=1)
        for lo in range(0, len(parts), ROWS):
            d = norm - 2 * (x[lo : lo + ROWS] @ c.T)
            at = d.argmin(axis=1)
            entry[lo : lo + ROWS], far[lo : lo + ROWS] = at, d[np.arange(len(at)), at] + own[lo : lo + ROWS]
        return entry, far
    for lo in range(0, len(parts), 64):
        d = ((parts[lo : lo + 64, None, :] - book[None]) ** 2).sum(axis=2)
        entry[lo : lo + 64] = d.argmin(axis=1)
        far[lo : lo + 64] = d.min(axis=1)
    return entry, far


def whole_vectors(rows: DataFrame, vector: str, id_col: str) -> tuple[DataFrame, int]:
    """The rows whose vector is whole, numbered (``row``) and in integers (``x``), and their length."""
    v = F.col(vector)
    good = v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * SCALE < LIMIT)), F.lit(False))
    whole = rows.where(good).withColumn("x", F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))).drop(vector)
    kept = spool(whole.withColumn("row", F.monotonically_increasing_id()), "codes-kept")
    least = kept.agg(F.min(F.struct(F.col(id_col).isNull(), id_col, "x")).alias("least")).select(F.size("least.x")).first()[0]
    return kept.where(F.size("x") == max(least or 0, 0)), max(least or 0, 0)


def first_books(kept: DataFrame, id_col: str, length: int, positions: int, entries: int) -> Books:
    """The parts of the vectors of the smallest ids: ``entries`` ids and rows reach the driver."""
    key = F.col(id_col)
    ids = [r[0] for r in kept.select(id_col).distinct().orderBy(key.asc_nulls_last()).limit(entries).collect()]
    mine = key.isin([i for i in ids if i is not None])
    few = kept.where(mine | key.isNull() if None in ids else mine).groupBy(id_col).agg(F.min("x").alias("x")).collect()
    few.sort(key=lambda r: (r[0] is None, r[0] or 0))
    whole = np.array([r["x"] for r in few], np.int64).reshape(len(few), length)
    cut = edges(length, positions)
    return [whole[:, a:z].copy() for a, z in zip(cut, cut[1:])]


PART = "row long, position int, entry int, part array<int>"


def enter(kept: DataFrame, books: Books, length: int) -> DataFrame:
    """row, position, entry, part: every part with its nearest entry in the first codebooks."""
    sent, cut = kept.sparkSession.sparkContext.broadcast(books), edges(length, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, length)
            row = b.column(0).to_numpy()
            for p, (a, z) in enumerate(zip(cut, cut[1:])):
                entry, _ = nearest(x[:, a:z].astype(np.int64), sent.value[p])
                part = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * (z - a)), pa.array(x[:, a:z].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.full(len(row), p, np.int32)), pa.array(entry.astype(np.int32)), part], ["row", "position", "entry", "part"])

    return kept.select("row", "x").mapInArrow(run, PART)


def _members(b: pa.RecordBatch, widths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a batch of parts (row, position, entry, part) the position, places and matrix, by position."""
    position = b.column(1).to_numpy()
    for p in np.unique(position).tolist():
        at = np.flatnonzero(position == p)
        yield p, at, b.column(3).take(pa.array(at)).flatten().to_numpy().reshape(len(at), widths[p]).astype(np.int64)


def updated(members: DataFrame, books: Books) -> tuple[Books, dict[tuple[int, int], int]]:
    """Codebooks of the floored means of the resident members, and how many each entry has. Every task
    adds up its own members; the sums of an entry's owners are then added."""
    entries, widths = [len(b) for b in books], [b.shape[1] for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((n, w), np.int64) for n, w in zip(entries, widths)]
        count = [np.zeros(n, np.int64) for n in entries]
        for b in batches:
            entry = b.column(2).to_numpy()
            for p, at, part in _members(b, widths):
                order = np.argsort(entry[at], kind="stable")
                of = entry[at][order]
                first = np.flatnonzero(np.diff(of, prepend=-1))
                sums[p][of[first]] += np.add.reduceat(part[order], first, axis=0)
                count[p] += np.bincount(of, minlength=entries[p])
        for p, n in enumerate(count):
            at = np.flatnonzero(n)
            width = widths[p]
            total = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), pa.array(sums[p][at].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, np.int32)), pa.array(at.astype(np.int32)), total, pa.array(n[at])], ["position", "entry", "total", "n"])

    own = members.mapInArrow(run, "position int, entry int, total array<long>, n long")
    size = max(widths, default=0)
    sums = own.groupBy("position", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(i))) for i in range(size))).alias("total"))
    made, held = [b.copy() for b in books], {}
    for r in sums.collect():
        p, e, n = r["position"], r["entry"], r["n"]
        made[p][e] = np.array(r["total"][: widths[p]], np.int64) // n
        held[p, e] = n
    return made, held


def judged(members: DataFrame, books: Books) -> DataFrame:
    """row, position, entry, part, moved: the members' nearest entries in new codebooks."""
    sent, widths = members.sparkSession.sparkContext.broadcast(books), [b.shape[1] for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            before, entry = b.column(2).to_numpy(), np.zeros(b.num_rows, np.int64)
            for p, at, part in _members(b, widths):
                entry[at], _ = nearest(part, sent.value[p])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(entry.astype(np.int32)), b.column(3), pa.array(entry != before)], ["row", "position", "entry", "part", "moved"])

    return members.mapInArrow(run, PART + ", moved boolean")


def at_owners(members: DataFrame, held: dict[tuple[int, int], int]) -> DataFrame:
    """Exchanged to (position, entry, salt), where an entry with more members than an owner's share,
    by the counts of the round before, has several salts."""
    spark = members.sparkSession
    share = max(1, sum(held.values()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salts = [(p, e, -(-n // share)) for (p, e), n in held.items() if n > share]
    if not salts:
        return members.repartition("position", "entry")
    known = F.broadcast(spark.createDataFrame(salts, "position int, entry int, salts int"))  # at most a row an entry
    salt = F.pmod(F.xxhash64("row"), F.coalesce("salts", F.lit(1)))
    return members.join(known, ["position", "entry"], "left").withColumn("salt", salt).repartition("position", "entry", "salt").select("row", "position", "entry", "part")


def fit(kept: DataFrame, books: Books, length: int, rounds: int) -> Books:
    """Codebooks after ``rounds`` rounds over kept(row, x)."""
    spark = kept.sparkSession
    with scope(spark, 0) as made:
        entered = spool(enter(kept, books, length), "codes-entered")
        held = {(r["position"], r["entry"]): r["n"] for r in entered.groupBy("position", "entry").agg(F.count("*").alias("n")).collect()}
        members = spool(at_owners(entered, held), "codes-members")
        for k in range(rounds):
            if k:
                seen = spool(judged(members, books), "codes-judged", "moved")
                stay, go = (seen.where(F.col("moved") == moved).select("row", "position", "entry", "part") for moved in (False, True))
                members = stay.unionByName(spool(at_owners(go, held), "codes-moved"))
                release_all_but_last(spark, made, 2)
            books, held = updated(members, books)
    return books


def encode(kept: DataFrame, books: Books, length: int, columns: tuple[str, ...]) -> DataFrame:
    """The columns, code (an entry's number a position, in hexadecimal digits) and error (the squared
    distances, summed)."""
    sent, cut = kept.sparkSession.sparkContext.broadcast(books), edges(length, len(books))
    digits = max(2, len(f"{max(map(len, books), default=1) - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(b.num_rows, length).astype(np.int64)
            found = [nearest(x[:, a:z], book) for a, z, book in zip(cut, cut[1:], sent.value)]
            codes = zip(*(entry.tolist() for entry, _ in found))
            code = ["".join(f"{e:0{digits}x}" for e in es) for es in codes]
            error = sum((far for _, far in found), np.zeros(b.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(code, pa.string()), pa.array(error)], [*columns, "code", "error"])

    kinds = dict(kept.dtypes)
    return kept.select("x", *columns).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "code string", "error long"]))


def digest(books: Books) -> str:
    """Of the entries' components in decimal, by position, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(rows: DataFrame, positions: int = 4, entries: int = 256, rounds: int = 4, vector: str = "embedding", id_col: str = "vec_id", columns: tuple[str, ...] = ("label",)) -> tuple[DataFrame, Books]:
    """id_col, the columns, code and error of every vector that is kept; and the codebooks."""
    with scope(rows.sparkSession):
        kept, length = whole_vectors(rows.select(id_col, *columns, vector), vector, id_col)
        books = fit(kept, first_books(kept, id_col, length, positions, entries), length, rounds)
        return spool(encode(kept, books, length, (id_col, *columns)), "codes"), books


def with_group_error(codes: DataFrame, by: str = "label") -> DataFrame:
    """The rows with ``{by}_error``, the error summed over rows of equal ``by``, nulls together."""
    keyed = codes.withColumn("group", F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")))
    total = keyed.groupBy("group").agg(F.sum("error").alias(f"{by}_error"), F.count("*").alias("n"))
    return join_hot(keyed, total, "group").drop("group")
