"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of whole sample texts; a text
is encoded with every dictionary, block by block, and gets the language whose encodings are
smallest in sum; a narrow margin is measured again by zstandard's closest parse, and if it
stays narrow the text is rejected. Case, digits and symbols are levelled first. Blocks keep the
dictionary's share of the work alike at every text length and bound memory; the whole text is
always encoded.

The sample is bounded: per language the ``sample_docs`` texts of lowest hashed id among those
of 200 to 8,000 bytes (or, where a language has none, of any length), up to ``dict_bytes``.

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected;
no labelled text at all makes every text ``und``; encodings of equal size go to the first language
in order; a very long text is encoded whole, block by block; null ids are kept and never held out;
repeated rows stay; an empty table gives no rows; other columns are ignored, or carried by
``keep_identified``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LETTER = regex.compile(r"\p{L}")
NO_LETTERS = re.compile(r"[\W\d_]+")


def learn(docs: DataFrame, fold: int = 5, held: int = 0, sample_docs: int = 96, dict_bytes: int = 112 << 10) -> dict[str, bytes]:
    """Language -> dictionary content, from rows whose crc32(doc_id) mod ``fold`` is not ``held``.

    At most ``dict_bytes`` a language reach the driver."""
    known = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(fold)) != held).where("lang is not null and length(text) > 0")
    n = F.octet_length("text")
    order = Window.partitionBy("lang").orderBy((~n.between(200, 8000)).cast("int"), F.xxhash64("doc_id"), "doc_id", "text")
    part = known.select("lang", F.substring("text", 1, dict_bytes).alias("text"), F.row_number().over(order).alias("r")).where(F.col("r") <= sample_docs)
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("r").rowsBetween(Window.unboundedPreceding, -1))
    rows = part.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < dict_bytes).select("lang", "r", "text").collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["r"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return {lang: b"".join(map(plain, reversed(t)))[-dict_bytes:] for lang, t in sorted(texts.items())}


def plain(text: str) -> bytes:
    """Lower-case letters, all else as single spaces: case and symbols tell no language."""
    return f" {NO_LETTERS.sub(' ', text.lower()).strip()} ".encode()


class Sizer:
    """Encoded sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 3, close: int = 19, block: int = 4096):
        self.langs, self.block = list(dictionaries), block
        self.fast, self.close = ([self._made(c, n) for c in dictionaries.values()] for n in (level, close))

    def _made(self, content: bytes, level: int) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level)
        return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def posterior(self, data: bytes, made: list[zstandard.ZstdCompressor]) -> tuple[str, float]:
        """The language of the smallest encoding; a saved byte counts as one bit of evidence."""
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in made]
        least = min(sizes)
        return self.langs[sizes.index(least)], 1.0 / sum(2.0 ** max(least - s, -60) for s in sizes)

    def classify(self, text: str | None, sure: float = 0.95) -> tuple[str, float]:
        """The language and its score; where the margin is narrow, by a closer encoding."""
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0
        data = plain(text)
        found = self.posterior(data, self.fast)
        return found if found[1] >= sure else self.posterior(data, self.close)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], least: float = 0.6) -> DataFrame:
    """doc_id, lang_pred, score, rejected (``und``, or a margin so narrow that score < least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(dictionaries)
        for b in batches:
            got = [sizer.classify(t.as_py()) for t in b.column(1)]
            lang, score = [g[0] for g in got], [g[1] for g in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([s < least for s in score], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], least: float = 0.6) -> DataFrame:
    """The rows, in all their columns, whose language is not rejected."""
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(dictionaries)
        for b in batches:
            yield b.filter(pa.array([sizer.classify(t.as_py())[1] >= least for t in b.column(where)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
