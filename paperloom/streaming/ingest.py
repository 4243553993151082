"""Arriving page text, merged into stored pages and carried through paragraphs, chunks and the index.

A library is a folder of ``pages`` (slot, batch), ``paragraphs`` (batch), ``chunks`` (batch) and an index.
A batch brings pages, or the word that a paper goes. The pages of the papers that it touches, old and
new, are put together, and only these papers are cut, chunked and indexed again. Every batch writes its
own parts under its number and looks only at earlier ones, so one that runs again, after a lost
executor or driver, replaces what it wrote; nothing that was there is rewritten.

Defined results: a page that comes again replaces the stored one of its number; of pages that share a
paper and number within a batch the last by text counts; pages of a paper may come in any number of
batches and any order; a row whose page number is null removes its paper, before pages of the same batch
are put in; rows without a paper are left out; a page without text is an empty page; no files give no
batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunk import chunks
from ..operators.index import Index
from ..operators.segment import paragraphs
from ..sources.staged import scope, staged

PAGES = "paper_id string, filename string, page_number int, text string"
PARAGRAPHS = "paper_id string, section_ord int, section string, para_no int, paragraph_id string, page_number int, text string"
CHUNKS = "paper_id string, chunk_id string, chunk_no int, section string, text string, page_number int, pages array<int>, paragraph_ids array<string>, token_count int"


class Library:
    """Pages, paragraphs, chunks and index of a growing corpus in one folder."""

    def __init__(self, spark: SparkSession, path: str, slots: int = 64, buckets: int = 64):
        self.spark, self.path, self.slots = spark, path.rstrip("/"), slots
        self.index = Index(spark, f"{self.path}/index", "string", buckets, slots)

    def _slot(self):
        return F.pmod(F.xxhash64("paper_id"), F.lit(self.slots)).cast("int")

    def _read(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], f"{schema}, slot int, batch long")
        rows = self.spark.read.schema(f"{schema}, slot int, batch long").parquet(f"{self.path}/{name}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def _write(self, name: str, rows: DataFrame, batch: int) -> None:
        """The batch's rows, in place of what an earlier try wrote; their papers' earlier rows hold no longer."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/batch={batch}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        rows.withColumn("slot", self._slot()).repartition("slot").write.partitionBy("slot").parquet(str(path))

    def _touched(self, before: int | None) -> DataFrame:
        """paper_id, batch of the last batch that each paper was part of."""
        return self._read("touched", "paper_id string", before).groupBy("paper_id").agg(F.max("batch").alias("batch"))

    def _current(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        """The rows of each paper's last batch."""
        return self._read(name, schema, before).join(self._touched(before), ["paper_id", "batch"], "left_semi").drop("slot", "batch")

    def pages(self) -> DataFrame:
        return self._current("pages", PAGES)

    def paragraphs(self) -> DataFrame:
        return self._current("paragraphs", PARAGRAPHS)

    def chunks(self) -> DataFrame:
        return self._current("chunks", CHUNKS)

    def merge(self, arriving: DataFrame, batch: int) -> None:
        """Put a batch in; see the module's head."""
        with scope(self.spark, 0):
            rows = staged(arriving.where("paper_id is not null").select("paper_id", "filename", "page_number", "text"), "stream-batch")
            touched = staged(rows.select("paper_id").distinct(), "stream-touched")
            slots = [r[0] for r in touched.select(self._slot().alias("s")).distinct().collect()]  # at most ``slots`` numbers
            last = self._touched(batch).join(touched, "paper_id", "left_semi")
            stored = self._read("pages", PAGES, batch).where(F.col("slot").isin(slots)).join(last, ["paper_id", "batch"], "left_semi").select("paper_id", "filename", "page_number", "text")
            gone = rows.where("page_number is null").select("paper_id").distinct()
            new = rows.where("page_number is not null").groupBy("paper_id", "page_number").agg(F.max_by(F.struct("filename", "text"), F.coalesce("text", F.lit(""))).alias("p"))
            new = new.select("paper_id", "p.filename", "page_number", "p.text")
            kept = stored.join(gone, "paper_id", "left_anti").join(new, ["paper_id", "page_number"], "left_anti")
            whole = staged(kept.select(new.columns).unionByName(new), "stream-pages")
            paras = staged(paragraphs(whole), "stream-paragraphs")
            made = staged(chunks(paras), "stream-chunks")
            for name, part in (("pages", whole), ("paragraphs", paras), ("chunks", made)):
                self._write(name, part, batch)
            texts = made.select(F.col("chunk_id").alias("id"), "paper_id", "text")
            self.index.replace(touched, texts, batch)
            self._write("touched", touched, batch)  # last: what a batch that fails before has written is not read, and its index is put right when it runs again


def follow(library: Library, arriving: str, checkpoint: str) -> StreamingQuery:
    """Merge Parquet files of PAGES as they arrive."""
    pages = library.spark.readStream.schema(PAGES).parquet(arriving)
    return pages.writeStream.foreachBatch(library.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
