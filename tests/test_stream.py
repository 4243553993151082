"""Pages that arrive in batches: what is stored equals what all pages at once would give."""

from test_corpus import A, B

from paperloom.operators import chunk, search, segment
from paperloom.streaming import ingest

D1, D2 = "Results\nfirst line of BLEU\n", "runs on\nLimitations\nOnly little data."


def arrive(spark, rows):
    return spark.createDataFrame(rows, ingest.PAGES)


def same(spark, library, rows):
    """The library holds the paragraphs, chunks and statistics of these pages."""
    pages = arrive(spark, rows)
    paras = segment.paragraphs(pages)
    assert sorted(map(str, library.pages().select(pages.columns).collect())) == sorted(map(str, pages.collect()))
    assert sorted(map(str, library.paragraphs().select(paras.columns).collect())) == sorted(map(str, paras.collect()))
    made = chunk.chunks(paras)
    assert sorted(map(str, library.chunks().select(made.columns).collect())) == sorted(map(str, made.collect()))
    texts = made.selectExpr("chunk_id as id", "text").cache()
    queries = spark.createDataFrame([(1, "BLEU data"), (2, "prose of lines")], "query_id long, text string")
    told = lambda df: sorted((r.query_id, r.id, round(r.bm25, 9)) for r in df.collect())
    assert told(library.index.bm25(queries, 5)) == told(search.bm25(texts, queries, 5))


def test_batches_equal_all_pages_at_once(spark, tmp_path):
    library = ingest.Library(spark, f"file://{tmp_path}/library", slots=4, buckets=4)
    library.merge(arrive(spark, [("a", "a.pdf", 1, A), ("d", "d.pdf", 2, D2), ("e", "e.pdf", 1, None), (None, "x.pdf", 1, "no paper")]), 0)
    same(spark, library, [("a", "a.pdf", 1, A), ("d", "d.pdf", 2, D2), ("e", "e.pdf", 1, None)])
    second = [("d", "d.pdf", 1, D1), ("b", "b.pdf", 1, B)]
    library.merge(arrive(spark, [("d", "d.pdf", 1, "a first try"), ("q", "q.pdf", 1, "that did not last")]), 1)
    library.merge(arrive(spark, second), 1)
    both = [("a", "a.pdf", 1, A), ("d", "d.pdf", 1, D1), ("d", "d.pdf", 2, D2), ("e", "e.pdf", 1, None), ("b", "b.pdf", 1, B)]
    same(spark, library, both)
    library.merge(arrive(spark, second), 1)
    same(spark, library, both)
    library.merge(arrive(spark, [("a", None, None, None), ("b", None, None, None), ("b", "b2.pdf", 3, "Results\nback with BLEU"), ("z", None, None, None)]), 2)
    same(spark, library, [("d", "d.pdf", 1, D1), ("d", "d.pdf", 2, D2), ("e", "e.pdf", 1, None), ("b", "b2.pdf", 3, "Results\nback with BLEU")])


def test_files_are_followed(spark, tmp_path):
    library = ingest.Library(spark, f"file://{tmp_path}/library", slots=4, buckets=4)
    for n, text in ((1, D1), (2, D2)):
        arrive(spark, [("d", "d.pdf", n, text)]).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.follow(library, f"{tmp_path}/in", f"{tmp_path}/check").awaitTermination()
    same(spark, library, [("d", "d.pdf", 1, D1), ("d", "d.pdf", 2, D2)])
