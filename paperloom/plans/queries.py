"""Registered queries over the paper corpus; ``oracle`` has their SQL for another engine."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk, claims, dense, extract, index, maintenance, matrix, metadata, nested, onepass, search, segment
from ..sources import intake, models
from ..sources.corpus import page_text
from ..sources.staged import exchanged, shared_dir, staged
from .oracle import ORACLE_SQL, PART_FIELDS, PARTS

__all__ = ["ORACLE_SQL", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _none(kind: str):
    return F.lit(None).cast(kind)


def _doc(c: str = "paper_id"):
    return F.substring(c, 2, 20).cast("long")


def _said(df: DataFrame) -> DataFrame:
    """The rows with their sources as text."""
    return df.withColumn("sources", T.tag_text(F.col("sources")))


def pages(spark, sf_dir) -> DataFrame:
    return page_text(_table(spark, sf_dir, "documents"))


def paragraphs(spark, sf_dir) -> DataFrame:
    return segment.paragraphs(pages(spark, sf_dir))


def sets(spark, sf_dir) -> DataFrame:
    """Comparison sets of ten papers."""
    return _table(spark, sf_dir, "documents").select(F.expr("doc_id div 10").alias("set_id"), (F.col("doc_id") % 10).alias("paper_ord"), F.expr("concat('d', doc_id)").alias("paper_id"))


def _toxic(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "labels").where("toxic = 1").select(F.expr("concat('d', doc_id)").alias("paper_id")).distinct()


# sources and maintenance


def a1_intake(spark, sf_dir):
    """Files made of documents: some misnamed, too large, empty, of another kind, without pages or
    without text."""
    docs = _table(spark, sf_dir, "documents")
    path = "concat('d', doc_id, case when doc_id % 9 = 4 then '.txt' when doc_id % 9 = 5 then '.PDF' else '.pdf' end) as path"
    files = docs.selectExpr(
        path,
        "case when doc_id % 10 = 7 then 'text/html' when doc_id % 2 = 0 then 'application/pdf' else '' end as content_type",
        "cast(case when doc_id % 7 = 0 then 0 when doc_id % 7 = 1 then 52428800 + n_chars else n_chars end as long) as length",
        "cast(case when doc_id % 5 = 0 then coalesce(substr(text, 1, 8), '') else '%PDF-1.4' end as binary) as content",
    )
    read = docs.where("doc_id % 11 <> 3").selectExpr(path, "case when doc_id % 11 = 5 then ' ' else concat('a ', text) end as text")
    return intake.judged(files, read)


def a2_page_text(spark, sf_dir):
    return pages(spark, sf_dir)


def a2_read_pages(spark, sf_dir):
    """Page text as another program may write it, as lines of JSON: some cut, of another type, without
    their paper, below page 1, without text, or with more fields. What is read, or why it is refused."""
    text, n = F.to_json(F.struct(*models.PAGE)), _doc() % 9
    said = (
        F.when(n == 1, F.substring(text, 1, 20))
        .when(n == 2, F.regexp_replace(text, r'"page_number":\d+', '"page_number":0'))
        .when(n == 3, F.to_json(F.struct("filename", "page_number", "text")))
        .when(n == 4, F.to_json(F.struct("paper_id", "filename", "page_number")))
        .when(n == 5, F.regexp_replace(text, r'"page_number":\d+', '"page_number":"two"'))
        .when(n == 6, F.to_json(F.struct(F.array(F.lit(1)).alias("marks"), *models.PAGE)))
        .when(n == 7, F.to_json(F.struct(F.lit(" ").alias("paper_id"), "filename", "page_number", "text")))
        .otherwise(text)
    )
    read = models.parsed(pages(spark, sf_dir).select(said.alias("value")), models.PAGE)
    return read.groupBy("refused", "paper_id", "filename", "page_number", F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


def a3_nested_papers(spark, sf_dir):
    """Papers nested, written to files, read back and laid flat."""
    docs = pages(spark, sf_dir)
    made = nested.papers(metadata.titles(docs), segment.paragraphs(docs))
    return nested.flat(staged(made, "nested-papers"))


def _filed(rows: DataFrame, model: dict, tag: str, kind: str = "json") -> DataFrame:
    """Rows of a model, written to files and read back with all checks."""
    path = f"{shared_dir(rows.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    models.write(rows, path, model, kind)
    return models.read(rows.sparkSession, path, model, kind)[0]


def a3_papers(spark, sf_dir):
    """Whole papers as files: all seven sections, metadata and counts; read back."""
    docs = pages(spark, sf_dir)
    described = nested.metadata(metadata.titles(docs), metadata.authors(docs), metadata.years_dois(docs))
    held = _filed(nested.whole_papers(docs, segment.paragraphs(docs), described), models.PAPER, "papers")
    names = F.array_join(F.transform("sections", lambda s: F.concat(s["name"], F.lit("="), F.size(s["paragraphs"]).cast("string"))), ";")
    whole = F.array_join(F.transform("sections", lambda s: F.concat_ws("|", s["name"], s["text"])), "\n")
    said = F.concat_ws("|", "metadata.title", F.array_join("metadata.authors", ","), F.col("metadata.year").cast("string"), "metadata.doi", "metadata.enrichment_source", F.md5("metadata.abstract"))
    return held.select("paper_id", "filename", "page_count", "paragraph_count", names.alias("sections"), F.md5(whole).alias("digest"), said.alias("metadata"))


def a3_refused(spark, sf_dir):
    """Extractions as JSON of which most are cut, of other shape or against a rule: why each is refused."""
    docs = pages(spark, sf_dir)
    wide = nested.extractions(onepass.extracted(metadata.titles(docs), segment.paragraphs(docs)))
    text, n = F.to_json(F.struct(*models.EXTRACTION)), _doc() % 9
    spoiled = (
        F.when(n == 1, F.substring(text, 1, 200))
        .when(n == 2, F.regexp_replace(text, r'"page_number":\d+', '"page_number":0'))
        .when(n == 3, F.regexp_replace(text, r'"extraction_source":"[^"]*"', '"extraction_source":"elsewhere"'))
        .when(n == 4, F.to_json(F.struct("paper_id", F.col("summary").withField("executive_summary", F.slice("summary.executive_summary", 1, 2)).alias("summary"))))
        .when(n == 5, F.to_json(F.struct("paper_id", F.col("summary").dropFields("technical_tldr").alias("summary"))))
        .when(n == 6, F.to_json(F.struct("paper_id", F.lit("words").alias("summary"))))
        .when(n == 7, F.to_json(F.struct("summary")))
        .when(n == 8, "")
        .otherwise(text)
    )
    judged = models.parsed(wide.select("paper_id", spoiled.alias("value")).select("value", F.lit(1).alias("extra")), models.EXTRACTION)
    return judged.groupBy(F.coalesce("refused", F.lit("good")).alias("refused")).agg(F.count("*").alias("n"), F.count_distinct("paper_id").alias("n_papers"))


def a4_upsert(spark, sf_dir):
    """Pages as chunks; page 2 of toxic papers comes again in two versions."""
    stored, new = _arriving(spark, sf_dir)
    return maintenance.upsert(stored, new, version="version").select("chunk_id", "paper_id", F.md5("text").alias("digest"))


def a4_upsert_counts(spark, sf_dir):
    """How many chunks that upsert writes for each paper."""
    return maintenance.counts(_arriving(spark, sf_dir)[1])


def _arriving(spark, sf_dir):
    stored = pages(spark, sf_dir).withColumn("chunk_id", F.concat("paper_id", F.lit(":"), "page_number"))
    again = stored.join(_toxic(spark, sf_dir), "paper_id", "left_semi").where("page_number >= 2")
    version = F.explode(F.array(F.lit(2), F.lit(1))).alias("version")
    return stored, again.select("*", version).withColumn("text", F.when(F.col("version") == 2, F.upper("text")).otherwise(F.lower("text")))


def a5_delete_papers(spark, sf_dir):
    """What is left and what went when every paper that a label marks as toxic is deleted."""
    left, removed = maintenance.delete(pages(spark, sf_dir), _toxic(spark, sf_dir))
    kept = left.groupBy("paper_id").agg(F.count("*").alias("n_pages"))
    return kept.withColumn("removed", F.lit(0).cast("long")).unionByName(removed.withColumn("n_pages", F.lit(0).cast("long")))


def a6_list_papers(spark, sf_dir):
    docs = pages(spark, sf_dir)
    return maintenance.list_papers(metadata.titles(docs), metadata.years_dois(docs), metadata.counts(docs, segment.paragraphs(docs)))


def a7_lookup(spark, sf_dir):
    """The Results section of every paper, by a name in any case."""
    return maintenance.lookup_sections(b9_sections(spark, sf_dir), "RESULTS").select("paper_id", "section", "text")


def a7_papers(spark, sf_dir):
    """Papers by id, some of which do not exist."""
    asked = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("request_id"), F.expr("concat('d', doc_id + quality * 3)").alias("paper_id"))
    docs = pages(spark, sf_dir)
    return maintenance.lookup_papers(metadata.counts(docs, segment.paragraphs(docs)), asked)


def a8_resolve(spark, sf_dir):
    """Labelled ids, ten a request, last first; some papers do not exist."""
    asked = _table(spark, sf_dir, "labels").select(F.expr("doc_id div 10").alias("request_id"), (-F.col("doc_id")).alias("ord"), F.expr("concat('d', doc_id + quality * 3)").alias("paper_id"))
    found = maintenance.resolve(asked, sets(spark, sf_dir))
    return found.select("request_id", F.array_join("papers", ",").alias("papers"), F.array_join("missing", ",").alias("missing"), "message")


def a9_reuse(spark, sf_dir):
    """Stored extractions of the even papers, some with two bullets or of unknown origin; the others,
    and those whose stored one does not hold, are extracted."""
    docs = pages(spark, sf_dir)
    bullets = F.when(_doc() % 8 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    source = F.when(_doc() % 12 == 2, "unknown").otherwise("openai-structured")
    papers = sets(spark, sf_dir).select("paper_id")
    stored = papers.where(_doc() % 2 == 0).select("paper_id", source.alias("source"), bullets.alias("bullets"), F.array(F.lit("stored")).alias("tldr"))

    def extracted(rest: DataFrame) -> DataFrame:
        mine = docs.join(rest, "paper_id", "left_semi")
        paras = segment.paragraphs(mine)
        parts = {"bullets": claims.executive_bullets(mine, paras), "tldr": claims.tldr(metadata.titles(mine), paras)}
        made = nested.envelope(mine, parts)
        return made.select("paper_id", "source", F.transform("bullets", lambda b: b["text"]).alias("bullets"), F.transform("tldr", lambda t: t["tldr"]).alias("tldr"))

    return maintenance.reuse(papers, stored, extracted).select("paper_id", "source", F.size("bullets").alias("n_bullets"), F.get("tldr", F.lit(0)).alias("tldr"))


# lines, sections, paragraphs


def b1_lines(spark, sf_dir):
    found = segment.lines(pages(spark, sf_dir))
    return found.groupBy("paper_id", "page_number").agg(F.count("*").alias("n_lines"), F.sum((F.col("line") == "").cast("int")).alias("n_blank"), F.sum(F.length("line")).alias("n_chars"))


def b2_b3_headings(spark, sf_dir):
    return segment.marked_lines(pages(spark, sf_dir)).where("heading is not null").select("paper_id", "page_number", "line_no", "heading", F.coalesce("body", F.lit("")).alias("rest"))


def _hints(docs):
    contents = F.array(*map(F.lit, ["2.1 Methods", "3 Resultss", "5 Limitations", "6 Future Work", "No section"]))
    return docs.select("paper_id").distinct().select("paper_id", F.explode(contents).alias("hint_text"))


def b4_hint_headings(spark, sf_dir):
    """Lines that nearly equal a heading of the paper's table of contents."""
    docs = pages(spark, sf_dir)
    return metadata.hint_headings(segment.lines(docs), _hints(docs))


def b4_hinted_paragraphs(spark, sf_dir):
    """Paragraphs, cut at those lines too."""
    docs = pages(spark, sf_dir)
    return segment.paragraphs(docs, _hints(docs))


def b5_b8_paragraphs(spark, sf_dir):
    return paragraphs(spark, sf_dir)


def b9_sections(spark, sf_dir):
    docs = pages(spark, sf_dir)
    return segment.sections(docs.select("paper_id").distinct(), segment.paragraphs(docs))


def b10_flat_numbers(spark, sf_dir):
    return segment.flat_numbers(paragraphs(spark, sf_dir))


def b11_math(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.latex(F.concat(F.coalesce("text", F.lit("")), F.lit("  λ·x ≤ Σ\ty "))).alias("latex"))


def b12_math_spans(spark, sf_dir):
    more = F.concat("text", F.lit(r" $$a_1 + b$$ and \(c\) or \[d = e\]."))
    spans = paragraphs(spark, sf_dir).select("paper_id", "paragraph_id", F.posexplode(T.math_spans(more)).alias("span_no", "span"))
    block, body = T.math_body(F.col("span"))
    return spans.withColumns({"block": block, "body": body})


def b13_tokens(spark, sf_dir):
    t = T.tokens(F.coalesce("text", F.lit("")))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"), F.md5(F.array_join(t, " ")).alias("digest"))


def b14_sentences(spark, sf_dir):
    return paragraphs(spark, sf_dir).select("paper_id", "paragraph_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_no", "sentence"))


def b15_keys(spark, sf_dir):
    docs = pages(spark, sf_dir)
    return docs.groupBy("paper_id").agg(T.key(F.min("filename")).alias("key")).join(metadata.titles(docs).select("paper_id", T.key(F.col("title")).alias("title_key")), "paper_id")


# metadata


def _spans(docs):
    """Page lines as spans of type, one of the first lines and one low on the page in large type."""
    size = F.when(F.col("line_no") == _doc() % 3, 18.0).when(F.col("line_no") > 16, 30.0).otherwise(10.0)
    return segment.lines(docs).select("paper_id", "page_number", F.lit(800.0).alias("page_height"), F.col("line_no").alias("span_no"), (F.col("line_no") * 20.0).alias("top"), size.alias("size"), F.col("line").alias("text"))


def c1_titles_by_font(spark, sf_dir):
    return metadata.titles_by_font(_spans(pages(spark, sf_dir)))


def c1_c2_titles(spark, sf_dir):
    """Titles of papers of which every second has spans."""
    docs = pages(spark, sf_dir)
    return metadata.titles(docs, _spans(docs).where(_doc() % 2 == 0))


def c2_titles(spark, sf_dir):
    return metadata.titles(pages(spark, sf_dir))


def c3_authors(spark, sf_dir):
    return metadata.authors(pages(spark, sf_dir))


def c4_c5_year_doi(spark, sf_dir):
    return metadata.years_dois(pages(spark, sf_dir))


def c6_abstracts(spark, sf_dir):
    return metadata.abstracts(paragraphs(spark, sf_dir))


def c7_counts(spark, sf_dir):
    docs = pages(spark, sf_dir)
    return metadata.counts(docs, segment.paragraphs(docs)).drop("filename")


def c8_enrichment(spark, sf_dir):
    """Papers completed from a catalogue with an entry for each: the title in capitals, cut, longer,
    misspelt, another, or the same only at its beginning."""
    docs = pages(spark, sf_dir)
    found = metadata.titles(docs).join(exchanged(metadata.authors(docs)), "paper_id").join(exchanged(metadata.years_dois(docs)), "paper_id")
    found = found.select("paper_id", "title", "authors", "year", _none("string").alias("abstract"), F.lit("").alias("venue"), "doi", _none("string").alias("url"))
    catalog = _table(spark, sf_dir, "documents").selectExpr(
        "doc_id as ord",
        """case doc_id % 7 when 1 then concat('Study ', doc_id, ' of Learned') when 2 then concat('Study ', doc_id, ' of Learned Sequence Models: An Extended Report') when 3 then concat('Other work ', doc_id)
        when 4 then concat('Study ', doc_id, ' of Le', repeat('x', 35)) when 5 then concat('Study ', doc_id, ' of Lerned Sequence Models') else concat('STUDY ', doc_id, ' of learned sequence models') end as title""",
        "array('A', 'B') as authors",
        "cast(doc_id % 30 + 1990 as int) as year",
        "cast(null as string) as abstract",
        "case when doc_id % 7 = 6 then '' else 'V' end as venue",
        "concat('10.1/', doc_id) as doi",
        "cast(null as string) as url",
    )
    return metadata.enrich(found, catalog).select("paper_id", "title", "year", "venue", "doi", F.array_join("authors", ", ").alias("authors"), "enrichment_source")


# chunks and search


def _texts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))


def _queries(spark, sf_dir):
    """Every twentieth document asks."""
    return _table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")


def d1_chunks(spark, sf_dir):
    made = chunk.chunks(paragraphs(spark, sf_dir))
    return made.select("chunk_id", "paper_id", "chunk_no", "section", "page_number", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), F.array_join(F.array_distinct("paragraph_ids"), ",").alias("paragraph_ids"), "token_count", F.md5("text").alias("digest"))


def d3_hashed_vectors(spark, sf_dir):
    return search.hashed_vectors(_texts(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


def d4_term_statistics(spark, sf_dir):
    return search.term_statistics(_texts(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


def d5_bm25(spark, sf_dir):
    """The ten best of every query; the operator gives all if no number is asked for."""
    return search.bm25(_texts(spark, sf_dir), _queries(spark, sf_dir), 10).withColumn("bm25", F.round("bm25", 6))


def _maintained(spark, sf_dir) -> index.Index:
    """An index of all documents; then some come again in another wording, all of a source twice, and
    those that a label marks as toxic go."""
    docs = _table(spark, sf_dir, "documents").selectExpr("doc_id as id", "concat('d', doc_id) as paper_id", "text")
    held = index.Index(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", "long", buckets=16, slots=16)
    held.upsert(docs, 1)
    again = docs.where("id % 10 = 3").selectExpr("id", "paper_id", "explode(array(1, 2)) as version", "text")
    held.upsert(again.withColumn("text", F.expr("case version when 2 then concat('revised ', coalesce(substr(text, 1, 200), ''), ' edition', id % 7) else 'draft' end")), 2, "version")
    held.delete(_toxic(spark, sf_dir), 3)
    held.upsert(docs.where("id % 30 = 3"), 4)
    return held


def d4_index_statistics(spark, sf_dir):
    """Statistics of a maintained index, which only sums of differences tell."""
    return _maintained(spark, sf_dir).statistics().withColumn("mean", F.round("mean", 6))


def d5_index_search(spark, sf_dir):
    """The ten best of every query in a maintained index, from the buckets of its terms alone."""
    return _maintained(spark, sf_dir).bm25(_queries(spark, sf_dir), 10).withColumn("bm25", F.round("bm25", 6))


def d7_dense_top_k(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return dense.dense_top_k(rows, rows.where("id % 20 = 0"))


def d9_hybrid_search(spark, sf_dir):
    return search.hybrid(_texts(spark, sf_dir), _queries(spark, sf_dir))


def d9_given_vectors(spark, sf_dir):
    """Hybrid search whose dense part ranks the vectors of ``embeddings`` by their documents' ids."""
    held = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return search.hybrid(_texts(spark, sf_dir), _queries(spark, sf_dir), vectors=held, query_vectors=held.where("id % 20 = 0").withColumnRenamed("id", "query_id"))


def d9_odd_queries(spark, sf_dir):
    """Queries that are blank, have no token, or tokens that hardly any text has: cosine ranks all
    the same."""
    odd = F.expr("case doc_id % 80 when 0 then '  ' when 20 then '?!' when 40 then concat('zzyzx', doc_id) else concat('qqxw ', substr(text, 1, 40)) end")
    return search.hybrid(_texts(spark, sf_dir), _table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), odd.alias("text")), top_k=20)


def d10_scoped_search(spark, sf_dir):
    """Every twentieth document searches all documents of its source."""
    docs = _table(spark, sf_dir, "documents")
    texts = _texts(spark, sf_dir).select("id", F.col("id").alias("paper_id"), "text")
    named = docs.where("source is not null").select(F.col("doc_id").alias("paper_id"), F.col("source").alias("scope_id"))
    scope = named.where("paper_id % 20 = 0").select(F.col("paper_id").alias("query_id"), "scope_id")
    return search.scoped(texts, _queries(spark, sf_dir), scope, members=named)


def d11_lexical_overlap(spark, sf_dir):
    return search.lexical_overlap(_texts(spark, sf_dir), _queries(spark, sf_dir))


def d12_citations(spark, sf_dir):
    """The best chunks of each query with their pages and paragraphs."""
    made = staged(chunk.chunks(paragraphs(spark, sf_dir)), "chunks")
    return search.cited(search.hybrid(made.select(F.col("chunk_id").alias("id"), "text"), _queries(spark, sf_dir)), made)


# claims


def e1_lead_sentences(spark, sf_dir):
    return _said(extract.lead_sentences(paragraphs(spark, sf_dir)))


def e2_bullets(spark, sf_dir):
    docs = pages(spark, sf_dir)
    return _said(claims.executive_bullets(docs, segment.paragraphs(docs)))


def e3_section_summaries(spark, sf_dir):
    return _said(claims.section_summaries(paragraphs(spark, sf_dir)))


def e4_tldr(spark, sf_dir):
    docs = pages(spark, sf_dir)
    return _said(claims.tldr(metadata.titles(docs), segment.paragraphs(docs)))


def e5_architectures(spark, sf_dir):
    return _said(claims.architectures(paragraphs(spark, sf_dir)))


def e6_hyperparameters(spark, sf_dir):
    return _said(extract.hyperparameters(paragraphs(spark, sf_dir)))


def e7_losses(spark, sf_dir):
    return _said(claims.loss_expressions(paragraphs(spark, sf_dir)))


def e8_e9_datasets(spark, sf_dir):
    return _said(extract.datasets(paragraphs(spark, sf_dir)))


def e10_hardware(spark, sf_dir):
    return _said(extract.hardware(paragraphs(spark, sf_dir)))


def e11_e12_benchmarks(spark, sf_dir):
    return _said(claims.benchmark_results(paragraphs(spark, sf_dir)))


def _parts(docs):
    """Everything extracted from papers in one pass, with sources that exist, written once."""
    wide = staged(onepass.extracted(metadata.titles(docs), segment.paragraphs(docs)), "extracted")
    return {name: onepass.part(wide, name) for name in onepass.PARTS}


def e13_envelope(spark, sf_dir):
    """Everything extracted from a paper, nested; counted and digested by part."""
    docs = pages(spark, sf_dir)
    whole = onepass.extracted(metadata.titles(docs), segment.paragraphs(docs)).withColumn("source", F.lit("heuristic-fallback"))
    counts = [F.size(n).alias(f"n_{n}") for n in PARTS]
    said = lambda x, f: F.round(x[f] * 1000).cast("long").cast("string") if f in ("baseline", "score") else x[f].cast("string")
    line = lambda fields: lambda x: F.concat_ws("|", *(said(x, f) for f in fields), T.tag_text(x["sources"]))
    digests = [F.md5(F.array_join(F.transform(n, line(fields)), "\n")).alias(f"digest_{n}") for n, fields in PART_FIELDS.items()]
    return whole.select("paper_id", "source", *counts, *digests)


def e13_extractions(spark, sf_dir):
    """Extractions as files, read back with all checks."""
    docs = pages(spark, sf_dir)
    held = _filed(nested.extractions(onepass.extracted(metadata.titles(docs), segment.paragraphs(docs))), models.EXTRACTION, "extractions")
    lines = lambda c, *fields: F.md5(F.array_join(F.transform(c, lambda x: F.concat_ws("|", *(x[f] for f in fields), T.tag_text(x["sources"]))), "\n"))
    return held.select(
        "paper_id", "extraction_source",
        lines("summary.executive_summary", "text").alias("bullets"),
        lines("summary.sectional_summary", "section", "summary").alias("sections"),
        F.concat_ws("|", "summary.technical_tldr", T.tag_text(F.col("summary.technical_tldr_sources"))).alias("tldr"),
        F.concat_ws("|", "methodology.architecture", T.tag_text(F.col("methodology.architecture_sources"))).alias("architecture"),
        F.concat_ws("|", "methodology.hardware_requirements", T.tag_text(F.col("methodology.hardware_sources"))).alias("hardware"),
        lines("methodology.hyperparameters", "name", "value").alias("hyperparameters"),
        lines("methodology.loss_functions", "expression_latex", "description").alias("losses"),
        lines("methodology.datasets", "name", "details").alias("datasets"),
        lines("quantitative_results.results", "task", "metric_name", "score_context").alias("results"),
        F.round(F.aggregate("quantitative_results.results", F.lit(0.0), lambda a, r: a + r["sota_delta"]), 6).alias("deltas"),
    )


def e14_repair(spark, sf_dir):
    """Claims of two paragraphs each, of which some or all are cited on a page that lacks them."""
    paras = staged(paragraphs(spark, sf_dir), "paragraphs")
    claim = F.expr("para_no div 2")
    page = F.when((F.col("para_no") % 3 == 0) | (claim % 4 == 1), F.col("page_number") + 5).otherwise(F.col("page_number")).cast("int")
    each = F.struct("para_no", F.struct("paragraph_id", page.alias("page_number"), "section").alias("tag"))
    made = paras.groupBy("paper_id", claim.alias("claim_no")).agg(F.transform(F.sort_array(F.collect_list(each)), lambda x: x["tag"]).alias("sources"))
    anchor = F.when(F.col("claim_no") % 3 == 1, "Methodology").when(F.col("claim_no") % 3 == 2, "Results")
    return _said(claims.repair(made.withColumn("anchor", anchor), paras))


def e15_audit(spark, sf_dir):
    """Claims of which some have lost their sources, are cited on a wrong page, or are missing."""
    docs = pages(spark, sf_dir)
    paras, parts = segment.paragraphs(docs), _parts(docs)
    row = lambda df, kind, label: df.select("paper_id", F.lit(kind).alias("kind"), label.cast("string").alias("label"), "sources")
    shifted = F.transform("sources", lambda t: F.struct(t["paragraph_id"].alias("paragraph_id"), (t["page_number"] + 7).alias("page_number"), t["section"].alias("section")))
    bullets = parts["bullets"].where(~((_doc() % 6 == 0) & (F.col("bullet_no") == 3)))
    bullets = bullets.withColumn("sources", F.when((_doc() % 5 == 1) & (F.col("bullet_no") == 1), claims.no_tags()).otherwise(F.col("sources")))
    sections = parts["sections"].withColumn("sources", F.when((_doc() % 7 == 2) & (F.col("section") == "Results"), shifted).otherwise(F.col("sources")))
    made = row(bullets, "executive", F.col("bullet_no") - 1).unionByName(row(sections, "sectional", F.col("section"))).unionByName(row(parts["results"], "result", F.col("metric")))
    told = parts["tldr"].select("paper_id", F.when(_doc() % 9 == 4, " ").otherwise(F.col("tldr")).alias("tldr"))
    return claims.audit(made, told, paras).withColumn("issues", F.array_join("issues", "; "))


def _contexts(spark, sf_dir, *budget):
    docs = pages(spark, sf_dir)
    known = metadata.titles(docs).join(metadata.authors(docs), "paper_id").join(metadata.years_dois(docs), "paper_id")
    return claims.contexts(claims.context_heads(known), segment.paragraphs(docs), *budget).select("paper_id", F.length("context").alias("n_chars"), F.md5("context").alias("digest"))


def e16_contexts(spark, sf_dir):
    """Contexts of a budget of 4,000 characters, which many papers overflow."""
    return _contexts(spark, sf_dir, 4000)


def e16_whole_contexts(spark, sf_dir):
    """Contexts of the operator's budget of 15,000 characters."""
    return _contexts(spark, sf_dir)


# comparison


def f1_paper_refs(spark, sf_dir):
    return matrix.paper_refs(sets(spark, sf_dir), c2_titles(spark, sf_dir), c4_c5_year_doi(spark, sf_dir).select("paper_id", "year"))


def f2_f3_matrix(spark, sf_dir):
    """All rows of a comparison."""
    parts = _parts(pages(spark, sf_dir))
    group = sets(spark, sf_dir)
    return _said(matrix.cells(group, matrix.values(parts), matrix.benchmark_values(group, parts["results"])))


def f2_f9_comparisons(spark, sf_dir):
    """Whole comparisons as files, read back: rows with cells, verdicts and notes; findings."""
    docs = pages(spark, sf_dir)
    parts, group = _parts(docs), sets(spark, sf_dir)
    refs = matrix.paper_refs(group, metadata.titles(docs), metadata.years_dois(docs).select("paper_id", "year"))
    held = _filed(matrix.comparisons(group, refs, parts), models.COMPARISON, "comparisons", "parquet")
    cell = lambda c: F.concat_ws("|", c["paper_id"], c["value"], T.tag_text(c["sources"]))
    row = lambda r: F.concat_ws("|", r["dimension"], r["kind"], r["verdict"], r["note"], F.array_join(F.transform(r["cells"], cell), "/"))
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("|", x["statement"], F.array_join(x["paper_ids"], ","), T.tag_text(x["sources"]))), "\n")
    return held.select(
        F.array_join("paper_ids", ",").alias("paper_ids"),
        F.array_join(F.transform("papers", lambda p: F.concat_ws("|", p["title"], p["year"].cast("string"))), "\n").alias("papers"),
        F.size("rows").alias("n_rows"),
        F.md5(F.array_join(F.transform("rows", row), "\n")).alias("rows_digest"),
        said("consensus_points").alias("consensus"),
        said("contradictions").alias("contradictions"),
        "generated_by",
    )


def f4_architecture_verdicts(spark, sf_dir):
    return matrix.architecture_verdicts(sets(spark, sf_dir), claims.architectures(paragraphs(spark, sf_dir)))


def f5_hyperparameter_verdicts(spark, sf_dir):
    return matrix.hyperparameter_verdicts(sets(spark, sf_dir), extract.hyperparameters(paragraphs(spark, sf_dir)))


def f6_dataset_verdicts(spark, sf_dir):
    found = matrix.dataset_verdicts(sets(spark, sf_dir), extract.datasets(paragraphs(spark, sf_dir)))
    return _said(found).withColumn("paper_ids", F.array_join("paper_ids", ","))


def f7_f8_benchmark_verdicts(spark, sf_dir):
    found = matrix.benchmark_rows(sets(spark, sf_dir), claims.benchmark_results(paragraphs(spark, sf_dir)))
    return _said(found).withColumn("paper_ids", F.array_join("paper_ids", ","))


def f9_findings(spark, sf_dir):
    paras = staged(paragraphs(spark, sf_dir), "paragraphs")
    found = matrix.findings(sets(spark, sf_dir), extract.datasets(paras), claims.benchmark_results(paras))
    return _said(found).withColumn("paper_ids", F.array_join("paper_ids", ","))


def f10_cells(spark, sf_dir):
    return claims.benchmark_results(paragraphs(spark, sf_dir)).select("paper_id", "ord", claims.cell_text("baseline", "score", "delta", "metric").alias("cell"))


def f11_wide_matrix(spark, sf_dir):
    values = extract.hyperparameters(paragraphs(spark, sf_dir)).select("paper_id", F.col("name").alias("dimension"), "ord", "value")
    return matrix.wide(sets(spark, sf_dir), values, 10)


# gaps


def g1_g2_gap_sentences(spark, sf_dir):
    return extract.gap_sentences(paragraphs(spark, sf_dir)).withColumn("tag", T.tag_text(F.array("tag")))


def _gaps(spark, sf_dir):
    return extract.gaps(sets(spark, sf_dir), extract.gap_sentences(paragraphs(spark, sf_dir)))


def g3_g4_gaps(spark, sf_dir):
    return _said(_gaps(spark, sf_dir))


def g5_themes(spark, sf_dir):
    return extract.themes(_gaps(spark, sf_dir))


def g6_cross_cutting(spark, sf_dir):
    return _said(claims.cross_cutting(_gaps(spark, sf_dir))).withColumn("paper_ids", F.array_join("paper_ids", ","))


def g7_counts(spark, sf_dir):
    capped = staged(_gaps(spark, sf_dir), "gaps")
    return extract.gap_counts(sets(spark, sf_dir), capped, claims.cross_cutting(capped))


def g_research_gaps(spark, sf_dir):
    """Whole gap reports as files, read back."""
    capped = staged(_gaps(spark, sf_dir), "gaps")
    held = _filed(matrix.research_gaps(sets(spark, sf_dir), capped, claims.cross_cutting(capped)), models.GAPS, "gap-reports")
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("|", x["category"], F.array_join(x["paper_ids"], ","), x["statement"], T.tag_text(x["sources"]))), "\n").alias(c)
    return held.select(F.array_join("paper_ids", ",").alias("papers"), *map(said, matrix.BUCKETS), "generated_by")


def g8_badges(spark, sf_dir):
    """Claims that cite a section's paragraphs, the last page first."""
    each = F.struct((-F.col("page_number")).alias("p"), "para_no", T.tag().alias("tag"))
    made = paragraphs(spark, sf_dir).groupBy("paper_id", F.col("section").alias("claim_no")).agg(F.transform(F.sort_array(F.collect_list(each)), lambda x: x["tag"]).alias("sources"))
    return claims.badges(made).drop("sources")


QUERIES = {
    f.__name__: f
    for f in (
        g3_g4_gaps,
        a1_intake, a2_page_text, a2_read_pages, a3_nested_papers, a3_papers, a3_refused, a4_upsert, a4_upsert_counts, a5_delete_papers, a6_list_papers, a7_lookup, a7_papers, a8_resolve, a9_reuse,
        b1_lines, b2_b3_headings, b4_hint_headings, b4_hinted_paragraphs, b5_b8_paragraphs, b9_sections, b10_flat_numbers, b11_math, b12_math_spans, b13_tokens, b14_sentences, b15_keys,
        c1_titles_by_font, c1_c2_titles, c2_titles, c3_authors, c4_c5_year_doi, c6_abstracts, c7_counts, c8_enrichment,
        d1_chunks, d3_hashed_vectors, d4_term_statistics, d4_index_statistics, d5_bm25, d5_index_search, d7_dense_top_k, d9_hybrid_search, d9_given_vectors, d9_odd_queries, d10_scoped_search, d11_lexical_overlap, d12_citations,
        e1_lead_sentences, e2_bullets, e3_section_summaries, e4_tldr, e5_architectures, e6_hyperparameters, e7_losses, e8_e9_datasets, e10_hardware, e11_e12_benchmarks, e13_envelope, e13_extractions, e14_repair, e15_audit, e16_contexts, e16_whole_contexts,
        f1_paper_refs, f2_f3_matrix, f2_f9_comparisons, f4_architecture_verdicts, f5_hyperparameter_verdicts, f6_dataset_verdicts, f7_f8_benchmark_verdicts, f9_findings, f10_cells, f11_wide_matrix,
        g1_g2_gap_sentences, g5_themes, g6_cross_cutting, g7_counts, g8_badges, g_research_gaps,
    )
}
