"""Titles, authors, years, abstracts, counts, and their completion from a catalogue.

Defined results: null page text is an empty page; a paper without a name, year or identifier has
null or an empty list; repeated pages are read each; ties go by line, then text; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from ..functions.constants import ARXIV, DOI, YEAR
from ..sources.staged import exchanged, scope, staged
from .relevance import relevant
from .segment import lines

# Lines that are affiliations, and parts that are no names.
AFFILIATION = r"(?i)@|university|institute|college|school|department|laboratory|lab\b"
NO_NAME = r"(?i)proceedings|conference|journal|arxiv|doi|http"


def titles_by_font(spans: DataFrame) -> DataFrame:
    """paper_id, title: the largest text in the upper part of page 1, the first of equals.

    spans: paper_id, page_number, page_height, span_no, top, size, text."""
    near = spans.where("page_number = 1 and top <= page_height / 2.5").withColumn("text", T.strip(F.col("text"))).where("length(text) >= 10")
    return near.groupBy("paper_id").agg(F.max_by("text", F.struct(F.col("size"), -F.col("span_no"))).alias("title"))


def titles(pages: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """paper_id, title: the largest text of ``spans`` where they are given, else the first line of
    page 1 with 15 characters, else the file's name."""
    each = F.transform(T.cut_lines(F.coalesce("text", F.lit(""))), lambda line, i: F.struct(i.alias("i"), T.strip(line).alias("line")))
    first = F.when(F.col("page_number") == 1, F.get(F.filter(each, lambda x: F.length(x["line"]) >= 15), F.lit(0)))
    stem = F.replace(F.regexp_replace("filename", r"\.[^.]*$", ""), F.lit("_"), F.lit(" "))
    named = pages.groupBy("paper_id").agg(F.min("filename").alias("filename"), F.min(first)["line"].alias("line"))
    if spans is None:
        return named.select("paper_id", F.coalesce("line", stem).alias("title"))
    return named.join(exchanged(titles_by_font(spans)), "paper_id", "left").select("paper_id", F.coalesce("title", "line", stem).alias("title"))


def years_dois(pages: DataFrame) -> DataFrame:
    """paper_id, year, doi of the first two pages: the year of a preprint stamp, else the latest
    from 1990 on that these pages or the file's name have."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n")
    head = pages.where("page_number <= 2").groupBy("paper_id").agg(F.min("filename").alias("filename"), text.alias("t"))
    stamp = T.first(F.col("t"), "(?i)" + ARXIV)
    yy = F.substring(stamp, 1, 2).cast("int")
    years = F.filter(F.transform(F.regexp_extract_all(F.concat("t", F.lit("\n"), "filename"), F.lit(T.ascii_words(YEAR)), F.lit(1)), lambda y: y.cast("int")), lambda y: y.between(1990, 2100))
    year = F.when(stamp.isNotNull(), yy + F.when(yy < 50, 2000).otherwise(1900)).otherwise(F.array_max(years))
    return head.select("paper_id", year.alias("year"), T.first(F.col("t"), T.ascii_words("(?i)" + DOI)).alias("doi"))


def counts(pages: DataFrame, paras: DataFrame) -> DataFrame:
    """paper_id, filename, page_count, paragraph_count."""
    n = pages.groupBy("paper_id").agg(F.min("filename").alias("filename"), F.count("*").alias("page_count"))
    return n.join(paras.groupBy("paper_id").agg(F.count("*").alias("paragraph_count")), "paper_id", "left").withColumn("paragraph_count", F.coalesce("paragraph_count", F.lit(0)))


def authors(pages: DataFrame, most: int = 20, spans: DataFrame | None = None) -> DataFrame:
    """paper_id, authors: names of the first line after the title (by ``spans`` where they are given),
    within four, that has any; an empty list where none has."""
    named = titles(pages, spans).select("paper_id", F.lower(F.substring("title", 1, 25)).alias("head"))
    page = lines(pages).where("page_number = 1 and line <> ''")
    page = page.withColumn("n", F.row_number().over(Window.partitionBy("paper_id").orderBy("line_no")))
    placed = page.join(exchanged(named), "paper_id")
    whole = Window.partitionBy("paper_id")
    at = F.coalesce(F.min(F.when(F.contains(F.lower("line"), F.col("head")), F.col("n"))).over(whole), F.lit(1))
    stop = F.min(F.when(F.contains(F.lower("line"), F.lit("abstract")) & (F.col("n") > F.col("at")), F.col("n"))).over(whole)
    near = placed.withColumn("at", at).withColumn("stop", stop).where("n > at and n <= at + 4 and (stop is null or n < stop)")
    words = F.size(F.split("line", r"\s+"))
    near = near.where(~F.col("line").rlike(AFFILIATION)).where((F.col("line").rlike(r"(?i),|\band\b") | words.between(2, 4)) & (F.length("line") < 200) & ~F.col("line").rlike(r"\d"))
    name = F.filter(F.transform(F.split("line", r",|\band\b|;|·|\|"), T.strip), lambda x: F.size(F.split(x, r"\s+")).between(1, 4) & (F.length(x) >= 3) & ~x.rlike(NO_NAME))
    found = near.withColumn("names", name).where("size(names) > 0").groupBy("paper_id").agg(F.min_by("names", "n").alias("names"))
    return named.join(exchanged(found), "paper_id", "left").select("paper_id", F.coalesce(F.slice("names", 1, most), F.array().cast("array<string>")).alias("authors"))


def abstracts(paras: DataFrame, most: int = 2000) -> DataFrame:
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("para_no", "text"))), lambda x: x["text"]), "\n\n")
    return paras.where("section = 'Abstract'").groupBy("paper_id").agg(F.substring(text, 1, most).alias("abstract"))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    told = {p: SequenceMatcher(None, *p).ratio() for p in set(zip(a, b))}
    return pd.Series([told[p] for p in zip(a, b)])


def ratio(a, b, least: float):
    """How alike two strings are, by matching blocks: 1 if equal, 0 if their lengths alone tell that
    they are not ``least`` alike; only the others are compared."""
    m, n = F.length(a), F.length(b)
    return F.when(a == b, 1.0).when(2 * F.least(m, n) < least * (m + n), 0.0).otherwise(_ratio(a, b))


def hint_headings(page_lines: DataFrame, hints: DataFrame, least: float = 0.92) -> DataFrame:
    """paper_id, page_number, line_no, heading of lines that equal or nearly equal a hint which
    itself names a section; the first section of several. hints: paper_id, hint_text."""
    known = hints.select("paper_id", F.lower(T.strip(F.col("hint_text"))).alias("hint")).withColumn("heading", T.heading(F.col("hint"))).where("heading is not null").distinct()
    a, b = F.length("low"), F.length("hint")
    # a hint that names a section has at most 100 characters, so longer lines meet none
    short = page_lines.where(F.length("line") < 250).withColumn("low", F.lower("line")).where(a * least < 100 * (2 - least))
    pairs = short.join(known, "paper_id").where(2 * F.least(a, b) > least * (a + b))
    # each distinct pair of texts is compared once
    distinct = pairs.select("low", "hint").distinct().where(ratio(F.col("low"), F.col("hint"), least) > least)
    from .segment import section_ord

    return pairs.join(distinct, ["low", "hint"]).groupBy("paper_id", "page_number", "line_no").agg(F.min_by("heading", section_ord(F.col("heading"))).alias("heading"))


HEAD = 40


def enrich(papers: DataFrame, catalog: DataFrame, least: float = 0.6, source: str = "catalog", near: float = 0.5, most: int = 5) -> DataFrame:
    """papers(paper_id, title, authors, year, abstract, venue, doi, url) completed from
    catalog(ord, title, authors, year, abstract, venue, doi, url).

    A catalogue is searched for the ``most`` entries whose titles are most relevant (``relevant``, at
    least ``near``). Two titles match if the keys are equal or one begins with the other's first 40
    characters. The candidate is the most relevant entry that matches; else the first entry of the whole
    catalogue, by ``ord``, that matches (titles that are parted into other words); else the most relevant.
    It is adopted if the keys are alike enough. Entries are found for each distinct key before they are
    joined, so titles that many share make no pairs; each row of papers comes once, whatever repeats
    (entries that share an ``ord`` go by their key, titles that share a key by the least). Empty values
    count as missing; papers without a title stay as they are."""
    fields = ["authors", "year", "abstract", "venue", "doi", "url"]
    none = lambda c, kind: F.col(c) if kind.startswith("array") or kind in ("int", "bigint") else F.nullif(F.trim(c), F.lit(""))
    kinds = dict(catalog.dtypes)
    entry = F.struct("ord", F.struct(F.col("title"), *(none(f, kinds[f]).alias(f) for f in fields)).alias("c"))
    mine = T.key(F.coalesce("title", F.lit("")))
    with scope(papers.sparkSession):
        # one entry for each key, the first; of those that share an order the least
        entries = catalog.select(T.key(F.col("title")).alias("ck"), entry.alias("e")).where("ck <> ''").groupBy("ck").agg(F.min("e").alias("e"))
        entries = staged(entries, "catalogue")
        keyed = papers.select(mine.alias("k"), "title").where("k <> ''").groupBy("k").agg(F.min("title").alias("title"))
        keyed = staged(keyed, "titles-asked")

        firsts = entries.select("ck", F.struct(F.col("e.ord").alias("ord"), F.col("ck").alias("at")).alias("first"))
        starts = firsts.select("first", "ck", F.explode(F.sequence(F.lit(1), F.least(F.lit(HEAD), F.length("ck")))).alias("n"))
        starts = starts.groupBy(F.expr("substring(ck, 1, n)").alias("p")).agg(F.min("first").alias("first"))
        # a title's first 40 characters, if so many, are those of an entry; a shorter one begins one
        longer = keyed.join(exchanged(starts), F.substring("k", 1, HEAD) == F.col("p")).select("k", "first")
        own = keyed.select("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(HEAD - 1), F.length("k")))).alias("n")).select("k", F.expr("substring(k, 1, n)").alias("ck"))
        shorter = own.join(exchanged(firsts.where(F.length("ck") < HEAD)), "ck").select("k", "first")
        alike = longer.unionByName(shorter).groupBy("k").agg(F.min("first").alias("first"))
        found = relevant(keyed, entries.select("ck", F.col("e.c.title").alias("title"), F.col("e.ord").alias("ord")), near, most)
        matches = F.startswith("ck", F.substring("k", 1, HEAD)) | F.startswith("k", F.substring("ck", 1, HEAD))
        found = found.groupBy("k").agg(F.min(F.struct((~matches).alias("other"), "rank", "ck")).alias("near"))
        first_at, other = F.col("first")["at"], F.col("near")["other"]
        chosen = alike.join(exchanged(found), "k", "full").select("k", F.when(other & first_at.isNotNull(), first_at).otherwise(F.coalesce(F.col("near")["ck"], first_at)).alias("ck"))
        taken = chosen.join(exchanged(entries), "ck").where(ratio(F.col("k"), F.col("ck"), least) >= least).select("k", F.col("e.c").alias("c"))
        taken = staged(taken, "titles-taken")

    out = papers.withColumn("k", mine).join(exchanged(taken), "k", "left").drop("k")
    few = F.coalesce(F.size("authors"), F.lit(0)) <= 1
    given = F.col("c.authors").isNotNull() & (F.size("c.authors") > 0)
    own_kinds = dict(papers.dtypes)
    filled = {f: F.coalesce(none(f, own_kinds[f]), F.col(f"c.{f}")) for f in fields[1:]} | {
        "authors": F.when(few & given, F.slice("c.authors", 1, 20)).otherwise(F.col("authors")),
        "title": F.coalesce("c.title", "title"),
        "enrichment_source": F.when(F.col("c").isNotNull(), source).otherwise("heuristic"),
    }
    return out.withColumns(filled).drop("c")
