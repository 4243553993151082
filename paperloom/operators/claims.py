"""Benchmark results, summaries, citations and their repair, context packing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..functions.constants import ARCHITECTURE, LOWER_IS_BETTER, METRICS, NO_TEXT, NUMBER, PRIORITY, SCORES, SECTIONS, TASK, THEMES
from .extract import lead_sentences

SCAN = ["Results", "Abstract", "Discussion", "Introduction"]
TAGS = "array<struct<paragraph_id string, page_number int, section string>>"


def no_tags():
    return F.array().cast(TAGS)


def scan(section: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SCAN)), section).cast("int")


def with_metric(paras: DataFrame) -> DataFrame:
    """The rows with their first metric word, where it stands, and their numbers, for ``result_told``."""
    letters = "".join(sorted({m[0].lower() for m in METRICS}))  # the pattern first looks whether a word begins like one of them
    may = F.col("section").isin(SCAN)
    word = T.first(F.col("text"), T.ascii_words(rf"(?i)\b(?=[{letters}])(" + "|".join(METRICS) + r")\b"), may=may)
    numbers = F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0))
    return paras.withColumn("word", word).withColumn("at", F.call_function("instr", F.col("text"), F.col("word"))).withColumn("numbers", F.when(F.col("word").isNotNull(), numbers))


def result_told(sentences: Column) -> Column:
    """task, metric, baseline, score, delta, higher_is_better, context of a paragraph; null where it
    has no metric word or no number. Rows: see ``with_metric``."""
    section, text, word, numbers = (F.col(c) for c in ("section", "text", "word", "numbers"))
    value = lambda x: x.try_cast("double")
    whole = lambda v: F.when((v == F.floor(v)) & F.contains(text, F.floor(v).cast("string")), F.floor(v).cast("string")).otherwise(v.cast("string"))
    apart = lambda x: F.abs(F.col("at") - F.call_function("instr", text, whole(value(x))))
    near = F.array_min(F.transform(numbers, lambda x, i: F.struct(apart(x).alias("far"), i.alias("i"), value(x).alias("v"))))
    pair = "(?i)" + SCORES
    low, high = value(T.first(text, pair)), value(T.first(text, pair, 2))
    baseline, score = F.when(low.isNotNull(), low).otherwise(0.0), F.when(low.isNotNull(), high).otherwise(near["v"])
    told = F.struct(
        F.coalesce(T.first(text, "(?U)" + TASK), F.concat(section, F.lit(" evaluation"))).alias("task"),
        F.when(F.length(word) <= 4, F.upper(word)).otherwise(word).alias("metric"),
        baseline.alias("baseline"),
        score.alias("score"),
        F.round(score - baseline, 6).alias("delta"),
        (~F.lower(word).isin(LOWER_IS_BETTER)).alias("higher_is_better"),
        F.substring(F.get(sentences, F.lit(0)), 1, 200).alias("context"),
    )
    return F.when(word.isNotNull() & (F.size(numbers) > 0), told)


def math_told(text: Column, sentences: Column) -> Column:
    """expression, description of each span of mathematics of 4 characters or more."""
    spans = F.filter(F.transform(T.math_spans(text), T.strip), lambda s: F.length(s) >= 4)
    said = lambda e: F.coalesce(F.get(F.filter(sentences, lambda x: F.contains(x, F.substring(e, 1, 20))), F.lit(0)), F.get(sentences, F.lit(0)))
    return F.transform(spans, lambda e: F.struct(e.alias("expression"), F.substring(said(e), 1, 300).alias("description")))


def benchmark_results(paras: DataFrame, most: int = 10) -> DataFrame:
    """paper_id, ord, task, metric, baseline, score, delta, higher_is_better, context, paragraph_id,
    page_number, section, sources.

    One result a paragraph: the first metric word, the numbers of ``from x to y``, or else the
    number nearest the metric with baseline 0. Sections are read in the order of SCAN; a
    section stops at ``most`` results in all, but each later one may still add one."""
    found = with_metric(paras.where(F.col("section").isin(SCAN))).where("word is not null").withColumn("told", result_told(T.sentences(F.col("text")))).where("told is not null")
    found = found.select("paper_id", "section", scan(F.col("section")).alias("scan"), "para_no", "paragraph_id", "page_number", "told.*")
    within = F.row_number().over(Window.partitionBy("paper_id", "scan").orderBy("para_no"))
    n = [F.coalesce(F.max(F.when(F.col("scan") == k, F.col("r"))).over(Window.partitionBy("paper_id")), F.lit(0)) for k in range(1, 5)]
    counted = found.withColumn("r", within).withColumns({f"n{k}": c for k, c in enumerate(n, 1)})
    before, keep = F.lit(0), F.lit(0)
    for k in range(1, 5):
        mine = F.least(F.col(f"n{k}"), F.greatest(most - before, F.lit(1)))
        keep = F.when(F.col("scan") == k, mine).otherwise(keep)
        before = before + mine
    kept = counted.withColumn("keep", keep).where("r <= keep")
    ord_ = F.row_number().over(Window.partitionBy("paper_id").orderBy("scan", "para_no"))
    return kept.select("paper_id", ord_.alias("ord"), "task", "metric", "baseline", "score", "delta", "higher_is_better", "context", "paragraph_id", "page_number", "section", F.array(T.tag()).alias("sources"))


def executive_bullets(papers: DataFrame, paras: DataFrame) -> DataFrame:
    """paper_id, bullet_no, text, sources: always three, about aim, result and limits; one that finds
    nothing says so and has no source."""
    names = ["Abstract", "Introduction", "Results", "Discussion", "Limitations", "Future Work"]
    lead = lead_sentences(paras.where(F.col("section").isin(names)), 1).select("paper_id", "section", F.struct("text", "sources").alias("x"))
    wide = papers.select("paper_id").distinct().join(lead.groupBy("paper_id").pivot("section", names).agg(F.first("x")), "paper_id", "left")
    none = [F.struct(F.lit(t).alias("text"), no_tags().alias("sources")) for t in NO_TEXT]
    limits, future = F.col("Limitations"), F.col("Future Work")
    tags = F.slice(F.concat(F.coalesce(limits["sources"], no_tags()), F.coalesce(future["sources"], no_tags())), 1, 3)
    both = F.when(limits.isNotNull() | future.isNotNull(), F.struct(F.concat_ws(" ", limits["text"], future["text"]).alias("text"), tags.alias("sources")))
    three = [F.coalesce("Abstract", "Introduction", none[0]), F.coalesce("Results", "Discussion", none[1]), F.coalesce(both, "Discussion", none[2])]
    return wide.select("paper_id", F.posexplode(F.array(*three)).alias("k", "b")).select("paper_id", (F.col("k") + 1).alias("bullet_no"), "b.text", "b.sources")


def section_summaries(paras: DataFrame) -> DataFrame:
    """paper_id, ord, section, text, sources: two lead sentences of each canonical section, by
    priority."""
    lead = lead_sentences(paras.where(F.col("section").isin(SECTIONS[1:8])), 2)
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("section"))
    return lead.select("paper_id", F.row_number().over(Window.partitionBy("paper_id").orderBy(rank)).alias("ord"), "section", "text", "sources")


def tldr(papers: DataFrame, paras: DataFrame) -> DataFrame:
    """paper_id, tldr, sources: the abstract's first sentence, else the first sentence of the title
    with a period. papers: paper_id, title."""
    lead = lead_sentences(paras.where("section = 'Abstract'"), 1).select("paper_id", "text", "sources")
    title = F.concat(F.coalesce("title", F.lit("Untitled paper.")), F.lit("."))
    said = F.coalesce("text", title)
    return papers.join(lead, "paper_id", "left").select("paper_id", F.coalesce(F.get(T.sentences(said), F.lit(0)), said).alias("tldr"), F.coalesce("sources", no_tags()).alias("sources"))


def architectures(paras: DataFrame) -> DataFrame:
    """paper_id, architecture, paragraph_id, sources: the first sentence of the first paragraph, of
    Methodology and then Abstract, that has a keyword, else of the first one."""
    near = paras.where(F.col("section").isin("Methodology", "Abstract"))
    order = [(~F.lower("text").rlike("|".join(ARCHITECTURE))).cast("int"), (F.col("section") != "Methodology").cast("int"), F.col("para_no")]
    first = near.withColumn("_r", F.row_number().over(Window.partitionBy("paper_id").orderBy(*order))).where("_r = 1")
    return first.select("paper_id", F.get(T.sentences(F.col("text")), F.lit(0)).alias("architecture"), "paragraph_id", F.array(T.tag()).alias("sources"))


def anchors(paras: DataFrame) -> DataFrame:
    """paper_id, valid (each paragraph's id and page), opening (the first source of each section),
    first (of the paper). A row holds one paper."""
    tag, order = T.tag(), F.struct("section_ord", "para_no")
    each = paras.groupBy("paper_id", "section").agg(F.min_by(tag, order).alias("tag"), F.min(order).alias("at"), F.collect_list(F.struct("paragraph_id", "page_number")).alias("ids"))
    whole = each.groupBy("paper_id").agg(F.flatten(F.collect_list("ids")).alias("valid"), F.map_from_entries(F.collect_list(F.struct("section", "tag"))).alias("opening"), F.min_by("tag", "at").alias("first"))
    return whole


def repair(claims: DataFrame, paras: DataFrame) -> DataFrame:
    """The claims with those of their sources that exist. A claim left without one gets the opening
    paragraph of its ``anchor`` (a section; null for none), else the paper's first one.

    claims: paper_id, anchor, sources, and others. Sources of papers without paragraphs all go."""
    joined = claims.join(anchors(paras), "paper_id", "left")
    there = lambda t: F.array_contains(F.col("valid"), F.struct(t["paragraph_id"].alias("paragraph_id"), t["page_number"].alias("page_number")))
    kept = F.coalesce(F.filter("sources", there), no_tags())
    other = F.coalesce(F.try_element_at("opening", F.coalesce("anchor", F.lit(""))), F.col("first"))
    fixed = F.when(F.size(kept) > 0, kept).when(other.isNotNull(), F.array(other)).otherwise(no_tags())
    return joined.withColumn("sources", fixed).drop("valid", "opening", "first")


def audit(claims: DataFrame, tldrs: DataFrame, paras: DataFrame) -> DataFrame:
    """paper_id, issues, clean: claims without a source, sources that do not exist, other than three
    executive bullets, an empty summary sentence.

    claims: paper_id, kind (executive, sectional or result), label, sources; tldrs: paper_id, tldr.
    All papers of tldrs are judged."""
    joined = claims.join(anchors(paras).select("paper_id", "valid"), "paper_id", "left")
    valid = F.coalesce("valid", F.array().cast("array<struct<paragraph_id string, page_number int>>"))
    unknown = F.filter("sources", lambda t: ~F.array_contains(valid, F.struct(t["paragraph_id"].alias("paragraph_id"), t["page_number"].alias("page_number"))))
    where = F.concat("kind", F.lit("["), "label", F.lit("]: "))
    said = F.when(F.coalesce(F.size("sources"), F.lit(0)) <= 0, F.array(F.concat(where, F.lit("missing source tags"))))
    said = said.otherwise(F.transform(unknown, lambda t: F.concat(where, F.lit("unknown tag "), t["paragraph_id"], F.lit("/p."), t["page_number"].cast("string"))))
    found = joined.groupBy("paper_id").agg(F.flatten(F.collect_list(said)).alias("found"), F.count_if(F.col("kind") == "executive").alias("bullets"))
    both = tldrs.join(found, "paper_id", "left")
    three = F.when(F.coalesce("bullets", F.lit(0)) != 3, F.array(F.lit("executive_summary must have exactly 3 bullets"))).otherwise(F.array().cast("array<string>"))
    empty = F.when(F.trim(F.coalesce("tldr", F.lit(""))) == "", F.array(F.lit("technical_tldr empty"))).otherwise(F.array().cast("array<string>"))
    issues = F.sort_array(F.concat(F.coalesce("found", F.array().cast("array<string>")), three, empty))
    return both.select("paper_id", issues.alias("issues"), (F.size(issues) == 0).alias("clean"))


def loss_expressions(paras: DataFrame) -> DataFrame:
    """paper_id, ord, expression, description, paragraph_id, sources of math spans of 4 characters or
    more.

    Of Methodology, Abstract and Introduction, the first section that has any gives those of its
    first paragraph that does; each later one those of its opening paragraph."""
    rank = F.array_position(F.array(F.lit("Methodology"), F.lit("Abstract"), F.lit("Introduction")), F.col("section")).cast("int")
    spans = F.filter(F.transform(T.math_spans(F.col("text")), T.strip), lambda s: F.length(s) >= 4)
    read = paras.withColumn("rank", rank).where("rank > 0").withColumn("spans", spans).withColumn("has", F.size("spans") > 0)
    paper, section = Window.partitionBy("paper_id"), Window.partitionBy("paper_id", "rank")
    read = read.withColumns({"first": F.min(F.when(F.col("has"), F.col("rank"))).over(paper), "yields": F.min(F.when(F.col("has"), F.col("para_no"))).over(section), "opens": F.min("para_no").over(section)})
    picked = read.where("(rank = first and para_no = yields) or (rank > first and para_no = opens)")
    each = picked.select("paper_id", "rank", "paragraph_id", T.tag().alias("tag"), T.sentences(F.col("text")).alias("s"), F.posexplode("spans").alias("k", "expression"))
    once = each.withColumn("_r", F.row_number().over(Window.partitionBy("paper_id", "expression").orderBy("rank", "k"))).where("_r = 1")
    said = F.coalesce(F.get(F.filter("s", lambda x: F.contains(x, F.substring("expression", 1, 20))), F.lit(0)), F.get("s", F.lit(0)))
    return once.select("paper_id", F.row_number().over(Window.partitionBy("paper_id").orderBy("rank", "k")).alias("ord"), "expression", F.substring(said, 1, 300).alias("description"), "paragraph_id", F.array("tag").alias("sources"))


def context_heads(papers: DataFrame) -> DataFrame:
    """paper_id, head: what a context begins with. papers: paper_id, title, authors, year."""
    head = F.concat(
        F.lit("TITLE: "), F.coalesce("title", F.lit("")),
        F.lit("\nAUTHORS: "), F.coalesce(F.array_join("authors", ", "), F.lit("")),
        F.lit("\nYEAR: "), F.coalesce(F.col("year").cast("string"), F.lit("None")), F.lit("\n\n"),
    )
    return papers.select("paper_id", head.alias("head"))


def contexts(heads: DataFrame, paras: DataFrame, budget: int = 15000) -> DataFrame:
    """paper_id, context: a head and whole tagged sections, the most telling first, until one
    overflows; a high-priority one is cut if more than 200 characters are left. heads: paper_id,
    head."""
    tagged = F.concat(F.lit("["), "paragraph_id", F.lit("|p."), F.col("page_number").cast("string"), F.lit("] "), "text")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("para_no", tagged.alias("t")))), lambda x: x["t"]), "\n")
    made = paras.groupBy("paper_id", "section").agg(body.alias("body"))
    always = heads.select("paper_id", F.explode(F.array(*map(F.lit, SECTIONS[1:8]))).alias("section"))
    block = F.concat(F.lit("## "), F.col("section"), F.coalesce(F.concat(F.lit("\n"), "body"), F.lit("")), F.lit("\n\n"))
    blocks = always.join(made, ["paper_id", "section"], "full").select("paper_id", block.alias("block"), F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("section")).cast("int").alias("ord")).join(heads, "paper_id")
    upto = Window.partitionBy("paper_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = (F.length("head") + F.sum(F.length("block")).over(upto)).cast("int")
    placed = blocks.withColumn("used", used).withColumn("last", F.min(F.when(F.col("used") > budget, F.col("ord"))).over(Window.partitionBy("paper_id")))
    room = (budget - (F.col("used") - F.length("block"))).cast("int")
    cut = F.when((F.col("ord") == F.col("last")) & (room > 200) & (F.col("ord") <= 3), F.concat(F.substring(F.col("block"), F.lit(1), room), F.lit("\n[truncated]\n\n")))
    kept = placed.withColumn("part", F.when(F.col("last").isNull() | (F.col("ord") < F.col("last")), F.col("block")).otherwise(cut)).where("part is not null or ord = 1")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.coalesce("part", F.lit("")).alias("part")))), lambda x: x["part"]), "")
    return kept.groupBy("paper_id", "head").agg(text.alias("t")).select("paper_id", F.concat("head", "t").alias("context"))


def badges(claims: DataFrame, shown: int = 4) -> DataFrame:
    """The claims with ``badges`` (``pid · p.N`` of the first ``shown`` sources, in the claim's order) and
    ``more`` (how many others)."""
    one = F.transform(F.slice("sources", 1, shown), lambda x: F.concat(x["paragraph_id"], F.lit(" · p."), x["page_number"].cast("string")))
    return claims.withColumns({"badges": F.array_join(one, ", "), "more": F.greatest(F.size("sources") - shown, F.lit(0))})


@F.pandas_udf(StringType())
def signed(delta: pd.Series) -> pd.Series:
    """A number with its sign and four digits; no built-in function drops its trailing zeros."""
    return delta.map("{:+.4g}".format)


@F.pandas_udf(StringType())
def cell_text(baseline: pd.Series, score: pd.Series, delta: pd.Series, metric: pd.Series) -> pd.Series:
    rows = pd.DataFrame({"b": baseline, "s": score, "d": delta, "m": metric})
    return rows["b"].map("{:g}".format) + " → " + rows["s"].map("{:g}".format) + " (Δ" + rows["d"].map("{:+.4g}".format) + " " + rows["m"] + ")"


def cross_cutting(capped: DataFrame, most: int = 10, chars: int = 120, tags: int = 8) -> DataFrame:
    """set_id, ord, theme, category, paper_ids, statement, sources: themes that two papers or more
    name, the first seen first; the category of the first item, each paper's first statement, and
    the sources of the first items.

    capped: set_id, category, ord, paper_id, statement, sources."""
    place = F.array_position(F.array(*map(F.lit, ["failure_modes", "dataset_shortfalls", "methodological_blinds"])), F.col("category")) * 100 + F.col("ord")
    found = F.filter(F.array(*map(F.lit, THEMES)), lambda t: F.contains(F.lower(F.col("statement")), t))
    tagged = capped.select("set_id", "paper_id", "category", "statement", "sources", place.alias("at"), F.explode(found).alias("theme"))
    paper = tagged.groupBy("set_id", "theme", "paper_id").agg(F.min(F.struct("at", "category", "statement")).alias("f"), F.collect_list(F.struct("at", "sources")).alias("s"))
    met = paper.groupBy("set_id", "theme").agg(F.sort_array(F.collect_list("f")).alias("f"), F.sort_array(F.collect_list("paper_id")).alias("paper_ids"), F.sort_array(F.flatten(F.collect_list("s"))).alias("s"))
    order = Window.partitionBy("set_id").orderBy(F.get("f", F.lit(0))["at"], F.array_position(F.array(*map(F.lit, THEMES)), F.col("theme")))
    kept = met.where(F.size("paper_ids") >= 2).withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= most)
    said = F.array_join(F.transform("f", lambda x: F.substring(x["statement"], 1, chars)), "; ")
    statement = F.concat(F.lit("Recurring theme: '"), "theme", F.lit("'. "), F.size("paper_ids").cast("string"), F.lit(" papers: "), said)
    return kept.select("set_id", "ord", "theme", F.get("f", F.lit(0))["category"].alias("category"), "paper_ids", statement.alias("statement"), F.slice(F.flatten(F.transform("s", lambda x: x["sources"])), 1, tags).alias("sources"))
