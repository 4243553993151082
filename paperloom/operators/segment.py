"""Pages to lines, headings, paragraphs and sections. Everything is keyed by paper_id.

Defined results: null page text is an empty page; papers without text have no paragraph, but all
canonical sections; pages that share a number are read line by line in turn; repeated rows are
read each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import SECTIONS


def lines(pages: DataFrame) -> DataFrame:
    """paper_id, page_number, line_no, line (stripped; blank lines stay)."""
    whole = pages.withColumn("cut", T.cut_lines(F.coalesce("text", F.lit(""))))  # read often and made once
    cut = F.when(F.element_at("cut", F.lit(-1)) == "", F.slice("cut", 1, F.size("cut") - 1)).otherwise(F.col("cut"))
    return whole.select("paper_id", "page_number", F.posexplode(cut).alias("line_no", "line")).withColumn("line", T.strip(F.col("line")))


def marked_lines(pages: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Lines with the heading they are or begin with, and the content they hold. A line that nearly
    equals a heading among its paper's ``hints`` (see metadata.hint_headings) is a heading, before
    it is looked at for one that it begins with."""
    found = lines(pages).withColumn("own", T.heading(F.col("line")))
    if hints is not None:
        from .metadata import hint_headings

        near = hint_headings(found.where("own is null and line <> ''"), hints).withColumnRenamed("heading", "hinted")
        found = found.join(near, ["paper_id", "page_number", "line_no"], "left").withColumn("own", F.coalesce("own", "hinted")).drop("hinted")
    begun, rest = T.run_on(F.col("line"))
    body = F.when(F.col("own").isNotNull() | (F.col("line") == ""), None).when(F.col("begun").isNotNull(), T.strip(F.col("rest"))).otherwise(F.col("line"))
    marked = found.withColumns({"begun": begun, "rest": rest})
    return marked.select("paper_id", "page_number", "line_no", "line", F.coalesce("own", "begun").alias("heading"), body.alias("body"))


def section_ord(section):
    return (F.array_position(F.array(*map(F.lit, SECTIONS)), section) - 1).cast("int")


def paragraphs(pages: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """paper_id, section_ord, section, para_no, paragraph_id, page_number, text.

    One exchange, of whole pages by paper: lines, windows and grouping share its partitioning,
    and the work on lines is spread however the input files are cut."""
    pages = pages.repartition("paper_id")
    order = Window.partitionBy("paper_id").orderBy("page_number", "line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    breaks = (F.col("heading").isNotNull() | (F.col("line") == "")).cast("int")
    placed = marked_lines(pages, hints).select(
        "paper_id", "page_number", "line_no", "body",
        F.sum(breaks).over(so_far).alias("grp"),
        F.last("heading", ignorenulls=True).over(so_far).alias("section"),
        F.max(F.col("heading").isNotNull()).over(Window.partitionBy("paper_id")).alias("any_heading"),
    )
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", "line_no", "body"))), lambda x: x["body"]), " ")
    grouped = placed.where("body is not null").groupBy("paper_id", "grp").agg(joined.alias("text"), F.first("section").alias("section"), F.first("any_heading").alias("any_heading"), F.min("page_number").cast("int").alias("page_number"))
    kept = grouped.withColumn("text", T.single_spaces(F.col("text"))).where("length(text) >= 2")
    number = F.row_number().over(Window.partitionBy("paper_id").orderBy("grp"))
    section = F.coalesce("section", F.when(F.col("any_heading"), "Preamble").otherwise("Introduction"))
    out = kept.select("paper_id", section.alias("section"), number.alias("para_no"), "page_number", T.latex(F.col("text")).alias("text"))
    return out.select("paper_id", section_ord(F.col("section")).alias("section_ord"), "section", "para_no", F.concat(F.lit("p"), "para_no").alias("paragraph_id"), "page_number", "text")


def sections(papers: DataFrame, paras: DataFrame) -> DataFrame:
    """paper_id, section_ord, section, n_paragraphs, text; the seven canonical sections always."""
    scaffold = papers.select("paper_id").distinct().select("paper_id", F.explode(F.array(*map(F.lit, SECTIONS[1:8]))).alias("section")).withColumn("section_ord", section_ord(F.col("section")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("para_no", "text"))), lambda x: x["text"]), "\n\n")
    made = paras.groupBy("paper_id", "section_ord", "section").agg(F.count("*").alias("n_paragraphs"), text.alias("text"))
    joined = scaffold.join(made, ["paper_id", "section_ord", "section"], "full")
    return joined.select("paper_id", "section_ord", "section", F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), F.coalesce("text", F.lit("")).alias("text"))


def flat_numbers(paras: DataFrame) -> DataFrame:
    """Paragraphs renumbered in section order."""
    number = F.row_number().over(Window.partitionBy("paper_id").orderBy("section_ord", "para_no"))
    return paras.select("paper_id", "paragraph_id", number.alias("flat_no"), "page_number")
