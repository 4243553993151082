"""One nested row a paper: its sections with their paragraphs, and everything extracted from it.

Defined results: a paper without paragraphs or claims has empty arrays; a null title stays null;
arrays are sorted by their structs, so equal ones stand together; repeated papers are joined each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import SECTIONS as SECTION_NAMES
from ..sources import models

PARAGRAPHS = "array<struct<para_no int, paragraph_id string, page_number int, text string>>"
SECTIONS = f"array<struct<section_ord int, section string, paragraphs {PARAGRAPHS}>>"
PAPER = f"paper_id string, title string, sections {SECTIONS}"


def papers(titles: DataFrame, paras: DataFrame) -> DataFrame:
    """Rows of PAPER. titles: paper_id, title. A group is one paper."""
    each = paras.groupBy("paper_id", "section_ord", "section").agg(F.sort_array(F.collect_list(F.struct("para_no", "paragraph_id", "page_number", "text"))).alias("paragraphs"))
    whole = each.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("section_ord", "section", "paragraphs"))).alias("sections"))
    return titles.join(whole, "paper_id", "left").select("paper_id", "title", F.coalesce("sections", F.array().cast(SECTIONS)).alias("sections"))


def flat(nested: DataFrame) -> DataFrame:
    """The paragraphs of nested papers, as segmentation gave them."""
    section = nested.select("paper_id", F.explode("sections").alias("s"))
    para = section.select("paper_id", "s.section_ord", "s.section", F.explode("s.paragraphs").alias("p"))
    return para.select("paper_id", "section_ord", "section", "p.para_no", "p.paragraph_id", "p.page_number", "p.text")


def envelope(papers: DataFrame, parts: dict[str, DataFrame], source: str = "heuristic-fallback") -> DataFrame:
    """paper_id, source and an array for each part, empty where a paper has none. A part has
    paper_id and the columns of its structs, in whose order the structs are sorted."""
    out = papers.select("paper_id").distinct().withColumn("source", F.lit(source))
    for name, part in parts.items():
        fields = [c for c in part.columns if c != "paper_id"]
        held = part.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(held, "paper_id", "left").withColumn(name, F.coalesce(name, F.array().cast(dict(held.dtypes)[name])))
    return out


def metadata(titles: DataFrame, *others: DataFrame) -> DataFrame:
    """paper_id, metadata (the struct of the paper model) from tables of paper_id and some of its fields,
    each with a row a paper."""
    out = titles
    for other in others:
        out = out.join(other, "paper_id", "left")
    have = set(out.columns)
    field = {n: F.col(n) if n in have else F.lit(None) for n in models.METADATA}
    whole = F.struct(*(field[n].cast(models.ddl(k)).alias(n) for n, (k, _) in models.METADATA.items()))
    return out.select("paper_id", models.completed(whole, models.METADATA, models.MUST).alias("metadata"))


def whole_papers(pages: DataFrame, paras: DataFrame, described: DataFrame) -> DataFrame:
    """Rows of models.PAPER: the preamble if it has text, the seven canonical sections even if empty, and
    the references if they have text; the abstract's text where ``described`` (see metadata) has none."""
    held = F.sort_array(F.collect_list(F.struct("section_ord", "para_no", "section", "paragraph_id", "page_number", "text")))
    gathered = paras.groupBy("paper_id").agg(held.alias("ps"))
    counted = pages.groupBy("paper_id").agg(F.min("filename").alias("filename"), F.count("*").cast("int").alias("page_count"))
    out = counted.join(gathered, "paper_id", "left").join(described, "paper_id", "left")
    out = out.withColumn("ps", F.coalesce("ps", F.array().cast(dict(out.dtypes)["ps"])))

    def section(name: Column) -> Column:
        inner = lambda mine: F.transform(mine, lambda p: F.struct(p["paragraph_id"].alias("paragraph_id"), p["page_number"].alias("page_number"), p["text"].alias("text")))
        whole = lambda mine: F.struct(name.alias("name"), F.array_join(F.transform(mine, lambda p: p["text"]), "\n\n").alias("text"), inner(mine).alias("paragraphs"))
        return T.let(F.filter("ps", lambda p: p["section"] == name), whole)

    each = F.transform(F.array(*map(F.lit, SECTION_NAMES)), section)
    out = out.withColumn("sections", F.filter(each, lambda s: s["name"].isin(*models.CANONICAL) | (F.size(s["paragraphs"]) > 0)))
    said = F.substring(F.trim(F.get(F.filter("sections", lambda s: s["name"] == "Abstract"), F.lit(0))["text"]), 1, 2000)
    abstract = F.coalesce(F.nullif("metadata.abstract", F.lit("")), F.nullif(said, F.lit("")))
    described_too = F.col("metadata").withField("abstract", abstract)
    return out.select("paper_id", "filename", described_too.alias("metadata"), "sections", "page_count", F.size("ps").alias("paragraph_count"))


def extractions(wide: DataFrame, source: str = "heuristic-fallback") -> DataFrame:
    """Rows of models.EXTRACTION from those of onepass.extracted."""
    pick = lambda part, /, **fields: F.transform(part, lambda x: F.struct(*((x[f] if isinstance(f, str) else f).alias(n) for n, f in fields.items())))
    one = lambda part, field, kind: F.coalesce(F.get(part, F.lit(0))[field], F.lit("") if kind == "string" else F.array().cast(kind))
    summary = F.struct(
        pick("bullets", text="text", sources="sources").alias("executive_summary"),
        pick("sections", section="section", summary="text", sources="sources").alias("sectional_summary"),
        one("tldr", "tldr", "string").alias("technical_tldr"),
        F.get("tldr", F.lit(0))["sources"].alias("technical_tldr_sources"),
    )
    methodology = F.struct(
        one("architecture", "architecture", "string").alias("architecture"),
        F.get("architecture", F.lit(0))["sources"].alias("architecture_sources"),
        pick("hyperparameters", name="name", value="value", sources="sources").alias("hyperparameters"),
        pick("losses", name=F.lit(""), expression_latex="expression", description="description", sources="sources").alias("loss_functions"),
        pick("datasets", name="name", details="details", sources="sources").alias("datasets"),
        one("hardware", "hardware", "string").alias("hardware_requirements"),
        F.get("hardware", F.lit(0))["sources"].alias("hardware_sources"),
    )
    result = dict(task="task", metric_name="metric", baseline_score="baseline", baseline_label=F.lit(""), paper_score="score", sota_delta="delta", higher_is_better="higher_is_better", score_context="context", sources="sources")
    rows = wide.select("paper_id", summary.alias("summary"), methodology.alias("methodology"), F.struct(pick("results", **result).alias("results")).alias("quantitative_results"), F.lit(source).alias("extraction_source"))
    rows = rows.select(*(models.completed(F.col(n), k, d).alias(n) for n, (k, d) in models.EXTRACTION.items()))
    return rows.select(*(F.col(n).cast(models.ddl(k)).alias(n) for n, (k, _) in models.EXTRACTION.items()))
