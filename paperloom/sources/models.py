"""The models as files: page text, papers, extractions, comparisons and gaps, one JSON text or row each.

A model says of every field its type, whether it must be there, what stands for it where it is missing,
and what it must satisfy. From this come the schema to read with, the completed row, and the reason
why a row is refused. So a file that another program has written is read with the same guarantees as
one of ours.

Defined results: text that is not JSON of the model's shape, or lacks what must be there, is refused
with the first reason, by the order of the fields; fields that may be missing, or are null, take their
default; unknown fields are ignored; null and blank lines are refused; repeated rows are read each; an
empty file gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MUST, MAY = object(), None  # a field that must be there; one that may be null

# The fields of the models in their order, as programs that exchange them name them.
# (type, default), where a type is a name, a model, or a list of one of these.
TAG = {"page_number": ("int", MUST), "paragraph_id": ("string", MUST), "section": ("string", "")}
CITED = ([TAG], [])
PARAGRAPH = {"paragraph_id": ("string", MUST), "page_number": ("int", MUST), "text": ("string", MUST)}
SECTION = {"name": ("string", MUST), "text": ("string", ""), "paragraphs": ([PARAGRAPH], [])}
METADATA = {
    "title": ("string", MAY), "authors": (["string"], []), "year": ("int", MAY), "venue": ("string", MAY), "abstract": ("string", MAY), "doi": ("string", MAY), "url": ("string", MAY),
    "enrichment_source": ("string", "pdf-heuristic"),
}
PAPER = {"paper_id": ("string", MUST), "filename": ("string", MUST), "metadata": (METADATA, MUST), "sections": ([SECTION], MUST), "page_count": ("int", MUST), "paragraph_count": ("int", MUST)}

PAGE = {"paper_id": ("string", MUST), "filename": ("string", MUST), "page_number": ("int", MUST), "text": ("string", "")}

BULLET = {"text": ("string", MUST), "sources": CITED}
SECTIONAL = {"section": ("string", MUST), "summary": ("string", MUST), "sources": CITED}
SUMMARY = {"executive_summary": ([BULLET], MUST), "sectional_summary": ([SECTIONAL], []), "technical_tldr": ("string", MUST), "technical_tldr_sources": CITED}
HYPERPARAMETER = {"name": ("string", MUST), "value": ("string", MUST), "sources": CITED}
LOSS = {"name": ("string", ""), "expression_latex": ("string", ""), "description": ("string", ""), "sources": CITED}
DATASET = {"name": ("string", MUST), "details": ("string", ""), "sources": CITED}
METHODOLOGY = {
    "architecture": ("string", ""), "architecture_sources": CITED, "hyperparameters": ([HYPERPARAMETER], []), "loss_functions": ([LOSS], []), "datasets": ([DATASET], []),
    "hardware_requirements": ("string", ""), "hardware_sources": CITED,
}
RESULT = {
    "task": ("string", MUST), "metric_name": ("string", MUST), "baseline_score": ("double", 0.0), "baseline_label": ("string", ""), "paper_score": ("double", 0.0), "sota_delta": ("double", 0.0),
    "higher_is_better": ("boolean", True), "score_context": ("string", ""), "sources": CITED,
}
RESULTS = {"results": ([RESULT], [])}
EXTRACTION = {"paper_id": ("string", MUST), "summary": (SUMMARY, MUST), "methodology": (METHODOLOGY, {}), "quantitative_results": (RESULTS, {}), "extraction_source": ("string", "heuristic-fallback")}

REF = {"paper_id": ("string", MUST), "title": ("string", ""), "year": ("int", MAY)}
CELL = {"paper_id": ("string", MUST), "value": ("string", MUST), "sources": CITED}
ROW = {"dimension": ("string", MUST), "kind": ("string", MUST), "cells": ([CELL], []), "verdict": ("string", "n/a"), "note": ("string", "")}
FINDING = {"statement": ("string", MUST), "paper_ids": (["string"], []), "sources": CITED}
COMPARISON = {"paper_ids": (["string"], MUST), "papers": ([REF], []), "rows": ([ROW], []), "consensus_points": ([FINDING], []), "contradictions": ([FINDING], []), "generated_by": ("string", "heuristic")}
GAP = {"statement": ("string", MUST), "category": ("string", MUST), "paper_ids": (["string"], []), "sources": CITED}
GAPS = {"paper_ids": (["string"], MUST), "failure_modes": ([GAP], []), "dataset_shortfalls": ([GAP], []), "methodological_blinds": ([GAP], []), "cross_cutting": ([GAP], []), "generated_by": ("string", "heuristic")}

# Who may have made an extraction, and the canonical sections that a paper must have.
MAKERS = ["openai-structured", "heuristic-fallback"]
CANONICAL = ["Abstract", "Introduction", "Methodology", "Results", "Discussion", "Limitations", "Future Work"]

CORRUPT = "_corrupt_record"


def ddl(kind) -> str:
    """A type of a model as Spark names it."""
    if isinstance(kind, str):
        return kind
    if isinstance(kind, list):
        return f"array<{ddl(kind[0])}>"
    return "struct<" + ", ".join(f"{name}: {ddl(k)}" for name, (k, _) in kind.items()) + ">"


def columns(model: dict) -> str:
    """A model as the schema of a table."""
    return ", ".join(f"{name} {ddl(kind)}" for name, (kind, _) in model.items())


def completed(c: Column, kind, default) -> Column:
    """The value with what stands for missing fields."""
    if isinstance(kind, dict):
        whole = F.struct(*(completed(c[name], k, d).alias(name) for name, (k, d) in kind.items()))
        return whole if default == {} else F.when(c.isNotNull(), whole)
    if isinstance(kind, list) and isinstance(kind[0], dict):
        c = F.transform(c, lambda x: completed(x, kind[0], MAY))
    if default is MUST or default is MAY:
        return c
    return F.coalesce(c, F.array().cast(ddl(kind)) if isinstance(kind, list) else F.lit(default).cast(kind))


def problems(c: Column, kind, default, at: str) -> Column:
    """What is wrong with a value, as texts that begin with its place; outer places first."""
    none = F.array().cast("array<string>")
    found = F.when(c.isNull(), F.array(F.lit(f"{at}: missing"))) if default is MUST else F.when(c.isNull(), none)
    if isinstance(kind, dict):
        parts = [problems(c[name], k, d, f"{at}.{name}" if at else name) for name, (k, d) in kind.items()]
        parts = [p for p in parts if p is not None]
        return found.otherwise(F.concat(*parts)) if parts else found.otherwise(none)
    if isinstance(kind, list):
        if kind == ["string"]:
            return found.otherwise(F.when(F.exists(c, lambda x: x.isNull()), F.array(F.lit(f"{at}: null entry"))).otherwise(none))
        return found.otherwise(F.flatten(F.transform(c, lambda x: problems(x, kind[0], MUST, at))))
    if at.endswith("page_number"):
        return found.when(c < 1, F.array(F.lit(f"{at}: below 1"))).otherwise(none)
    return found.otherwise(none) if default is MUST else None


def rules(model: dict, c: Column) -> list[Column]:
    """What holds for a model as a whole: text of what is wrong, or null."""
    if model is PAGE:
        return [F.when(F.trim(c["paper_id"]) == "", "paper_id: empty")]
    if model is EXTRACTION:
        return [
            F.when(F.size(c["summary"]["executive_summary"]) != 3, "summary.executive_summary: not 3 entries"),
            F.when(~c["extraction_source"].isin(MAKERS), "extraction_source: unknown"),
        ]
    if model is PAPER:
        names = F.transform(c["sections"], lambda s: s["name"])
        held = F.aggregate(c["sections"], F.lit(0), lambda n, s: n + F.coalesce(F.size(s["paragraphs"]), F.lit(0)))
        return [
            F.when(F.size(F.array_except(F.array(*map(F.lit, CANONICAL)), names)) > 0, "sections: a canonical one is missing"),
            F.when(held != c["paragraph_count"], "paragraph_count: not that of the sections"),
        ]
    return [F.when(~F.size(c["paper_ids"]).between(1, 20), "paper_ids: not 1 to 20")]


def refusal(c: Column, model: dict) -> Column:
    """Why a row of a model is refused: its first fault; null if it is good. A null row is not of the shape."""
    inner = [p for name, (k, d) in model.items() if (p := problems(c[name], k, d, name)) is not None]
    ruled = F.filter(F.array(*rules(model, c)), lambda x: x.isNotNull())
    return F.when(c.isNull(), "not of the model's shape").otherwise(F.get(F.concat(*inner, ruled), F.lit(0)))


def judged(rows: DataFrame, model: dict, *keep: str) -> DataFrame:
    """The columns of a model, completed, ``keep``, and ``refused`` (why, or null). rows: a column ``m``."""
    fields = [completed(F.col("m")[name], k, d).alias(name) for name, (k, d) in model.items()]
    return rows.select(*keep, refusal(F.col("m"), model).alias("refused"), *fields)


def parsed(texts: DataFrame, model: dict, column: str = "value") -> DataFrame:
    """Texts of JSON as rows of ``judged``; ``value`` is the text."""
    read = F.from_json(column, f"{columns(model)}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    # exploded, as a filter on the rows would else be pushed below and read a text once for each field it asks for
    whole = texts.select(F.col(column).alias("value"), F.explode(F.array(read)).alias("m"))
    bad = F.col("m").isNull() | F.col(f"m.{CORRUPT}").isNotNull() | (F.trim(F.coalesce("value", F.lit(""))) == "")
    return judged(whole.select("value", F.explode(F.array(F.when(~bad, F.col("m")))).alias("m")), model, "value")


def write(rows: DataFrame, path: str, model: dict, kind: str = "json", mode: str = "errorifexists") -> None:
    """Rows of a model as JSON lines or Parquet; columns beside the model's are left out."""
    rows.select(*(F.col(name).cast(ddl(k)).alias(name) for name, (k, _) in model.items())).write.format(kind).mode(mode).save(path)


def read(spark: SparkSession, path: str, model: dict, kind: str = "json") -> tuple[DataFrame, DataFrame]:
    """The good rows of a model's files; and the others: refused (why), value (the row as JSON)."""
    if kind == "json":
        rows = parsed(spark.read.text(path), model)
    else:
        held = spark.read.schema(columns(model)).format(kind).load(path)
        rows = judged(held.select(F.struct(*model).alias("m"), F.to_json(F.struct(*model)).alias("value")), model, "value")
    return rows.where("refused is null").drop("refused", "value"), rows.where("refused is not null").select("refused", "value")
