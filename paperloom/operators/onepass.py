"""Everything that is extracted from a paper, in one pass over its paragraphs.

Each paragraph's own findings are columns of its row; paragraphs are gathered by paper once, in order,
and what needs a paper as a whole (firsts, caps, ordinals, sources) is said by array functions over
that one array. So a paper costs one exchange, which segmentation has already made. The results are
those of ``extract`` and ``claims``, part by part.

Defined results: a paper without paragraphs has three bullets that say so, a summary sentence of its
title and nothing else; otherwise as in ``extract`` and ``claims``. A row holds one paper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import ARCHITECTURE, HARDWARE, HYPERPARAMETERS, NO_TEXT, PRIORITY, SECTIONS
from .claims import SCAN, math_told, no_tags, result_told, scan, with_metric
from .extract import dataset_mentions, hyperparameter_values

BULLETS = ["Abstract", "Introduction", "Results", "Discussion", "Limitations", "Future Work"]
MATH = ["Methodology", "Abstract", "Introduction"]
BUILT = ["Methodology", "Abstract"]
PARTS = ["bullets", "sections", "tldr", "architecture", "hyperparameters", "losses", "datasets", "hardware", "results"]


def gathered(paras: DataFrame, texts: bool = False) -> DataFrame:
    """paper_id, ps: the paragraphs of each paper in order, each with what it says by itself, and with ``texts``
    its text."""
    read = with_metric(paras).withColumn("sentences", T.sentences(F.col("text")))
    section, text, sentences = F.col("section"), F.col("text"), F.col("sentences")
    lead = F.get(sentences, F.lit(0))
    para = F.struct(
        "section_ord", "para_no", "section", T.tag().alias("tag"),
        F.slice(sentences, 1, 2).alias("lead"),
        (section.isin(BUILT) & F.lower(text).rlike("|".join(ARCHITECTURE))).alias("built"),
        hyperparameter_values(text).alias("settings"),
        dataset_mentions(text, lead).alias("data"),
        T.first(text, HARDWARE, may=T.digits(text)).alias("hardware"),
        F.when(section.isin(MATH), math_told(text, sentences)).otherwise(F.array()).alias("math"),
        result_told(sentences).alias("result"),
        *["text"] * texts,
    )
    return read.select("paper_id", para.alias("p")).groupBy("paper_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))


def _opening(name: str) -> Column:
    """A section's first two paragraphs, each of which has a sentence."""
    return F.get("opened", F.lit(SECTIONS.index(name)))


def _lead(name: str, n: int, most: int = 600, tags: int = 3) -> Column:
    """text, sources of a section's first n sentences; null without any."""
    none = F.struct(F.array().cast("array<string>").alias("s"), no_tags().alias("t"))

    def read(so_far: Column, p: Column) -> Column:
        more = F.when(F.length(F.array_join(so_far["s"], " ")) <= most, F.slice(p["lead"], F.lit(1), F.lit(n) - F.size(so_far["s"]))).otherwise(F.array().cast("array<string>"))
        cited = F.when(F.size(more) > 0, F.array(p["tag"])).otherwise(no_tags())
        return F.struct(F.concat(so_far["s"], more).alias("s"), F.concat(so_far["t"], cited).alias("t"))

    whole = lambda x: F.when(F.size(x["s"]) > 0, F.struct(F.array_join(x["s"], " ").alias("text"), F.slice(F.array_distinct(x["t"]), 1, tags).alias("sources")))
    return F.aggregate(_opening(name), none, read, whole)


def _once(items: Column, name: str) -> Column:
    """The first of the items that share a name."""
    first = lambda xs: T.let(F.transform(xs, lambda x: x[name]), lambda names: F.filter(xs, lambda x, i: F.array_position(names, x[name]) == i + 1))
    return T.let(items, first)


def _numbered(items: Column, make) -> Column:
    return F.transform(items, lambda x, i: F.struct((i + 1).alias("ord"), *make(x)))


def _cited(x: Column) -> Column:
    return F.array(x["tag"]).alias("sources")


def _held(sources: Column, anchor: Column | None = None) -> Column:
    """Sources that exist; else the opening paragraph of the anchor's section, else the paper's."""
    kept = F.filter(sources, lambda t: F.array_contains("known", F.struct(t["paragraph_id"], t["page_number"])))
    first = F.get("tags", F.lit(0))
    other = first if anchor is None else F.coalesce(F.get(F.filter("tags", lambda t: t["section"] == anchor), F.lit(0)), first)
    return T.let(kept, lambda ts: F.when(F.size(ts) > 0, ts).when(other.isNotNull(), F.array(other)).otherwise(no_tags()))


def _said(column: str, names: list[str]) -> dict[str, Column]:
    return {name: F.get(column, F.lit(k)) for k, name in enumerate(names)}


def _bullets() -> Column:
    said = _said("one", BULLETS)
    none = [F.struct(F.lit(t).alias("text"), no_tags().alias("sources")) for t in NO_TEXT]
    limits, future = said["Limitations"], said["Future Work"]
    tags = F.slice(F.concat(F.coalesce(limits["sources"], no_tags()), F.coalesce(future["sources"], no_tags())), 1, 3)
    both = F.when(limits.isNotNull() | future.isNotNull(), F.struct(F.concat_ws(" ", limits["text"], future["text"]).alias("text"), tags.alias("sources")))
    three = F.array(F.coalesce(said["Abstract"], said["Introduction"], none[0]), F.coalesce(said["Results"], said["Discussion"], none[1]), F.coalesce(both, said["Discussion"], none[2]))
    return F.transform(three, lambda b, i: F.struct((i + 1).alias("bullet_no"), b["text"].alias("text"), _held(b["sources"]).alias("sources")))


def _summaries() -> Column:
    order = [s for s in PRIORITY if s in SECTIONS[1:8]]
    said = _said("two", SECTIONS[1:8])
    each = F.array(*(F.struct(F.lit(s).alias("section"), said[s].alias("said")) for s in order))
    there = F.filter(each, lambda x: x["said"].isNotNull())
    return _numbered(there, lambda x: (x["section"].alias("section"), x["said"]["text"].alias("text"), _held(x["said"]["sources"], x["section"]).alias("sources")))


def _tldr() -> Column:
    told = _said("one", BULLETS)["Abstract"]
    said = F.coalesce(told["text"], F.concat(F.coalesce("title", F.lit("Untitled paper.")), F.lit(".")))
    sentence = F.coalesce(F.get(T.sentences(said), F.lit(0)), said)
    return F.array(F.struct(sentence.alias("tldr"), _held(F.coalesce(told["sources"], no_tags())).alias("sources")))


def _architecture() -> Column:
    built = [F.filter("ps", lambda p: p["built"] & (p["section"] == name)) for name in BUILT]
    best = F.slice(F.concat(*built, *map(_opening, BUILT)), 1, 1)
    return F.transform(best, lambda p: F.struct(F.get(p["lead"], F.lit(0)).alias("architecture"), p["tag"]["paragraph_id"].alias("paragraph_id"), _cited(p)))


def _hyperparameters() -> Column:
    def met(p: Column, k: int, name: str) -> Column:
        found = F.struct(p["section_ord"].alias("a"), p["para_no"].alias("b"), F.lit(k).alias("c"), F.lit(name).alias("name"), F.get(p["settings"], F.lit(k)).alias("value"), p["tag"].alias("tag"))
        return F.when(p.isNotNull(), found)

    def each(ps: Column) -> Column:
        first = [F.get(F.filter(ps, lambda p: F.get(p["settings"], F.lit(k)).isNotNull()), F.lit(0)) for k in range(len(HYPERPARAMETERS))]
        return F.array(*(T.let(p, lambda p: met(p, k, n)) for k, (n, p) in enumerate(zip(HYPERPARAMETERS, first))))

    some = F.filter("ps", lambda p: F.exists(p["settings"], lambda v: v.isNotNull()))
    order = F.array_sort(F.filter(T.let(some, each), lambda x: x.isNotNull()))
    return _numbered(order, lambda x: (x["name"].alias("name"), x["value"].alias("value"), x["tag"]["paragraph_id"].alias("paragraph_id"), x["tag"]["page_number"].alias("page_number"), _cited(x)))


def _flat(paras: Column, field: str) -> Column:
    """The findings of paragraphs one after another, each with the paragraph's tag."""
    return F.flatten(F.transform(paras, lambda p: F.transform(p[field], lambda x: F.struct(x.alias("x"), p["tag"].alias("tag")))))


def _losses() -> Column:
    """Of the first section that has any those of its first paragraph that does, of later ones those of
    their opening paragraph."""
    picked, before = F.filter("ps", lambda p: F.lit(False)), F.lit(False)
    for name in MATH:
        has = F.filter("ps", lambda p: (p["section"] == name) & (F.size(p["math"]) > 0))
        picked = F.concat(picked, F.when(before, F.slice(_opening(name), 1, 1)).otherwise(F.slice(has, 1, 1)))
        before = before | F.exists("ps", lambda p: (p["section"] == name) & (F.size(p["math"]) > 0))
    items = F.transform(_flat(picked, "math"), lambda m: F.struct(m["x"]["expression"].alias("expression"), m["x"]["description"].alias("description"), m["tag"].alias("tag")))
    return _numbered(_once(items, "expression"), lambda x: (x["expression"].alias("expression"), x["description"].alias("description"), x["tag"]["paragraph_id"].alias("paragraph_id"), _cited(x)))


def _datasets() -> Column:
    items = F.transform(_flat(F.col("ps"), "data"), lambda d: F.struct(d["x"]["low"].alias("low"), d["x"]["name"].alias("name"), d["x"]["details"].alias("details"), d["tag"].alias("tag")))
    return _numbered(_once(items, "low"), lambda x: (x["name"].alias("name"), x["details"].alias("details"), x["tag"]["paragraph_id"].alias("paragraph_id"), _cited(x)))


def _hardware() -> Column:
    first = F.slice(F.filter("ps", lambda p: p["hardware"].isNotNull()), 1, 1)
    return F.transform(first, lambda p: F.struct(p["hardware"].alias("hardware"), p["tag"]["paragraph_id"].alias("paragraph_id"), p["tag"]["page_number"].alias("page_number"), _cited(p)))


RESULT = ("task", "metric", "baseline", "score", "delta", "higher_is_better", "context")


def _results(most: int = 10) -> Column:
    """By the order of SCAN; a section stops at ``most`` in all, but each later one may add one."""

    def read(told: Column) -> Column:
        kept = F.slice(F.filter(told, lambda p: scan(p["section"]) == 1), 1, most)
        for k in range(2, len(SCAN) + 1):
            mine = F.filter(told, lambda p: scan(p["section"]) == k)
            kept = T.let(kept, lambda ps: F.concat(ps, F.slice(mine, F.lit(1), F.greatest(most - F.size(ps), F.lit(1)))))
        return kept

    kept = T.let(F.filter("ps", lambda p: p["result"].isNotNull()), read)
    tag = lambda p: [p["tag"][c].alias(c) for c in ("paragraph_id", "page_number", "section")]
    return _numbered(kept, lambda p: (*(p["result"][c].alias(c) for c in RESULT), *tag(p), _cited(p)))


def extracted(titles: DataFrame, paras: DataFrame, texts: bool = False) -> DataFrame:
    """paper_id, title, an array for each of PARTS, and with ``texts`` the paragraphs themselves (ps).
    titles: paper_id, title, and others that are kept."""
    keys = [c for c in titles.columns if c != "paper_id"]
    whole = titles.join(gathered(paras, texts), "paper_id", "left")
    whole = whole.withColumn("ps", F.coalesce("ps", F.array().cast(dict(whole.dtypes)["ps"])))
    tags = F.transform("ps", lambda p: p["tag"])
    known = F.transform("ps", lambda p: F.struct(p["tag"]["paragraph_id"], p["tag"]["page_number"]))
    opened = F.array(*(F.slice(F.filter("ps", lambda p: p["section"] == s), 1, 2) for s in SECTIONS))
    whole = whole.withColumns({"tags": tags, "known": known, "opened": opened})  # arrays, which are read often and made once
    leads = {"one": F.array(*(_lead(s, 1) for s in BULLETS)), "two": F.array(*(_lead(s, 2) for s in SECTIONS[1:8]))}
    whole = whole.withColumns(leads)
    made = (_bullets(), _summaries(), _tldr(), _architecture(), _hyperparameters(), _losses(), _datasets(), _hardware(), _results())
    return whole.select("paper_id", *keys, *(c.alias(n) for n, c in zip(PARTS, made)), *["ps"] * texts)


def part(wide: DataFrame, name: str) -> DataFrame:
    """One part as rows: paper_id and the columns of its structs."""
    return wide.select("paper_id", F.explode(name).alias("x")).select("paper_id", "x.*")
