"""Paragraphs to retrieval chunks; each keeps the paragraphs and pages it came from.

Defined results: blank and null paragraphs are left out; a paper without others has no chunk;
paragraphs are taken by section and number, and equal ones by what they hold; a very long one is
cut at sentences; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

ITEM = "struct<i:int,part:int>"


def split_long(text: Column, target: int) -> Column:
    """Sentences packed greedily into groups of at most ``target`` characters."""
    sentences = F.split(text, r"(?U)(?<=[.!?])[\s\x1c-\x1f]+")

    def step(s: Column, x: Column) -> Column:
        full = (F.length(s["last"]) > 0) & (F.length(s["last"]) + F.length(x) > target)
        done = F.when(full, F.array_append(s["done"], s["last"])).otherwise(s["done"])
        last = F.when(full, x).otherwise(T.strip(F.concat_ws(" ", s["last"], x)))
        return F.struct(done.alias("done"), last.alias("last"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.get(sentences, F.lit(0)).alias("last"))
    groups = F.aggregate(F.slice(sentences, 2, F.size(sentences)), start, step, lambda s: F.filter(F.array_append(s["done"], s["last"]), lambda g: g != ""))
    return F.when(F.size(groups) > 0, groups).otherwise(F.array(text))


def packed(sizes: Column, parts: Column, target: int, overlap: int) -> Column:
    """Chunks as arrays of (i, part): paragraph ``i`` whole where part is -1, else one part of it.

    sizes: characters of each paragraph; parts: those of its parts, where it has more than twice the
    ``target``. A chunk takes whole paragraphs until it holds ``target`` characters; a paragraph that
    is too long and alone is cut. The last ``overlap`` items open the next chunk if this one took new
    paragraphs; such items that fill a chunk by themselves are one, and open no other."""
    none = F.array().cast(f"array<{ITEM}>")
    item = lambda i, part: F.struct(i.cast("int").alias("i"), part.cast("int").alias("part"))
    size = lambda x: F.when(x["part"] < 0, F.get(sizes, x["i"])).otherwise(F.get(F.get(parts, x["i"]), x["part"]))
    state = lambda out, held, at, n: F.struct(out.alias("out"), held.alias("held"), at.cast("int").alias("at"), n.cast("int").alias("n"))

    def items(s: Column, i: Column) -> Column:
        new = F.when(i > s["at"], F.transform(F.sequence(s["at"], i - 1), lambda j: item(j, F.lit(-1)))).otherwise(none)

        def cut(xs: Column) -> Column:
            only = F.get(xs, F.lit(0))["i"]
            alone = (F.size(xs) == 1) & (F.get(xs, F.lit(0))["part"] < 0) & (F.get(sizes, only) > 2 * target)
            return F.when(alone, F.transform(F.get(parts, only), lambda _, k: item(only, k))).otherwise(xs)

        return T.let(F.concat(s["held"], new), cut)

    def close(s: Column, i: Column) -> Column:
        def then(xs: Column) -> Column:
            held = F.when(i > s["at"], F.slice(xs, F.greatest(F.size(xs) - overlap, F.lit(0)) + 1, overlap)).otherwise(none)
            return T.let(held, lambda h: state(F.array_append(s["out"], xs), h, i, F.aggregate(F.transform(h, size), F.lit(0), lambda a, n: a + n)))

        return T.let(items(s, i), then)

    def step(s: Column, x: Column) -> Column:
        room = lambda s: F.when(s["n"] >= target, close(s, x["i"])).otherwise(s)
        return T.let(T.let(room(s), room), lambda s: state(s["out"], s["held"], s["at"], s["n"] + x["n"]))

    each = F.transform(sizes, lambda n, i: F.struct(i.alias("i"), n.alias("n")))
    start = state(F.array().cast(f"array<array<{ITEM}>>"), none, F.lit(0), F.lit(0))
    return F.aggregate(each, start, step, lambda s: F.array_append(s["out"], items(s, F.size(sizes))))


def chunks(paras: DataFrame, target: int = 1000, overlap: int = 1) -> DataFrame:
    """paper_id, chunk_id, chunk_no, section, text, page_number, pages, paragraph_ids,
    token_count. A paper is one row of its paragraphs, and they are packed by place and size, so
    that a chunk's text is put together once."""
    held = F.struct("section_ord", "para_no", "section", "paragraph_id", F.col("page_number").cast("int").alias("page"), "text")
    papers = paras.where(T.strip(F.col("text")) != "").groupBy("paper_id").agg(F.sort_array(F.collect_list(held)).alias("ps"))
    long = lambda p: F.when(F.length(p["text"]) > 2 * target, split_long(p["text"], target))
    papers = papers.withColumn("parts", F.transform("ps", long))
    # columns, as every step of the packing reads them
    papers = papers.withColumns({"sizes": F.transform("ps", lambda p: F.length(p["text"])), "part_sizes": F.transform("parts", lambda p: F.transform(p, F.length))})
    made = papers.withColumn("made", packed(F.col("sizes"), F.col("part_sizes"), target, overlap))

    ps, parts = F.col("ps"), F.col("parts")
    said = lambda x: F.when(x["part"] < 0, F.get(ps, x["i"])["text"]).otherwise(F.get(F.get(parts, x["i"]), x["part"]))
    of = lambda xs, field: F.transform(xs, lambda x: F.get(ps, x["i"])[field])
    chunk = lambda xs, n: F.struct(
        n.cast("int").alias("chunk_no"),
        F.get(of(xs, "section"), F.lit(0)).alias("section"),
        F.array_join(F.transform(xs, said), "\n\n").alias("text"),
        F.array_sort(F.array_distinct(of(xs, "page"))).alias("pages"),
        of(xs, "paragraph_id").alias("paragraph_ids"),
    )
    out = made.select("paper_id", F.explode(F.transform("made", chunk)).alias("c"))
    named = F.concat("paper_id", F.lit(":c"), F.col("c.chunk_no").cast("string"))
    return out.select(
        "paper_id", named.alias("chunk_id"), "c.chunk_no", "c.section", "c.text", F.get("c.pages", F.lit(0)).alias("page_number"), "c.pages", "c.paragraph_ids", F.size(T.tokens(F.col("c.text"))).alias("token_count")
    )
