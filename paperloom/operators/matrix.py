"""Comparison of the papers of a set: rows with a cell for each paper, verdicts, notes, findings.

sets: set_id, paper_ord, paper_id. Values of one dimension: paper_id, ord, name, value, sources.
A set's rows come first in the order in which its papers, and a paper's claims, name them.

Defined results: a missing or empty value is a dash without sources; papers outside every set
count nowhere; of several values of a paper for one name the first counts, of benchmarks the
last; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import models
from .claims import cell_text, no_tags, signed

BUCKETS = ["failure_modes", "dataset_shortfalls", "methodological_blinds", "cross_cutting"]
MISSING = "—"
KINDS = ["tl_dr", "architecture", "hyperparameter", "dataset", "benchmark"]


def paper_refs(sets: DataFrame, titles: DataFrame, years: DataFrame) -> DataFrame:
    """The papers of each set with title (Untitled where there is none) and year."""
    return sets.join(titles, "paper_id", "left").join(years, "paper_id", "left").withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")))


def limited(sets: DataFrame, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """The sets of at most ``most`` papers, whose rows and cells are bounded; and set_id, n_papers of the
    others, which are not compared."""
    counted = sets.groupBy("set_id").agg(F.count("*").alias("n_papers"))
    return sets.join(counted.where(F.col("n_papers") > most), "set_id", "left_anti"), counted.where(F.col("n_papers") > most)


def dimension(claims: DataFrame, rank: int, name: Column, kind: str, value: Column) -> DataFrame:
    """paper_id, rank, ord, dimension, kind, value, sources for ``cells``."""
    ord_ = F.col("ord") if "ord" in claims.columns else F.lit(1)
    return claims.select("paper_id", F.lit(rank).alias("rank"), ord_.alias("ord"), name.alias("dimension"), F.lit(kind).alias("kind"), value.alias("value"), "sources")


def cells(sets: DataFrame, values: DataFrame, benchmarks: DataFrame | None = None) -> DataFrame:
    """set_id, row_ord, dimension, kind, paper_ord, paper_id, value, sources: a dash and no sources
    where a paper has no value. values: see ``dimension``; benchmarks: see ``benchmark_values``."""
    at = lambda *c: F.struct(*(x.cast("long").alias(n) for n, x in zip("abc", c)))
    keys = ["set_id", "dimension", "kind", "paper_id"]
    held = sets.join(values, "paper_id").select(*keys, at(F.col("rank"), F.col("paper_ord"), F.col("ord")).alias("at"), "value", "sources")
    if benchmarks is not None:
        last = at(F.lit(len(KINDS)), F.col("row_ord"), F.lit(0))
        held = held.unionByName(benchmarks.select("set_id", "dimension", F.lit("benchmark").alias("kind"), "paper_id", last.alias("at"), "value", "sources"))
    given = held.groupBy(*keys).agg(F.min(F.struct("at", "value", "sources")).alias("v"))
    rows = given.groupBy("set_id", "dimension", "kind").agg(F.min("v.at").alias("first"))
    rows = rows.withColumn("row_ord", F.row_number().over(Window.partitionBy("set_id").orderBy("first", "dimension"))).drop("first")
    laid = rows.join(sets, "set_id").join(given, keys, "left")
    value = F.coalesce(F.nullif("v.value", F.lit("")), F.lit(MISSING))
    return laid.select("set_id", "row_ord", "dimension", "kind", "paper_ord", "paper_id", value.alias("value"), F.coalesce("v.sources", no_tags()).alias("sources"))


def wide(sets: DataFrame, values: DataFrame, places: int) -> DataFrame:
    """set_id, dimension, p0, p1, ...: one column for each place in a set; the first value counts.
    values: paper_id, dimension, ord, value."""
    found = sets.join(values, "paper_id").groupBy("set_id", "dimension").pivot("paper_ord", list(range(places))).agg(F.min_by("value", "ord"))
    return found.select("set_id", "dimension", *(F.coalesce(F.nullif(F.col(f"`{k}`"), F.lit("")), F.lit(MISSING)).alias(f"p{k}") for k in range(places)))


def _named(sets: DataFrame, claims: DataFrame, value: Column) -> DataFrame:
    """set_id, name, first (place of its first mention), papers (in order), n_values, some value."""
    placed = sets.join(claims, "paper_id").withColumn("value", F.nullif(value, F.lit("")))
    each = placed.groupBy("set_id", "name", "paper_ord", "paper_id").agg(F.min(F.struct("ord", "value", "sources")).alias("v"))
    papers = F.sort_array(F.collect_list(F.struct("paper_ord", "paper_id", F.col("v.sources").alias("sources"))))
    return each.groupBy("set_id", "name").agg(F.min(F.struct("paper_ord", "v.ord")).alias("first"), papers.alias("papers"), F.count_distinct("v.value").alias("n_values"), F.min("v.value").alias("value"))


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("row_ord", F.row_number().over(Window.partitionBy("set_id").orderBy("first", "name")))


def architecture_verdicts(sets: DataFrame, found: DataFrame) -> DataFrame:
    """set_id, n_values, verdict, note of the architecture row; 300 characters count."""
    joined = sets.join(found, "paper_id", "left").groupBy("set_id").agg(F.count("*").alias("n"), F.count_distinct(F.substring("architecture", 1, 300)).alias("n_values"))
    verdict = F.when(F.col("n") == 1, "single-source").when(F.col("n_values") == 0, "n/a").when(F.col("n_values") == 1, "consensus").otherwise("divergent")
    note = F.when(F.col("verdict") == "consensus", "Papers describe a matching architecture.").when(F.col("verdict") == "divergent", "Papers use different architectures.").otherwise("")
    return joined.select("set_id", "n_values", verdict.alias("verdict")).withColumn("note", note)


def hyperparameter_verdicts(sets: DataFrame, found: DataFrame) -> DataFrame:
    """set_id, row_ord, name, n_papers, n_values, verdict, note."""
    n = F.size("papers")
    verdict = F.when(n <= 1, "single-source").when(F.col("n_values") == 1, "consensus").otherwise("divergent")
    note = F.when(F.col("verdict") == "consensus", F.concat(F.lit("All papers set "), "name", F.lit("="), "value", F.lit("."))).when(F.col("verdict") == "divergent", F.concat("name", F.lit(" differs across papers."))).otherwise("")
    return _placed(_named(sets, found, F.col("value"))).select("set_id", "row_ord", "name", n.alias("n_papers"), "n_values", verdict.alias("verdict"), "value").withColumn("note", note).drop("value")


def _ids(papers: Column) -> Column:
    return F.sort_array(F.transform(papers, lambda p: p["paper_id"]))


def _sources(papers: Column, most: int) -> Column:
    return F.slice(F.flatten(F.transform(papers, lambda p: p["sources"])), 1, most)


def dataset_verdicts(sets: DataFrame, datasets: DataFrame) -> DataFrame:
    """set_id, row_ord, name, paper_ids, verdict, note, sources: data that two papers or more share
    is consensus."""
    shared = F.size("papers") >= 2
    rows = _placed(_named(sets, datasets, F.substring("details", 1, 200)))
    note = F.when(shared, F.concat(F.lit("Shared evaluation on "), "name", F.lit("."))).otherwise("")
    return rows.select("set_id", "row_ord", "name", _ids(F.col("papers")).alias("paper_ids"), F.when(shared, "consensus").otherwise("single-source").alias("verdict"), note.alias("note"), _sources(F.col("papers"), 6).alias("sources"))


def benchmark_rows(sets: DataFrame, results: DataFrame) -> DataFrame:
    """set_id, row_ord, task, metric, n_papers, verdict, note, paper_ids, sources of results grouped
    by task and metric, whatever their spelling: a paper's last result counts, the last spelling
    names the row, and deltas of both signs are a contradiction."""
    placed = results.join(sets, "paper_id").withColumns({"task_key": T.key(F.col("task")), "metric_key": T.key(F.col("metric"))})
    keys = ["set_id", "task_key", "metric_key"]
    last = placed.groupBy(*keys, "paper_ord", "paper_id").agg(F.max(F.struct("ord", "delta", "task", "metric", "sources")).alias("l"), F.min("ord").alias("seen"))
    last = last.withColumn("said", F.concat("paper_id", F.lit(" Δ"), signed("l.delta")))
    papers = F.sort_array(F.collect_list(F.struct("paper_ord", "paper_id", F.col("l.sources").alias("sources"), "said")))
    met = last.groupBy(*keys).agg(
        F.min(F.struct("paper_ord", "seen")).alias("first"), F.max(F.struct("paper_ord", "l.ord", "l.task", "l.metric")).alias("label"), papers.alias("papers"),
        F.max(F.col("l.delta") > 0).alias("up"), F.max(F.col("l.delta") < 0).alias("down"),
    )
    met = met.select("*", F.col("label.task").alias("task"), F.col("label.metric").alias("metric"), F.concat("task_key", F.lit(" "), "metric_key").alias("name"))
    n = F.size("papers")
    verdict = F.when(n < 2, "single-source").when(F.col("up") & F.col("down"), "contradiction").otherwise("consensus")
    each = F.array_join(F.transform("papers", lambda p: p["said"]), ", ")
    note = (
        F.when(F.col("verdict") == "contradiction", F.concat(F.lit("Conflicting "), "metric", F.lit(" results on "), "task", F.lit(": "), each, F.lit(".")))
        .when(F.col("verdict") == "consensus", F.concat(F.lit("Consistent direction on "), "task", F.lit(" ["), "metric", F.lit("] across papers.")))
        .otherwise("")
    )
    rows = _placed(met).withColumn("verdict", verdict)
    return rows.select("set_id", "row_ord", "task_key", "metric_key", "task", "metric", n.alias("n_papers"), "verdict", note.alias("note"), _ids(F.col("papers")).alias("paper_ids"), _sources(F.col("papers"), 8).alias("sources"))


def benchmark_values(sets: DataFrame, results: DataFrame) -> DataFrame:
    """A set's values of its benchmark rows, named by the last spelling: set_id, row_ord, dimension,
    paper_id, value, sources."""
    rows = benchmark_rows(sets, results).select("set_id", "task_key", "metric_key", "row_ord", F.concat(F.lit("benchmark:"), "task", F.lit(" ["), "metric", F.lit("]")).alias("dimension"))
    placed = results.join(sets, "paper_id").withColumns({"task_key": T.key(F.col("task")), "metric_key": T.key(F.col("metric"))})
    last = placed.groupBy("set_id", "task_key", "metric_key", "paper_id").agg(F.max(F.struct("ord", "baseline", "score", "delta", "metric", "sources")).alias("l"))
    told = last.select("*", cell_text("l.baseline", "l.score", "l.delta", "l.metric").alias("value")).join(rows, ["set_id", "task_key", "metric_key"])
    return told.select("set_id", "row_ord", "dimension", "paper_id", "value", F.col("l.sources").alias("sources"))


def findings(sets: DataFrame, datasets: DataFrame, results: DataFrame) -> DataFrame:
    """set_id, kind (consensus or contradiction), part (dataset or benchmark), row_ord, statement,
    paper_ids, sources of what two papers or more report."""
    data = dataset_verdicts(sets, datasets).where("verdict = 'consensus'").select("set_id", F.col("verdict").alias("kind"), F.lit("dataset").alias("part"), "row_ord", F.concat(F.lit("Shared evaluation dataset: "), "name", F.lit(".")).alias("statement"), "paper_ids", "sources")
    rows = benchmark_rows(sets, results).where("verdict <> 'single-source'")
    return data.unionByName(rows.select("set_id", F.col("verdict").alias("kind"), F.lit("benchmark").alias("part"), "row_ord", F.col("note").alias("statement"), "paper_ids", "sources"))


def verdicts(sets: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """set_id, dimension, verdict, note of every row of a comparison; a summary sentence has none."""
    row = lambda df, name: df.select("set_id", name.alias("dimension"), "verdict", "note")
    made = row(sets.select("set_id").distinct().withColumns({"verdict": F.lit("n/a"), "note": F.lit("")}), F.lit("tl_dr"))
    made = made.unionByName(row(architecture_verdicts(sets, parts["architecture"]), F.lit("architecture")))
    made = made.unionByName(row(hyperparameter_verdicts(sets, parts["hyperparameters"]), F.concat(F.lit("hyperparameter:"), "name")))
    made = made.unionByName(row(dataset_verdicts(sets, parts["datasets"]), F.concat(F.lit("dataset:"), "name")))
    return made.unionByName(row(benchmark_rows(sets, parts["results"]), F.concat(F.lit("benchmark:"), "task", F.lit(" ["), "metric", F.lit("]"))))


def values(parts: dict[str, DataFrame]) -> DataFrame:
    """The values of all dimensions but benchmarks: see ``dimension``."""
    details = F.coalesce(F.nullif(F.substring("details", 1, 200), F.lit("")), F.lit("evaluated"))
    return (
        dimension(parts["tldr"], 1, F.lit("tl_dr"), "metadata", F.col("tldr"))
        .unionByName(dimension(parts["architecture"], 2, F.lit("architecture"), "methodology", F.substring("architecture", 1, 300)))
        .unionByName(dimension(parts["hyperparameters"], 3, F.concat(F.lit("hyperparameter:"), "name"), "methodology", F.col("value")))
        .unionByName(dimension(parts["datasets"], 4, F.concat(F.lit("dataset:"), "name"), "dataset", details))
    )


def _without_architecture(sets: DataFrame, found: DataFrame) -> DataFrame:
    """A dimension's empty value for sets none of whose papers has an architecture, whose row stays."""
    some = sets.join(found.select("paper_id"), "paper_id", "left_semi").select("set_id").distinct()
    rest = sets.join(some, "set_id", "left_anti").select("paper_id").distinct()
    return dimension(rest.withColumn("sources", no_tags()), 2, F.lit("architecture"), "methodology", F.lit(""))


def comparisons(sets: DataFrame, refs: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """set_id and the columns of models.COMPARISON: the papers of a set in its order, all rows with their
    cells, verdicts and notes, what is agreed on and what is contradicted.

    refs: see ``paper_refs``. Sets beyond the limit (see ``limited``) are left out, so a row is bounded."""
    sets, _ = limited(sets)
    listed = lambda *fields: F.sort_array(F.collect_list(F.struct(*fields)))
    within = lambda df, name, order, fields, model: df.groupBy("set_id").agg(listed(order, *fields).alias("held")).select("set_id", F.transform("held", lambda x: _as(x, model)).alias(name))
    found = cells(sets, values(parts).unionByName(_without_architecture(sets, parts["architecture"])), benchmark_values(sets, parts["results"]))
    rows = found.groupBy("set_id", "row_ord", "dimension", "kind").agg(listed("paper_ord", "paper_id", "value", "sources").alias("held"))
    rows = rows.withColumn("cells", F.transform("held", lambda x: _as(x, models.CELL))).join(verdicts(sets, parts), ["set_id", "dimension"], "left")
    points = findings(sets, parts["datasets"], parts["results"]).withColumn("place", F.struct((F.col("part") == "benchmark").cast("int").alias("a"), F.col("row_ord").alias("b")))
    out = within(refs.join(sets.select("set_id").distinct(), "set_id", "left_semi"), "papers", "paper_ord", ["paper_id", "title", "year"], models.REF)
    out = out.withColumn("paper_ids", F.transform("papers", lambda p: p["paper_id"]))
    out = out.join(within(rows, "rows", "row_ord", list(models.ROW), models.ROW), "set_id", "left")
    for name, kind in (("consensus_points", "consensus"), ("contradictions", "contradiction")):
        out = out.join(within(points.where(F.col("kind") == kind), name, "place", list(models.FINDING), models.FINDING), "set_id", "left")
    out = out.withColumn("generated_by", F.lit("heuristic"))
    return out.select("set_id", *(models.completed(F.col(n), k, d).alias(n) for n, (k, d) in models.COMPARISON.items()))


def _as(x: Column, model: dict) -> Column:
    """A struct as one of a model, in its order and with its defaults."""
    return models.completed(x, model, models.MUST)


def research_gaps(sets: DataFrame, capped: DataFrame, crossing: DataFrame) -> DataFrame:
    """set_id and the columns of models.GAPS, from rows of extract.gaps and claims.cross_cutting: all four
    buckets, empty ones too. Sets beyond the limit are left out."""
    sets, _ = limited(sets)
    items = capped.select("set_id", "category", "ord", "statement", F.col("category").alias("said"), F.array("paper_id").alias("paper_ids"), "sources")
    items = items.unionByName(crossing.select("set_id", F.lit("cross_cutting").alias("category"), "ord", "statement", F.col("category").alias("said"), "paper_ids", "sources"))
    item = F.struct("ord", "statement", F.col("said").alias("category"), "paper_ids", "sources")
    held = {c: F.sort_array(F.collect_list(F.when(F.col("category") == c, item))) for c in BUCKETS}
    whole = items.groupBy("set_id").agg(*(F.transform(c, lambda x: _as(x, models.GAP)).alias(n) for n, c in held.items()))
    papers = sets.groupBy("set_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("paper_ord", "paper_id"))), lambda p: p["paper_id"]).alias("paper_ids"))
    out = papers.join(whole, "set_id", "left").withColumn("generated_by", F.lit("heuristic"))
    return out.select("set_id", *(models.completed(F.col(n), k, d).alias(n) for n, (k, d) in models.GAPS.items()))
