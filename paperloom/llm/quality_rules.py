"""Quality rules: a learned decision list over text statistics, in Spark expressions only.

``statistics`` measures every text. ``learn_rules`` covers the labelled low-quality rows
sequentially: a rule, a conjunction of thresholds, is grown by information gain on two thirds
of them and pruned on the last third; rows it covers leave; the next rule is learned. Only
counts by feature and threshold come to the driver. ``verdict`` is the list as one ordered
CASE expression.

Defined results: null and wordless texts have zero counts and fail the base rules; a very long
text is measured whole, in its own row; null ids are kept and have no label; a repeated row is
measured like any other, and of several labels of an id the lower one counts; of thresholds of
equal gain the first is taken, by feature and value; with no labelled rows the list is empty and
keeps all that passes the base rules; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import spool

SPACES = r"[\x20\x09-\x0D]"
FEATURES = ("mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share")
Rule = list[tuple[str, str, float]]


def statistics(docs: DataFrame, window: int = 8) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper.

    Windows of words are hashed; only if two of a text are equal are their places sorted by
    hash, each place with an equal neighbour kept, and the words these places cover counted.
    """
    zero = F.lit(0)
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACES + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashed = docs.select("doc_id", text.alias("_t"), words.alias("_w"), lines.alias("_l"))
    hashed = hashed.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.length("_t") - F.length(F.regexp_replace("_t", r"[A-Z]", ""))).cast("long").alias("n_upper"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    place = F.sequence(zero, F.size("_h") - window)
    spans = F.when(F.size("_h") >= window, F.transform(place, lambda i: F.xxhash64(*(F.get(F.col("_h"), i + k) for k in range(window)))))
    spanned = hashed.withColumn("_s", spans).drop("_h")
    twice = F.size(F.array_distinct("_s")) < F.size("_s")
    placed = spanned.withColumn("_s", F.when(twice, F.array_sort(F.transform("_s", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.coalesce(F.get(F.col("_s"), k)["h"] == x["h"], F.lit(False))
    marked = placed.withColumn("_s", F.array_sort(F.transform(F.filter("_s", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    covered = F.aggregate(F.transform("_s", lambda i, k: F.least(F.lit(window), F.coalesce(F.get(F.col("_s"), k + 1) - i, F.lit(window)))), zero, lambda a, x: a + x)
    return marked.withColumn("n_repeat_words", F.coalesce(covered, zero).cast("long")).drop("_s")


def base_failed(least_words: int = 20, most_repeated: int = 30) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def features() -> list[Column]:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return [
        share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_upper", "word_chars").alias("upper_share"),
    ]


def _holds(rule: Rule) -> Column:
    out = F.lit(True)
    for name, sign, at in rule:
        out = out & (F.col(name) > at if sign == ">" else F.col(name) <= at)
    return out


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[tuple[str, int, int], int]:
    """Rows by feature, number of cuts below the value, and label; one small row each."""
    bins = [F.struct(F.lit(f).alias("f"), sum((F.col(f) > c).cast("int") for c in cs).alias("bin")) for f, cs in cuts.items() if cs]
    if not bins:
        return {}
    got = rows.select("bad", F.explode(F.array(*bins)).alias("x")).groupBy("x.f", "x.bin", "bad").count().collect()
    return {(r["f"], r["bin"], r["bad"]): r["count"] for r in got}


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn_rules(rows: DataFrame, most_rules: int = 6, most_terms: int = 3, precision: float = 0.9, least: int = 5) -> list[Rule]:
    """Rules for bad = 1 from rows(id, bad, FEATURES). ``precision`` is what a pruned rule must
    reach on the pruning third, ``least`` the bad rows it must cover there."""
    third = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(3))
    rows = spool(rows.select("id", "bad", *FEATURES, (third == 0).alias("prune")), "rule-rows")
    steps = [i / 24 for i in range(1, 24)]
    asked = [F.percentile_approx(F.when(F.col("bad") == b, F.col(f)), steps, 1000).alias(f"{f}_{b}") for f in FEATURES for b in (0, 1)]
    found = rows.agg(*asked).first()
    cuts = {f: sorted({float(x) for b in (0, 1) for x in found[f"{f}_{b}"] or []}) for f in FEATURES}
    rules: list[Rule] = []
    for _ in range(most_rules):
        left = rows.where(~_holds_any(rules))
        rule, grow = [], left.where("not prune")
        while len(rule) < most_terms:
            counts = _counts(grow.where(_holds(rule)), cuts)
            total = [sum(v for (f, _, b), v in counts.items() if b == y and f == FEATURES[0]) if cuts[FEATURES[0]] else 0 for y in (0, 1)]
            if not total[1] or not total[0]:
                break
            best = (1e-9, None)
            for f, cs in cuts.items():
                below = [0, 0]
                for k, c in enumerate(cs):
                    for y in (0, 1):
                        below[y] += counts.get((f, k, y), 0)
                    above = [total[0] - below[0], total[1] - below[1]]
                    for sign, (n, p) in ((">", above), ("<=", below)):
                        best = max(best, (_gain(p, n, total[1], total[0]), (f, sign, c)), key=lambda x: x[0])
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        # pruning: the leading terms whose (p - n) / (p + n) on the last third is largest
        heads = [rule[:k] for k in range(1, len(rule) + 1)]
        got = left.where("prune").agg(*(F.sum((_holds(h) & (F.col("bad") == y)).cast("int")).alias(f"c{k}_{y}") for k, h in enumerate(heads) for y in (0, 1))).first()
        scored = [(p / (p + n), p, h) for k, h in enumerate(heads) if (p := got[f"c{k}_1"] or 0) + (n := got[f"c{k}_0"] or 0)]
        worth, p, head = max(scored, key=lambda x: (x[0], x[1]), default=(0, 0, []))
        if worth < precision or p < least:
            break
        rules.append(head)
    return rules


def _holds_any(rules: list[Rule]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | _holds(r)
    return out


def verdict(rules: list[Rule]) -> Column:
    """True (kept) unless the first rule that holds says otherwise."""
    case = F.when(F.lit(False), F.lit(False))
    for r in rules:
        case = case.when(_holds(r), F.lit(False))
    return case.otherwise(F.lit(True))


def apply_rules(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """The base statistics with base_failed and kept."""
    judged = stats.select("*", *features()).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & verdict(rules)).drop(*FEATURES)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, rules learned from labels(doc_id, quality) and their verdict on all docs."""
    stats = spool(statistics(docs), "rule-stats")
    known = labels.select("doc_id", F.col("quality").alias("q")).where("q is not null").groupBy("doc_id").agg(F.min("q").alias("q"))
    rows = stats.join(known, "doc_id").where(~base_failed()).select(F.col("doc_id").alias("id"), (F.col("q") == 0).cast("int").alias("bad"), *features())
    return apply_rules(stats, learn_rules(rows))
