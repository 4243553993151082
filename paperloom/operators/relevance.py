"""The titles of a catalogue that are most like a given one, by the rare words they share.

Defined results: a title without words of the catalogue, null or empty, has no candidates; words
are told apart without case and count once a title; ties go by order, then key; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staged import exchanged, scope, staged

SLACK = 1e-9


def _words(titles: DataFrame, key: str) -> DataFrame:
    words = F.array_distinct(F.filter(F.split(F.lower("title"), r"(?U)\W+"), lambda w: w != ""))
    return titles.select(key, F.explode(words).alias("w"))


def _weighed(titles: DataFrame, key: str, weights: DataFrame, often: DataFrame) -> DataFrame:
    """key, w, g, whole (weight of all words), rest (weight of this word and those after it, the
    rarest first). Words that hold a thousandth of all are fewer than a thousand: their weights are
    broadcast, and only the others are exchanged by word."""
    words = _words(titles, key)
    each = words.join(F.broadcast(often), "w").unionByName(words.join(F.broadcast(often.select("w")), "w", "left_anti").join(exchanged(weights), "w"))
    title = Window.partitionBy(key)
    before = F.sum("g").over(title.orderBy(F.desc("g"), "w").rowsBetween(Window.unboundedPreceding, -1))
    return each.withColumn("whole", F.sum("g").over(title)).withColumn("rest", F.col("whole") - F.coalesce(before, F.lit(0.0)))


def relevant(asked: DataFrame, entries: DataFrame, near: float = 0.5, most: int = 5) -> DataFrame:
    """k, ck, rank: for every title the ``most`` entries that share most of its words' weight.

    asked: k, title; entries: ck, title, ord; keys are unique. A word that df of n entries have weighs
    ln(1 + n / df), one that none has nothing. How alike two titles are is the weight of the words they
    share over that of the words of either; ``near`` is the least. Nothing is lost: two titles near
    enough share a word before what is left of either falls below ``near`` of its weight, so only these
    leading words, the rarest, are joined, and pairs whose first shared word comes too late for what
    is left after it are refused in the join."""
    with scope(entries.sparkSession):
        counted = _words(entries, "ck").groupBy("w").agg(F.count("*").alias("df"))
        all_words, n = counted.agg(F.sum("df").alias("words")), entries.agg(F.count("*").alias("n"))
        weights = counted.join(F.broadcast(all_words)).join(F.broadcast(n)).withColumn("g", F.log1p(F.col("n") / F.col("df")))  # one row each
        weights = staged(weights, "title-words")
        often = weights.where(1000 * F.col("df") > F.col("words")).select("w", "g")
        weights = weights.select("w", "g")
        mine, theirs = (staged(_weighed(t, key, weights, often), "titles-weighed") for t, key in ((asked, "k"), (entries, "ck")))
        lead = lambda t, key: t.where(F.col("rest") >= near * F.col("whole") - SLACK).select(key, "w", F.col("whole").alias(f"{key}_whole"), F.col("rest").alias(f"{key}_rest"))
        enough = near / (1 + near) * (F.col("k_whole") + F.col("ck_whole")) - SLACK
        pairs = lead(mine, "k").join(exchanged(lead(theirs, "ck")), "w").where(F.least("k_rest", "ck_rest") >= enough).select("k", "ck").distinct()

        held = lambda t, key: t.groupBy(key).agg(F.collect_list(F.struct("g", "w")).alias(f"{key}_words"), F.first("whole").alias(f"{key}_whole"))
        both = pairs.join(exchanged(held(mine, "k")), "k").join(exchanged(held(theirs, "ck")), "ck").join(exchanged(entries.select("ck", "ord")), "ck")
        said = F.transform("ck_words", lambda x: x["w"])
        shared = F.aggregate(F.array_sort(F.filter("k_words", lambda x: F.array_contains(said, x["w"]))), F.lit(0.0), lambda a, x: a + x["g"])
        alike = F.round(shared / (F.col("k_whole") + F.col("ck_whole") - shared), 9)
        best = Window.partitionBy("k").orderBy(F.desc("alike"), "ord", "ck")
        ranked = both.withColumn("alike", alike).where(F.col("alike") >= near).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
        return staged(ranked.select("k", "ck", "rank"), "titles-relevant")
