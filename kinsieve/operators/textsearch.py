"""Many patterns in many texts as an equi-join on word n-grams.

Texts become word runs with their positions, patterns become runs of the same lengths, and a hash join
finds who is named where; nothing scans every text for every pattern. A pattern holds where its words
follow each other with single blanks between them, at word boundaries, whatever the case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def word_grams(texts: DataFrame, text_id: str, text: str, lengths: list[int]) -> DataFrame:
    """(text_id, gram, at): every run of the given numbers of words, `at` counted from 0."""
    ws = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}'-]+"), lambda w: w != "")
    base = texts.where(F.length(text) > 0).select(F.col(text_id).alias("text_id"), ws.alias("w"))
    runs = None
    for n in lengths:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n)).otherwise(F.array().cast("array<int>"))
        grams = F.transform(starts, lambda i: F.struct(F.array_join(F.slice("w", i + 1, n), " ").alias("gram"), i.alias("at")))
        runs = grams if runs is None else F.concat(runs, grams)
    return base.select("text_id", F.explode(runs).alias("g")).select("text_id", "g.gram", "g.at")


def search(texts: DataFrame, text_id: str, text: str, patterns: DataFrame, pattern: str, lengths: list[int] = [2, 3]) -> DataFrame:  # noqa: B006
    """(text_id, pattern, at) of every occurrence of patterns of the given numbers of words."""
    ws = F.filter(F.split(F.lower(F.col(pattern)), r"[^\p{L}\p{N}'-]+"), lambda w: w != "")
    keys = patterns.select(F.array_join(ws, " ").alias("gram"), F.size(ws).alias("n")).where(F.col("n").isin(lengths)).select("gram").distinct()
    return word_grams(texts, text_id, text, lengths).join(keys, "gram").select("text_id", F.col("gram").alias("pattern"), "at")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str = "at") -> DataFrame:
    """Smallest distance between a left and a right position with the same keys. Positions of both sides
    are put in one order, where the nearest one of the other side is the last before or the first after,
    so no pair of positions is formed."""
    both = left.select(*keys, F.col(at).alias("p"), F.lit(0).alias("side")).unionByName(right.select(*keys, F.col(at).alias("p"), F.lit(1).alias("side")))
    w = W.partitionBy(*keys).orderBy("p", "side")
    before = F.last(F.when(F.col("side") == 1, F.col("p")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = F.first(F.when(F.col("side") == 1, F.col("p")), ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    gap = F.least(F.col("p") - before, after - F.col("p"))
    return both.withColumn("gap", gap).where("side = 0").groupBy(*keys).agg(F.min("gap").alias("distance")).where("distance is not null")


def around(text: Column, at: Column, reach: int) -> Column:
    """The characters within `reach` of a position, counted from 1."""
    start = F.greatest(at - reach, F.lit(1))
    return F.substr(text, start, at - start + reach)


def joined_evidence(structured: DataFrame, textual: DataFrame, keys: list[str]) -> DataFrame:
    """Structured matches, and textual ones only where there is no structured one for the same keys."""
    return structured.unionByName(textual.join(structured.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)
