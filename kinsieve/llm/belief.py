"""Matching entities across sources without keys: loopy belief propagation with one-to-one factors.

A candidate pair (left, right) is a variable, matched or not, with a prior from its evidence. A factor
at each entity allows at most one of its pairs. The factors' messages say how free an entity is for a
pair, given what its other pairs believe: 1 / (1 + sum of the others' weighted beliefs). Left and right
factors exchange them through joins until no marginal, the pair's match probability, moves any more.
Pairs without a rival on either side need no message. `settled` tells whether a pair's marginal stood
still at the end; only after `max_rounds` may it not have.

Sums go through partial aggregates, so an entity with very many candidates is a row of sums and never a
group in memory. Defined cases: a repeated pair counts with its best score; null entities take no part;
ties share the probability; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsieve.session import discard, materialize


def match_probabilities(pairs: DataFrame, left: str, right: str, score: str, damping: float = 0.3, tolerance: float = 1e-3, max_rounds: int = 200) -> DataFrame:
    """(left, right, score, probability, settled); score is the log of the pair's odds by itself."""
    edges = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(F.col(left).alias("l"), F.col(right).alias("r")).agg(F.max(score).alias("s"))
    edges = materialize(edges.withColumn("w", F.exp(F.greatest(F.least("s", F.lit(25.0)), F.lit(-25.0)))), "edges")
    # entities with rivals are few
    many_l = edges.groupBy("l").agg(F.count("*").alias("nl")).where("nl > 1").select("l", F.lit(True).alias("ml"))
    many_r = edges.groupBy("r").agg(F.count("*").alias("nr")).where("nr > 1").select("r", F.lit(True).alias("mr"))
    counted = materialize(edges.join(many_l, "l", "left").join(many_r, "r", "left").select("l", "r", "s", "w", (F.col("ml").isNotNull() | F.col("mr").isNotNull()).alias("rivals")), "counted")
    discard(edges)
    alone = counted.where("not rivals").select("l", "r", "s", (F.col("w") / (1 + F.col("w"))).alias("p"), F.lit(True).alias("settled"))
    # a: the left factor's message to the pair, b: the right factor's; p: the marginal they give
    state = materialize(counted.where("rivals").select("l", "r", "s", "w", F.lit(1.0).alias("a"), F.lit(1.0).alias("b"), F.lit(0.0).alias("p"), F.lit(1.0).alias("moved")), "beliefs")
    for _ in range(max_rounds):
        at_l = state.groupBy("l").agg(F.sum(F.col("w") * F.col("b")).alias("sl"))
        at_r = state.groupBy("r").agg(F.sum(F.col("w") * F.col("a")).alias("sr"))
        free_l = 1 / (1 + F.greatest(F.col("sl") - F.col("w") * F.col("b"), F.lit(0.0)))
        free_r = 1 / (1 + F.greatest(F.col("sr") - F.col("w") * F.col("a"), F.lit(0.0)))
        sent = state.join(at_l, "l").join(at_r, "r").select("l", "r", "s", "w", (damping * F.col("a") + (1 - damping) * free_l).alias("a"), (damping * F.col("b") + (1 - damping) * free_r).alias("b"), F.col("p").alias("was"))
        odds = F.col("w") * F.col("a") * F.col("b")
        new = materialize(sent.withColumn("p", odds / (1 + odds)).select("l", "r", "s", "w", "a", "b", "p", F.abs(F.col("p") - F.col("was")).alias("moved")), "beliefs")
        moved = new.agg(F.max("moved")).first()[0]
        discard(state)
        state = new
        if moved is None or moved < tolerance:
            break
    out = state.select("l", "r", "s", "p", (F.col("moved") < tolerance).alias("settled")).unionByName(alone)
    return out.select(F.col("l").alias(left), F.col("r").alias(right), F.col("s").alias(score), F.col("p").alias("probability"), "settled")
