"""Change data: classifying a keyed row against its prior state, alerts, watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify_changes(current: DataFrame, prior: DataFrame, key: str, groups: dict[str, list[str]], unchanged: str = "no_change", new: str = "new_to_cache") -> DataFrame:
    """current plus change_type: the first group of fields any of which differs from the prior state,
    nulls being equal to nulls. groups: change -> its fields, most important first. prior holds one row
    per key."""
    fields = [f for fs in groups.values() for f in fs]
    before = prior.select(key, F.lit(True).alias("_known"), *[F.col(f).alias(f"_was_{f}") for f in fields])
    kind = F.lit(unchanged)
    for name, fs in reversed(list(groups.items())):
        differs = F.lit(False)
        for f in fs:
            differs |= ~F.col(f).eqNullSafe(F.col(f"_was_{f}"))
        kind = F.when(differs, name).otherwise(kind)
    joined = current.join(before, key, "left").withColumn("change_type", F.when(F.col("_known").isNull(), new).otherwise(kind))
    return joined.drop("_known", *[f"_was_{f}" for f in fields])


def upsert(state: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The state with the changed keys replaced and the new ones added."""
    return state.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def should_alert(change: Column, first_scan: Column, scan_all: Column) -> Column:
    """Whether a change is news: all of a full scan, a new owner, and a new record unless all are new."""
    return scan_all | (change == "owner_change") | ((change == "new_to_cache") & ~first_scan)


def advance_watermarks(watermarks: DataFrame, scans: DataFrame, key: str) -> DataFrame:
    """(key, last_completed, last_started, status): finished scans move last_completed on, others leave it
    and stay partial, to be asked for again."""
    w = watermarks.select(key, F.col("last_completed").alias("_done"))
    s = scans.groupBy(key).agg(F.max(F.when(F.col("status") == "complete", F.col("end_date"))).alias("_end"), F.max("start_date").alias("last_started"), F.bool_and(F.col("status") == "complete").alias("_all"))
    out = w.join(s, key, "full")
    return out.select(key, F.greatest("_done", "_end").alias("last_completed"), "last_started", F.when(F.coalesce("_all", F.lit(True)), "complete").otherwise("partial").alias("status"))


def pages_left(manifest: DataFrame, key: str, total: str, done: str) -> DataFrame:
    """(key, page): pages that a resumed scan still has to fetch."""
    known = F.coalesce(F.col(done), F.array().cast("array<int>"))
    wanted = F.when(F.col(total) >= 1, F.sequence(F.lit(1), F.col(total))).otherwise(F.array().cast("array<int>"))
    return manifest.select(key, F.explode(F.array_except(wanted, known)).alias("page"))
