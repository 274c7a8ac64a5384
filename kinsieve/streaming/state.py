"""Structured Streaming forms of the incremental operators.

Batch and stream give the same rows: the stream keeps per key the last version or state in the state
store and emits what the batch operator would for the rows that came since.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsieve.operators.changes import classify_changes, upsert
from kinsieve.operators.records import latest_version


def new_records(stream: DataFrame, key: str, event_time: str, overlap: str = "1 day") -> DataFrame:
    """Each key once, though sources are asked with an overlap: duplicates within it are dropped, and the
    watermark lets their state go."""
    typed = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return typed.withWatermark(event_time, overlap).dropDuplicatesWithinWatermark([key])


def windowed_totals(stream: DataFrame, event_time: str, key: str, value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums per key and window, late rows up to `late`."""
    typed = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, late)
    return typed.groupBy(F.window(event_time, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(stream: DataFrame, event_time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    typed = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, late)
    return typed.groupBy(F.session_window(event_time, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def changed_values(stream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, was, change): rows whose value differs from the key's last one, or whose key is new.
    The last value per key is the state; rows of one key in one batch are taken in the order of `seq`."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        known, out = state.exists, []
        rows = pd.concat(list(batches)).sort_values("seq")
        for v in rows["value"]:
            v = None if pd.isna(v) else str(v)
            if not known or v != last:
                out.append((k[0], v, last, "changed" if known else "new"))
            last, known = v, True
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "value", "was", "change"])

    typed = stream.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"), F.col("seq").cast("bigint").alias("seq"))
    return typed.groupBy("key").applyInPandasWithState(step, "key string, value string, was string, change string", "last string", "append", "NoTimeout")


def change_feed(spark, stream: DataFrame, key: str, groups: dict[str, list[str]], state_path: str, out_path: str, checkpoint: str, version: list[str] | None = None, buckets: int = 64):
    """A query that classifies each micro-batch against the state table and brings it up to date, for
    states too wide for the store. Of several rows of a key in a batch the greatest by `version` counts.

    The state lies in buckets by hash of the key. Batch n writes only the buckets that its keys fall in,
    as version n, and a manifest that says which version of each bucket holds; a batch that is run again
    reads manifest n - 1 again, so the result is exactly once. Versions that neither of the last two
    manifests names are deleted. A missing manifest is an error, never an empty state."""

    def path_of(p: str):
        return spark._jvm.org.apache.hadoop.fs.Path(p)

    def exists(p: str) -> bool:
        return path_of(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path_of(p))

    def manifest(n: int) -> dict[int, int]:
        """bucket -> version, at most `buckets` rows."""
        return {r.bucket: r.version for r in spark.read.schema("bucket int, version bigint").parquet(f"{state_path}/manifest/{n}").collect()} if n >= 0 else {}

    def data(b: int, v: int) -> str:
        return f"{state_path}/data/{v}/bucket={b}"

    def run(batch: DataFrame, n: int) -> None:
        if n > 0 and not exists(f"{state_path}/manifest/{n - 1}"):
            raise FileNotFoundError(f"the state before batch {n} is missing: {state_path}/manifest/{n - 1}")
        fields = [key, *[f for fs in groups.values() for f in fs]]
        held = manifest(n - 1)
        rows = latest_version(batch, key, version or []).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())
        known = [data(b, held[b]) for b in touched if b in held]
        prior = spark.read.schema(rows.select(*fields).schema).parquet(*known) if known else rows.select(*fields).limit(0)
        classify_changes(rows.drop("bucket"), prior, key, groups).write.mode("overwrite").parquet(f"{out_path}/batch={n}")
        new = upsert(prior, rows.select(*fields), key).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{state_path}/data/{n}")
        now = held | dict.fromkeys(touched, n)
        spark.createDataFrame(sorted(now.items()), "bucket int, version bigint").write.mode("overwrite").parquet(f"{state_path}/manifest/{n}")
        for b, v in manifest(n - 2).items() if n >= 2 else ():
            if held.get(b) != v and now.get(b) != v:
                path_of(data(b, v)).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path_of(data(b, v)), True)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
