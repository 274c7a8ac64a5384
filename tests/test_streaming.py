from pyspark.sql import functions as F

from kinsieve.operators.changes import classify_changes
from kinsieve.streaming import state as S


def run(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def stream_of(spark, tmp_path, df, parts=1):
    df.repartition(parts).write.mode("overwrite").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_new_records(spark, frame, tmp_path):
    d = frame("id string, t string", ("a", "2025-01-01 00:00:00"), ("a", "2025-01-01 05:00:00"), ("b", "2025-01-01 06:00:00")).withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert {r.id for r in run(spark, S.new_records(stream_of(spark, tmp_path, d), "id", "t"), "nr")} == {"a", "b"}


def test_windows(spark, frame, tmp_path):
    d = frame("k string, v double, t string", ("a", 1.0, "2025-01-01 01:00:00"), ("a", 2.0, "2025-01-01 02:00:00"), ("a", 4.0, "2025-01-02 02:00:00")).withColumn("t", F.to_timestamp("t"))
    got = {(str(r.start)[:10], r.n, r.total) for r in run(spark, S.windowed_totals(stream_of(spark, tmp_path, d), "t", "k", "v"), "wt", "complete")}
    assert got == {("2025-01-01", 2, 3.0), ("2025-01-02", 1, 4.0)}


def test_changed_values(spark, frame, tmp_path):
    d = frame("k string, v string, seq int", ("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("b", None, 1))
    got = {(r.key, r.value, r.was, r.change) for r in run(spark, S.changed_values(stream_of(spark, tmp_path, d), "k", "v"), "cv")}
    assert got == {("a", "x", None, "new"), ("a", "y", "x", "changed"), ("b", None, None, "new")}


def test_change_feed_equals_batch(spark, frame, tmp_path):
    groups = {"owner_change": ["o"], "sale_update": ["s"]}
    one = frame("id string, o string, s string", ("1", "a", "x"), ("2", "b", "y"))
    two = frame("id string, o string, s string", ("1", "a", "z"), ("3", "c", "y"))
    src = tmp_path / "src"
    feed = lambda: S.change_feed(spark, spark.readStream.schema(one.schema).parquet(str(src)), "id", groups, str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    one.coalesce(1).write.parquet(str(src))
    feed()
    two.coalesce(1).write.mode("append").parquet(str(src))
    feed()
    got = {(r.id, r.change_type) for r in spark.read.parquet(str(tmp_path / "out")).where("batch = 1").collect()}
    assert got == {(r.id, r.change_type) for r in classify_changes(two, one, "id", groups).collect()} == {("1", "sale_update"), ("3", "new_to_cache")}
    # a state that is gone is an error, not an empty one
    import shutil

    import pytest

    shutil.rmtree(tmp_path / "state" / "manifest" / "1")
    two.coalesce(1).write.mode("append").parquet(str(src))
    with pytest.raises(Exception, match="is missing"):
        feed()
