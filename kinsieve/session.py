"""Session helpers: reading tables, the shared folder for cut lineages, partition counts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# tables written to the shared folder and not yet discarded
_WRITTEN: list[str] = []


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kinsieve")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: what the cluster set for its shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Only under a local master is there
    one of our own, below /tmp; a cluster without the setting is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file:///tmp/kinsieve-shared"
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut, the rows are computed
    once, and they outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinsieve_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(df: DataFrame) -> None:
    """Delete a materialized table that nothing reads any more."""
    path = getattr(df, "_kinsieve_path", None)
    if path:
        _delete(df.sparkSession, path)
        if path in _WRITTEN:
            _WRITTEN.remove(path)


def discard_all(spark: SparkSession) -> int:
    """Delete every table that this driver materialized and did not discard, once the results that read
    them are written. How many there were."""
    gone = len(_WRITTEN)
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())
    return gone


def blank_to_null(c: Column | str) -> Column:
    """Trimmed text, with '' and blanks as null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(c), F.lit(""))


def nz(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(""))
