"""Writing results: delimited files with fixed column orders, run manifests, summaries."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def escape_csv(c: Column) -> Column:
    """A cell for a delimited file: quoted if it holds a quote, comma or line break, quotes doubled."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(F.regexp_like(t, F.lit('[",\n]')), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def flat(df: DataFrame, columns: dict[str, str], separator: str = "; ") -> DataFrame:
    """The columns in their order under their titles; arrays joined, booleans yes, no or empty."""
    kinds = dict(df.dtypes)
    out = []
    for name, title in columns.items():
        c = F.col(name)
        if kinds[name].startswith("array"):
            c = F.array_join(c.cast("array<string>"), separator)
        elif kinds[name] == "boolean":
            c = F.when(c, "yes").when(~c, "no")
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(title))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, columns: dict[str, str], files: int | None = None) -> None:
    """With a header; `files` fixes the number of files where the result is known to be small."""
    out = flat(df, columns)
    (out.coalesce(files) if files else out).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_manifest(path: str, counts: dict[str, int], freshness: dict[str, str], outputs: dict[str, str]) -> None:
    """What a run read, how fresh its sources were, and what it wrote, on whatever file system the path
    names."""
    degraded = sorted(k for k, v in freshness.items() if v != "ok")
    text = json.dumps({"counts": counts, "freshness": freshness, "degraded": degraded, "outputs": outputs}, indent=2, sort_keys=True)
    spark = SparkSession.getActiveSession()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text, "utf8"))
    finally:
        out.close()


def report(title: str, counts: dict[str, int], freshness: dict[str, str]) -> str:
    lines = [f"# {title}", "", "## Counts", *[f"- {k}: {v:,}" for k, v in sorted(counts.items())], "", "## Sources", *[f"- {k}: {v}" for k, v in sorted(freshness.items())]]
    warn = [k for k, v in sorted(freshness.items()) if v != "ok"]
    return "\n".join([*lines, *(["", "## Warnings", *[f"- {k} was not complete" for k in warn]] if warn else [])]) + "\n"


def interleaved(matches: DataFrame, grants: DataFrame, person: str, confidence: str) -> DataFrame:
    """Matches and grants by person, people in the order of their best confidence, matches first."""
    both = matches.withColumn("row_kind", F.lit("match")).unionByName(grants.withColumn("row_kind", F.lit("grant")), allowMissingColumns=True)
    best = both.groupBy(person).agg(F.max(confidence).alias("best_confidence"))
    return both.join(best, person).orderBy(F.desc("best_confidence"), person, F.desc("row_kind"), F.desc(confidence))
