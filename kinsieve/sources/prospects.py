"""Prospect lists: delimited files with free header spellings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsieve.functions.fields import strip_legal_suffixes
from kinsieve.functions.names import parse_person_name
from kinsieve.functions.rules import PROSPECT_HEADERS


class TooManyFailures(ValueError):
    pass


def resolve_headers(headers: list[str], known: dict[str, str] | None = None) -> dict[str, str]:
    """column -> header for the first header that one of the column's spellings fits."""
    plain = {h: re.sub(r"^_|_$", "", re.sub(r"[^a-z0-9]+", "_", h.lower())) for h in headers}
    out = {}
    for column, spellings in (known or PROSPECT_HEADERS).items():
        found = next((h for h in headers if plain[h] in spellings), None)
        if found is not None:
            out[column] = found
    if "name" not in out:
        raise ValueError(f"a prospect list needs a name column; there are {', '.join(headers)}")
    return out


def read_prospects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(prospects, failures): rows whose name parses, and (row, name) of the others, row 1 being the header.
    Rows without an id get prospect-<row number>, counted over all rows."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, multiLine=False)
    columns = resolve_headers(raw.columns)
    # Row numbers over all splits of the file: how many rows the splits before it hold (a row per split,
    # as many as the file has blocks), and the row's place within its own.
    numbered = raw.select("*", F.monotonically_increasing_id().alias("_id"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    splits = numbered.groupBy("_file", "_start").agg(F.min("_id").alias("first"), F.count("*").alias("n")).collect()
    offset, upto = {}, 0
    for r in sorted(splits):
        offset[r._file, r._start], upto = upto - r.first, upto + r.n
    shift = F.lit(0).cast("bigint")
    for (file, start), by in offset.items():
        shift = F.when((F.col("_file") == file) & (F.col("_start") == start), F.lit(by)).otherwise(shift)
    at = F.col("_id") + shift + 1
    text = {c: F.coalesce(F.trim(F.col(f"`{columns[c]}`")), F.lit("")) if c in columns else F.lit("") for c in PROSPECT_HEADERS}
    rows = numbered.select(at.alias("row"), *[e.alias(c) for c, e in text.items()]).withColumn("person", parse_person_name(F.col("name")))

    def listed(c: str):
        return F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")

    others = listed("other_companies")
    good = rows.where("person is not null").select(
        F.coalesce(F.nullif("prospect_id", F.lit("")), F.concat(F.lit("prospect-"), F.col("row").cast("string"))).alias("prospect_id"),
        F.col("name").alias("name_raw"),
        "person.*",
        listed("alias_names").alias("alias_names"),
        others.alias("other_companies"),
        F.col("company").alias("company_raw"),
        strip_legal_suffixes(F.col("company")).alias("company_normalized"),
        F.transform(F.filter(F.concat(F.array("company"), others), lambda x: x != ""), strip_legal_suffixes).alias("all_companies_normalized"),
        *["title", "address", "city", "state", "zip", "country", "external_id"],
    )
    return good, rows.where("person is null").select((F.col("row") + 1).alias("row"), "name")


def load_summary(good: DataFrame, failures: DataFrame) -> dict:
    loaded, skipped = good.count(), failures.count()
    total = loaded + skipped
    return {"total_rows": total, "loaded_rows": loaded, "skipped_rows": skipped, "skipped_rate": skipped / total if total else 0.0}


def require_loaded(summary: dict, most: float = 0.05) -> None:
    """Raise where too many rows were skipped."""
    if summary["skipped_rate"] > most:
        raise TooManyFailures(f"{summary['skipped_rows']} of {summary['total_rows']} rows did not load; at most {most:.0%} may")
