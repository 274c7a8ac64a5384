"""Command line: python -m kinsieve COMMAND --input ... --output ..."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from kinsieve.plans import pipelines
from kinsieve.session import discard_all, local_session
from kinsieve.sources import edgar, fec, json_records, prospects, sinks, tax_returns


def _prospects(spark, args):
    good, bad = prospects.read_prospects(spark, args.prospects)
    summary = prospects.load_summary(good, bad)
    prospects.require_loaded(summary, args.max_skip_rate)
    return good, summary


def contributions(spark, args):
    """Campaign lines matched with a prospect list."""
    people, summary = _prospects(spark, args)
    lines = spark.read.text(args.input).select(F.col("value").alias("line"), F.concat_ws(":", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), F.xxhash64("value").cast("string")).alias("ref"))
    rows = fec.as_contributions(fec.narrow(fec.admit(fec.scan_lines(lines, "line", "ref")), people, args.min_amount, args.first_day, args.last_day)).withColumn("load_date", F.lit(None).cast("timestamp"))
    return pipelines.match_contributions(people, rows), summary


def nonprofits(spark, args):
    """Tax returns matched with a prospect list."""
    people, summary = _prospects(spark, args)
    rows = tax_returns.collapse(tax_returns.people(tax_returns.read_returns(spark, args.input)))
    rows = rows.select("*", F.col("person.normalized").alias("person_name_normalized"), F.col("person.last_name").alias("last_name"), F.xxhash64("object_id", "source", "normalized", "normalized_title", "amount").alias("nonprofit_id"))
    return pipelines.match_nonprofit(people, rows), summary


def filings(spark, args):
    """Regulatory filings in which prospects are named."""
    people, summary = _prospects(spark, args)
    return pipelines.match_filings(edgar.parse_filings(edgar.read_filings(spark, args.input)), people), summary


def inspect_properties(spark, args):
    """Cached property pages, read and flattened."""
    return json_records.property_pages(spark, args.input).drop("owners", "mailing"), {}


def validate(spark, args):
    """Whether a prospect list loads."""
    good, bad = prospects.read_prospects(spark, args.prospects)
    return bad, prospects.load_summary(good, bad)


COMMANDS = {"contributions": contributions, "nonprofits": nonprofits, "filings": filings, "properties": inspect_properties, "validate": validate}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kinsieve", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("--input", help="file or folder of records")
    p.add_argument("--prospects", help="delimited list of people with a header")
    p.add_argument("--output", required=True)
    p.add_argument("--max-skip-rate", type=float, default=0.05)
    p.add_argument("--min-amount", type=float)
    p.add_argument("--first-day")
    p.add_argument("--last-day")
    args = p.parse_args(argv)
    spark = local_session()
    out, summary = COMMANDS[args.command](spark, args)
    sinks.write_csv(out, f"{args.output}/rows", {c: c for c in out.columns})
    discard_all(spark)
    counts = {k: int(v) for k, v in summary.items() if k.endswith("rows")}
    print(sinks.report(args.command, counts, {}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
