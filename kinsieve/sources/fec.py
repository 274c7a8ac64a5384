"""Scans of pipe-delimited campaign files: contributions, committees, candidates, linkages, section 527.

Lines are split natively, so column pruning and filters reach the text scan's projection; the lines
that do not load are `grammar.parse_lines`' business.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsieve.functions.fields import parse_date, strip_legal_suffixes
from kinsieve.functions.names import parse_fec_name, parse_person_name
from kinsieve.operators.records import keep_best
from kinsieve.sources.grammar import FEC_COLUMNS


def _fields(line: Column, names: list[str]) -> list[Column]:
    cells = F.split(line, r"\|", -1)
    return [F.trim(F.get(cells, F.lit(i))).alias(n) for i, n in enumerate(names)]


def _wide(line: Column, n: int) -> Column:
    return F.size(F.split(line, r"\|", -1)) >= n


def prefilter(df: DataFrame, line: str) -> DataFrame:
    """Lines that can be admitted, told from the raw text before any is split into columns: enough pipes,
    a comma somewhere, then the three columns that are tested, each cut out by itself."""
    part = lambda n: F.trim(F.split_part(F.col(line), F.lit("|"), F.lit(n)))
    pipes = F.length(line) - F.length(F.replace(F.col(line), F.lit("|"), F.lit("")))
    return df.where(F.contains(line, F.lit(","))).where(pipes >= 20).where(part(7).isin("", "IND")).where(F.contains(part(8), F.lit(","))).where(F.upper(part(19)) != "X")


def scan_lines(df: DataFrame, line: str, ref: str) -> DataFrame:
    """Lines of individual contributions with at least 21 columns, by column."""
    return df.where(_wide(F.col(line), 21)).select(F.col(ref).alias("raw_ref"), *_fields(F.col(line), FEC_COLUMNS))


def admit(lines: DataFrame) -> DataFrame:
    """Contributions of people: a name with a comma that parses, no memo, individual or no entity. The
    cheap tests come first."""
    kept = lines.where(F.contains("name", F.lit(",")) & (F.upper("memo_cd") != "X") & F.col("entity").isin("", "IND"))
    parsed = kept.withColumn("raw_name", F.col("name")).withColumn("name", parse_fec_name(F.col("raw_name"))).where("name is not null")
    return parsed.withColumn("amount", F.col("amount").try_cast("double")).withColumn(
        "day", F.when(F.regexp_like("date", F.lit(r"^[0-9]{8}$")), F.to_date(F.try_to_timestamp("date", F.lit("MMddyyyy"))))
    )


def narrow(rows: DataFrame, last_names: DataFrame | None, least: float | None, first_day: str | None, last_day: str | None) -> DataFrame:
    """Optional filters: known last names as a semi join, amount, dates; a missing date passes."""
    out = rows.withColumn("last_name", F.col("name.last_name"))
    if least is not None:
        out = out.where(F.col("amount") >= least)
    if first_day or last_day:
        within = F.lit(True)
        if first_day:
            within &= F.col("day") >= F.lit(first_day).cast("date")
        if last_day:
            within &= F.col("day") <= F.lit(last_day).cast("date")
        out = out.where((F.col("date") == "") | within)
    if last_names is not None:
        out = out.join(last_names.select("last_name").where("last_name is not null").distinct(), "last_name", "left_semi")
    return out


def as_contributions(rows: DataFrame) -> DataFrame:
    """Admitted lines in the common shape of all contribution sources."""
    return rows.select(
        F.lit("FEC").alias("source"),
        F.lit("contribution").alias("signal_type"),
        F.coalesce(F.nullif("sub_id", F.lit("")), F.nullif("tran_id", F.lit("")), "raw_ref").alias("source_record_id"),
        F.col("raw_name").alias("donor_name_raw"),
        F.col("name.normalized").alias("donor_name_normalized"),
        F.col("name.normalized_full").alias("donor_name_normalized_full"),
        F.col("employer").alias("employer_raw"),
        strip_legal_suffixes(F.col("employer")).alias("employer_normalized"),
        F.col("occupation").alias("occupation_raw"),
        "city",
        "state",
        "zip",
        F.col("day").alias("donation_date"),
        "amount",
        (F.col("amount") < 0).alias("refund_flag"),
        (F.col("amendment") == "A").alias("amendment_flag"),
        "committee_id",
        "raw_ref",
    )


def committees(df: DataFrame, line: str, at: str) -> DataFrame:
    """Committee master, at least 15 columns; of several lines of an id the last holds."""
    names = "committee_id name treasurer street1 street2 city state zip designation type party freq org_type connected_org candidate_id".split()
    rows = df.where(_wide(F.col(line), 15)).select(F.col(at).alias("at"), *_fields(F.col(line), names)).where("committee_id <> ''")
    return keep_best(rows, ["committee_id"], [F.desc("at")]).drop("at")


def candidates(df: DataFrame, line: str, at: str) -> DataFrame:
    """Candidate master, at least 10 columns; the last line of an id holds."""
    names = "candidate_id name party year office_state office district".split()
    rows = df.where(_wide(F.col(line), 10)).select(F.col(at).alias("at"), *_fields(F.col(line), names)).where("candidate_id <> ''")
    return keep_best(rows, ["candidate_id"], [F.desc("at")]).drop("at")


def linkages(df: DataFrame, line: str, at: str) -> DataFrame:
    """Candidate of each committee, at least 4 columns; the first line of a committee holds."""
    rows = df.where(_wide(F.col(line), 4)).select(F.col(at).alias("at"), *_fields(F.col(line), ["candidate_id", "candidate_year", "fec_year", "committee_id"])).where("committee_id <> ''")
    return keep_best(rows, ["committee_id"], [F.asc("at")]).drop("at")


SECTION_527 = [
    "record", "form_id", "schedule_a_id", "org", "ein", "contributor", "address1", "address2", "city", "state", "zip", "zip_ext", "employer", "amount", "occupation", "ytd", "date",
]


def section_527(df: DataFrame, line: str, ref: str) -> DataFrame:
    """Schedule A lines of section 527 organisations whose contributor parses as a person."""
    rows = df.where(_wide(F.col(line), 17)).select(F.col(ref).alias("raw_ref"), *_fields(F.col(line), SECTION_527)).where("record = 'A'")
    rows = rows.withColumn("name", parse_person_name(F.col("contributor"))).where("name is not null")
    composite = F.concat_ws(":", "form_id", "contributor", "amount", "date")
    return rows.select(
        F.lit("527").alias("source"),
        F.lit("contribution").alias("signal_type"),
        F.coalesce(F.nullif("schedule_a_id", F.lit("")), composite).alias("source_record_id"),
        F.col("contributor").alias("donor_name_raw"),
        F.col("name.normalized").alias("donor_name_normalized"),
        F.col("name.normalized_full").alias("donor_name_normalized_full"),
        F.col("employer").alias("employer_raw"),
        strip_legal_suffixes(F.col("employer")).alias("employer_normalized"),
        F.col("occupation").alias("occupation_raw"),
        "city",
        "state",
        "zip",
        parse_date(F.regexp_replace("date", r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "$1/$2/$3")).alias("donation_date"),
        F.col("amount").try_cast("double").alias("amount"),
        (F.col("amount").try_cast("double") < 0).alias("refund_flag"),
        F.lit(False).alias("amendment_flag"),
        F.lit("").alias("committee_id"),
        "raw_ref",
    )
