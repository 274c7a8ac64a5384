"""Queries of the general operators for training data: snapshot differences and failed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsieve.operators.snapshot_diff import snapshot_diff
from kinsieve.session import table
from kinsieve.sources.grammar import FEC_SCHEMA, PROSPECT_CSV_SCHEMA, RecordSchema, parse_lines

CONTRIBUTION_FIELDS = ["donor_name_raw", "employer_raw", "city", "state", "zip", "donation_date", "amount", "transaction_type", "memo_flag"]


def _pages(c: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.array_distinct(F.filter(c, lambda x: x.isNotNull()))), lambda x: x.cast("string")), ",")


def snapshot_changes(spark: SparkSession, sf: str) -> DataFrame:
    contributions = snapshot_diff(
        table(spark, sf, "contribution_snapshot"), "source_record_id", "snapshot_no", {c: F.col(c) for c in CONTRIBUTION_FIELDS}, version="load_date"
    )
    manifests = snapshot_diff(
        table(spark, sf, "scan_manifest"),
        "scan_id",
        "snapshot_no",
        {"total_pages": F.col("total_pages"), "scan_status": F.col("scan_status"), "completed_pages": _pages("completed_pages")},
        version="written_at",
    )
    return contributions.select(F.lit("contribution_snapshot").alias("table_name"), "*").unionByName(manifests.select(F.lit("scan_manifest").alias("table_name"), "*"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_changes(spark, sf).select("table_name", "record_key", "snapshot_no", "change_kind")


def p4_changed_fields(spark: SparkSession, sf: str) -> DataFrame:
    """How often each field changed between two deliveries."""
    return (
        snapshot_changes(spark, sf)
        .select("table_name", "snapshot_no", F.explode("changed_fields").alias("field_name"))
        .groupBy("table_name", "snapshot_no", "field_name")
        .agg(F.count("*").alias("n_records"))
    )


def parsed_lines(spark: SparkSession, sf: str) -> DataFrame:
    fec = parse_lines(table(spark, sf, "fec_raw"), "raw_ref", "line", FEC_SCHEMA)
    csv = parse_lines(table(spark, sf, "prospect_csv_raw").where("row_no > 1"), "raw_ref", "line", PROSPECT_CSV_SCHEMA)
    return fec.select(F.lit("fec_raw").alias("table_name"), "*").unionByName(csv.select(F.lit("prospect_csv_raw").alias("table_name"), "*"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return parsed_lines(spark, sf).where("reason is not null").select("raw_ref", "reason")


LOADED = ["prospect_id", *FEC_SCHEMA.names, "company", "address"]


def p7_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """The typed records of the lines that load, of both tables; a column that a table lacks is null."""
    good = parsed_lines(spark, sf).where("reason is null")

    def records(name: str, schema: RecordSchema) -> DataFrame:
        cell = {n: F.nullif(F.col("cells")[i], F.lit("")) for i, n in enumerate(schema.names)}
        own = [cell.get(n, F.lit(None).cast("string")).alias(n) for n in LOADED]
        return good.where(F.col("table_name") == name).select("table_name", "raw_ref", *own)

    out = records("fec_raw", FEC_SCHEMA).unionByName(records("prospect_csv_raw", PROSPECT_CSV_SCHEMA))
    return out.withColumn("date", F.to_date("date", "MMddyyyy")).withColumn("amount", F.col("amount").cast("double"))


QUERIES = {"p4_found": p4_found, "p4_changed_fields": p4_changed_fields, "p7_found": p7_found, "p7_loaded": p7_loaded}

_CONTRIBUTION_VALUES = ", ".join(f"coalesce(cast({c} as varchar), '') as {c}" for c in CONTRIBUTION_FIELDS)


def _diff_sql(name: str, key: str, values: str, fields: list[str], version: str) -> str:
    order = ", ".join(f"{f} desc" for f in fields)
    differs = " or ".join(f"a.{f} <> b.{f}" for f in fields)
    lists = ", ".join(f"case when a.{f} <> b.{f} then '{f}' end" for f in fields)
    return f"""
select '{name}' as table_name, record_key, snapshot_no, change_kind, changed from (
  with v as (select {key} as k, snapshot_no as s, {version} as ver, {values} from {name}),
  u as (select * from (select *, row_number() over (partition by k, s order by ver desc nulls last, {order}) as rn from v) where rn = 1)
  select coalesce(a.k, b.k) as record_key, cast(coalesce(a.s, b.s + 1) as integer) as snapshot_no,
    case when b.k is null then 'added' when a.k is null then 'removed' else 'changed' end as change_kind,
    case when a.k is not null and b.k is not null then [{lists}] else [] end as changed
  from (select * from u where s > 1) a full join (select * from u where s < 4) b on a.k = b.k and a.s = b.s + 1
  where a.k is null or b.k is null or {differs})"""


_MANIFEST = ["total_pages", "scan_status", "completed_pages"]
_DIFFS = (
    _diff_sql("contribution_snapshot", "source_record_id", _CONTRIBUTION_VALUES, CONTRIBUTION_FIELDS, "load_date")
    + " union all "
    + _diff_sql(
        "scan_manifest",
        "scan_id",
        "coalesce(cast(total_pages as varchar), '') as total_pages, coalesce(scan_status, '') as scan_status, coalesce(array_to_string(list_sort(list_distinct(completed_pages)), ','), '') as completed_pages",
        _MANIFEST,
        "written_at",
    )
)
_CSV_CELL = r'(?:"(?:[^"]|"")*"|[^",]*)'
_UNQUOTE = "case when {0} like '\"%' then replace({0}[2:-2], '\"\"', '\"') else {0} end"


def _csv_cells() -> str:
    return ", ".join(f"regexp_extract(line, '^{_CSV_CELL}" .replace("^" + _CSV_CELL, "^" + (_CSV_CELL + ",") * i + f"({_CSV_CELL})") + f"', 1) as c{i + 1}" for i in range(6))


def _loaded_sql(cells: dict[str, str]) -> str:
    """The columns of p7_loaded from the cells that a table has."""
    kinds = {"date": "cast(try_strptime({0}, '%m%d%Y') as date)", "amount": "cast({0} as double)"}
    return ", ".join(f"{kinds.get(n, 'cast({0} as varchar)').format(f'nullif({cells[n]}, {chr(39) * 2})' if n in cells else 'null')} as {n}" for n in LOADED)


_PARSED = rf"""
with f as (select raw_ref, string_split(line, '|') as c from fec_raw),
g as (select raw_ref, c, case when len(c) <> 21 then 'wrong_column_count'
    when not (c[14] = '' or (regexp_full_match(c[14], '[0-9]{{8}}') and c[14][5:8] <> '0000' and try_strptime(c[14], '%m%d%Y') is not null))
      or not regexp_full_match(c[15], '-?[0-9]+(\.[0-9]{{1,2}})?') or not regexp_full_match(c[11], '([0-9]{{5}}([0-9]{{4}})?)?')
      or not regexp_full_match(c[10], '([A-Z]{{2}})?') or c[7] not in ('IND', 'ORG', 'COM', 'CAN', 'PAC', 'CCM', 'PTY', '')
      or trim(c[8]) = '' or not regexp_full_match(c[21], '[0-9]+') then 'invalid_value' end as reason from f),
p as (select raw_ref, line, not regexp_full_match(line, '{_CSV_CELL}(?:,{_CSV_CELL})*') as broken,
    len(regexp_replace(regexp_replace(line, '"(?:[^"]|"")*"', 'q', 'g'), '[^,]', '', 'g')) + 1 as n, {_csv_cells()}
    from prospect_csv_raw where row_no > 1),
q as (select *, case when broken then 'broken_quoting' when n <> 6 then 'wrong_column_count'
    when trim({_UNQUOTE.format("c1")}) = '' or len(list_filter(string_split_regex({_UNQUOTE.format("c2")}, '\s+'), lambda x: x <> '')) < 2
      or not regexp_full_match(trim({_UNQUOTE.format("c6")}), '([A-Z]{{2}})?') then 'invalid_value' end as reason from p)"""
SQL = {
    "p4_found": f"select table_name, record_key, snapshot_no, change_kind from ({_DIFFS})",
    "p4_changed_fields": f"select table_name, snapshot_no, field_name, count(*) as n_records from (select table_name, snapshot_no, unnest(changed) as field_name from ({_DIFFS})) where field_name is not null group by all",
    "p7_found": f"{_PARSED} select raw_ref, reason from g where reason is not null union all select raw_ref, reason from q where reason is not null",
    "p7_loaded": f"""{_PARSED}
select 'fec_raw' as table_name, raw_ref, {_loaded_sql({n: f"c[{i + 1}]" for i, n in enumerate(FEC_SCHEMA.names)})} from g where reason is null
union all select 'prospect_csv_raw' as table_name, raw_ref, {_loaded_sql({n: _UNQUOTE.format(f"c{i + 1}") for i, n in enumerate(PROSPECT_CSV_SCHEMA.names)})} from q where reason is null""",
}
