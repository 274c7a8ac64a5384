"""Queries of sources, text search, change data and pipelines, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinsieve.functions.fields import parse_date
from kinsieve.operators.changes import advance_watermarks, classify_changes, pages_left, should_alert, upsert
from kinsieve.operators.textcontext import credible_mentions
from kinsieve.operators.textsearch import nearest, search, word_grams
from kinsieve.plans import sqltext as S
from kinsieve.session import table
from kinsieve.sources import edgar, fec, json_records, tax_returns
from kinsieve.sources.sinks import escape_csv

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# sources: records of the tables take the sources' shapes and are read back


_JSON_ROWS = "(select distinct source_record_id, amount, state, donor_name_raw from contribution where source_record_id is not null)"


@query(f"select source_record_id, amount, amount < 0 as refund_flag, c.state, p.normalized as donor_name_normalized from {_JSON_ROWS} c join ({S.parsed('(select distinct donor_name_raw as k, donor_name_raw as v from contribution where donor_name_raw is not null)', True)}) p on p.k = c.donor_name_raw")
def campaign_json(spark, sf):
    """Every contribution as the service's JSON, read back; names that do not parse are left out."""
    c = table(spark, sf, "contribution").where("source_record_id is not null").select("source_record_id", "amount", "state", "donor_name_raw").distinct()
    j = c.select(F.to_json(F.struct(F.col("source_record_id").alias("sub_id"), F.col("donor_name_raw").alias("contributor_name"), F.col("state").alias("contributor_state"), F.col("amount").alias("contribution_receipt_amount"))).alias("j"))
    return json_records.campaign_records(j.select(F.from_json("j", json_records.CAMPAIGN_RECORD).alias("r")).select("r.*")).select("source_record_id", "amount", "refund_flag", "state", "donor_name_normalized")


@query("select committee_id || ':' || cast(row_number() over (partition by committee_id order by source_record_id) - 1 as varchar) as source_record_id, amount from (select distinct committee_id, source_record_id, amount from contribution where committee_id <> '' and amount is not null qualify row_number() over (partition by source_record_id order by amount) = 1)")
def lobby_items(spark, sf):
    c = table(spark, sf, "contribution").where("committee_id <> '' and amount is not null").groupBy("source_record_id").agg(F.min_by(F.struct("committee_id", "amount"), F.struct("amount", "committee_id")).alias("m")).select("source_record_id", "m.*")
    item = F.struct("source_record_id", F.struct(F.lit(None).cast("string").alias("contributor_name"), F.lit("payee").alias("payee_name"), F.col("amount").cast("string").alias("amount")).alias("item"))
    r = c.groupBy("committee_id").agg(F.array_sort(F.collect_list(item)).alias("l"))
    lobbyist = F.struct(F.lit(7).alias("id"), F.lit("Ada").alias("first_name"), F.lit("Lobb").alias("last_name"))
    j = r.select(F.to_json(F.struct(F.col("committee_id").alias("filing_uuid"), lobbyist.alias("lobbyist"), F.transform("l", lambda x: x["item"]).alias("contribution_items"))).alias("j"))
    return json_records.lobby_contributions(j.select(F.from_json("j", json_records.LOBBY_REPORT).alias("r")).select("r.*")).select("source_record_id", "amount")


_RETURN_PEOPLE = "(select nonprofit_id, person_name, title, amount, filing.object_id as object_id from nonprofit_record where filing.object_id is not null and nonprofit_id is not null qualify row_number() over (partition by nonprofit_id order by loaded_at desc nulls last, person_name desc nulls last) = 1)"


def _tried(source: str) -> str:
    """Officers' names as they are parsed, of source(person_name)."""
    return rf"""(with s as (select distinct person_name as k, regexp_replace(coalesce(person_name, ''), '(?i)\s+AS\s+OF\s+\w+\s+\d{{4}}\s*$', '') as c from {source} where person_name is not null),
t as (select k, {S.ws('c')} as v from s),
u as (select k, v from t where length(v) >= 3 and upper(v) not in ('VACANT', 'NONE', 'N/A', 'NA', 'NOT APPLICABLE', 'TBD', 'UNKNOWN') and not regexp_matches(v, '\d'))
select k, normalized from ({S.parsed('u', True)}))"""


def _return_people(spark, sf):
    n = table(spark, sf, "nonprofit_record").where("filing.object_id is not null and nonprofit_id is not null")
    n = n.groupBy("nonprofit_id").agg(F.max_by(F.struct("person_name", "title", "amount", F.col("filing.object_id").alias("object_id")), F.struct("loaded_at", "person_name")).alias("r"))
    return n.select("nonprofit_id", "r.*")


def _xml_text(c):
    c = F.coalesce(F.col(c).cast("string"), F.lit(""))
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def _element(name, c):
    return F.concat(F.lit(f"<{name}>"), _xml_text(c), F.lit(f"</{name}>"))


def _returns(rows, kind, path, entry):
    """A return per object_id whose entries are elements of `entry`, inside the elements of `path`."""
    x = rows.groupBy("object_id").agg(F.concat_ws("", F.collect_list(entry)).alias("o"))
    opened, closed = "".join(f"<{t}>" for t in path), "".join(f"</{t}>" for t in reversed(path))
    head = f'<Return xmlns="http://www.irs.gov/efile"><ReturnHeader><ReturnTypeCd>{kind}</ReturnTypeCd></ReturnHeader><ReturnData>{opened}'
    return tax_returns.parse_returns(x.select("object_id", F.concat(F.lit(head), "o", F.lit(f"{closed}</ReturnData></Return>")).alias("xml")), "xml", "object_id")


def _group(name, *parts):
    return F.concat(F.lit(f"<{name}>"), *parts, F.lit(f"</{name}>"))


@query(f"select object_id, p.normalized, round(coalesce(amount, 0), 2) as amount from {_RETURN_PEOPLE} r join {_tried('nonprofit_record')} p on p.k = r.person_name")
def tax_return_officers(spark, sf):
    n = _return_people(spark, sf)
    rows = tax_returns.people(_returns(n, "990", ["IRS990"], _group("Form990PartVIISectionAGrp", _element("PersonNm", "person_name"), _element("ReportableCompFromOrgAmt", "amount"))))
    return rows.select(F.col("filing.object_id").alias("object_id"), F.col("person.normalized").alias("normalized"), F.round("amount", 2).alias("amount"))


_ROLE = "case when contains(upper(trim(coalesce(title, ''))), 'TRUSTEE') then 'trustee' when contains(upper(trim(coalesce(title, ''))), 'DIRECTOR') then 'director' when contains(upper(trim(coalesce(title, ''))), 'KEY EMP') then 'key_employee' else 'officer' end"


@query(f"select object_id, p.normalized, {_ROLE} as role, round(coalesce(amount, 0), 2) as amount from {_RETURN_PEOPLE} r join {_tried('nonprofit_record')} p on p.k = r.person_name")
def tax_return_pf_officers(spark, sf):
    n = _return_people(spark, sf)
    entry = _group("OfficerDirTrstKeyEmplGrp", _element("PersonNm", "person_name"), _element("TitleTxt", "title"), _element("CompensationAmt", "amount"))
    rows = tax_returns.people(_returns(n, "990PF", ["IRS990PF", "OfficerDirTrstKeyEmplInfoGrp"], entry))
    return rows.select(F.col("filing.object_id").alias("object_id"), F.col("person.normalized").alias("normalized"), "role", F.round("amount", 2).alias("amount"))


@query(f"select object_id, p.normalized, 'donor' as role, round(coalesce(amount, 0), 2) as amount from {_RETURN_PEOPLE} r join {_tried('nonprofit_record')} p on p.k = r.person_name")
def tax_return_donors(spark, sf):
    n = _return_people(spark, sf)
    entry = _group("ContributorInformationGrp", _element("ContributorPersonNm", "person_name"), F.lit("<PersonContributionInd>X</PersonContributionInd>"), _element("TotalContributionsAmt", "amount"))
    rows = tax_returns.people(_returns(n, "990PF", ["IRS990ScheduleB"], entry))
    return rows.select(F.col("filing.object_id").alias("object_id"), F.col("person.normalized").alias("normalized"), "role", F.round("amount", 2).alias("amount"))


@query(f"select object_id, p.normalized, {_ROLE} as role, round(coalesce(amount, 0) * 2, 2) as amount from {_RETURN_PEOPLE} r join {_tried('nonprofit_record')} p on p.k = r.person_name")
def tax_return_related_pay(spark, sf):
    n = _return_people(spark, sf)
    entry = _group("RltdOrgOfficerTrstKeyEmplGrp", _element("PersonNm", "person_name"), _element("TitleTxt", "title"), _element("BaseCompensationFilingOrgAmt", "amount"), _element("CompensationBasedOnRelatedOrgAmt", "amount"))
    rows = tax_returns.people(_returns(n, "990", ["IRS990ScheduleJ"], entry))
    return rows.select(F.col("filing.object_id").alias("object_id"), F.col("person.normalized").alias("normalized"), "role", F.round("amount", 2).alias("amount"))


@query(f"select object_id, trim(person_name) as recipient_name, trim(coalesce(title, '')) as purpose, round(coalesce(amount, 0), 2) as amount from {_RETURN_PEOPLE} where trim(coalesce(person_name, '')) <> ''")
def tax_return_grants(spark, sf):
    n = _return_people(spark, sf)
    entry = _group("GrantOrContributionPdDurYrGrp", _element("RecipientPersonNm", "person_name"), _element("GrantOrContributionPurposeTxt", "title"), _element("Amt", "amount"))
    rows = tax_returns.grants(_returns(n, "990PF", ["IRS990PF", "SupplementaryInformationGrp"], entry))
    return rows.select(F.col("filing.object_id").alias("object_id"), "recipient_name", "purpose", F.round("amount", 2).alias("amount"))


# campaign masters

_MASTERS = "(select * from contribution where committee_id <> '' and source_record_id is not null)"


@query(f"select committee_id, arg_max(trim(recipient_name), source_record_id || coalesce(recipient_name, '')) as name, arg_max(trim(coalesce(city, '')), source_record_id || coalesce(recipient_name, '')) as city from (select committee_id, source_record_id, coalesce(recipient_name, '') as recipient_name, min(coalesce(city, '')) as city from {_MASTERS} where not contains(coalesce(recipient_name, '') || coalesce(city, ''), '|') group by all) group by 1")
def committees_scan(spark, sf):
    text = lambda x: F.coalesce(F.col(x), F.lit(""))
    c = table(spark, sf, "contribution").where("committee_id <> '' and source_record_id is not null and not contains(coalesce(recipient_name, '') || coalesce(city, ''), '|')")
    c = c.groupBy("committee_id", "source_record_id", text("recipient_name").alias("n")).agg(F.min(text("city")).alias("c"))
    lines = c.select(F.concat("source_record_id", "n").alias("at"), F.concat_ws("|", "committee_id", "n", *[F.lit("")] * 3, "c", *[F.lit("")] * 9).alias("line"))
    return fec.committees(lines, "line", "at").select("committee_id", "name", "city")


@query(f"select trim(candidate_id) as candidate_id, arg_max(trim(coalesce(office, '')), source_record_id) as office from {_MASTERS} where trim(candidate_id) <> '' group by 1")
def candidates_scan(spark, sf):
    c = table(spark, sf, "contribution").where("committee_id <> '' and source_record_id is not null and trim(candidate_id) <> ''").dropDuplicates(["source_record_id", "candidate_id"])
    text = lambda x: F.coalesce(F.col(x), F.lit(""))
    lines = c.select(F.col("source_record_id").alias("at"), F.concat_ws("|", "candidate_id", F.lit("x"), text("party"), F.lit("2024"), text("office_state"), text("office"), text("office_district"), *[F.lit("")] * 8).alias("line"))
    return fec.candidates(lines, "line", "at").select("candidate_id", "office")


@query(f"select trim(committee_id) as committee_id, arg_min(trim(candidate_id), source_record_id) as candidate_id from {_MASTERS} where trim(candidate_id) <> '' group by 1")
def linkages_scan(spark, sf):
    c = table(spark, sf, "contribution").where("committee_id <> '' and source_record_id is not null and trim(candidate_id) <> ''").dropDuplicates(["source_record_id", "candidate_id"])
    lines = c.select(F.col("source_record_id").alias("at"), F.concat_ws("|", "candidate_id", F.lit("2024"), F.lit("2024"), "committee_id", F.lit("P")).alias("line"))
    return fec.linkages(lines, "line", "at").select("committee_id", "candidate_id")


@query(f"select source_record_id, p.normalized as donor_name_normalized, amount < 0 as refund_flag, trim(coalesce(city, '')) as city from (select distinct source_record_id, donor_name_raw, trim(donor_name_raw) as t, city, amount from contribution where source_record_id is not null and donor_name_raw is not null and amount is not null and not contains(donor_name_raw || coalesce(city, ''), '|')) c join ({S.parsed('(select distinct trim(donor_name_raw) as k, trim(donor_name_raw) as v from contribution where donor_name_raw is not null)', True)}) p on p.k = c.t")
def section_527_scan(spark, sf):
    c = table(spark, sf, "contribution").where("source_record_id is not null and donor_name_raw is not null and amount is not null and not contains(donor_name_raw || coalesce(city, ''), '|')").select("source_record_id", "donor_name_raw", "city", "amount").distinct()
    blank = lambda n: [F.lit("")] * n
    line = F.concat_ws("|", F.lit("A"), F.lit("f"), "source_record_id", F.lit("org"), F.lit("ein"), "donor_name_raw", *blank(2), F.coalesce("city", F.lit("")), *blank(4), F.col("amount").cast("string"), *blank(3))
    return fec.section_527(c.select("source_record_id", line.alias("line")), "line", "source_record_id").select("source_record_id", "donor_name_normalized", "refund_flag", "city")


@query("select distinct source_property_id, fips, line1 as situs_address, coalesce(city, '') as situs_city, coalesce(state, '') as situs_state from property_address where source_property_id is not null")
def property_payloads(spark, sf):
    a = table(spark, sf, "property_address").where("source_property_id is not null").select("source_property_id", "fips", "line1", "city", "state").distinct()
    j = a.select(F.to_json(F.struct(F.struct(F.col("source_property_id").alias("attomId"), "fips").alias("identifier"), F.struct(F.col("line1").alias("oneLine"), F.col("city").alias("locality"), F.col("state").alias("countrySubd")).alias("address"))).alias("j"))
    schema = json_records.PROPERTY.replace(" struct<", ":struct<").replace(", ", ",")
    return json_records.properties(j.select(F.from_json("j", f"struct<{schema}>").alias("r")).select("r.*")).select("source_property_id", "fips", "situs_address", "situs_city", "situs_state")


# filings: forms are written from the documents' columns and read back

_PERSON_OF = "'Jane Doe ' || cast(doc_id % 97 as varchar)"


def _filings(spark, sf, form, body):
    d = table(spark, sf, "documents")
    who = F.concat(F.lit("Jane Doe "), (F.col("doc_id") % 97).cast("string"))
    head = F.format_string(f"<SEC-HEADER>\nACCESSION NUMBER: 1\nCONFORMED SUBMISSION TYPE: {form}\nFILED AS OF DATE: 20250102\nFILED BY:\n COMPANY CONFORMED NAME: %s\nFILER:\n COMPANY CONFORMED NAME: %s\n</SEC-HEADER>\n", who, who)
    return edgar.parse_filings(d.select(F.col("doc_id").cast("string").alias("filename"), F.concat(head, body(F.col("doc_id"), F.coalesce("n_tokens", F.lit(0)), who)).alias("content")))


def _x(name, c):
    return F.concat(F.lit(f"<{name}>"), c.cast("string"), F.lit(f"</{name}>"))


@query(f"select doc_id, {_PERSON_OF} as name, case when doc_id % 2 = 0 then 'Director' else 'Insider' end as role, (['S', 'P', 'G'])[doc_id % 3 + 1] as code, cast(coalesce(n_tokens, 0) as double) as shares, case when coalesce(n_tokens, 0) <> 0 then cast(coalesce(n_tokens, 0) * 250 as double) end as value from documents")
def insider_filings(spark, sf):
    def body(i, n, who):
        owner = F.concat(_x("rptOwnerName", who), _x("isDirector", F.when(i % 2 == 0, 1).otherwise(0)))
        trade = F.concat(_x("transactionCode", F.element_at(F.array(*map(F.lit, "SPG")), (i % 3 + 1).cast("int"))), _x("transactionShares", n), _x("transactionPricePerShare", F.lit(250)))
        return F.concat(F.lit("<XML>"), _x("reportingOwner", owner), _x("nonDerivativeTransaction", trade), F.lit("</XML>"))

    p = _filings(spark, sf, "4", body).select(F.col("filename").cast("bigint").alias("doc_id"), F.get("persons", F.lit(0)).alias("p"), F.get("trades", F.lit(0)).alias("t"))
    return p.select("doc_id", "p.name", "p.role", "t.code", "t.shares", "t.value")


@query("""select doc_id, kind as alert, total from (select doc_id, cast(coalesce(n_tokens, 0) as double) * 250 as total, (['S', 'P', 'G'])[doc_id % 3 + 1] as code, unnest(['gift', 'large_sale', 'large_purchase']) as kind from documents)
where code = 'G' and kind = 'gift' or code = 'S' and kind = 'large_sale' and total > 100000 or code = 'P' and kind = 'large_purchase' and total > 100000""")
def insider_alerts(spark, sf):
    def body(i, n, who):
        trade = F.concat(_x("transactionCode", F.element_at(F.array(*map(F.lit, "SPG")), (i % 3 + 1).cast("int"))), _x("transactionShares", n), _x("transactionPricePerShare", F.lit(250)))
        return F.concat(F.lit("<XML>"), _x("nonDerivativeTransaction", trade), F.lit("</XML>"))

    a = _filings(spark, sf, "4", body).select(F.col("filename").cast("bigint").alias("doc_id"), F.explode(edgar.trade_alerts(F.col("trades"), F.col("planned"))).alias("a"))
    return a.select("doc_id", F.col("a.type").alias("alert"), F.col("a.total").alias("total"))


@query(f"select doc_id, {_PERSON_OF} as name, cast(coalesce(n_tokens, 0) as double) as shares from documents")
def form_144(spark, sf):
    p = _filings(spark, sf, "144", lambda i, n, who: F.concat(F.lit("<XML>"), _x("entityName", who), _x("numberOfShares", n), F.lit("</XML>")))
    return p.select(F.col("filename").cast("bigint").alias("doc_id"), F.get("persons", F.lit(0))["name"].alias("name"), F.get("trades", F.lit(0))["shares"].alias("shares"))


@query("select doc_id, 'Jane Doe' as name, 'Director' as role, case when coalesce(n_tokens, 0) <> 0 then cast(n_tokens as double) end as value from documents")
def form_d(spark, sf):
    def body(i, n, who):
        person = F.lit("<relatedPersonName><firstName>Jane</firstName><lastName>Doe</lastName></relatedPersonName><relatedPersonRelationshipList><relationship>Director</relationship></relatedPersonRelationshipList>")
        return F.concat(F.lit("<XML>"), _x("relatedPersonInfo", person), _x("totalOfferingAmount", n), F.lit("</XML>"))

    p = _filings(spark, sf, "D", body).select(F.col("filename").cast("bigint").alias("doc_id"), F.get("persons", F.lit(0)).alias("p"), F.get("trades", F.lit(0)).alias("t"))
    return p.select("doc_id", "p.name", "p.role", "t.value")


@query(f"select doc_id, {_PERSON_OF} as name, '5%+ Active Investor' as role, cast(coalesce(n_tokens, 0) as double) as shares from documents")
def schedule_13d(spark, sf):
    body = lambda i, n, who: F.concat(F.lit("<TEXT>They hold "), n.cast("string"), F.lit(" shares, 7.5% of the class.</TEXT>"))
    p = _filings(spark, sf, "SC 13D", body).select(F.col("filename").cast("bigint").alias("doc_id"), F.get("persons", F.lit(0)).alias("p"), F.get("trades", F.lit(0)).alias("t"))
    return p.select("doc_id", "p.name", "p.role", "t.shares")


@query("select doc_id, cast((coalesce(n_tokens, 0) + 7) * 1000 as double) as total_value, cast(2 as integer) as n_holdings from documents")
def holdings_13f(spark, sf):
    row = lambda v: _x("infoTable", F.concat(_x("nameOfIssuer", F.lit("Acme")), _x("value", v), _x("sshPrnamt", F.lit(5))))
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("<XML>"), row(F.coalesce("n_tokens", F.lit(0))), row(F.lit(7)), F.lit("</XML>")).alias("c"))
    h = d.select("doc_id", edgar.holdings_13f(F.col("c")).alias("h"))
    return h.select("doc_id", F.aggregate("h.top", F.lit(0.0), lambda a, r: a + r["value"]).alias("total_value"), F.col("h.holdings_count").cast("int").alias("n_holdings"))


@query("select doc_id, case when doc_id % 2 = 0 then 'Chief Financial Officer' else 'Departed' end as role, 'Maria Stone' as name from documents")
def current_reports(spark, sf):
    d = table(spark, sf, "documents")
    head = F.lit("<SEC-HEADER>\nCONFORMED SUBMISSION TYPE: 8-K\nITEM INFORMATION: Departure of Directors or Certain Officers\n</SEC-HEADER>\n<TEXT>")
    text = F.when(F.col("doc_id") % 2 == 0, "The board appointed Maria Stone as its Chief Financial Officer on Monday.").otherwise("The company announced the resignation of Maria Stone on Monday.")
    p = edgar.parse_filings(d.select(F.col("doc_id").cast("string").alias("filename"), F.concat(head, text, F.lit("</TEXT>")).alias("content")))
    return p.select(F.col("filename").cast("bigint").alias("doc_id"), F.explode("persons").alias("p")).select("doc_id", "p.role", "p.name")


@query("select doc_id, case when doc_id % 2 = 0 then 'no structured part' end as parse_error, case when doc_id % 2 = 0 then 'Filing party' else 'Insider' end as role from documents")
def filing_fallback(spark, sf):
    """A form whose reader finds nothing is read by its header's parties, with the reason."""
    body = lambda i, n, who: F.when(i % 2 == 0, "<TEXT>scanned</TEXT>").otherwise(F.concat(F.lit("<XML>"), _x("reportingOwner", _x("rptOwnerName", who)), F.lit("</XML>")))
    p = _filings(spark, sf, "4", body)
    return p.select(F.col("filename").cast("bigint").alias("doc_id"), "parse_error", F.get("persons", F.lit(0))["role"].alias("role"))


_FORMS = ["4", "4/A", "3", "144", "8-K", "DEF 14A", "SC 13D", "SCHEDULE 13G/A", "13F-HR", "D", "10-K", "424B5", "S-1/A", "XYZ"]
_CLASSES = ["FORM4", "FORM4", "FORM3", "FORM144", "8K", "DEF14A", "SC13D", "SC13G", "13FHR", "FORMD", "10K", "424B", "S1", "OTHER"]


@query(f"select doc_id, ({_CLASSES!r})[(doc_id % {len(_FORMS)}) + 1] as form_class, 'Issuer ' || cast(doc_id as varchar) as issuer, strftime(written_at, '%Y%m%d') as filed_date from documents where written_at is not null")
def filing_header(spark, sf):
    d = table(spark, sf, "documents").where("written_at is not null")
    form = F.get(F.array(*map(F.lit, _FORMS)), (F.col("doc_id") % len(_FORMS)).cast("int"))
    head = F.format_string("<SEC-HEADER>\nACCESSION NUMBER: 1\nCONFORMED SUBMISSION TYPE: %s\nFILED AS OF DATE: %s\nISSUER:\n COMPANY CONFORMED NAME: Issuer %s\nREPORTING-OWNER:\n COMPANY CONFORMED NAME: Doe Jane\n</SEC-HEADER>", form, F.date_format("written_at", "yyyyMMdd"), F.col("doc_id").cast("string"))
    filings = d.select(F.col("doc_id").cast("string").alias("filename"), head.alias("content"))
    p = edgar.parse_filings(filings)
    return p.select(F.col("filename").cast("bigint").alias("doc_id"), "form_class", "issuer", "filed_date")


@query("select donor_name_raw, case when regexp_matches(donor_name_raw, '[\",\\n]') then '\"' || replace(donor_name_raw, '\"', '\"\"') || '\"' else donor_name_raw end as cell from (select distinct donor_name_raw from contribution where donor_name_raw is not null)")
def csv_escape(spark, sf):
    d = table(spark, sf, "contribution").select("donor_name_raw").where("donor_name_raw is not null").distinct()
    return d.withColumn("cell", escape_csv(F.col("donor_name_raw")))


# text search

_AT = '"at"'
_GRAMS = r"""(select doc_id, array_to_string(w[i:i + 1], ' ') as gram, i - 1 as at from (select doc_id, w, unnest(range(1, greatest(len(w), 1))) as i from
  (select doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}''-]+'), lambda x: x <> '') as w from documents where length(text) > 0)))"""
_WORDS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}''-]+'), lambda x: x <> '')"
_NAMES2 = f"""(select distinct array_to_string(w, ' ') as gram from (select {_WORDS.format('n')} as w from (select name_normalized as n from prospect union all select last_name from prospect union all select filing.org_name from nonprofit_record union all select employer_name from employer_ref)) where len(w) between 1 and 5)"""
_RUNS = f"""(select doc_id, array_to_string(w[i:i + n - 1], ' ') as gram, i - 1 as at from (select doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) as i from (select doc_id, {_WORDS.format('text')} as w, unnest([1, 2, 3, 4, 5]) as n from documents where length(text) > 0)))"""


@query(f"select doc_id as text_id, gram as pattern, cast(g.at as integer) as {_AT} from {_RUNS} g join {_NAMES2} using (gram)")
def text_search(spark, sf):
    """Prospects, their surnames, organisations and employers, of one to five words, in all documents."""
    p, n = table(spark, sf, "prospect"), table(spark, sf, "nonprofit_record")
    names = p.select(F.col("name_normalized").alias("n")).union(p.select("last_name")).union(n.select("filing.org_name")).union(table(spark, sf, "employer_ref").select("employer_name"))
    return search(table(spark, sf, "documents"), "doc_id", "text", names, "n", [1, 2, 3, 4, 5])


@query(r"""with d as (select doc_id, text, lower(text) as t from documents where length(text) > 0),
w as (select distinct lower(industry) as pattern from employer_ref where trim(industry) <> ''),
o as (select doc_id, text, pattern, unnest(list_transform(range(1, len(string_split(t, pattern))), lambda i: 1 + list_sum(list_transform((string_split(t, pattern))[1:i], lambda x: length(x))) + (i - 1) * length(pattern))) as place from d join w on contains(t, pattern))
select doc_id, pattern, cast(place as integer) as place, (place = 1 or regexp_matches(text[place - 1:place - 1], '\s')) and (place + length(pattern) > length(text) or regexp_matches(text[place + length(pattern):place + length(pattern)], '[\s,.]')) as bounded,
  len(regexp_extract_all(text[greatest(place - 50, 1):place + length(pattern) + 49], '\b[a-z]{4,}\b')) >= 2 as prose from o""")
def mention_tests(spark, sf):
    """Every place of the industries' names in the documents, with the tests of its surroundings."""
    d = table(spark, sf, "documents")
    kinds = table(spark, sf, "employer_ref").where("trim(industry) <> ''").select(F.lower("industry").alias("pattern")).distinct()
    named = search(d, "doc_id", "text", kinds, "pattern", [1, 2, 3]).select("text_id", "pattern")
    # a pattern may also stand inside of longer words
    inside = d.join(F.broadcast(kinds), F.contains(F.lower("text"), F.col("pattern"))).select(F.col("doc_id").alias("text_id"), "pattern")
    found = named.unionByName(inside).distinct().withColumn("company", F.lit(""))
    return credible_mentions(found, d, "doc_id", "text").select(F.col("text_id").alias("doc_id"), "pattern", "place", "bounded", "prose")


@query(f"select gram, count(*) as n from {_GRAMS} group by 1 order by n desc, gram limit 50")
def frequent_grams(spark, sf):
    return word_grams(table(spark, sf, "documents"), "doc_id", "text", [2]).groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(50)


@query(f"select a.doc_id as text_id, cast(min(abs(a.at - b.at)) as integer) as distance from (select * from {_GRAMS} where gram in ('of the', 'in the')) a join (select * from {_GRAMS} where gram like '% foundation') b using (doc_id) group by 1")
def min_distance(spark, sf):
    g = word_grams(table(spark, sf, "documents"), "doc_id", "text", [2])
    return nearest(g.where(F.col("gram").isin("of the", "in the")), g.where("gram like '% foundation'"), ["text_id"]).withColumn("distance", F.col("distance").cast("int"))


# change data


def _scans(spark, sf):
    m = table(spark, sf, "scan_manifest").withColumn("key", F.concat_ws("#", F.col("snapshot_no").cast("string"), "scan_id"))
    return m.groupBy("key", "snapshot_no", "scan_id").agg(F.max_by(F.struct("fips", "total_pages", "scan_status", F.size(F.array_distinct("completed_pages")).alias("done")), F.struct("written_at", F.size("completed_pages"))).alias("s")).select("key", "snapshot_no", "scan_id", "s.*")


_SCANS = "(select snapshot_no, scan_id, fips, total_pages, scan_status, len(list_distinct(completed_pages)) as done from scan_manifest qualify row_number() over (partition by snapshot_no, scan_id order by written_at desc, len(completed_pages) desc) = 1)"
_KINDS = f"(select a.snapshot_no, a.scan_id, case when b.scan_id is null then 'new_to_cache' when a.scan_status is distinct from b.scan_status then 'status_change' when a.total_pages is distinct from b.total_pages then 'size_change' when a.done is distinct from b.done then 'progress' else 'no_change' end as change_type from {_SCANS} a left join {_SCANS} b on a.scan_id = b.scan_id and a.snapshot_no = b.snapshot_no + 1)"


def _kinds(spark, sf):
    groups = {"status_change": ["scan_status"], "size_change": ["total_pages"], "progress": ["done"]}
    s = _scans(spark, sf)
    # the state before a snapshot is the one delivered before it
    before = s.withColumn("key", F.concat_ws("#", (F.col("snapshot_no") + 1).cast("string"), "scan_id"))
    return classify_changes(s, before, "key", groups)


@query(f"select snapshot_no, scan_id, change_type from {_KINDS}")
def change_classify(spark, sf):
    return _kinds(spark, sf).select("snapshot_no", "scan_id", "change_type")


@query(f"select scan_id, fips, total_pages, scan_status, done from {_SCANS} qualify row_number() over (partition by scan_id order by snapshot_no desc) = 1")
def state_upsert(spark, sf):
    """The state after all deliveries, each replacing what it names."""
    s = _scans(spark, sf)
    rows = [s.where(F.col("snapshot_no") == n).drop("key", "snapshot_no") for n in (1, 2, 3, 4)]
    state = rows[0]
    for more in rows[1:]:
        state = upsert(state, more, "scan_id")
    return state.select("scan_id", "fips", "total_pages", "scan_status", F.col("done").cast("bigint").alias("done"))


@query("select fips, cast(max(case when scan_status = 'complete' then end_date end) as varchar) as last_completed, max(start_date) as last_started, case when bool_and(scan_status = 'complete') then 'complete' else 'partial' end as status from scan_manifest where snapshot_no = 4 group by 1")
def watermark_next(spark, sf):
    s = table(spark, sf, "scan_manifest").where("snapshot_no = 4").select("fips", "start_date", "end_date", F.col("scan_status").alias("status"))
    empty = s.select("fips", F.lit(None).cast("string").alias("last_completed")).where("false")
    return advance_watermarks(empty, s, "fips")


@query("select scan_id, cast(page as integer) as page from (select scan_id, unnest(list_filter(range(1, total_pages + 1), lambda x: not list_contains(coalesce(completed_pages, []), x))) as page from (select * from scan_manifest where snapshot_no = 4 and total_pages >= 1 qualify row_number() over (partition by scan_id order by written_at desc, len(completed_pages) desc) = 1))")
def scan_pages_left(spark, sf):
    m = table(spark, sf, "scan_manifest").where("snapshot_no = 4")
    m = m.groupBy("scan_id").agg(F.max_by(F.struct("total_pages", "completed_pages"), F.struct("written_at", F.size("completed_pages"))).alias("s")).select("scan_id", "s.*")
    return pages_left(m, "scan_id", "total_pages", "completed_pages")


@query(f"select snapshot_no, scan_id, change_type, cast(change_type = 'owner_change' or (change_type = 'new_to_cache' and snapshot_no > 1) as boolean) as alert from {_KINDS}")
def alert_rule(spark, sf):
    """Which changes of all deliveries are news; all are new in the first one."""
    return _kinds(spark, sf).select("snapshot_no", "scan_id", "change_type", should_alert(F.col("change_type"), F.col("snapshot_no") == 1, F.lit(False)).alias("alert"))


# totals


_DAY = r"""case when regexp_matches(t, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') then try_strptime(left(t, 10), '%Y-%m-%d') when regexp_full_match(t, '[0-9]{4}/[0-9]{2}/[0-9]{2}') then try_strptime(t, '%Y/%m/%d')
  when regexp_full_match(t, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}') then try_strptime(t, '%m/%d/%Y')
  when regexp_full_match(t, '(19|20)[0-9]{2}(0[1-9]|1[0-2])[0-9]{2}') and try_strptime(t, '%Y%m%d') is not null then try_strptime(t, '%Y%m%d') when regexp_full_match(t, '[0-9]{8}') then try_strptime(t, '%m%d%Y') end"""


@query(f"select month, count(*) as n, round(sum(cast(amount as decimal(18, 2))), 2)::double as total from (select strftime(cast({_DAY} as date), '%Y-%m') as month, amount from (select trim(coalesce(donation_date, '')) as t, amount from contribution)) where month is not null group by 1")
def monthly_totals(spark, sf):
    d = table(spark, sf, "contribution").select(F.date_format(parse_date(F.col("donation_date")), "yyyy-MM").alias("month"), "amount").where("month is not null")
    return d.groupBy("month").agg(F.count("*").alias("n"), F.round(F.sum(F.col("amount").cast("decimal(18,2)")), 2).cast("double").alias("total"))


@query("select user_id, event_type, count(*) as n, min(cast(ts as varchar)) as first_ts from events group by all")
def event_totals(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("t")).select("user_id", "event_type", "n", F.col("t").cast("string").alias("first_ts"))
