import json

from pyspark.sql import functions as F

from kinsieve.sources import edgar, fec, json_records, prospects, sinks, tax_returns

FORM4 = """<SEC-HEADER>
ACCESSION NUMBER: 0001
CONFORMED SUBMISSION TYPE: 4
FILED AS OF DATE: 20250301
REPORTING-OWNER:
  COMPANY CONFORMED NAME: DOE JANE
ISSUER:
  COMPANY CONFORMED NAME: ACME &amp; CO
  CENTRAL INDEX KEY: 77
</SEC-HEADER>
<XML><ownershipDocument><aff10b5One>1</aff10b5One><issuerName>Acme &amp; Co</issuerName>
<reportingOwner><rptOwnerCik>9</rptOwnerCik><rptOwnerName>Doe Jane</rptOwnerName><isDirector>1</isDirector><isOfficer>true</isOfficer><officerTitle>CFO</officerTitle></reportingOwner>
<nonDerivativeTransaction><securityTitle><value>Common</value></securityTitle><transactionDate><value>2025-02-01</value></transactionDate><transactionCode>S</transactionCode><transactionShares><value>1000</value></transactionShares><transactionPricePerShare><value>150.5</value></transactionPricePerShare></nonDerivativeTransaction>
<nonDerivativeTransaction><transactionDate><value>2025-02-01</value></transactionDate><transactionCode>M</transactionCode><transactionShares><value>10</value></transactionShares></nonDerivativeTransaction>
<footnotes><footnote id="F1">Sold under a plan</footnote></footnotes></ownershipDocument></XML>"""
EIGHT = """<SEC-HEADER>
CONFORMED SUBMISSION TYPE: 8-K/A
ITEM INFORMATION: Departure of Directors or Certain Officers
FILER:
 COMPANY CONFORMED NAME: ACME
</SEC-HEADER><TEXT><p>The board appointed John Q. Public as chief. The resignation of Mary Major was accepted.</p></TEXT>"""
FUND = """<SEC-HEADER>
CONFORMED SUBMISSION TYPE: 13F-HR
FILER:
 COMPANY CONFORMED NAME: FUND LP
</SEC-HEADER><XML><formType>13F-HR</formType><tableEntryTotal>2</tableEntryTotal><tableValueTotal>30</tableValueTotal></XML><XML><infoTable><nameOfIssuer>A</nameOfIssuer><value>10</value></infoTable><infoTable><nameOfIssuer>B</nameOfIssuer><value>20</value></infoTable></XML>"""


def test_filings(frame):
    d = frame("filename string, content string", ("a", FORM4), ("b", EIGHT), ("c", FUND), ("d", ""), ("e", None))
    got = {r.filename: r for r in edgar.parse_filings(d).collect()}
    a = got["a"]
    assert a.form_class == "FORM4" and a.issuer == "Acme & Co" and a.planned
    assert [(p.name, p.role, p.cik) for p in a.persons] == [("Doe Jane", "CFO, Director", "9")]
    assert [(t.code, t.value) for t in a.trades] == [("S", 150500.0), ("M", None)]
    assert got["b"].form_class == "8K" and [p.name for p in got["b"].persons] == ["John Q. Public", "Mary Major"]
    assert got["c"].trades[0].value == 30000.0 and got["c"].persons[0].name == "FUND LP"
    assert got["d"].form_class == "UNKNOWN" and got["e"].persons == []
    al = edgar.parse_filings(d.where("filename = 'a'")).select(edgar.trade_alerts(F.col("trades"), F.col("planned")).alias("x")).first().x
    assert [(r.type, r.total) for r in al] == [("same_day_sale", 150500.0), ("large_sale", 150500.0), ("planned_trading", 0.0)]
    h = d.where("filename = 'c'").select(edgar.holdings_13f(F.col("content")).alias("h")).first().h
    assert h.holdings_count == 2 and [x.issuer for x in h.top] == ["B", "A"]


XML = """<Return xmlns="http://www.irs.gov/efile"><ReturnHeader><TaxPeriodEndDt>2024-12-31</TaxPeriodEndDt><ReturnTypeCd>990PF</ReturnTypeCd>
<Filer><EIN>020876534</EIN><BusinessName><BusinessNameLine1Txt>Roe Fund</BusinessNameLine1Txt></BusinessName></Filer></ReturnHeader><ReturnData>
<IRS990ScheduleB><ContributorInformationGrp><ContributorPersonNm>JANE ROE</ContributorPersonNm><PersonContributionInd>X</PersonContributionInd><TotalContributionsAmt>9518</TotalContributionsAmt><ContributorUSAddress><CityNm>RENO</CityNm><ZIPCd>01234</ZIPCd></ContributorUSAddress></ContributorInformationGrp>
<ContributorInformationGrp><ContributorBusinessName><BusinessNameLine1Txt>ACME</BusinessNameLine1Txt></ContributorBusinessName><PersonContributionInd>X</PersonContributionInd></ContributorInformationGrp></IRS990ScheduleB>
<IRS990PF><OfficerDirTrstKeyEmplInfoGrp><OfficerDirTrstKeyEmplGrp><PersonNm>JOHN DOE</PersonNm><TitleTxt>DIRECTOR</TitleTxt><CompensationAmt>5</CompensationAmt></OfficerDirTrstKeyEmplGrp></OfficerDirTrstKeyEmplInfoGrp>
<SupplementaryInformationGrp><GrantOrContributionPdDurYrGrp><RecipientBusinessName><BusinessNameLine1Txt>Library</BusinessNameLine1Txt></RecipientBusinessName><Amt>13294</Amt></GrantOrContributionPdDurYrGrp><GrantOrContributionPdDurYrGrp><Amt>1</Amt></GrantOrContributionPdDurYrGrp></SupplementaryInformationGrp></IRS990PF></ReturnData></Return>"""


def test_tax_returns(spark, tmp_path):
    (tmp_path / "2024_public.xml").write_text(XML)
    r = tax_returns.read_returns(spark, str(tmp_path))
    people = {p.source: p for p in tax_returns.people(r).collect()}
    assert set(people) == {"990-PF-DONOR", "990-PF-OFFICER"}
    d = people["990-PF-DONOR"]
    assert d.amount == 9518 and d.zip == "01234" and d.filing.ein == "020876534" and d.filing.object_id == "2024" and d.person.normalized == "jane roe"
    assert people["990-PF-OFFICER"].role == "director"
    assert [(g.recipient_name, g.amount) for g in tax_returns.grants(r).collect()] == [("Library", 13294.0)]
    both = tax_returns.people(r).unionByName(tax_returns.people(r))
    assert {c.duplicate_count for c in tax_returns.collapse(both).collect()} == {2}


def test_fec_files(frame):
    line = "C1|N|Q1|P|1|15|{}|{}|RENO|NV|89501|ACME INC|BOSS|03042025|{}||t|1|{}||99"
    rows = [("a", line.format("IND", "DOE, JANE", "250", "")), ("b", line.format("ORG", "DOE, JANE", "250", "")), ("c", line.format("", "DOE, JANE", "250", "X")), ("d", line.format("IND", "ACTBLUE", "1", "")), ("e", "x|y"), ("f", None)]
    d = fec.admit(fec.scan_lines(frame("ref string, line string", *rows), "line", "ref"))
    assert [r.raw_ref for r in d.collect()] == ["a"]
    c = fec.as_contributions(d).first()
    assert (c.donor_name_normalized, c.employer_normalized, str(c.donation_date), c.amount, c.source_record_id) == ("jane doe", "acme", "2025-03-04", 250.0, "99")
    assert fec.narrow(d, frame("last_name string", "roe"), None, None, None).count() == 0
    s = "A|1|S9|Org|12|Jane Roe|1 St||Reno|NV|89501||Acme|100.5|Boss|100|20250101"
    got = fec.section_527(frame("ref string, line string", ("x", s), ("y", s.replace("A|", "B|", 1))), "line", "ref").collect()
    assert [(g.source_record_id, g.amount, str(g.donation_date)) for g in got] == [("S9", 100.5, "2025-01-01")]
    m = frame("at int, line string", (1, "|".join(["K1", "Old"] + [""] * 13)), (2, "|".join(["K1", "New"] + [""] * 13)))
    assert [r.name for r in fec.committees(m, "line", "at").collect()] == ["New"]
    assert [r.candidate_id for r in fec.linkages(frame("at int, line string", (1, "H1|24|24|K1"), (2, "H2|24|24|K1")), "line", "at").collect()] == ["H1"]


def test_lobby_and_property(spark, frame):
    rep = {"filing_uuid": "u", "dt_posted": "2025-01-02T03:04:05", "registrant": {"name": "Firm LLC", "city": "DC"}, "lobbyist": {"first_name": "Ada", "last_name": "Lobb"}, "contribution_items": [{"contributor_name": "Self", "amount": "25.5", "date": "2025-01-01"}, {"contributor_name": "Jane Roe", "amount": "-1"}]}
    d = frame("j string", json.dumps(rep), "{}").select(F.from_json("j", json_records.LOBBY_REPORT).alias("r")).select("r.*")
    got = {r.source_record_id: r for r in json_records.lobby_contributions(d).collect()}
    assert got["u:0"].identity_source == "lobbyist" and got["u:0"].donor_name_normalized == "ada lobb" and got["u:0"].employer_normalized == "firm"
    assert got["u:1"].identity_source == "contributor" and got["u:1"].refund_flag
    reg = {"id": 3, "first_name": "Ada", "nickname": "", "last_name": "Lobb", "registrant": {"id": 4, "name": "Firm"}}
    r = json_records.lobby_registrations(frame("j string", json.dumps(reg)).select(F.from_json("j", json_records.LOBBY_REGISTRATION).alias("r")).select("r.*")).first()
    assert r.source_record_id == "registration:3:4" and r.donor_name_raw == "Ada Lobb"
    prop = {"identifier": {"attomId": "5"}, "address": {"oneLine": "1 Main, Austin, TX 78701"}, "assessment": {"assessed": {"assdttlvalue": "$1,000"}}, "owner": {"owner1": {"fullname": "SMITH JOHN & JANE"}, "mailingaddressoneline": "2 Elm, Reno, NV 89501", "absenteeownerstatus": "A"}}
    p = json_records.properties(frame("j string", json.dumps(prop)).select(F.from_json("j", json_records.PROPERTY).alias("r")).select("r.*")).first()
    assert p.source_property_id == "5" and p.situs_city == "AUSTIN" and p.assessed_total == 1000.0 and p.absentee_owner and not p.owner_occupied and len(p.owners) >= 1


def test_prospects(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text('Full Name,Organization,Aliases\nJohn Smith,Acme Inc,"Jon Smith; J Smith"\nX,,\nJane Doe,,\n')
    good, bad = prospects.read_prospects(spark, str(f))
    rows = good.orderBy("prospect_id").collect()
    assert [r.prospect_id for r in rows] == ["prospect-1", "prospect-3"] and rows[0].alias_names == ["Jon Smith", "J Smith"] and rows[0].company_normalized == "acme"
    assert [(r.row, r.name) for r in bad.collect()] == [(3, "X")]
    s = prospects.load_summary(good, bad)
    assert s["skipped_rows"] == 1
    try:
        prospects.require_loaded(s)
        raise AssertionError
    except prospects.TooManyFailures:
        pass
    try:
        prospects.resolve_headers(["city"])
        raise AssertionError
    except ValueError:
        pass


def test_sinks(frame, tmp_path):
    d = frame("a string, b array<string>, c boolean", ('say "hi", you', ["x", "y"], True), (None, None, None))
    rows = sinks.flat(d, {"a": "A", "b": "B", "c": "C"}).collect()
    assert tuple(rows[0]) == ('say "hi", you', "x; y", "yes") and tuple(rows[1]) == ("", "", "")
    assert d.select(sinks.escape_csv(F.col("a")).alias("x")).first().x == '"say ""hi"", you"'
    sinks.write_csv(d, str(tmp_path / "o"), {"a": "A", "b": "B"}, files=1)
    sinks.write_manifest(str(tmp_path / "m.json"), {"n": 1}, {"FEC": "ok", "State": "missing"}, {})
    assert json.loads((tmp_path / "m.json").read_text())["degraded"] == ["State"]
    assert "State was not complete" in sinks.report("Run", {"n": 1}, {"State": "missing"})
