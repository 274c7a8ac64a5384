"""Regulatory filings: header, form type, and what each form holds, as column expressions over the text.

A filing is one row (filename, content). Tags are taken by patterns, as filings are SGML with embedded
XML or HTML rather than well-formed documents; nothing leaves the JVM. Fields that a form lacks are
null, lists empty. Two totals of institutional holdings that other readers swap are mapped by meaning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PERSONS = "array<struct<name:string,role:string,cik:string>>"
_TRADES = "array<struct<code:string,date:string,shares:double,price:double,value:double,acquired_disposed:string,security:string,shares_after:double>>"


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, pattern, group)), F.lit(""))


def tag(xml: Column, name: str) -> Column:
    """The first element's text; of an element with a <value> inside, that."""
    inner = F.regexp_extract(xml, rf"(?s)<{name}>\s*(.*?)\s*</{name}>", 1)
    return F.coalesce(_found(inner, r"(?s)<value>\s*(.*?)\s*</value>"), F.nullif(F.trim(inner), F.lit("")))


def blocks(xml: Column, name: str) -> Column:
    return F.coalesce(F.regexp_extract_all(xml, F.lit(rf"(?s)<{name}>(.*?)</{name}>"), F.lit(1)), F.array().cast("array<string>"))


def number(xml: Column, name: str) -> Column:
    return _found(tag(xml, name), r"^(-?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)").try_cast("double")


def flag(xml: Column, name: str) -> Column:
    return F.coalesce(F.lower(tag(xml, name)).isin("1", "true"), F.lit(False))


def embedded_xml(content: Column) -> Column:
    return _found(content, r"(?s)<XML>\s*(.*?)\s*</XML>")


def embedded_html(content: Column) -> Column:
    return F.coalesce(
        _found(content, r"(?s)<XBRL>\s*(.*?)\s*</XBRL>"), _found(content, r"(?is)<HTML>\s*(.*?)\s*</HTML>"), _found(content, r"(?s)<TEXT>\s*(.*?)\s*</TEXT>")
    )


def decode(c: Column) -> Column:
    pairs = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")]
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, F.replace(c, F.lit("&amp;"), F.lit("&")))


def strip_html(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))


def raw_text(content: Column) -> Column:
    """The filing without header and tags, for text search."""
    bare = F.regexp_replace(content, r"(?s)<SEC-HEADER>.*?</SEC-HEADER>", "")
    return F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), r"\s+", " ")


# header


def _line(section: Column, label: str) -> Column:
    return _found(section, rf"{label}:[ \t]*([^\r\n]*)")


def _section(header: Column, label: str) -> Column:
    others = "|".join(x for x in ("REPORTING-OWNER", "ISSUER", "FILER", "SUBJECT COMPANY", "FILED BY") if x != label)
    return F.nullif(F.regexp_extract(header, rf"(?s){label}:\s*(.*?)(?=(?:{others}):|\z)", 1), F.lit(""))


def _party(header: Column, label: str) -> Column:
    s = _section(header, label)
    return F.struct(
        _line(s, "COMPANY CONFORMED NAME").alias("name"),
        _line(s, "CENTRAL INDEX KEY").alias("cik"),
        _line(s, "STANDARD INDUSTRIAL CLASSIFICATION").alias("sic"),
        _line(s, "STATE").alias("state"),
        _line(s, "CITY").alias("city"),
        _line(s, "ZIP").alias("zip"),
    )


def header(content: Column) -> Column:
    h = F.regexp_extract(content, r"(?s)<SEC-HEADER>(.*?)</SEC-HEADER>", 1)
    return F.struct(
        _line(h, "ACCESSION NUMBER").alias("accession_number"),
        _line(h, "CONFORMED SUBMISSION TYPE").alias("form_type"),
        _line(h, "FILED AS OF DATE").alias("filed_date"),
        _line(h, "CONFORMED PERIOD OF REPORT").alias("period_of_report"),
        F.transform(F.regexp_extract_all(h, F.lit(r"ITEM INFORMATION:\s*([^\r\n]+)"), F.lit(1)), lambda x: F.trim(x)).alias("items"),
        _party(h, "REPORTING-OWNER").alias("owner"),
        _party(h, "ISSUER").alias("issuer"),
        _party(h, "FILER").alias("filer"),
        _party(h, "SUBJECT COMPANY").alias("subject"),
        _party(h, "FILED BY").alias("filed_by"),
    )


# Form types by pattern, the first that fits.
FORM_TYPES = [
    (r"4(/A)?", "FORM4"), (r"3(/A)?", "FORM3"), (r"5(/A)?", "FORM5"), (r"144", "FORM144"), (r"8-K.*", "8K"),
    (r"DEF\s*14A", "DEF14A"), (r"DEFA14A", "DEFA14A"), (r"DEFC14A", "DEFC14A"), (r"DEFM14A", "DEFM14A"), (r"PRE\s*14A", "PRE14A"), (r"PREM14A", "PREM14A"),
    (r"(SCHEDULE|SC) 13D.*", "SC13D"), (r"(SCHEDULE|SC) 13G.*", "SC13G"), (r"13F-HR.*", "13FHR"), (r"13F-NT.*", "13FNT"), (r"D(/A)?", "FORMD"),
    (r"10-K.*", "10K"), (r"10-Q.*", "10Q"), (r"S-1.*", "S1"), (r"F-1.*", "F1"), (r"S-4.*", "S4"), (r"424B.*", "424B"), (r"20-F.*", "20F"), (r"6-K.*", "6K"), (r"40-F.*", "40F"),
    (r"(ADV|MA-I|MA/A|MA-A).*", "ADV"), (r"SC TO.*", "SCTO"), (r"SC 13E.*", "SC13E3"),
]


def form_class(c: Column) -> Column:
    t = F.upper(F.trim(c))
    out = reduce(lambda e, p: F.when(F.regexp_like(t, F.lit(rf"^(?:{p[0]})\z")), F.lit(p[1])).otherwise(e), reversed(FORM_TYPES), F.lit("OTHER"))
    return F.when(F.coalesce(t, F.lit("")) == "", "UNKNOWN").otherwise(out)


# forms; each gives persons and trades


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _person(name: Column, role: Column, cik: Column) -> Column:
    return F.struct(name.alias("name"), role.alias("role"), cik.cast("string").alias("cik"))


def _one_person(name: Column, role: Column, cik: Column) -> Column:
    return F.when(name.isNotNull(), F.array(_person(name, role, cik))).otherwise(_none(_PERSONS))


def _trade(code, date=None, shares=None, price=None, value=None, acquired=None, security=None, after=None) -> Column:
    def as_(c, kind, name):
        return (c if c is not None else F.lit(None)).cast(kind).alias(name)

    return F.struct(
        as_(code, "string", "code"), as_(date, "string", "date"), as_(shares, "double", "shares"), as_(price, "double", "price"), as_(value, "double", "value"),
        as_(acquired, "string", "acquired_disposed"), as_(security, "string", "security"), as_(after, "double", "shares_after"),
    )


def trade_value(shares: Column, price: Column) -> Column:
    """Shares times price in cents, halves up; null where either is missing or 0."""
    return F.when((shares != 0) & (price != 0), F.floor(shares * price * 100 + 0.5) / 100)


def owner_role(x: Column) -> Column:
    parts = F.array_compact(
        F.array(
            F.when(flag(x, "isOfficer"), F.coalesce(decode(tag(x, "officerTitle")), F.lit("Officer"))),
            F.when(flag(x, "isDirector"), F.lit("Director")),
            F.when(flag(x, "isTenPercentOwner"), F.lit("10%+ Owner")),
            F.when(flag(x, "isOther"), decode(tag(x, "otherText"))),
        )
    )
    return F.coalesce(F.nullif(F.array_join(parts, ", "), F.lit("")), F.lit("Insider"))


def insider_persons(xml: Column) -> Column:
    people = F.transform(blocks(xml, "reportingOwner"), lambda x: _person(decode(tag(x, "rptOwnerName")), owner_role(x), tag(x, "rptOwnerCik")))
    return F.filter(people, lambda p: p["name"].isNotNull())


def insider_trades(xml: Column) -> Column:
    """Transactions of forms 3, 4 and 5, derivative ones behind."""
    def one(x):
        s, p = number(x, "transactionShares"), number(x, "transactionPricePerShare")
        return _trade(tag(x, "transactionCode"), tag(x, "transactionDate"), s, p, trade_value(s, p), tag(x, "transactionAcquiredDisposedCode"), tag(x, "securityTitle"), number(x, "sharesOwnedFollowingTransaction"))

    return F.concat(F.transform(blocks(xml, "nonDerivativeTransaction"), one), F.transform(blocks(xml, "derivativeTransaction"), one))


def insider_holdings(xml: Column) -> Column:
    def one(x):
        return F.struct(tag(x, "securityTitle").alias("security"), number(x, "sharesOwnedFollowingTransaction").alias("shares"), tag(x, "directOrIndirectOwnership").alias("ownership"))

    return F.concat(F.transform(blocks(xml, "nonDerivativeHolding"), one), F.transform(blocks(xml, "derivativeHolding"), one))


def footnotes(xml: Column) -> Column:
    found = F.regexp_extract_all(xml, F.lit(r'(?s)<footnote\s+id="F\d+">.*?</footnote>'), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r'id="(F\d+)"', 1).alias("id"), decode(F.trim(F.regexp_extract(x, r"(?s)>(.*)</footnote>", 1))).alias("text")))


def trade_alerts(trades: Column, planned: Column) -> Column:
    """What the trades of one filing show: gifts, an exercise and sale on one day, large sales, planned
    trades, large purchases, each with its total."""
    def of(code):
        return F.filter(trades, lambda t: t["code"] == code)

    def total(ts):
        return F.aggregate(ts, F.lit(0.0), lambda a, t: a + F.coalesce(t["value"], F.lit(0.0)))

    days = F.array_intersect(F.transform(of("M"), lambda t: t["date"]), F.transform(of("S"), lambda t: t["date"]))
    days = F.filter(days, lambda d: d.isNotNull())
    same = F.filter(of("S"), lambda t: F.array_contains(days, t["date"]))

    def alert(when, kind, amount):
        return F.when(when, F.struct(F.lit(kind).alias("type"), amount.alias("total")))

    return F.array_compact(
        F.array(
            alert(F.size(of("G")) > 0, "gift", total(of("G"))),
            alert(F.size(days) > 0, "same_day_sale", total(same)),
            alert(total(of("S")) > 100_000, "large_sale", total(of("S"))),
            alert(planned, "planned_trading", F.lit(0.0)),
            alert(total(of("P")) > 100_000, "large_purchase", total(of("P"))),
        )
    )


def form_144(content: Column, h: Column) -> tuple[Column, Column]:
    x, t = embedded_xml(content), strip_html(embedded_html(content))
    name = F.coalesce(decode(tag(x, "entityName")), decode(tag(x, "nameOfReportingPerson")), h["owner"]["name"], _found(t, r"Name of Person[^:]*:\s*([A-Z][A-Za-z\s,.'-]+)"))
    value = F.coalesce(number(x, "aggregateMarketValue"), F.replace(_found(t, r"Aggregate Market Value[^:]*:\s*\$?([\d,]+\.?\d*)"), F.lit(","), F.lit("")).try_cast("double"))
    shares = F.coalesce(number(x, "amountOfSecurities"), number(x, "numberOfShares"))
    day = F.coalesce(tag(x, "approximateDateOfSale"), _found(t, r"Approximate Date of Sale[^:]*:\s*(\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2})"))
    trades = F.when(value.isNotNull() | shares.isNotNull(), F.array(_trade(F.lit("144_NOTICE"), day, shares, None, value))).otherwise(_none(_TRADES))
    return _one_person(name, F.lit("Restricted Securities Holder"), h["owner"]["cik"]), trades


def form_d(content: Column, h: Column) -> tuple[Column, Column]:
    x = embedded_xml(content)

    def one(p):
        own, rel = F.regexp_extract(p, r"(?s)<relatedPersonName>(.*?)</relatedPersonName>", 1), F.regexp_extract(p, r"(?s)<relatedPersonRelationshipList>(.*?)</relatedPersonRelationshipList>", 1)
        roles = F.array_compact(F.array(*[F.when(F.regexp_like(rel, F.lit(f"(?i){w.split()[0]}")), F.lit(w)) for w in ("Executive Officer", "Director", "Promoter")]))
        name = F.nullif(F.concat_ws(" ", tag(own, "firstName"), tag(own, "lastName")), F.lit(""))
        return _person(name, F.coalesce(F.nullif(F.array_join(roles, ", "), F.lit("")), F.lit("Related Person")), F.lit(None))

    people = F.filter(F.transform(blocks(x, "relatedPersonInfo"), one), lambda p: p["name"].isNotNull())
    amount = F.coalesce(number(x, "totalOfferingAmount"), number(x, "totalAmountSold"))
    trades = F.when(amount != 0, F.array(_trade(F.lit("FORM_D"), F.coalesce(tag(x, "dateOfFirstSale"), h["filed_date"]), None, None, amount))).otherwise(_none(_TRADES))
    return people, trades


# Items of current reports, by the first 20 letters of their titles, then by words of them; the first that fits.
ITEM_CLASSES = [
    ("entry into a material definitive agreement", "1.01", "AGREEMENT"),
    ("completion of acquisition or disposition of assets", "2.01", "M&A"),
    ("results of operations and financial condition", "2.02", "EARNINGS"),
    ("creation of a direct financial obligation", "2.03", "DEBT"),
    ("departure of directors or certain officers", "5.02", "PERSONNEL"),
    ("election of directors", "5.02", "PERSONNEL"),
    ("appointment of certain officers", "5.02", "PERSONNEL"),
    ("amendments to articles of incorporation or bylaws", "5.03", "GOVERNANCE"),
    ("submission of matters to a vote of security holders", "5.07", "GOVERNANCE"),
    ("regulation fd disclosure", "7.01", "DISCLOSURE"),
    ("other events", "8.01", "OTHER"),
    ("financial statements and exhibits", "9.01", "EXHIBITS"),
    ("departure", "5.02", "PERSONNEL"),
    ("appointment", "5.02", "PERSONNEL"),
    ("election", "5.02", "PERSONNEL"),
    ("officer", "5.02", "PERSONNEL"),
    ("director", "5.02", "PERSONNEL"),
    ("acquisition", "2.01", "M&A"),
    ("merger", "2.01", "M&A"),
    ("disposition", "2.01", "M&A"),
    ("financial condition", "2.02", "EARNINGS"),
]


def item_class(text: Column) -> Column:
    t = F.lower(F.trim(text))
    none = F.struct(F.lit(None).cast("string").alias("code"), F.lit("OTHER").alias("category"))
    return reduce(lambda e, k: F.when(F.contains(t, F.lit(k[0][:20])), F.struct(F.lit(k[1]).alias("code"), F.lit(k[2]).alias("category"))).otherwise(e), reversed(ITEM_CLASSES), none)


# A person in running text: two to four capitalised words, of which the middle ones may be initials.
_GIVEN = r"\p{Lu}\p{Ll}[\p{L}'’-]*"
_PERSON = rf"{_GIVEN}(?: (?:\p{{Lu}}\.|{_GIVEN})){{0,2}} \p{{Lu}}[\p{{L}}'’-]+(?:,? (?:Jr|Sr|II|III|IV)\b\.?)?"
_RANK = r"(?:[A-Z][\w&-]*(?:,? (?:and|of|for|&))? ){0,6}(?:Officer|President|Director|Chair\w*|Treasurer|Secretary|Counsel|Controller|CEO|CFO|COO|CTO)"


def mined(text: Column, pattern: str, name: int, role: int | None, what: str) -> Column:
    """array<struct<name, role>> of what a pattern finds: its group `name` and, with `role`, the title that
    stands there; else what the sentence says."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    title = lambda x: F.nullif(F.trim(F.regexp_extract(x, pattern, role)), F.lit("")) if role else F.lit(None).cast("string")
    return F.transform(whole, lambda x: F.struct(F.trim(F.regexp_extract(x, pattern, name)).alias("name"), F.coalesce(title(x), F.lit(what)).alias("role")))


def distinct_people(found: Column) -> Column:
    """People by name, each with the role of its first mention."""
    names = F.array_distinct(F.transform(found, lambda x: x["name"]))
    return F.transform(names, lambda n: _person(n, F.element_at(F.filter(found, lambda x: x["name"] == n), 1)["role"], F.lit(None)))


def form_8k(content: Column, h: Column) -> tuple[Column, Column]:
    """Who came and who left, with the title where the sentence has it."""
    text = strip_html(embedded_html(content))
    personnel = F.exists(h["items"], lambda i: item_class(i)["category"] == "PERSONNEL")
    found = F.concat(
        mined(text, rf"(?:appoint|elect|nam|promot|hir)ed ({_PERSON})(?: (?:as|to serve as|to be|to the position of))? ?(?:its |our |the |an? )?({_RANK})?", 1, 2, "Appointed"),
        mined(text, rf"({_PERSON})(?:, (?:its |our |the )?({_RANK}),)? (?:has |will |has been |was )?(?:appointed|elected|join(?:s|ed)?|succeeds?)", 1, 2, "Appointed"),
        mined(text, rf"({_PERSON})(?:, (?:its |our |the )?({_RANK}),)? (?:has |will |notified [^.]{{0,60}} )?(?:resign|retire|depart|step)", 1, 2, "Departed"),
        mined(text, rf"(?:resignation|retirement|departure|termination) of ({_PERSON})(?:,? (?:as )?(?:its |our |the )?({_RANK}))?", 1, 2, "Departed"),
    )
    return F.when(personnel, distinct_people(found)).otherwise(_none(_PERSONS)), _none(_TRADES)


def schedule_13(content: Column, h: Column) -> tuple[Column, Column]:
    text = strip_html(embedded_html(content))
    percent = _found(text, r"(\d{1,3}(?:\.\d+)?)\s*%").try_cast("double")
    shares = F.replace(_found(text, r"(?i)(\d{1,3}(?:,\d{3})+|\d+)\s*shares"), F.lit(","), F.lit("")).try_cast("double")
    active = F.contains(h["form_type"], F.lit("13D"))
    who = F.coalesce(h["filed_by"]["name"], h["owner"]["name"], h["filer"]["name"])
    people = _one_person(who, F.when(active, "5%+ Active Investor").otherwise("5%+ Passive Investor"), F.coalesce(h["filed_by"]["cik"], h["owner"]["cik"], h["filer"]["cik"]))
    trade = _trade(F.when(active, F.lit("SC13D")).otherwise(F.lit("SC13G")), h["filed_date"], shares, None, None, None, F.when(percent.between(1, 100), F.concat(percent.cast("string"), F.lit("%"))))
    return people, F.array(trade)


def holdings_13f(content: Column) -> Column:
    """struct<total_value, holdings_count, top>: of the table if there is one, else of the cover page."""
    sections = F.coalesce(F.regexp_extract_all(content, F.lit(r"(?s)<XML>(.*?)</XML>"), F.lit(1)), F.array().cast("array<string>"))
    rows = F.flatten(F.transform(sections, lambda s: blocks(s, "infoTable")))

    def one(x):
        # the sort key is first: by value, then issuer
        return F.struct((-F.coalesce(number(x, "value"), F.lit(0.0))).alias("order"), decode(tag(x, "nameOfIssuer")).alias("issuer"), (number(x, "value") * 1000).alias("value"), number(x, "sshPrnamt").alias("shares"))

    table = F.transform(rows, one)
    cover = F.get(F.filter(sections, lambda s: tag(s, "formType") == "13F-HR"), F.lit(0))
    total = F.aggregate(table, F.lit(0.0), lambda a, r: a + F.coalesce(r["value"], F.lit(0.0)))
    return F.struct(
        F.when(F.size(table) > 0, total).otherwise(number(cover, "tableValueTotal")).alias("total_value"),
        F.when(F.size(table) > 0, F.size(table)).otherwise(number(cover, "tableEntryTotal").cast("int")).alias("holdings_count"),
        F.transform(F.slice(F.array_sort(table), 1, 10), lambda r: F.struct(r["issuer"].alias("issuer"), r["value"].alias("value"), r["shares"].alias("shares"))).alias("top"),
    )


def form_13f(content: Column, h: Column) -> tuple[Column, Column]:
    total = holdings_13f(content)["total_value"]
    trades = F.when(total != 0, F.array(_trade(F.lit("13F"), F.coalesce(h["period_of_report"], h["filed_date"]), None, None, total))).otherwise(_none(_TRADES))
    return _one_person(h["filer"]["name"], F.lit("Institutional Investment Manager"), h["filer"]["cik"]), trades


_SCHOOL = r"(?:\p{Lu}[\p{L}.'’&-]+ (?:of |the |and )*){0,5}(?:University|College|Institute|School|Academy)(?: (?:of|at) (?:\p{Lu}[\p{L}-]+ ?){1,3})?"


def proxy_statement(content: Column, h: Column) -> tuple[Column, Column]:
    """Officers with the title that follows their name, or stands before it, then directors."""
    text = strip_html(embedded_html(content))
    found = F.concat(
        mined(text, rf"({_PERSON})(?:, age \d+)?,? (?:has served as |serves as |is )?(?:our |the )?({_RANK})", 1, 2, "Director"),
        mined(text, rf"(?:our |the )?({_RANK}),? ({_PERSON})", 2, 1, "Director"),
        mined(text, rf"({_PERSON})(?:, age \d+,?)? (?:has been|was elected|is) (?:a |an )?(?:independent |lead )?(?:member of (?:our|the) [Bb]oard|director)", 1, None, "Director"),
    )
    return distinct_people(found), _none(_TRADES)


def schools(content: Column) -> Column:
    """Schools that a proxy statement says people come from, each once."""
    text = strip_html(embedded_html(content))
    found = F.concat(
        *[
            F.regexp_extract_all(text, F.lit(p), F.lit(1))
            for p in (rf"(?:degree|diploma|doctorate|[BMJ]\.?[ABDS]\.?|M\.?B\.?A\.?|Ph\.?D\.?)[^.]{{0,60}}? (?:from|at) (?:the )?({_SCHOOL})", rf"(?:graduate[ds]?|alumn\w+|attended|studied)(?: (?:of|from|at))? (?:the )?({_SCHOOL})")
        ]
    )
    return F.array_distinct(F.transform(found, lambda x: F.trim(x)))


def parse_filings(filings: DataFrame) -> DataFrame:
    """filings(filename, content) -> one row per filing with its header, form class, issuer, persons and
    trades. Each row takes only its own form's branch. parse_error says why a form's reader had nothing;
    such a filing is read by its header's parties, as one of an unknown form is."""
    base = filings.select("filename", "content", header(F.col("content")).alias("h")).withColumn("form_class", form_class(F.col("h.form_type")))
    c, h, x = F.col("content"), F.col("h"), embedded_xml(F.col("content"))
    by_form = {
        "FORM4 FORM3 FORM5": (insider_persons(x), insider_trades(x)),
        "FORM144": form_144(c, h),
        "FORMD": form_d(c, h),
        "8K": form_8k(c, h),
        "SC13D SC13G": schedule_13(c, h),
        "13FHR 13FNT": form_13f(c, h),
        "DEF14A DEFA14A DEFC14A DEFM14A PRE14A PREM14A": proxy_statement(c, h),
    }
    persons, trades = _none(_PERSONS), _none(_TRADES)
    readers = [f for forms in by_form for f in forms.split()]
    for forms, (p, t) in by_form.items():
        own = F.col("form_class").isin(forms.split())
        persons, trades = F.when(own, p.cast(_PERSONS)).otherwise(persons), F.when(own, t.cast(_TRADES)).otherwise(trades)
    # a filing that its form's reader gives nothing for is read like one of no known form: by its parties
    missing_xml = F.col("form_class").isin("FORM4", "FORM3", "FORM5", "FORMD") & ~F.contains(c, F.lit("<XML>"))
    error = (
        F.when(h["form_type"].isNull(), "no header")
        .when(missing_xml, "no structured part")
        .when(F.col("form_class").isin(readers) & (F.size(persons) == 0) & ~F.col("form_class").isin("8K"), "nobody found")
    )
    party = F.coalesce(h["owner"]["name"], h["filed_by"]["name"])
    persons = F.when(error.isNotNull() & (F.size(F.coalesce(persons, _none(_PERSONS))) == 0), _one_person(party, F.lit("Filing party"), F.coalesce(h["owner"]["cik"], h["filed_by"]["cik"]))).otherwise(persons)
    issuer = F.coalesce(decode(tag(x, "issuerName")), F.col("h.issuer.name"), F.col("h.subject.name"), F.col("h.filer.name"))
    return base.select(
        "filename", F.col("h.accession_number").alias("accession_number"), F.col("h.form_type").alias("form_type"), "form_class", F.col("h.filed_date").alias("filed_date"),
        issuer.alias("issuer"), F.coalesce(persons, _none(_PERSONS)).alias("persons"), F.coalesce(trades, _none(_TRADES)).alias("trades"), flag(x, "aff10b5One").alias("planned"), error.alias("parse_error"),
        F.when(F.contains(F.col("form_class"), F.lit("14A")), schools(c)).otherwise(F.array().cast("array<string>")).alias("schools"), "content",
    )


def read_filings(spark, path: str) -> DataFrame:
    """Whole files of a folder as (filename, content)."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("filename"), F.col("value").alias("content"))
