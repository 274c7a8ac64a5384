"""Nonprofit tax returns in XML: filing header, donors, officers, related-organisation pay, grants.

The schema is given, never inferred: identifiers and zips keep their zeros and one child reads like
many. The rows of a return become rows by `explode`; duplicates in one filing fold by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinsieve.functions.fields import free_text
from kinsieve.functions.names import try_person


def _fields(*names: str, **nested) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(n, t) for n, t in nested.items()])


_ADDRESS = _fields("AddressLine1Txt", "AddressLine2Txt", "CityNm", "StateAbbreviationCd", "ZIPCd")
_BUSINESS = _fields("BusinessNameLine1Txt", "BusinessNameLine2Txt")
_INDICATORS = ["IndividualTrusteeOrDirectorInd", "HighestCompensatedEmployeeInd", "KeyEmployeeInd", "OfficerInd"]
RETURN = _fields(
    ReturnHeader=_fields("TaxPeriodEndDt", "ReturnTypeCd", Filer=_fields("EIN", BusinessName=_BUSINESS, USAddress=_ADDRESS)),
    ReturnData=_fields(
        IRS990ScheduleB=_fields(
            ContributorInformationGrp=T.ArrayType(_fields("ContributorPersonNm", "PersonContributionInd", "TotalContributionsAmt", ContributorBusinessName=_BUSINESS, ContributorUSAddress=_ADDRESS))
        ),
        IRS990PF=_fields(
            OfficerDirTrstKeyEmplInfoGrp=_fields(OfficerDirTrstKeyEmplGrp=T.ArrayType(_fields("PersonNm", "TitleTxt", "AverageHrsPerWkDevotedToPosRt", "CompensationAmt", USAddress=_ADDRESS))),
            SupplementaryInformationGrp=_fields(
                GrantOrContributionPdDurYrGrp=T.ArrayType(_fields("RecipientPersonNm", "GrantOrContributionPurposeTxt", "Amt", RecipientBusinessName=_BUSINESS, RecipientUSAddress=_ADDRESS))
            ),
        ),
        IRS990=_fields(Form990PartVIISectionAGrp=T.ArrayType(_fields("PersonNm", "TitleTxt", "AverageHoursPerWeekRt", "ReportableCompFromOrgAmt", "OtherCompensationAmt", *_INDICATORS))),
        IRS990ScheduleJ=_fields(
            RltdOrgOfficerTrstKeyEmplGrp=T.ArrayType(_fields("PersonNm", "TitleTxt", "BaseCompensationFilingOrgAmt", "CompensationBasedOnRelatedOrgAmt", "OtherCompensationAmt", *_INDICATORS))
        ),
    ),
)


def read_returns(spark: SparkSession, path: str) -> DataFrame:
    """One row per return; object_id is the file's name without its ending."""
    raw = spark.read.format("xml").option("rowTag", "Return").option("ignoreNamespace", True).schema(RETURN).load(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return raw.withColumn("object_id", F.regexp_replace(F.regexp_replace(name, r"\.xml$", ""), "_public$", ""))


def parse_returns(df: DataFrame, xml: str, object_id: str) -> DataFrame:
    """The same for returns held as text in a column."""
    return df.select(F.from_xml(F.col(xml), RETURN, {"ignoreNamespace": "true"}).alias("r"), F.col(object_id).alias("object_id")).select("r.*", "object_id")


def _text(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def _amount(*cs: Column) -> Column:
    out = F.lit(0.0)
    for c in cs:
        out = out + F.coalesce(F.trim(c).try_cast("double"), F.lit(0.0))
    return out


def filing(r: DataFrame) -> Column:
    h = F.col("ReturnHeader")
    return F.struct(
        h["Filer"]["EIN"].alias("ein"),
        F.nullif(F.concat_ws(" ", h["Filer"]["BusinessName"]["BusinessNameLine1Txt"], h["Filer"]["BusinessName"]["BusinessNameLine2Txt"]), F.lit("")).alias("org_name"),
        h["Filer"]["USAddress"]["CityNm"].alias("org_city"),
        h["Filer"]["USAddress"]["StateAbbreviationCd"].alias("org_state"),
        h["TaxPeriodEndDt"].alias("tax_period_end"),
        F.when(h["ReturnTypeCd"] == "990PF", "990PF").otherwise("990").alias("return_type"),
        F.col("object_id").alias("object_id"),
    )


def classify_role(title: Column, group: Column | None = None) -> Column:
    t = F.upper(_text(title))
    out = F.when(F.contains(t, F.lit("TRUSTEE")), "trustee").when(F.contains(t, F.lit("DIRECTOR")), "director").when(F.contains(t, F.lit("KEY EMP")), "key_employee")
    if group is not None:
        out = out.when(group["IndividualTrusteeOrDirectorInd"] == "X", "director")
        out = out.when((group["HighestCompensatedEmployeeInd"] == "X") | (group["KeyEmployeeInd"] == "X"), "key_employee")
    return out.otherwise("officer")


def _rows(r: DataFrame, entries: Column, source: str, section: str, name, title, role, amount, hours, address) -> DataFrame:
    e = F.col("e")
    rows = r.select(filing(r).alias("filing"), F.posexplode(entries).alias("at", "e"))
    a = address(e) if address else None
    part = lambda f: _text(a[f]) if a is not None else F.lit("")
    street = F.trim(F.concat_ws(" ", F.nullif(part("AddressLine1Txt"), F.lit("")), F.nullif(part("AddressLine2Txt"), F.lit(""))))
    city, state = part("CityNm"), part("StateAbbreviationCd")
    return rows.select(
        F.lit(source).alias("source"), F.lit(section).alias("source_section"), "filing", "at", _text(name(e)).alias("person_name"), try_person(name(e)).alias("person"),
        _text(title(e)).alias("title"), free_text(title(e)).alias("normalized_title"), role(e).alias("role"), amount(e).alias("amount"), hours(e).alias("hours_per_week"),
        street.alias("street"), city.alias("city"), state.alias("state"), part("ZIPCd").alias("zip"),
        F.when((city != "") | (state != ""), "person_address").otherwise("unknown").alias("person_location_source"),
    ).where("person is not null")


def people(r: DataFrame) -> DataFrame:
    """Donors and officers of private foundations, officers and related-organisation pay of others."""
    d = F.col("ReturnData")
    pf, other = r.where("ReturnHeader.ReturnTypeCd = '990PF'"), r.where("coalesce(ReturnHeader.ReturnTypeCd, '') <> '990PF'")
    zero, none = (lambda e: F.lit(0.0)), (lambda e: F.lit(""))
    givers = F.filter(d["IRS990ScheduleB"]["ContributorInformationGrp"], lambda c: c["ContributorBusinessName"].isNull() & (c["PersonContributionInd"] == "X"))
    donors = _rows(pf, givers, "990-PF-DONOR", "schedule_b_contributor", lambda e: e["ContributorPersonNm"], none, lambda e: F.lit("donor"), lambda e: _amount(e["TotalContributionsAmt"]), zero, lambda e: e["ContributorUSAddress"])
    pf_officers = _rows(
        pf, d["IRS990PF"]["OfficerDirTrstKeyEmplInfoGrp"]["OfficerDirTrstKeyEmplGrp"], "990-PF-OFFICER", "pf_officer_info", lambda e: e["PersonNm"], lambda e: e["TitleTxt"],
        lambda e: classify_role(e["TitleTxt"]), lambda e: _amount(e["CompensationAmt"]), lambda e: _amount(e["AverageHrsPerWkDevotedToPosRt"]), lambda e: e["USAddress"],
    )
    part_vii = _rows(
        other, d["IRS990"]["Form990PartVIISectionAGrp"], "990-OFFICER", "part_vii_section_a", lambda e: e["PersonNm"], lambda e: e["TitleTxt"],
        lambda e: classify_role(e["TitleTxt"], e), lambda e: _amount(e["ReportableCompFromOrgAmt"], e["OtherCompensationAmt"]), lambda e: _amount(e["AverageHoursPerWeekRt"]), None,
    )
    related = _rows(
        other, d["IRS990ScheduleJ"]["RltdOrgOfficerTrstKeyEmplGrp"], "990-OFFICER", "schedule_j_related_org", lambda e: e["PersonNm"], lambda e: e["TitleTxt"],
        lambda e: classify_role(e["TitleTxt"], e), lambda e: _amount(e["BaseCompensationFilingOrgAmt"], e["CompensationBasedOnRelatedOrgAmt"], e["OtherCompensationAmt"]), zero, None,
    )
    return donors.unionByName(pf_officers).unionByName(part_vii).unionByName(related)


def collapse(rows: DataFrame) -> DataFrame:
    """One row per filing, source, person, title and amount, the first with a place, and how many."""
    from kinsieve.operators.records import collapse_duplicates

    keyed = rows.withColumn("object_id", F.col("filing.object_id")).withColumn("normalized", F.col("person.normalized"))
    keys = ["object_id", "source", "normalized", "normalized_title", "amount"]
    return collapse_duplicates(keyed, keys, F.col("person_location_source") != "unknown", [F.asc("source_section"), F.asc("at")])


def grants(r: DataFrame) -> DataFrame:
    g = F.col("g")
    rows = r.where("ReturnHeader.ReturnTypeCd = '990PF'").select(
        filing(r).alias("filing"), F.explode(F.col("ReturnData")["IRS990PF"]["SupplementaryInformationGrp"]["GrantOrContributionPdDurYrGrp"]).alias("g")
    )
    name = F.coalesce(F.nullif(_text(g["RecipientBusinessName"]["BusinessNameLine1Txt"]), F.lit("")), F.nullif(_text(g["RecipientPersonNm"]), F.lit("")))
    return rows.select(
        "filing", name.alias("recipient_name"), _text(g["RecipientUSAddress"]["CityNm"]).alias("recipient_city"), _text(g["RecipientUSAddress"]["StateAbbreviationCd"]).alias("recipient_state"),
        _amount(g["Amt"]).alias("amount"), _text(g["GrantOrContributionPurposeTxt"]).alias("purpose"),
    ).where("recipient_name is not null")
