"""JSON sources: lobbying reports and registrations, campaign records of the web service, properties,
staged contributions. Schemas are given; malformed rows land in `_corrupt`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsieve.functions.fields import normalize_address, parse_date, safe_number, strip_legal_suffixes
from kinsieve.functions.names import classify_owner, full_name, parse_owners, parse_person_name

_LOBBYIST = "id:bigint,prefix:string,first_name:string,nickname:string,middle_name:string,last_name:string,suffix:string"
_REGISTRANT = "id:bigint,name:string,city:string,state:string,zip:string,url:string"
LOBBY_REPORT = (
    f"filing_uuid string, filing_year int, dt_posted string, filing_type string, filer_type string, filing_document_url string, registrant struct<{_REGISTRANT}>, lobbyist struct<{_LOBBYIST}>, "
    "city string, state string, zip string, contribution_items array<struct<contributor_name:string,payee_name:string,honoree_name:string,amount:string,date:string,contribution_type:string>>"
)
LOBBY_REGISTRATION = f"id bigint, first_name string, nickname string, middle_name string, last_name string, suffix string, registrant struct<{_REGISTRANT}>"


def _lobbyist_name(p: Column) -> Column:
    return F.nullif(full_name(p["first_name"], p["nickname"], p["middle_name"], p["last_name"], p["suffix"]), F.lit(""))


def _named(c: Column) -> list[Column]:
    return [c["normalized"].alias("donor_name_normalized"), c["normalized_full"].alias("donor_name_normalized_full")]


def lobby_contributions(reports: DataFrame) -> DataFrame:
    """A row per contribution item whose contributor, else lobbyist, is a person; ids are uuid:index."""
    r = reports.select("*", F.posexplode("contribution_items").alias("at", "item"))
    typed, fallback = F.nullif(F.trim("item.contributor_name"), F.lit("")), _lobbyist_name(F.col("lobbyist"))
    own, other = parse_person_name(typed), parse_person_name(fallback)
    out = r.withColumn("own", own).withColumn("person", F.coalesce(F.when(typed.isNotNull(), F.col("own")), other)).where("person is not null")
    amount = safe_number(F.col("item.amount"))
    return out.select(
        F.lit("Lobbying").alias("source"), F.lit("contribution").alias("signal_type"), F.concat_ws(":", "filing_uuid", F.col("at").cast("string")).alias("source_record_id"),
        F.when(F.col("own").isNotNull() & typed.isNotNull(), typed).otherwise(fallback).alias("donor_name_raw"), *_named(F.col("person")),
        F.col("registrant.name").alias("employer_raw"), strip_legal_suffixes(F.col("registrant.name")).alias("employer_normalized"), F.lit("LOBBYIST").alias("occupation_raw"),
        F.coalesce("city", "registrant.city").alias("city"), F.coalesce("state", "registrant.state").alias("state"), F.coalesce("zip", "registrant.zip").alias("zip"),
        parse_date(F.col("item.date")).alias("donation_date"), F.try_to_timestamp("dt_posted").alias("posted_at"), amount.alias("amount"), (amount < 0).alias("refund_flag"), F.col("item.payee_name").alias("recipient_name"),
        F.col("item.honoree_name").alias("honoree_name"), F.when(F.col("own").isNotNull() & typed.isNotNull(), "contributor").otherwise("lobbyist").alias("identity_source"),
    )


def lobby_registrations(snapshot: DataFrame) -> DataFrame:
    """A row per registered lobbyist, amount 0."""
    name = full_name(F.col("first_name"), F.col("nickname"), F.col("middle_name"), F.col("last_name"), F.col("suffix"))
    out = snapshot.withColumn("raw", name).withColumn("person", parse_person_name(F.col("raw"))).where("person is not null")
    return out.select(
        F.lit("Lobbying").alias("source"), F.lit("registration").alias("signal_type"), F.concat_ws(":", F.lit("registration"), F.col("id").cast("string"), F.col("registrant.id").cast("string")).alias("source_record_id"),
        F.col("raw").alias("donor_name_raw"), *_named(F.col("person")), F.col("registrant.name").alias("employer_raw"), F.lit("LOBBYIST").alias("occupation_raw"),
        F.col("registrant.city").alias("city"), F.col("registrant.state").alias("state"), F.col("registrant.zip").alias("zip"), F.lit(0.0).alias("amount"), F.col("registrant.name").alias("recipient_name"),
    )


CAMPAIGN_RECORD = (
    "transaction_id string, sub_id string, file_number bigint, entity_type string, contributor_name string, contributor_employer string, contributor_occupation string, contributor_city string, "
    "contributor_state string, contributor_zip string, contribution_receipt_date string, load_date string, contribution_receipt_amount double, memo_code string, amendment_indicator string, committee_id string, candidate_id string"
)


def campaign_records(records: DataFrame) -> DataFrame:
    """Records of the campaign web service in the common shape; unparseable names are left out."""
    out = records.withColumn("person", parse_person_name(F.col("contributor_name"))).where("person is not null")
    return out.select(
        F.lit("FEC").alias("source"), F.lit("contribution").alias("signal_type"), F.coalesce("sub_id", "transaction_id").alias("source_record_id"), F.col("contributor_name").alias("donor_name_raw"), *_named(F.col("person")),
        F.col("contributor_employer").alias("employer_raw"), strip_legal_suffixes(F.col("contributor_employer")).alias("employer_normalized"), F.col("contributor_occupation").alias("occupation_raw"),
        F.col("contributor_city").alias("city"), F.col("contributor_state").alias("state"), F.col("contributor_zip").alias("zip"), parse_date(F.col("contribution_receipt_date")).alias("donation_date"),
        F.col("contribution_receipt_amount").alias("amount"), (F.col("contribution_receipt_amount") < 0).alias("refund_flag"), (F.coalesce(F.upper("memo_code"), F.lit("")) == "X").alias("memo_flag"),
        (F.col("amendment_indicator") == "A").alias("amendment_flag"), "committee_id", "candidate_id", "file_number", "transaction_id",
    )


_OWNER = "struct<lastname:string,firstnameandmi:string,fullname:string>"
PROPERTY = (
    "identifier struct<attomId:string,Id:string,apn:string,fips:string>, address struct<oneLine:string,line1:string,locality:string,countrySubd:string,postal1:string,fips:string>, "
    "summary struct<proptype:string,propclass:string>, assessment struct<assessed:struct<assdttlvalue:string,assdlandvalue:string>>, avm struct<amount:struct<value:string>>, "
    "sale struct<saleTransDate:string,amount:struct<value:string,saleamt:string>>, mortgage struct<amount:string,lendername:string>, "
    f"owner struct<owner1:{_OWNER},owner2:{_OWNER},owner3:{_OWNER},owner4:{_OWNER},mailingaddressoneline:string,absenteeownerstatus:string>"
)


def properties(payloads: DataFrame) -> DataFrame:
    """Property payloads, one row each: owners of all four slots, mailing and situs address, amounts."""
    slots = F.filter(F.array(*[F.col(f"owner.owner{i}") for i in range(1, 5)]), lambda o: o.isNotNull())

    def typed(o):
        return F.coalesce(F.nullif(F.trim(o["fullname"]), F.lit("")), F.nullif(F.trim(F.concat_ws(" ", o["firstnameandmi"], o["lastname"])), F.lit("")))

    def parsed(o):
        person = parse_person_name(typed(o))
        direct = F.array(F.struct(typed(o).alias("raw"), person.alias("person"), F.lit("direct").alias("extracted_from")))
        return F.when(person.isNotNull(), direct).otherwise(parse_owners(typed(o)))

    raw = F.array_join(F.filter(F.transform(slots, lambda o: F.trim(o["fullname"])), lambda x: x != ""), " | ")
    money = lambda c: F.when(F.trim(F.col(c)) != "", F.regexp_replace(F.col(c), "[$,]", "").try_cast("double"))
    situs, mailing = F.coalesce("address.oneLine", "address.line1"), F.col("owner.mailingaddressoneline")
    return payloads.select(
        F.coalesce("identifier.attomId", "identifier.Id").alias("source_property_id"), F.col("identifier.apn").alias("parcel_id"), F.coalesce("address.fips", "identifier.fips").alias("fips"),
        situs.alias("situs_address"), F.coalesce("address.locality", normalize_address(situs)["city"]).alias("situs_city"), F.coalesce("address.countrySubd", normalize_address(situs)["state"]).alias("situs_state"),
        raw.alias("owner_raw"), classify_owner(raw).alias("owner_kind"), F.flatten(F.transform(slots, parsed)).alias("owners"), mailing.alias("mailing_address"), normalize_address(mailing).alias("mailing"),
        money("assessment.assessed.assdttlvalue").alias("assessed_total"), money("avm.amount.value").alias("estimated_value"), F.col("sale.saleTransDate").alias("last_sale_date"),
        F.coalesce(money("sale.amount.value"), money("sale.amount.saleamt")).alias("last_sale_price"), money("mortgage.amount").alias("mortgage_amount"),
        (F.upper("owner.absenteeownerstatus") == "O").alias("owner_occupied"), (F.upper("owner.absenteeownerstatus") == "A").alias("absentee_owner"),
    )


def property_pages(spark: SparkSession, path: str) -> DataFrame:
    """Cached pages of the property service, its `property` list exploded; a page without is empty."""
    pages = spark.read.schema(f"property array<struct<{PROPERTY.replace(' struct<', ':struct<').replace(', ', ',')}>>").json(path, multiLine=True)
    return properties(pages.select(F.explode("property").alias("p")).select("p.*"))


def read_json(spark: SparkSession, path: str, schema: str, corrupt: bool = True) -> DataFrame:
    """JSON of a given schema, an array or a record per line; broken rows keep their text in _corrupt."""
    s = schema + (", _corrupt string" if corrupt else "")
    return spark.read.schema(s).option("columnNameOfCorruptRecord", "_corrupt").json(path, multiLine=True)


def staged_sources(spark: SparkSession, paths: dict[str, str], schema: str) -> tuple[DataFrame, dict[str, str]]:
    """The union of staged contribution files and each source's state: a missing file degrades the run,
    it does not fail it."""
    jvm, frames, state = spark._jvm, [], {}
    for name, path in paths.items():
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            frames.append(read_json(spark, path, schema, corrupt=False).withColumn("source", F.lit(name)))
            state[name] = "ok"
        else:
            state[name] = "missing"
    out = frames[0] if frames else spark.createDataFrame([], schema + ", source string")
    for f in frames[1:]:
        out = out.unionByName(f)
    return out, state
