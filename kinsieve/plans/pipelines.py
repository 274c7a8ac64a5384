"""End-to-end plans: from records to matched, described pairs. Decisions about them (tiers, prices,
routes) are their users' business and not part of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsieve.functions import fields as X
from kinsieve.functions import names as N
from kinsieve.operators import records as R
from kinsieve.operators.changes import classify_changes
from kinsieve.session import materialize

PROSPECT = ["prospect_id", "name_raw", "alias_names", "company_raw", "other_companies", "title", "city", "state", "zip"]
PROPERTY_CHANGES = {
    "owner_change": ["owner_fingerprint"],
    "sale_update": ["last_sale_date", "last_sale_price"],
    "refinance": ["mortgage_amount"],
    "assessment_update": ["assessed_total"],
}


def _latest(df: DataFrame, columns: list[str], key: str, version: str) -> DataFrame:
    """The columns of each key's latest version; a list without versions has one row per key."""
    own = [version] if version in df.columns else []
    return R.latest_version(df.select(*columns, *own), key, own).select(*columns)


def match_contributions(prospects: DataFrame, contributions: DataFrame) -> DataFrame:
    """Contributions by the prospects they may be of, a row per pair with the nearest spelling and what
    speaks for it: names, employer, place, occupation, and how many such signals there are.

    Both sides are folded to one row per key first. A popular name is one row until the very last join,
    and names are counted by aggregates.
    """
    p = _latest(prospects, PROSPECT, "prospect_id", "updated_at")
    p = p.withColumn("parsed", N.parse_person_name(F.col("name_raw")))
    c = R.latest_version(
        contributions.select("source_record_id", "load_date", "donor_name_raw", "employer_raw", "occupation_raw", F.col("city").alias("c_city"), F.col("state").alias("c_state"), F.col("zip").alias("c_zip"), "amount", "donation_date", "committee_id"),
        "source_record_id",
        ["load_date"],
    )
    # Names are parsed, counted and looked up once each, however many records bear them; the records join
    # the few names that somebody in the index bears.
    names = materialize(c.where("donor_name_raw is not null").groupBy("donor_name_raw").agg(F.count("*").alias("rows")).withColumn("donor", N.parse_person_name(F.col("donor_name_raw"))).where("donor is not null").withColumn("block_key", F.col("donor.normalized")), "names")
    index = R.variant_index(p, "prospect_id", "name_raw", "alias_names")
    hits = R.block_join(names.select("block_key").distinct(), "block_key", index).withColumnRenamed("person_id", "prospect_id")
    hits = R.keep_best(hits, ["block_key", "prospect_id"], [N.variant_priority(F.col("variant_type")).desc(), F.col("variant_type")])
    counts = names.groupBy("block_key").agg(F.sum("rows").alias("donor_name_count"))
    named = names.drop("rows").join(hits.join(counts, "block_key"), "block_key")
    j = named.join(c, "donor_name_raw").join(p, "prospect_id")
    companies = F.concat(F.array("company_raw"), F.coalesce("other_companies", F.array().cast("array<string>")))
    employer = F.coalesce(X.best_employer(companies, F.col("employer_raw"))["status"], F.lit("missing"))
    place = X.location_status(F.col("city"), F.col("state"), F.col("zip"), F.col("c_city"), F.col("c_state"), F.col("c_zip"))
    trade = X.occupation_class(F.col("occupation_raw"))
    same_trade = F.exists(F.filter(companies, lambda x: X.text(x) != ""), lambda x: X.company_class(x) == trade)
    d, q = F.col("donor"), F.col("parsed")

    def agree(f):
        return (d[f] != "") & (q[f] != "") & (d[f] == q[f])

    out = j.select(
        "prospect_id", "source_record_id", "variant_type", "amount", "donation_date", "committee_id", "donor_name_count",
        F.coalesce(d["normalized_full"] == q["normalized_full"], F.lit(False)).alias("exact_full_name"),
        F.coalesce(d["normalized"] == q["normalized"], F.lit(False)).alias("exact_first_last"),
        employer.alias("employer_status"), place.alias("location_status"), F.coalesce(same_trade, F.lit(False)).alias("occupation_agrees"),
        F.coalesce(agree("middle_initial"), F.lit(False)).alias("middle_agrees"), F.coalesce(agree("suffix"), F.lit(False)).alias("suffix_agrees"),
    )
    signals = [F.col("employer_status").isin("confirmed", "likely"), F.col("location_status").isin("zip_match", "city_state_match"), F.col("occupation_agrees"), F.col("middle_agrees"), F.col("suffix_agrees")]
    return out.withColumn("identity_signals", sum((s.cast("int") for s in signals[1:]), signals[0].cast("int")))


def match_nonprofit(prospects: DataFrame, people: DataFrame) -> DataFrame:
    """Officers and donors of nonprofits by prospects: spelling, agreement of employer and organisation,
    of places, foundation names, filing history and name frequency."""
    p = _latest(prospects, PROSPECT, "prospect_id", "updated_at")
    loaded = F.col("loaded_at") if "loaded_at" in people.columns else F.lit(0)
    n = people.where("person_name_normalized <> ''").select(
        "nonprofit_id", loaded.alias("loaded_at"), F.col("person_name_normalized").alias("block_key"), "last_name", "title", "role", "amount", F.col("filing.ein").alias("ein"), F.col("filing.org_name").alias("org_name"),
        F.col("filing.tax_period_end").alias("period"), F.col("city").alias("n_city"), F.col("state").alias("n_state"), F.col("zip").alias("n_zip"),
    )
    n = R.latest_version(n, "nonprofit_id", ["loaded_at"])
    n = R.with_frequency(n, "block_key", "name_count").join(R.distinct_periods(n, ["ein", "block_key"], "period", "n_periods"), ["ein", "block_key"], "left")
    hits = R.block_join(n.select("nonprofit_id", "block_key"), "block_key", R.variant_index(p, "prospect_id", "name_raw", "alias_names"))
    hits = R.best_variant(hits.select("nonprofit_id", "person_id", "variant_type"), "nonprofit_id").withColumnRenamed("person_id", "prospect_id")
    j = hits.join(n, "nonprofit_id").join(p.withColumnRenamed("title", "p_title"), "prospect_id")
    return j.select(
        "prospect_id", "nonprofit_id", "variant_type", "ein", "amount", "name_count", "n_periods", X.title_class(F.col("title"), F.col("role")).alias("title_class"),
        X.org_agreement(F.col("company_raw"), F.col("org_name")).alias("org_agreement"), X.names_family_foundation(F.col("last_name"), F.col("org_name")).alias("family_foundation"),
        X.location_status(F.col("city"), F.col("state"), F.col("zip"), F.col("n_city"), F.col("n_state"), F.col("n_zip")).alias("location_status"),
    )


def monitor_properties(current: DataFrame, prior: DataFrame, prospects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, matches): how each property changed since its prior state, and the prospects whose names
    its owners bear. current: json_records.properties; prior: the same fields as last seen."""
    owners = F.transform("owners", lambda o: o["person"]["normalized"])
    c = current.withColumn("owner_fingerprint", X.owner_fingerprint(F.when(F.size(owners) > 0, owners).otherwise(F.array("owner_raw"))))
    changes = classify_changes(c, prior, "source_property_id", PROPERTY_CHANGES)
    keys = changes.select("source_property_id", "change_type", F.explode("owners").alias("o")).select("source_property_id", "change_type", F.col("o.raw").alias("owner"), "o.extracted_from")
    spelled = keys.select("source_property_id", "change_type", "extracted_from", F.explode(N.name_variants(F.col("owner"))["value"]).alias("block_key")).distinct()
    hits = R.block_join(spelled, "block_key", R.variant_index(prospects, "prospect_id", "name_raw", "alias_names"))
    best = R.keep_best(hits, ["source_property_id", "person_id"], [N.variant_priority(F.col("variant_type")).desc(), F.asc("block_key"), F.asc("extracted_from")])
    return changes, best.select("source_property_id", F.col("person_id").alias("prospect_id"), "change_type", "extracted_from", "variant_type")


def match_filings(filings: DataFrame, prospects: DataFrame) -> DataFrame:
    """Prospects named in filings: in the structured part, else in the text. filings: edgar.parse_filings."""
    from kinsieve.operators.textsearch import joined_evidence, search
    from kinsieve.sources.edgar import raw_text

    index = R.variant_index(prospects, "prospect_id", "name_raw", "alias_names")
    named = filings.select("filename", F.explode("persons").alias("p")).select("filename", F.lower(N.collapse_ws(F.replace("p.name", F.lit(","), F.lit("")))).alias("n"), F.col("p.role").alias("role"))
    # insiders are filed last name first
    keyed = named.select("filename", "role", F.explode(F.array("n", F.concat_ws(" ", F.regexp_replace("n", r"^\S+\s+", ""), F.substring_index("n", " ", 1)))).alias("block_key")).distinct()
    structured = R.block_join(keyed, "block_key", index).select("filename", F.col("person_id").alias("prospect_id"), "role", F.lit("structured").alias("method")).distinct()
    texts = filings.select("filename", raw_text(F.col("content")).alias("text"))
    found = search(texts, "filename", "text", index, "block_key").join(index.select("person_id", F.col("block_key").alias("pattern")).distinct(), "pattern")
    textual = found.groupBy(F.col("text_id").alias("filename"), F.col("person_id").alias("prospect_id")).agg(F.count("*").alias("mentions")).withColumn("method", F.lit("text"))
    return joined_evidence(structured, textual, ["filename", "prospect_id"])
