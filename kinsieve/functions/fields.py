"""Employers, places, addresses, titles, dates and money as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinsieve.functions.names import collapse_ws
from kinsieve.functions.rules import (
    COMPANY_CLASSES,
    FOUNDATION_WORDS,
    LEGAL_SUFFIXES,
    NON_INFORMATIVE_EMPLOYERS,
    NON_INFORMATIVE_OCCUPATIONS,
    OCCUPATION_CLASSES,
    STATES,
    TITLE_CLASSES,
)


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


# employers


def strip_legal_suffixes(c: Column) -> Column:
    bare = F.regexp_replace(text(c), rf"(?i)\b({LEGAL_SUFFIXES})\b", "")
    return F.lower(collapse_ws(F.regexp_replace(bare, "[.,]", "")))


def employer_status(prospect: Column, donor: Column) -> Column:
    """How two typed employers relate: missing, non_informative, confirmed, likely, weak_overlap, mismatch."""
    p, d = strip_legal_suffixes(prospect), strip_legal_suffixes(donor)
    return (
        F.when(d == "", "missing")
        .when(d.isin(NON_INFORMATIVE_EMPLOYERS), "non_informative")
        .when(p == "", "missing")
        .when(p == d, "confirmed")
        .when(F.contains(p, d) | F.contains(d, p), "likely")
        .when(F.substring_index(p, " ", 1) == F.substring_index(d, " ", 1), "weak_overlap")
        .otherwise("mismatch")
    )


EMPLOYER_ORDER = ["mismatch", "missing", "non_informative", "weak_overlap", "likely", "confirmed"]


def best_employer(companies: Column, donor: Column) -> Column:
    """struct<rank, at, company, status>: the company of a list that agrees best, the first of equals."""
    def one(c, i):
        s = employer_status(c, donor)
        rank = reduce(lambda e, k: F.when(s == k[1], k[0]).otherwise(e), enumerate(EMPLOYER_ORDER), F.lit(-1))
        return F.struct(rank.alias("rank"), (-i).alias("at"), c.alias("company"), s.alias("status"))

    return F.array_max(F.transform(F.filter(companies, lambda c: text(c) != ""), one))


# places


def normalize_state(c: Column) -> Column:
    table = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in STATES.items()) + ")")
    t = F.trim(text(c))
    return F.coalesce(F.try_element_at(table, F.lower(t)), F.upper(t))


def normalize_city(c: Column) -> Column:
    return collapse_ws(F.regexp_replace(F.upper(text(c)), r"[^A-Z\s]", ""))


def normalize_zip5(c: Column) -> Column:
    d = F.regexp_replace(text(c), r"\D", "")
    return F.when(F.length(d) < 5, "").otherwise(F.substring(d, 1, 5))


def location_status(pc: Column, ps: Column, pz: Column, dc: Column, ds: Column, dz: Column) -> Column:
    """How two places agree, the narrowest first: zip, city and state, city where a state is missing, state."""
    c, d, s, t, y, z = normalize_city(pc), normalize_city(dc), normalize_state(ps), normalize_state(ds), normalize_zip5(pz), normalize_zip5(dz)
    city = (c != "") & (c == d)
    return (
        F.when((y != "") & (y == z), "zip_match")
        .when(city & (s != "") & (s == t), "city_state_match")
        .when(city & ((s == "") | (t == "")), "city_match")
        .when((s != "") & (t != ""), F.when(s == t, "state_match").otherwise("state_mismatch"))
        .otherwise("no_data")
    )


def location_support(p_address: Column, pc: Column, ps: Column, pz: Column, street: Column, c: Column, s: Column, z: Column, org_city: Column, org_state: Column) -> Column:
    """How a filed person's place supports a prospect's, in eight levels: the person's own address where
    the filing has its state, else the organisation's."""
    return support_level(prospect_place(p_address, pc, ps, pz), filed_place(street, c, s, z, org_city, org_state))


def prospect_place(address: Column, city: Column, state: Column, zip_code: Column) -> Column:
    """struct<street, city, state, zip>: what location_support compares of a prospect, so that a join of
    many pairs reads each place once; '' where there is none."""
    return F.struct(free_text(address).alias("street"), normalize_city(city).alias("city"), normalize_state(state).alias("state"), normalize_zip5(zip_code).alias("zip"))


def filed_place(street: Column, city: Column, state: Column, zip_code: Column, org_city: Column, org_state: Column) -> Column:
    """The same of a filed person, with the organisation's city and state where the person has no state."""
    own, org = normalize_state(state), normalize_state(org_state)
    place = lambda mine, its: F.when(own != "", mine).otherwise(its)
    return F.struct(
        place(free_text(street), F.lit("")).alias("street"), place(normalize_city(city), normalize_city(org_city)).alias("city"), place(own, org).alias("state"),
        place(normalize_zip5(zip_code), F.lit("")).alias("zip"), (own != "").alias("own"),
    )


def support_level(p: Column, n: Column) -> Column:
    """The level of a prospect's place and a filed one."""

    def same(field: str) -> Column:
        return (p[field] != "") & (p[field] == n[field])

    return (
        F.when((p["state"] == "") | (n["state"] == ""), "unknown")
        .when(p["state"] != n["state"], "mismatch")
        .when(~same("city"), F.when(n["own"], "person_state").otherwise("org_state"))
        .when(~n["own"], "org_city_state")
        .when(same("street"), "person_full_address")
        .when(same("zip"), "person_city_state_zip")
        .otherwise("person_city_state")
    )


# addresses


def prospect_address_like(address: Column, city: Column, state: Column, zip_code: Column) -> Column:
    """The address of a prospect as 'street, city, state zip', with an unknown street where there is none;
    null without city and state."""
    a, c, s, z = text(address), text(city), text(state), text(zip_code)
    tail = F.trim(F.concat(c, F.lit(", "), s, F.lit(" "), z))
    return F.when((a != "") & (c != "") & (s != ""), F.concat(a, F.lit(", "), tail)).when((c != "") | (s != ""), F.concat(F.lit("UNKNOWN, "), tail))


def property_address_like(city: Column, state: Column, zip_code: Column, line: Column) -> Column:
    """The same for a property's site or its owner's mail: city and state if both are there, else the line."""
    c, s = text(city), text(state)
    return F.when((c != "") & (s != ""), F.trim(F.concat(F.lit("UNKNOWN, "), c, F.lit(", "), s, F.lit(" "), text(zip_code)))).otherwise(line)


def _token(c: Column) -> Column:
    return collapse_ws(F.regexp_replace(F.upper(text(c)), "[.,]", ""))


def normalize_address(c: Column) -> Column:
    """struct<line1, city, state, zip, normalized_key> of 'line, city, state zip'; a text of fewer
    segments is all line1; null where there is none."""
    t = F.trim(text(c))
    seg = F.filter(F.transform(F.split(t, ","), lambda x: F.trim(x)), lambda x: x != "")
    region = F.split(F.get(seg, F.lit(2)), r"\s+")
    line, city, state, zip_code = _token(F.get(seg, F.lit(0))), _token(F.get(seg, F.lit(1))), _token(F.get(region, F.lit(0))), F.trim(text(F.get(region, F.lit(1))))
    full = F.struct(
        line.alias("line1"),
        city.alias("city"),
        state.alias("state"),
        zip_code.alias("zip"),
        F.array_join(F.filter(F.array(line, city, state, zip_code), lambda x: x != ""), "|").alias("normalized_key"),
    )
    whole = F.struct(_token(t).alias("line1"), F.lit("").alias("city"), F.lit("").alias("state"), F.lit("").alias("zip"), _token(t).alias("normalized_key"))
    return F.when(t == "", None).when(F.size(seg) >= 3, full).otherwise(whole)


def address_tier(prospect: Column, mailing: Column, situs: Column) -> Column:
    """The narrowest agreement of a typed address with where the owner lives, then with where the
    property lies."""
    p, m, s = normalize_address(prospect), normalize_address(mailing), normalize_address(situs)

    def same(a, b, *fields):
        return reduce(lambda x, y: x & y, [(text(a[f]) != "") & (a[f] == b[f]) for f in fields])

    return (
        F.when(p.isNull(), "mismatch")
        .when(same(p, m, "line1", "normalized_key") & (p["line1"] != "UNKNOWN") | ((p["line1"] != "UNKNOWN") & (p["normalized_key"] == m["normalized_key"])), "mailing_exact")
        .when(same(p, m, "zip"), "mailing_zip")
        .when(same(p, m, "city", "state"), "mailing_city_state")
        .when(same(p, m, "state"), "mailing_state")
        .when(same(p, s, "city", "state"), "situs_city_state")
        .when(same(p, s, "state"), "situs_state")
        .otherwise("mismatch")
    )


# titles, occupations, organisations


def free_text(c: Column) -> Column:
    return collapse_ws(F.regexp_replace(F.replace(F.lower(text(c)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def _first_class(c: Column, classes: list[tuple[str, str]], default: Column) -> Column:
    return reduce(lambda out, k: F.when(F.regexp_like(c, F.lit(k[1])), F.lit(k[0])).otherwise(out), reversed(classes), default)


def title_class(title: Column, role: Column) -> Column:
    words_ = F.trim(F.concat_ws(" ", free_text(title), free_text(role)))
    return F.when(role == "donor", "board_trustee").otherwise(_first_class(words_, TITLE_CLASSES, F.lit("frontline_or_operational")))


def occupation_class(c: Column) -> Column:
    """Null for occupations that say nothing or fit no class. An architect of software is no builder."""
    t = F.lower(F.trim(text(c)))
    classes = _first_class(t, OCCUPATION_CLASSES, F.lit(None).cast("string"))
    return F.when((t != "") & ~t.isin(NON_INFORMATIVE_OCCUPATIONS), classes)


def company_class(c: Column) -> Column:
    t = F.lower(F.trim(text(c)))
    return F.when(t != "", _first_class(t, COMPANY_CLASSES, F.lit(None).cast("string")))


def normalize_org(c: Column) -> Column:
    return free_text(strip_legal_suffixes(c))


def token_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(free_text(c), " "), lambda w: F.length(w) >= 3))


def token_overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(token_set(a), token_set(b)))


def org_agreement(company: Column, org: Column) -> Column:
    """equal, contained, two_tokens, one_token or none."""
    c, o = normalize_org(company), normalize_org(org)
    n = token_overlap(c, o)
    return (
        F.when((c == "") | (o == ""), "none")
        .when(c == o, "equal")
        .when(F.contains(c, o) | F.contains(o, c), "contained")
        .when(n >= 2, "two_tokens")
        .when(n == 1, "one_token")
        .otherwise("none")
    )


def names_family_foundation(last_name: Column, org: Column) -> Column:
    o, z = normalize_org(org), free_text(last_name)
    return F.regexp_like(o, F.lit(FOUNDATION_WORDS)) & (F.length(z) >= 4) & F.contains(o, z)


# dates, money, keys


def parse_date(c: Column) -> Column:
    """A date in any of the forms that the sources use: ISO, slashes, MMDDYYYY, YYYYMMDD; else null."""
    t = F.trim(text(c))
    eight = F.regexp_like(t, F.lit(r"^[0-9]{8}$"))
    return F.coalesce(
        F.when(F.regexp_like(t, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}")), F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd"))),
        F.when(F.regexp_like(t, F.lit(r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$")), F.try_to_timestamp(t, F.lit("yyyy/MM/dd"))),
        F.when(F.regexp_like(t, F.lit(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$")), F.try_to_timestamp(t, F.lit("M/d/yyyy"))),
        F.when(eight & F.regexp_like(t, F.lit(r"^(19|20)")) & F.regexp_like(t, F.lit(r"^....(0[1-9]|1[0-2])")), F.try_to_timestamp(t, F.lit("yyyyMMdd"))),
        F.when(eight, F.try_to_timestamp(t, F.lit("MMddyyyy"))),
    ).cast("date")


def next_day(c: Column) -> Column:
    """The day after a watermark, as the sources ask for it."""
    return F.date_format(F.date_add(c, 1), "yyyy/MM/dd")


def format_currency(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.coalesce(c, F.lit(0.0)), 2))


def safe_number(c: Column) -> Column:
    """A number typed with signs and commas; 0 where there is none."""
    return F.coalesce(F.regexp_replace(text(c), "[$, ]", "").try_cast("double"), F.lit(0.0))


def record_key(*parts: Column) -> Column:
    """Identity fields joined by '|', '-' for a blank one."""
    return F.concat_ws("|", *[F.coalesce(F.nullif(F.trim(p.cast("string")), F.lit("")), F.lit("-")) for p in parts])


def owner_fingerprint(owners: Column) -> Column:
    """Sorted lower-case owner names, joined; the same whatever their order."""
    return F.array_join(F.array_sort(F.filter(F.transform(owners, lambda x: F.lower(x)), lambda x: x != "")), "|")


def receipt_link(source: Column, committee: Column, last_name: Column, day: Column) -> Column:
    """Address of the public search for a contribution: committee, surname and, where known, its day."""
    d = F.date_format(day, "MM/dd/yyyy")
    base = F.concat(F.lit("https://www.fec.gov/data/receipts/individual-contributions/?committee_id="), F.url_encode(committee), F.lit("&contributor_name="), F.url_encode(F.upper(text(last_name))))
    dated = F.concat(base, F.lit("&min_date="), F.url_encode(d), F.lit("&max_date="), F.url_encode(d))
    return F.when((source == "FEC") & (text(committee) != ""), F.coalesce(dated, base)).otherwise("")


def schedule_a_key(line: Column) -> Column:
    """Identity of a section 527 Schedule A line: form, schedule, recipient, donor, amount, day; null for
    other lines and for those of fewer than 17 columns."""
    cells = F.split(line, r"\|", -1)
    cell = lambda i: F.trim(F.get(cells, F.lit(i)))
    day = F.coalesce(F.date_format(parse_date(cell(16)), "yyyy-MM-dd"), F.lit(""))
    return F.when((F.size(cells) >= 17) & (F.get(cells, F.lit(0)) == "A"), F.concat_ws("|", cell(1), cell(2), F.lower(cell(3)), F.lower(cell(5)), cell(13), day))
