"""Queries of the end-to-end plans, with SQL composed of their parts' SQL, and of further operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinsieve.functions import fields as X
from kinsieve.functions import names as N
from kinsieve.functions.rules import COMPANY_CLASSES, FOUNDATION_WORDS, NON_INFORMATIVE_OCCUPATIONS, OCCUPATION_CLASSES, TITLE_CLASSES
from kinsieve.operators import records as R
from kinsieve.plans import pipelines
from kinsieve.plans import sqltext as S
from kinsieve.plans.reference import _ABBREVIATED, _OWNER_KIND, _OWNERS, _PRIORITY, _RANK, _STATUS, _TOKENS, _address_sql, _owners, _variants_sql
from kinsieve.session import table
from kinsieve.sources import fec

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# end-to-end plans

_P = "p as (select * from prospect where prospect_id is not null qualify row_number() over (partition by prospect_id order by updated_at desc nulls last, name_raw desc nulls last) = 1)"
_P_INDEX = "(select distinct prospect_id || chr(1) || n as k, n as v from (select prospect_id, name_raw as n from p union all select prospect_id, unnest(alias_names) as n from p) where trim(n) <> '')"
_COMMON = f"""{_P},
pp as (select * from ({S.parsed("(select prospect_id as k, name_raw as v from p)", True)})),
idx as (select distinct value as block_key, split_part(k, chr(1), 1) as prospect_id, variant_type from ({_variants_sql(_P_INDEX)}) where length(value) >= 4)"""
_GEO_STATUS = f"""case when {S.zip5("p.zip")} <> '' and {S.zip5("p.zip")} = {S.zip5("x.zip")} then 'zip_match'
  when {S.city("p.city")} <> '' and {S.city("p.city")} = {S.city("x.city")} and {S.state("p.state")} <> '' and {S.state("p.state")} = {S.state("x.state")} then 'city_state_match'
  when {S.city("p.city")} <> '' and {S.city("p.city")} = {S.city("x.city")} and ({S.state("p.state")} = '' or {S.state("x.state")} = '') then 'city_match'
  when {S.state("p.state")} <> '' and {S.state("x.state")} <> '' then case when {S.state("p.state")} = {S.state("x.state")} then 'state_match' else 'state_mismatch' end else 'no_data' end"""
_OCC = "lower(trim(coalesce(x.occupation_raw, '')))"
_TRADE = f"case when {_OCC} not in ({S.quoted(NON_INFORMATIVE_OCCUPATIONS)}) and {_OCC} <> '' then {S.classes(_OCC, OCCUPATION_CLASSES, 'null')} end"


@query(
    f"""with {_COMMON},
x as (select * from contribution where source_record_id is not null qualify row_number() over (partition by source_record_id order by load_date desc nulls last, donor_name_raw desc nulls last,
  employer_raw desc nulls last, occupation_raw desc nulls last, city desc nulls last, state desc nulls last, zip desc nulls last, amount desc nulls last, donation_date desc nulls last, committee_id desc nulls last) = 1),
d as (select * from ({S.parsed("(select distinct donor_name_raw as k, donor_name_raw as v from x where donor_name_raw is not null)", True)})),
c as (select normalized, count(*) as n from x join d on x.donor_name_raw = d.k group by 1),
h as (select d.normalized, i.prospect_id, i.variant_type from (select distinct normalized from d) d join idx i on i.block_key = d.normalized qualify row_number() over (partition by d.normalized, i.prospect_id order by {_PRIORITY} desc, variant_type) = 1),
m as (select p.prospect_id, x.source_record_id, h.variant_type, x.amount, x.donation_date, x.committee_id, c.n as donor_name_count, p.company_raw, p.other_companies, x.employer_raw, {_TRADE} as trade, {_GEO_STATUS} as location_status,
  coalesce(d.normalized_full = pp.normalized_full, false) as exact_full_name, coalesce(d.normalized = pp.normalized, false) as exact_first_last,
  coalesce(d.middle_initial <> '' and d.middle_initial = pp.middle_initial, false) as middle_agrees, coalesce(d.suffix <> '' and d.suffix = pp.suffix, false) as suffix_agrees,
  list_filter(list_concat([p.company_raw], coalesce(p.other_companies, [])), lambda z: trim(coalesce(z, '')) <> '') as cs
  from h join d on h.normalized = d.normalized join c on c.normalized = d.normalized join x on x.donor_name_raw = d.k join p on p.prospect_id = h.prospect_id left join pp on pp.k = p.prospect_id),
b as (select prospect_id, source_record_id, status from (select *, {_STATUS} as status from (select *, {S.legal_stripped('company')} as p, {S.legal_stripped('employer_raw')} as d from (select prospect_id, source_record_id, employer_raw, unnest(cs) as company, unnest(range(1, len(cs) + 1)) as i from m)))
  qualify row_number() over (partition by prospect_id, source_record_id order by {_RANK.format('status')} desc, i) = 1),
t as (select prospect_id, source_record_id, bool_or(coalesce({S.classes("lower(trim(z))", COMPANY_CLASSES, "null")} = trade, false)) as agrees from (select prospect_id, source_record_id, trade, unnest(cs) as z from m) group by all)
select prospect_id, source_record_id, variant_type, amount, donation_date, committee_id, cast(donor_name_count as bigint) as donor_name_count, exact_full_name, exact_first_last, coalesce(status, 'missing') as employer_status, location_status,
  coalesce(agrees, false) as occupation_agrees, middle_agrees, suffix_agrees,
  cast((coalesce(status, 'missing') in ('confirmed', 'likely'))::int + (location_status in ('zip_match', 'city_state_match'))::int + coalesce(agrees, false)::int + middle_agrees::int + suffix_agrees::int as integer) as identity_signals
from m left join b using (prospect_id, source_record_id) left join t using (prospect_id, source_record_id)"""
)
def political_pipeline(spark, sf):
    return pipelines.match_contributions(table(spark, sf, "prospect"), table(spark, sf, "contribution"))


_HEAD = f"trim({S.free('x.title')} || ' ' || {S.free('x.role')})"
_C, _O = S.free(S.legal_stripped("p.company_raw")), S.free(S.legal_stripped("x.org_name"))


@query(
    f"""with {_COMMON},
x as (select nonprofit_id, person_name_normalized as block_key, last_name, title, role, amount, filing.ein as ein, filing.org_name as org_name, filing.tax_period_end as period, city, state, zip from nonprofit_record where person_name_normalized <> '' and nonprofit_id is not null
  qualify row_number() over (partition by nonprofit_id order by loaded_at desc nulls last, person_name_normalized desc, last_name desc nulls last, title desc nulls last) = 1),
f as (select block_key, count(*) as n from x group by 1),
y as (select ein, block_key, count(distinct period) as n from x group by all),
h as (select x.nonprofit_id, i.prospect_id, i.variant_type from x join idx i using (block_key) qualify row_number() over (partition by x.nonprofit_id, i.prospect_id order by {_PRIORITY} desc, variant_type) = 1),
m as (select p.prospect_id, x.nonprofit_id, h.variant_type, x.ein, x.amount, f.n as name_count, y.n as n_periods,
  case when x.role = 'donor' then 'board_trustee' else {S.classes(_HEAD, TITLE_CLASSES, "'frontline_or_operational'")} end as title_class, {_C} as co, {_O} as oo, x.last_name, {_GEO_STATUS} as location_status
  from h join x using (nonprofit_id) join p using (prospect_id) join f using (block_key) left join y on y.ein = x.ein and y.block_key = x.block_key)
select prospect_id, nonprofit_id, variant_type, ein, amount, name_count, n_periods, title_class,
  case when co = '' or oo = '' then 'none' when co = oo then 'equal' when contains(co, oo) or contains(oo, co) then 'contained'
    when len(list_intersect({_TOKENS.format('co')}, {_TOKENS.format('oo')})) >= 2 then 'two_tokens' when len(list_intersect({_TOKENS.format('co')}, {_TOKENS.format('oo')})) = 1 then 'one_token' else 'none' end as org_agreement,
  regexp_matches(oo, '{FOUNDATION_WORDS}') and length({S.free('last_name')}) >= 4 and contains(oo, {S.free('last_name')}) as family_foundation, location_status from m"""
)
def nonprofit_pipeline(spark, sf):
    return pipelines.match_nonprofit(table(spark, sf, "prospect"), table(spark, sf, "nonprofit_record"))


# owners and addresses

_LAST_FIRST = "array_to_string(list_concat(w[2:], w[1:1]), ' ')"
_OWNER_TEXT = f"(select v, c, {_OWNER_KIND} as kind from (select v, {S.ws(_ABBREVIATED)} as c from {_OWNERS}))"
_OWNER_PARTS = r"""(select v, kind, p, several, unnest(range(1, len(p) + 1)) as i, unnest(p) as x from (select v, c, kind, regexp_matches(c, '(?i)\s(&|AND)\s') as several,
  list_filter(list_transform(regexp_split_to_array(c, '(?i)\s+(?:&|AND)\s+'), lambda x: trim(x)), lambda x: x <> '') as p from %s where kind not in ('llc', 'corporation', 'trust', 'estate')))""" % _OWNER_TEXT
_NAMED = r"""(select v, i, x, n from (select v, i, len(p) as n, case when len(p) < 2 or not several then trim(x) when i = 1 or len(regexp_split_to_array(x, '\s+')) > 2 or contains(regexp_split_to_array(x, '\s+')[1], ',') then x
  else regexp_split_to_array(trim(p[1]), '\s+')[1] || ' ' || x end as x from %s))""" % _OWNER_PARTS


def _owner_rows(name: str, source: str, value: str, kind: str) -> str:
    """Parsed names of one way to find them: (k, source, first_name, last_name, normalized)."""
    return f"select split_part(k, chr(1), 1) as owner, {kind} as extracted_from, first_name, last_name, normalized from ({S.parsed(f'(select k, {value} as v from {source} where {value} is not null)', True)})"


@query(
    f"""with o as (select v || chr(1) || i || chr(1) || n as k, {S.ws('x')} as x, list_filter(string_split({S.ws('x')}, ' '), lambda z: z <> '') as w, n from {_NAMED}),
a as (select k, n, case when contains(x, ',') then x when len(w) >= 2 then {_LAST_FIRST} end as t from o),
t as (select v || chr(1) as k, regexp_extract(c, '(?i)^(.+?)\\s+(?:TTEE|TR|TRS|TRUSTEE|TRUSTEES)$', 1) as a, regexp_extract(c, '(?i)^(.+?)\\s+(?:REVOCABLE|IRREVOCABLE|LIVING|FAMILY)\\s+TRUST', 1) as b from {_OWNER_TEXT} where kind = 'trust'),
u as (select k, case when a <> '' then a when b <> '' then b end as t from t),
e as (select v || chr(1) as k, trim(regexp_replace(c, '(?i)\\bESTATE OF\\b', '', 'g')) as t from {_OWNER_TEXT} where kind = 'estate')
{_owner_rows('direct', "a", "t", "case when cast(split_part(k, chr(1), 3) as integer) > 1 then 'co_owner' else 'direct' end")}
union all {_owner_rows('trust', "u", "t", "'trust_name'")} union all {_owner_rows('estate', "e", "t", "'trustee_field'")}""".replace("\\\\", "\\")
)
def owner_parse(spark, sf):
    o = _owners(spark, sf).select("owner", F.explode(N.parse_owners(F.col("owner"))).alias("o"))
    return o.select("owner", "o.extracted_from", "o.person.first_name", "o.person.last_name", "o.person.normalized")


def _keyed(source: str, a: str, keys: str) -> str:
    return f"(select distinct {keys}, line1, a_city, a_state, a_zip, array_to_string(list_filter([line1, a_city, a_state, a_zip], lambda x: x <> ''), '|') as nk from {_address_sql(source, a)})"


_MAILING = "concat_ws(', ', line1, city, concat_ws(' ', state, zip))"


@query(
    f"""with p as {_keyed('(select distinct prospect_id, address, ' + S.zip5('zip') + ' as z from prospect)', 'address', 'prospect_id, z, a')},
m as {_keyed('(select address_id, ' + _MAILING + ' as mailing, ' + S.zip5('zip') + ' as z from property_address)', 'mailing', 'address_id, z, a')}
select case when p.line1 <> 'UNKNOWN' and p.nk = m.nk then 'mailing_exact' when p.a_zip <> '' and p.a_zip = m.a_zip then 'mailing_zip'
  when p.a_city <> '' and p.a_city = m.a_city and p.a_state <> '' and p.a_state = m.a_state then 'mailing_city_state' when p.a_state <> '' and p.a_state = m.a_state then 'mailing_state' else 'mismatch' end as status, count(*) as n
from p join m using (z) group by 1"""
)
def address_tier(spark, sf):
    p = table(spark, sf, "prospect").where("trim(address) <> ''").select("prospect_id", F.col("address").alias("a"), X.normalize_zip5(F.col("zip")).alias("z")).distinct()
    mailing = F.concat_ws(", ", "line1", "city", F.concat_ws(" ", "state", "zip"))
    m = table(spark, sf, "property_address").select("address_id", mailing.alias("a"), X.normalize_zip5(F.col("zip")).alias("z")).where("trim(a) <> ''").distinct()
    parts = ["line1", "city", "state", "zip", "normalized_key"]
    p, m = (d.select("z", X.normalize_address(F.col("a")).alias("n")).select("z", *[f"n.{x}" for x in parts]) for d in (p, m))
    # an unknown street is exact with none
    p = p.withColumn("normalized_key", F.when(F.col("line1") != "UNKNOWN", F.col("normalized_key")))
    tiers = {"mailing_exact": ["normalized_key"], "mailing_zip": ["zip"], "mailing_city_state": ["city", "state"], "mailing_state": ["state"]}
    said = lambda d: d.select("z", "normalized_key", *[F.nullif(x, F.lit("")).alias(x) for x in parts[1:4]])
    return R.count_tiers(said(p), said(m), "z", tiers, "mismatch").select(F.col("tier").alias("status"), "n")


_TAIL = "trim(coalesce(city, '') || ', ' || coalesce(state, '') || ' ' || coalesce(zip, ''))"


@query(f"select distinct prospect_id, case when coalesce(address, '') <> '' and coalesce(city, '') <> '' and coalesce(state, '') <> '' then address || ', ' || {_TAIL} when coalesce(city, '') <> '' or coalesce(state, '') <> '' then 'UNKNOWN, ' || {_TAIL} end as address_like from prospect")
def prospect_address_like(spark, sf):
    p = table(spark, sf, "prospect")
    return p.select("prospect_id", X.prospect_address_like(*map(F.col, ["address", "city", "state", "zip"])).alias("address_like")).distinct()


@query("select distinct address_id, case when coalesce(city, '') <> '' and coalesce(state, '') <> '' then trim('UNKNOWN, ' || city || ', ' || state || ' ' || coalesce(zip, '')) else line1 end as address_like from property_address")
def property_address_like(spark, sf):
    p = table(spark, sf, "property_address")
    return p.select("address_id", X.property_address_like(*map(F.col, ["city", "state", "zip", "line1"])).alias("address_like")).distinct()


def _same(a: str, b: str) -> str:
    return f"({a} <> '' and {a} = {b})"


_CITY = _same(S.city("p.city"), S.city("n.city"))


@query(
    f"""select prospect_id, nonprofit_id, case when {S.state('p.state')} = '' then 'unknown' when {S.state('n.state')} <> '' then case when {S.state('p.state')} <> {S.state('n.state')} then 'mismatch'
    when {_CITY} and {_same(S.free('p.address'), S.free('n.street'))} then 'person_full_address' when {_CITY} and {_same(S.zip5('p.zip'), S.zip5('n.zip'))} then 'person_city_state_zip' when {_CITY} then 'person_city_state' else 'person_state' end
  when {S.state('n.filing.org_state')} <> '' then case when {S.state('p.state')} <> {S.state('n.filing.org_state')} then 'mismatch' when {_same(S.city('p.city'), S.city('n.filing.org_city'))} then 'org_city_state' else 'org_state' end else 'unknown' end as support
from (select distinct prospect_id, last_name, address, city, state, zip from prospect) p join (select distinct nonprofit_id, last_name, street, city, state, zip, filing from nonprofit_record) n on lower(p.last_name) = lower(n.last_name)"""
)
def location_support(spark, sf):
    p = table(spark, sf, "prospect").select("prospect_id", "last_name", "address", "city", "state", "zip").distinct()
    n = table(spark, sf, "nonprofit_record").select("nonprofit_id", "last_name", "street", "city", "state", "zip", "filing").distinct()
    p = p.select("prospect_id", F.lower("last_name").alias("k"), X.prospect_place(*map(F.col, ["address", "city", "state", "zip"])).alias("p"))
    n = n.select("nonprofit_id", F.lower("last_name").alias("k"), X.filed_place(*map(F.col, ["street", "city", "state", "zip", "filing.org_city", "filing.org_state"])).alias("n"))
    # a pair costs its comparisons only: places are read on either side of the join
    return R.spread_join(p, n, "k").select("prospect_id", "nonprofit_id", X.support_level(F.col("p"), F.col("n")).alias("support"))


# names in filings

_FILED = "(select distinct name_raw as k, name_raw as v from prospect where trim(name_raw) <> '')"
_CLEANED = f"lower({S.ws('''replace(coalesce(v, ''), ',', '')''')})"


@query(
    f"""with t(name, nick) as (values {S.nickname_rows()}),
c as (select k, cleaned, bare, contains(string_split(cleaned, ' ')[-1], '-') as double from (select k, {_CLEANED} as cleaned, {S.stripped(_CLEANED)} as bare from {_FILED})),
f as (select k, cleaned, double, cleaned as x from c union all select k, cleaned, double, bare from c where bare <> cleaned and length(bare) >= 4),
o as (select k, cleaned, double, {S.ws("replace(x, '-', ' ')")} as x from f where contains(x, '-')),
s as (select k, cleaned, string_split(x, ' ')[1] || ' ' || string_split(x, ' ')[-1] as x from (select * from f union all select * from o) where not double and len(string_split(x, ' ')) >= 3),
p as (select distinct k, x from (select k, cleaned, x from f union all select k, cleaned, x from o union all select k, cleaned, x from s union all select k, cleaned, {S.ws("replace(x, '-', ' ')")} from s) where x = cleaned or length(x) >= 4),
n as (select k, nick || ' ' || array_to_string(string_split(x, ' ')[2:], ' ') as x from p join t on string_split(x, ' ')[1] = t.name where len(string_split(x, ' ')) >= 2
  union all select k, nick || ' ' || string_split(x, ' ')[-1] from p join t on string_split(x, ' ')[1] = t.name where len(string_split(x, ' ')) >= 3)
select distinct k as name, x as variant from (select * from p union all select * from n where length(x) >= 4) where x <> ''"""
)
def filed_name_variants(spark, sf):
    p = table(spark, sf, "prospect").where("trim(name_raw) <> ''").select(F.col("name_raw").alias("name")).distinct()
    return p.select("name", F.explode(N.filed_name_variants(F.col("name"))).alias("variant"))


# scans, keys and links


@query("select raw_ref from fec_raw where len(string_split(line, '|')) >= 21 and contains(string_split(line, '|')[8], ',') and upper(trim(string_split(line, '|')[19])) <> 'X' and trim(string_split(line, '|')[7]) in ('', 'IND')")
def fec_prefilter(spark, sf):
    return fec.prefilter(table(spark, sf, "fec_raw"), "line").select("raw_ref")


_A_LINE = "concat_ws('|', 'A', source_record_id, '7', coalesce(recipient_name, ''), '', coalesce(donor_name_raw, ''), '', '', '', '', '', '', '', cast(cast(round(amount) as bigint) as varchar), '', '', coalesce(donation_date, ''))"
_DAY = r"""case when regexp_matches(t, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') then try_strptime(left(t, 10), '%Y-%m-%d') when regexp_full_match(t, '[0-9]{4}/[0-9]{2}/[0-9]{2}') then try_strptime(t, '%Y/%m/%d')
  when regexp_full_match(t, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}') then try_strptime(t, '%m/%d/%Y')
  when regexp_full_match(t, '(19|20)[0-9]{2}(0[1-9]|1[0-2])[0-9]{2}') and try_strptime(t, '%Y%m%d') is not null then try_strptime(t, '%Y%m%d') when regexp_full_match(t, '[0-9]{8}') then try_strptime(t, '%m%d%Y') end"""


@query(
    f"""select source_record_id || '|7|' || lower(trim(coalesce(recipient_name, ''))) || '|' || lower(trim(coalesce(donor_name_raw, ''))) || '|' || cast(cast(round(amount) as bigint) as varchar) || '|' || coalesce(strftime(cast({_DAY} as date), '%Y-%m-%d'), '') as record_key
from (select distinct source_record_id, recipient_name, donor_name_raw, amount, donation_date, trim(coalesce(donation_date, '')) as t from contribution where amount is not null and not contains(coalesce(donor_name_raw, '') || coalesce(recipient_name, ''), '|'))"""
)
def schedule_a_keys(spark, sf):
    c = table(spark, sf, "contribution").where("amount is not null and not contains(coalesce(donor_name_raw, '') || coalesce(recipient_name, ''), '|')").select("source_record_id", "recipient_name", "donor_name_raw", "amount", "donation_date").distinct()
    blank = lambda n: [F.lit("")] * n
    text = lambda x: F.coalesce(F.col(x), F.lit(""))
    line = F.concat_ws("|", F.lit("A"), "source_record_id", F.lit("7"), text("recipient_name"), F.lit(""), text("donor_name_raw"), *blank(7), F.round("amount").cast("bigint").cast("string"), *blank(2), text("donation_date"))
    return c.select(X.schedule_a_key(line).alias("record_key"))


@query(
    f"""select distinct source_record_id, case when source = 'FEC' and coalesce(committee_id, '') <> '' then 'https://www.fec.gov/data/receipts/individual-contributions/?committee_id=' || committee_id || '&contributor_name=' || replace(replace(url_encode(upper(coalesce(last_name, ''))), '%20', '+'), '~', '%7E')
  || coalesce('&min_date=' || strftime(day, '%m%%2F%d%%2F%Y') || '&max_date=' || strftime(day, '%m%%2F%d%%2F%Y'), '') else '' end as link from (select *, cast({_DAY} as date) as day from (select source_record_id, source, committee_id, last_name, trim(coalesce(donation_date, '')) as t from contribution))"""
)
def receipt_links(spark, sf):
    c = table(spark, sf, "contribution")
    return c.select("source_record_id", X.receipt_link(F.col("source"), F.col("committee_id"), F.col("last_name"), X.parse_date(F.col("donation_date"))).alias("link")).distinct()


# results

_RESULT_KEY = ["prospect_id", "filing_id", "org_ein", "person_name_normalized", "normalized_title", "amount"]
_NONE = "coalesce(cast({0} as varchar), '')"
_RESULT_PART = ", ".join("coalesce(nullif(normalized_title, ''), '-')" if c == "normalized_title" else c for c in _RESULT_KEY)


@query(f"select match_id, prospect_id, org_ein from nonprofit_match qualify row_number() over (partition by {_RESULT_PART} order by match_confidence desc nulls last, match_id) = 1")
def result_dedupe(spark, sf):
    m = table(spark, sf, "nonprofit_match").withColumn("normalized_title", F.coalesce(F.nullif("normalized_title", F.lit("")), F.lit("-")))
    return R.keep_best(m, _RESULT_KEY, [F.desc_nulls_last("match_confidence"), F.asc("match_id")]).select("match_id", "prospect_id", "org_ein")


@query("select source, max(coalesce(nullif(trim(donation_date), ''), strftime(load_date, '%Y-%m-%d'))) as latest from contribution group by 1")
def latest_record_date(spark, sf):
    c = table(spark, sf, "contribution")
    return c.groupBy("source").agg(F.max(F.coalesce(F.nullif(F.trim("donation_date"), F.lit("")), F.date_format("load_date", "yyyy-MM-dd"))).alias("latest"))


@query("select record_type, count(distinct prospect_id) as n_prospects, count(distinct match_id) as n_matches from nonprofit_match group by 1")
def prospects_matched(spark, sf):
    m = table(spark, sf, "nonprofit_match")
    return m.groupBy("record_type").agg(F.countDistinct("prospect_id").alias("n_prospects"), F.countDistinct("match_id").alias("n_matches"))


@query(
    """with b as (select org_ein, prospect_id, max(coalesce(match_confidence, -1)) as conf from nonprofit_match where org_ein <> '' and prospect_id is not null group by all),
f as (select org_ein, count(*) as n_people, arg_min(prospect_id, (-conf, prospect_id)) as first_prospect_id from b group by 1)
select distinct n.nonprofit_id, n.filing.ein as org_ein, f.n_people, f.first_prospect_id, case when f.n_people > 1 then 'ambiguous_foundation_link' else 'verified_foundation_link' end as link_status
from nonprofit_record n join f on f.org_ein = n.filing.ein"""
)
def foundation_grants(spark, sf):
    m = table(spark, sf, "nonprofit_match").where("prospect_id is not null").select("org_ein", "prospect_id", F.coalesce("match_confidence", F.lit(-1)).alias("conf"))
    g = table(spark, sf, "nonprofit_record").select("nonprofit_id", F.col("filing.ein").alias("org_ein")).distinct()
    return R.grants_of_matched(m, g, "org_ein", "prospect_id", [F.desc("conf")])


@query("with d as (select source_record_id, max(load_date::date) as day from contribution where load_date is not null group by 1) select source_record_id from d where day >= (select max(day) from d) - 90")
def first_delivery(spark, sf):
    c = table(spark, sf, "contribution").where("load_date is not null").groupBy("source_record_id").agg(F.max(F.to_date("load_date")).alias("day"))
    return R.first_delivery(c, "source_record_id", "day").select("source_record_id")


@query(
    """with d as (select source_record_id, max(load_date::date) as day from contribution where load_date is not null group by 1)
select source_record_id from d where day >= date '2026-01-15' - 1 and source_record_id not in (select source_record_id from contribution where load_date < timestamp '2026-01-15 00:00:00')"""
)
def since_cursor(spark, sf):
    c = table(spark, sf, "contribution").where("load_date is not null")
    d = c.groupBy("source_record_id").agg(F.max(F.to_date("load_date")).alias("day"))
    seen = c.where("load_date < timestamp_ntz '2026-01-15 00:00:00'").select("source_record_id")
    return R.since_cursor(d, "source_record_id", "day", "2026-01-15", seen).select("source_record_id")
