"""Queries of the engine's own operators over the domain's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsieve.functions import fields as X
from kinsieve.functions import names as N
from kinsieve.functions.rules import (
    COMPANY_CLASSES,
    FOUNDATION_WORDS,
    NICKNAMES,
    NON_INFORMATIVE_EMPLOYERS,
    NON_INFORMATIVE_OCCUPATIONS,
    OCCUPATION_CLASSES,
    OWNER_ABBREVIATIONS,
    OWNER_KINDS,
    TITLE_CLASSES,
)
from kinsieve.operators import records as R
from kinsieve.plans import sqltext as S
from kinsieve.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _donors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "contribution").select(F.col("donor_name_raw").alias("name")).where("name is not null").distinct()


_DONORS = "(select distinct donor_name_raw as k, donor_name_raw as v from contribution where donor_name_raw is not null)"
_PEOPLE = "(select distinct person_name as k, person_name as v from nonprofit_record where person_name is not null)"
_PARTS = ["first_name", "middle_name", "middle_initial", "last_name", "suffix", "normalized", "normalized_full"]

# names


@query(f"select k as name, {', '.join(_PARTS)} from ({S.parsed(_DONORS, False)})")
def name_parse_fec(spark, sf):
    return _donors(spark, sf).withColumn("p", N.parse_fec_name(F.col("name"))).where("p is not null").select("name", "p.*")


@query(f"select k as name, {', '.join(_PARTS)} from ({S.parsed(_PEOPLE, True)})")
def name_parse_person(spark, sf):
    d = table(spark, sf, "nonprofit_record").select(F.col("person_name").alias("name")).where("name is not null").distinct()
    return d.withColumn("p", N.parse_person_name(F.col("name"))).where("p is not null").select("name", "p.*")


@query(f"select k as name, {S.last_suffix('v')} as suffix, {S.stripped('v')} as bare from {_DONORS} where {S.last_suffix('v')} <> ''")
def suffix_extract(spark, sf):
    n = F.col("name")
    return _donors(spark, sf).select("name", N.last_suffix(n).alias("suffix"), N.strip_suffixes(n).alias("bare")).where("suffix <> ''")


@query(
    f"""with t(name, nick) as (values {S.nickname_rows()}),
f as (select first_name as f, count(*) as n from ({S.parsed(_DONORS, False)}) group by 1)
select f as first_name, nick as nickname, n as n_names from f join t on f.f = t.name"""
)
def nickname_expand(spark, sf):
    first = _donors(spark, sf).select(N.parse_fec_name(F.col("name"))["first_name"].alias("first_name")).where("first_name is not null")
    return first.groupBy("first_name").agg(F.count("*").alias("n_names")).select("first_name", F.explode(N.nicknames(F.col("first_name"))).alias("nickname"), "n_names")


_PROSPECT_NAMES = "(select distinct prospect_id as k, name_raw as v from prospect where trim(name_raw) <> '')"


def _variants_sql(source: str) -> str:
    """The spellings of source(k, v): (k, value, variant_type), the last rule of equal ones."""
    cleaned = f"lower({S.ws('''replace(coalesce(v, ''), ',', '')''')})"
    return f"""
select k, value, arg_max(variant_type, ord) as variant_type from (
  with t(name, nick) as (values {S.nickname_rows()}),
  c as (select k, v, cleaned, bare, contains(string_split(cleaned, ' ')[-1], '-') as hyphen from (select k, v, {cleaned} as cleaned, {S.stripped(cleaned)} as bare from {source}) where cleaned <> ''),
  b as (select k, v, cleaned, bare, hyphen, base, string_split(base, ' ') as w, o from (select *, cleaned as base, 10 as o from c union all select *, bare as base, 20 as o from c where bare <> cleaned and bare <> '')),
  p as ({S.parsed(source, True)})
  select k, cleaned as value, 'exact' as variant_type, 0 as ord from c
  union all select k, bare, 'suffix_stripped', 1 from c where bare <> '' and bare <> cleaned and length(bare) >= 4
  union all select k, {S.ws("replace(base, '-', ' ')")}, 'dehyphenated', o from b where contains(base, '-') and length({S.ws("replace(base, '-', ' ')")}) >= 4
  union all select k, w[1] || ' ' || w[-1], 'middle_dropped', o + 1 from b where len(w) >= 3 and not hyphen and length(w[1] || ' ' || w[-1]) >= 4
  union all select k, nick || ' ' || array_to_string(w[2:], ' '), 'nickname', o + 2 from b join t on w[1] = t.name where len(w) >= 2
  union all select k, nick || ' ' || w[-1], 'nickname', o + 3 from b join t on w[1] = t.name where len(w) >= 3
  union all select k, first_name || ' ' || last_name, 'exact', 30 from p where first_name <> '' and last_name <> ''
  union all select k, first_name || ' ' || middle_initial || ' ' || last_name, 'initial_variant', 31 from p where first_name <> '' and last_name <> '' and middle_name <> '')
group by k, value"""


@query(f"select k as name, value, variant_type from ({_variants_sql(_PEOPLE)})")
def name_variants(spark, sf):
    d = table(spark, sf, "nonprofit_record").select(F.col("person_name").alias("name")).where("name is not null").distinct()
    v = d.select("name", F.explode(N.name_variants(F.col("name"))).alias("v"))
    return v.groupBy("name", F.col("v.value").alias("value")).agg(F.max_by("v.variant_type", "v.ord").alias("variant_type"))


_ABBREVIATED = "v"
for _a, _b in OWNER_ABBREVIATIONS.items():
    _ABBREVIATED = rf"regexp_replace({_ABBREVIATED}, '\b{_a}\b', '{_b}', 'g')"
_OWNERS = "(select distinct upper(donor_name_raw) || case when length(donor_name_raw) % 4 = 0 then ' REVOCABLE TRUST' when length(donor_name_raw) % 4 = 1 then ' ETUX & JANE' when length(donor_name_raw) % 4 = 2 then ' TTEE' else '' end as v from contribution where trim(donor_name_raw) <> '')"


def _owners(spark, sf):
    n = F.length("donor_name_raw") % 4
    tail = F.when(n == 0, " REVOCABLE TRUST").when(n == 1, " ETUX & JANE").when(n == 2, " TTEE").otherwise("")
    return table(spark, sf, "contribution").where("trim(donor_name_raw) <> ''").select(F.concat(F.upper("donor_name_raw"), tail).alias("owner")).distinct()


@query(f"select v as owner, {S.ws(_ABBREVIATED)} as cleaned from {_OWNERS}")
def abbreviation_expand(spark, sf):
    return _owners(spark, sf).select("owner", N.expand_abbreviations(F.col("owner"))["cleaned"].alias("cleaned"))


_OWNER_KIND = S.classes("c", [(k, f"(?i){p}") for k, p in OWNER_KINDS], "'individual'")


@query(f"select kind as owner_kind, count(*) as n from (select {_OWNER_KIND} as kind from (select {S.ws(_ABBREVIATED)} as c from {_OWNERS})) group by 1")
def owner_classify(spark, sf):
    kinds = _owners(spark, sf).select(N.classify_owner(N.expand_abbreviations(F.col("owner"))["cleaned"]).alias("owner_kind"))
    return kinds.groupBy("owner_kind").agg(F.count("*").alias("n"))


_SPLIT = rf"""(select v, c, list_filter(list_transform(regexp_split_to_array(c, '(?i)\s+(?:&|AND)\s+'), lambda x: trim(x)), lambda x: x <> '') as p, regexp_matches(c, '(?i)\s(&|AND)\s') as several,
  {_OWNER_KIND} as kind from (select v, {S.ws(_ABBREVIATED)} as c from {_OWNERS}))"""


@query(
    rf"""select v as owner, cast(i as integer) as at, case when i = 1 or len(regexp_split_to_array(x, '\s+')) > 2 or contains(regexp_split_to_array(x, '\s+')[1], ',') then x
  else regexp_split_to_array(trim(p[1]), '\s+')[1] || ' ' || x end as part
from (select v, p, unnest(range(1, len(p) + 1)) as i, unnest(p) as x from {_SPLIT} where several and len(p) >= 2 and kind not in ('llc', 'corporation'))"""
)
def owner_split(spark, sf):
    cleaned = N.expand_abbreviations(F.col("owner"))["cleaned"]
    parts = _owners(spark, sf).select("owner", N.split_owners(cleaned, N.classify_owner(cleaned)).alias("p")).where("size(p) > 1")
    return parts.select("owner", F.posexplode("p").alias("at", "part")).select("owner", (F.col("at") + 1).alias("at"), "part")


@query(
    rf"""with s as (select k, regexp_replace(coalesce(v, ''), '(?i)\s+AS\s+OF\s+\w+\s+\d{{4}}\s*$', '') as c from {_PEOPLE}),
t as (select k, {S.ws('c')} as v from s),
u as (select k, v from t where length(v) >= 3 and upper(v) not in ('VACANT', 'NONE', 'N/A', 'NA', 'NOT APPLICABLE', 'TBD', 'UNKNOWN') and not regexp_matches(v, '\d'))
select k as person_name, normalized, normalized_full from ({S.parsed('u', True)})"""
)
def officer_name(spark, sf):
    d = table(spark, sf, "nonprofit_record").select("person_name").where("person_name is not null").distinct()
    return d.withColumn("p", N.try_person(F.col("person_name"))).where("p is not null").select("person_name", "p.normalized", "p.normalized_full")


@query(f"select k as name, w[-1] || ' ' || array_to_string(w[:-2], ' ') as reversed_key from (select k, {S.words(f'lower({S.ws(chr(118))})')} as w from {_PROSPECT_NAMES}) where len(w) >= 2".replace("select k as name", "select v as name").replace("from (select k,", "from (select distinct v,"))
def reversed_name_key(spark, sf):
    d = table(spark, sf, "prospect").where("trim(name_raw) <> ''").select(F.col("name_raw").alias("name")).distinct()
    return d.select("name", N.reversed_key(F.col("name")).alias("reversed_key")).where("reversed_key is not null")


_LETTERS = "array_to_string(list_filter(" + S.words(S.ws("regexp_replace(lower(coalesce(person_name, '')), '[^a-z ]', ' ', 'g')")) + ", lambda w: w not in ('jr', 'sr', 'ii', 'iii', 'iv', 'md', 'phd', 'esq', 'mr', 'mrs', 'ms', 'dr')), ' ')"


@query(
    f"""select case when n = 1 then '1' when n = 2 then '2' when n <= 5 then '3-5' else '6+' end as bucket, count(*) as n_names, cast(sum(n) as bigint) as n_records
from (select {_LETTERS} as k, count(*) as n from nonprofit_record group by 1) where k <> '' group by 1"""
)
def yield_buckets(spark, sf):
    names = table(spark, sf, "nonprofit_record").groupBy(N.letters_only(F.col("person_name")).alias("k")).agg(F.count("*").alias("n")).where("k <> ''")
    bucket = F.when(F.col("n") == 1, "1").when(F.col("n") == 2, "2").when(F.col("n") <= 5, "3-5").otherwise("6+")
    return names.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_names"), F.sum("n").alias("n_records"))


@query(f"select k as name, cast(n as bigint) as n_records from (select {_LETTERS} as k, count(*) as n from nonprofit_record group by 1) where k <> '' order by n desc, k limit 20")
def yield_top_names(spark, sf):
    names = table(spark, sf, "nonprofit_record").groupBy(N.letters_only(F.col("person_name")).alias("name")).agg(F.count("*").alias("n_records")).where("name <> ''")
    return R.top_k(names, [F.desc("n_records"), F.asc("name")], 20)


@query("select median, n_values from (select list_sort(list(amount)) as a, count(*) as n_values from nonprofit_record where amount is not null) , lateral (select a[(n_values // 2) + 1] as median)")
def yield_median_amount(spark, sf):
    return R.upper_median(table(spark, sf, "nonprofit_record"), "amount")


# employers


@query(f"select distinct employer_raw, {S.legal_stripped('employer_raw')} as stripped from contribution where employer_raw is not null")
def employer_strip(spark, sf):
    d = table(spark, sf, "contribution").select("employer_raw").where("employer_raw is not null").distinct()
    return d.select("employer_raw", X.strip_legal_suffixes(F.col("employer_raw")).alias("stripped"))


_STATUS = f"""case when d = '' then 'missing' when d in ({S.quoted(NON_INFORMATIVE_EMPLOYERS)}) then 'non_informative' when p = '' then 'missing' when p = d then 'confirmed'
  when contains(p, d) or contains(d, p) then 'likely' when string_split(p, ' ')[1] = string_split(d, ' ')[1] then 'weak_overlap' else 'mismatch' end"""
_LAST = "(select c.* from contribution c qualify row_number() over (partition by source_record_id order by load_date desc nulls last, donor_name_raw desc, employer_raw desc, amount desc) = 1)"


def _by_zip(spark, sf):
    """Pairs of a prospect and a donor with one surname and one zip, whatever its writing."""
    p = table(spark, sf, "prospect").where("last_name is not null").select("prospect_id", F.lower("last_name").alias("z"), X.normalize_zip5(F.col("zip")).alias("zip5"), "company_raw", "other_companies", F.col("city").alias("p_city"), F.col("state").alias("p_state"), F.col("zip").alias("p_zip")).distinct()
    c = table(spark, sf, "contribution").where("last_name is not null").select("source_record_id", F.lower("last_name").alias("z"), X.normalize_zip5(F.col("zip")).alias("zip5"), "employer_raw", "city", "state", "zip", "occupation_raw").distinct()
    return p.join(c, ["zip5", "z"])


_BY_ZIP = f"""(select * from (select distinct prospect_id, lower(last_name) as z, {S.zip5('zip')} as zip5, company_raw, other_companies, city as p_city, state as p_state, zip as p_zip from prospect where last_name is not null)
  join (select distinct source_record_id, lower(last_name) as z, {S.zip5('zip')} as zip5, employer_raw, city, state, zip, occupation_raw from contribution where last_name is not null) using (zip5, z))"""


@query(f"select status, count(*) as n from (select {_STATUS} as status from (select {S.legal_stripped('company_raw')} as p, {S.legal_stripped('employer_raw')} as d from {_BY_ZIP})) group by 1")
def employer_match(spark, sf):
    return _by_zip(spark, sf).groupBy(X.employer_status(F.col("company_raw"), F.col("employer_raw")).alias("status")).agg(F.count("*").alias("n"))


_RANK = "list_position(['mismatch', 'missing', 'non_informative', 'weak_overlap', 'likely', 'confirmed'], {})"


@query(
    f"""with l as (select prospect_id, source_record_id, company_raw, employer_raw, list_filter(list_concat([company_raw], coalesce(other_companies, [])), lambda x: coalesce(x, '') <> '') as cs from {_BY_ZIP}),
s as (select distinct prospect_id, source_record_id, company_raw, employer_raw, cs, x, i, {_STATUS} as status from (select *, {S.legal_stripped('x')} as p, {S.legal_stripped('employer_raw')} as d from (select prospect_id, source_record_id, company_raw, employer_raw, cs, unnest(cs) as x, unnest(range(1, len(cs) + 1)) as i from l))),
u as (select * from s qualify row_number() over (partition by prospect_id, source_record_id, company_raw, employer_raw, cs order by {_RANK.format('status')} desc, i) = 1)
select prospect_id, source_record_id, x as company, status from u qualify row_number() over (partition by prospect_id, source_record_id order by {_RANK.format('status')} desc, x, status) = 1"""
)
def employer_best(spark, sf):
    all_ = F.concat(F.array("company_raw"), F.coalesce("other_companies", F.array().cast("array<string>")))
    b = _by_zip(spark, sf).withColumn("b", X.best_employer(all_, F.col("employer_raw"))).where("b is not null").select("prospect_id", "source_record_id", "b.rank", "b.company", "b.status")
    return R.keep_best(b, ["prospect_id", "source_record_id"], [F.desc("rank"), F.asc("company"), F.asc("status")]).drop("rank")


# places


@query(f"select distinct state as typed, {S.state('state')} as state from contribution where state is not null")
def state_norm(spark, sf):
    return table(spark, sf, "contribution").where("state is not null").select(F.col("state").alias("typed")).distinct().withColumn("state", X.normalize_state(F.col("typed")))


@query(f"select distinct city as typed, {S.city('city')} as city from contribution where city is not null")
def city_norm(spark, sf):
    return table(spark, sf, "contribution").where("city is not null").select(F.col("city").alias("typed")).distinct().withColumn("city", X.normalize_city(F.col("typed")))


@query(f"select {S.zip5('zip')} as zip5, count(*) as n from contribution group by 1")
def zip_norm(spark, sf):
    return table(spark, sf, "contribution").groupBy(X.normalize_zip5(F.col("zip")).alias("zip5")).agg(F.count("*").alias("n"))


_GEO = f"""(select *, case when y <> '' and y = z5 then 'zip_match' when c <> '' and c = d and s <> '' and s = t then 'city_state_match' when c <> '' and c = d and (s = '' or t = '') then 'city_match'
  when s <> '' and t <> '' then case when s = t then 'state_match' else 'state_mismatch' end else 'no_data' end as status
  from (select *, {S.city('p_city')} as c, {S.city('city')} as d, {S.state('p_state')} as s, {S.state('state')} as t, {S.zip5('p_zip')} as y, {S.zip5('zip')} as z5 from %s))"""
_SAME_NAME = """(select distinct p.prospect_id, p.city as p_city, p.state as p_state, p.zip as p_zip, c.source_record_id, c.city, c.state, c.zip from prospect p join contribution c on p.name_normalized = c.donor_name_normalized where p.name_normalized <> '')"""


@query(f"select status, count(*) as n from {_GEO % _SAME_NAME} group by 1")
def geo_match(spark, sf):
    p = table(spark, sf, "prospect").where("name_normalized <> ''").select("prospect_id", F.col("name_normalized").alias("k"), F.col("city").alias("p_city"), F.col("state").alias("p_state"), F.col("zip").alias("p_zip"))
    c = table(spark, sf, "contribution").select("source_record_id", F.col("donor_name_normalized").alias("k"), "city", "state", "zip")
    j = p.join(c, "k").drop("k").distinct()
    return j.groupBy(X.location_status(*map(F.col, ["p_city", "p_state", "p_zip", "city", "state", "zip"])).alias("status")).agg(F.count("*").alias("n"))


_TOKEN = "regexp_replace(upper({}), '[.,]', '', 'g')"


def _address_sql(source: str, a: str) -> str:
    t = lambda x: S.ws(_TOKEN.format(f"coalesce({x}, '')"))
    return f"""(select *, case when len(seg) >= 3 then {t('seg[1]')} else {t('trim(a)')} end as line1, case when len(seg) >= 3 then {t('seg[2]')} else '' end as a_city,
      case when len(seg) >= 3 then {t("regexp_split_to_array(seg[3], '[ ]+')[1]".replace('[ ]', chr(92) + 's'))} else '' end as a_state, case when len(seg) >= 3 then trim(coalesce({"regexp_split_to_array(seg[3], '[ ]+')[2]".replace('[ ]', chr(92) + 's')}, '')) else '' end as a_zip
      from (select *, {a} as a, list_filter(list_transform(string_split(trim({a}), ','), lambda x: trim(x)), lambda x: x <> '') as seg from {source} where trim({a}) <> ''))"""


@query(
    f"select distinct a as address, line1, a_city as city, a_state as state, a_zip as zip, array_to_string(list_filter([line1, a_city, a_state, a_zip], lambda x: x <> ''), '|') as normalized_key from {_address_sql('prospect', 'address')}"
)
def address_norm(spark, sf):
    d = table(spark, sf, "prospect").where("trim(address) <> ''").select("address").distinct()
    return d.withColumn("n", X.normalize_address(F.col("address"))).select("address", "n.line1", "n.city", "n.state", "n.zip", "n.normalized_key")


# titles, occupations, organisations


@query(f"select title, role, {S.classes('h', TITLE_CLASSES, chr(39) + 'frontline_or_operational' + chr(39))} as title_class from (select distinct title, role, trim({S.free('title')} || ' ' || {S.free('role')}) as h from nonprofit_record) where coalesce(role, '') <> 'donor' union all select distinct title, role, 'board_trustee' from nonprofit_record where role = 'donor'")
def title_bucket(spark, sf):
    d = table(spark, sf, "nonprofit_record").select("title", "role").distinct()
    return d.withColumn("title_class", X.title_class(F.col("title"), F.col("role")))


_OCC = "lower(trim(coalesce(occupation_raw, '')))"


@query(f"select occupation_raw, {S.classes(_OCC, OCCUPATION_CLASSES, 'null')} as occupation_class from (select distinct occupation_raw from contribution where occupation_raw is not null) where {_OCC} <> '' and {_OCC} not in ({S.quoted(NON_INFORMATIVE_OCCUPATIONS)}) and {S.classes(_OCC, OCCUPATION_CLASSES, 'null')} is not null")
def occupation_class(spark, sf):
    d = table(spark, sf, "contribution").where("occupation_raw is not null").select("occupation_raw").distinct()
    return d.withColumn("occupation_class", X.occupation_class(F.col("occupation_raw"))).where("occupation_class is not null")


_COMP = "lower(trim(coalesce(company_raw, '')))"


@query(
    f"""select oc as occupation_class, cc as company_class, count(*) as n from (select {S.classes(_COMP, COMPANY_CLASSES, 'null')} as cc, case when {_OCC} not in ({S.quoted(NON_INFORMATIVE_OCCUPATIONS)}) then {S.classes(_OCC, OCCUPATION_CLASSES, 'null')} end as oc
from {_BY_ZIP}) where oc is not null and cc is not null group by all"""
)
def occupation_company(spark, sf):
    j = _by_zip(spark, sf).select(X.occupation_class(F.col("occupation_raw")).alias("occupation_class"), X.company_class(F.col("company_raw")).alias("company_class"))
    return j.where("occupation_class is not null and company_class is not null").groupBy("occupation_class", "company_class").agg(F.count("*").alias("n"))


_ORG = f"(select distinct filing.org_name as o, {S.free(S.legal_stripped('filing.org_name'))} as org from nonprofit_record)"


@query(f"select distinct o as org_name, org as normalized from {_ORG} where o is not null")
def org_normalize(spark, sf):
    d = table(spark, sf, "nonprofit_record").select(F.col("filing.org_name").alias("org_name")).where("org_name is not null").distinct()
    return d.withColumn("normalized", X.normalize_org(F.col("org_name")))


_TOKENS = "list_distinct(list_filter(string_split({}, ' '), lambda w: length(w) >= 3))"


@query(
    f"""with j as (select distinct n.record_fingerprint, n.filing.org_name as org_name, p.company_raw from nonprofit_record n join prospect p on n.person_name_normalized = p.name_normalized where p.name_normalized <> ''),
k as (select *, {S.free(S.legal_stripped('company_raw'))} as c, {S.free(S.legal_stripped('org_name'))} as o from j),
m as (select *, len(list_intersect({_TOKENS.format('c')}, {_TOKENS.format('o')})) as n from k)
select agreement, count(*) as n from (select case when c = '' or o = '' then 'none' when c = o then 'equal' when contains(c, o) or contains(o, c) then 'contained' when n >= 2 then 'two_tokens' when n = 1 then 'one_token' else 'none' end as agreement from m) group by 1"""
)
def org_affinity(spark, sf):
    p = table(spark, sf, "prospect").where("name_normalized <> ''").select(F.col("name_normalized").alias("k"), "company_raw")
    n = table(spark, sf, "nonprofit_record").select(F.col("person_name_normalized").alias("k"), "record_fingerprint", F.col("filing.org_name").alias("org_name"))
    j = n.join(p, "k").drop("k").distinct()
    return j.groupBy(X.org_agreement(F.col("company_raw"), F.col("org_name")).alias("agreement")).agg(F.count("*").alias("n"))


@query(f"select distinct n.last_name, n.filing.org_name as org_name from nonprofit_record n where regexp_matches({S.free(S.legal_stripped('n.filing.org_name'))}, '{FOUNDATION_WORDS}') and length({S.free('n.last_name')}) >= 4 and contains({S.free(S.legal_stripped('n.filing.org_name'))}, {S.free('n.last_name')})")
def foundation_affinity(spark, sf):
    n = table(spark, sf, "nonprofit_record").select("last_name", F.col("filing.org_name").alias("org_name")).distinct()
    return n.where(X.names_family_foundation(F.col("last_name"), F.col("org_name")))


# dates, money, keys

_ISO = "try_strptime(left(t, 10), '%Y-%m-%d')"


@query(
    r"""with d as (select distinct donation_date, trim(coalesce(donation_date, '')) as t from contribution where donation_date is not null)
select donation_date as typed, cast(case when regexp_matches(t, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') then try_strptime(left(t, 10), '%Y-%m-%d') when regexp_full_match(t, '[0-9]{4}/[0-9]{2}/[0-9]{2}') then try_strptime(t, '%Y/%m/%d')
  when regexp_full_match(t, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}') then try_strptime(t, '%m/%d/%Y')
  when regexp_full_match(t, '(19|20)[0-9]{2}(0[1-9]|1[0-2])[0-9]{2}') and try_strptime(t, '%Y%m%d') is not null then try_strptime(t, '%Y%m%d') when regexp_full_match(t, '[0-9]{8}') then try_strptime(t, '%m%d%Y') end as date) as day from d"""
)
def date_norm(spark, sf):
    d = table(spark, sf, "contribution").where("donation_date is not null").select(F.col("donation_date").alias("typed")).distinct()
    return d.withColumn("day", X.parse_date(F.col("typed")))


@query("select distinct amount, '$' || format('{:t,.2f}', amount) as shown from contribution where amount >= 0".replace("{:t,.2f}", "{:,.2f}"))
def currency_fmt(spark, sf):
    d = table(spark, sf, "contribution").where("amount >= 0").select("amount").distinct()
    return d.withColumn("shown", X.format_currency(F.col("amount")))


def _key_part(x: str) -> str:
    return f"coalesce(nullif(trim(cast({x} as varchar)), ''), '-')"


@query(f"select nonprofit_id, concat_ws('|', {_key_part('filing.object_id')}, {_key_part('source')}, {_key_part('person_name_normalized')}, {_key_part('normalized_title')}, {_key_part('source_section')}) as record_key from (select distinct nonprofit_id, filing, source, person_name_normalized, normalized_title, source_section from nonprofit_record)")
def record_keys(spark, sf):
    n = table(spark, sf, "nonprofit_record").select("nonprofit_id", F.col("filing.object_id").alias("o"), "source", "person_name_normalized", "normalized_title", "source_section", "filing").distinct()
    return n.select("nonprofit_id", X.record_key(*map(F.col, ["o", "source", "person_name_normalized", "normalized_title", "source_section"])).alias("record_key"))


# filters and scans


@query(
    f"""with l as (select raw_ref, string_split(line, '|') as c from fec_raw),
a as (select raw_ref as k, c[8] as v, c from l where len(c) >= 21 and contains(c[8], ',') and upper(trim(c[19])) <> 'X' and trim(c[7]) in ('', 'IND'))
select p.k as raw_ref, p.normalized, p.last_name, try_cast(c[15] as double) as amount from ({S.parsed('a', False)}) p join a using (k)"""
)
def fec_admit(spark, sf):
    from kinsieve.sources.fec import admit, scan_lines

    return admit(scan_lines(table(spark, sf, "fec_raw"), "line", "raw_ref")).select("raw_ref", "name.normalized", "name.last_name", "amount")


@query(
    f"""with l as (select raw_ref, string_split(line, '|') as c from fec_raw), p as (select distinct lower(last_name) as z from prospect where last_name is not null),
a as (select raw_ref as k, c[8] as v, c from l where len(c) >= 21 and contains(c[8], ',') and upper(trim(c[19])) <> 'X' and trim(c[7]) in ('', 'IND'))
select q.k as raw_ref, q.last_name, try_cast(c[15] as double) as amount, cast(try_strptime(c[14], '%m%d%Y') as date) as day from ({S.parsed('a', False)}) q join a using (k)
where q.last_name in (select z from p) and try_cast(c[15] as double) >= 100 and (c[14] = '' or try_strptime(c[14], '%m%d%Y') between '2025-06-01' and '2026-03-31')"""
)
def fec_pushdown(spark, sf):
    from kinsieve.sources.fec import admit, narrow, scan_lines

    known = table(spark, sf, "prospect").select(F.lower("last_name").alias("last_name"))
    out = narrow(admit(scan_lines(table(spark, sf, "fec_raw"), "line", "raw_ref")), known, 100.0, "2025-06-01", "2026-03-31")
    return out.select("raw_ref", "last_name", "amount", "day")


# joins


@query("select c.snapshot_no, c.source_record_id from (select distinct snapshot_no, source_record_id from contribution_snapshot where snapshot_no > 1) c where not exists (select 1 from contribution_snapshot p where p.snapshot_no = c.snapshot_no - 1 and p.source_record_id = c.source_record_id)")
def fec_diff_anti(spark, sf):
    s = table(spark, sf, "contribution_snapshot").select("snapshot_no", "source_record_id", F.concat_ws("#", F.col("snapshot_no").cast("string"), "source_record_id").alias("key"))
    before = s.select(F.concat_ws("#", (F.col("snapshot_no") + 1).cast("string"), "source_record_id").alias("key"))
    return R.new_rows(s.where("snapshot_no > 1").distinct(), before, "key").select("snapshot_no", "source_record_id")


@query("select source_record_id, count(*) as n from contribution where last_name in (select last_name from prospect) group by 1")
def semi_lastname(spark, sf):
    c = R.only_known(table(spark, sf, "contribution").select("source_record_id", "last_name"), "last_name", table(spark, sf, "prospect"))
    return c.groupBy("source_record_id").agg(F.count("*").alias("n"))


_ALL_NAMES = "(select distinct prospect_id || chr(1) || n as k, n as v from (select prospect_id, name_raw as n from prospect union all select prospect_id, unnest(alias_names) as n from prospect) where trim(n) <> '')"
_INDEX = f"(select distinct value as block_key, split_part(k, chr(1), 1) as person_id, variant_type from ({_variants_sql(_ALL_NAMES)}) where length(value) >= 4)"


def _index(spark, sf):
    p = table(spark, sf, "prospect").select("prospect_id", "name_raw", "alias_names").dropDuplicates()
    return R.variant_index(p, "prospect_id", "name_raw", "alias_names")


@query(f"select block_key, person_id, variant_type from {_INDEX}")
def variant_index(spark, sf):
    return _index(spark, sf)


_HITS = f"(select distinct c.source_record_id, i.person_id, i.variant_type from {_INDEX} i join (select distinct source_record_id, donor_name_normalized from contribution where donor_name_normalized <> '') c on i.block_key = c.donor_name_normalized)"


def _hits(spark, sf):
    c = table(spark, sf, "contribution").where("donor_name_normalized <> ''").select("source_record_id", "donor_name_normalized").distinct()
    return R.block_join(c, "donor_name_normalized", _index(spark, sf)).select("source_record_id", "person_id", "variant_type").distinct()


@query(f"select source_record_id, person_id, variant_type from {_HITS}")
def block_join(spark, sf):
    return _hits(spark, sf)


_PRIORITY = "list_position(['nickname', 'dehyphenated', 'initial_variant', 'middle_dropped', 'suffix_stripped', 'exact'], variant_type)"


@query(f"select source_record_id, person_id, variant_type from {_HITS} qualify row_number() over (partition by source_record_id, person_id order by {_PRIORITY} desc, variant_type) = 1")
def block_join_best_variant(spark, sf):
    return R.best_variant(_hits(spark, sf), "source_record_id")


@query(f"select source_record_id, n_people from (select source_record_id, count(distinct person_id) as n_people from {_HITS} group by 1) where n_people > 1")
def collision_count(spark, sf):
    return R.collisions(_hits(spark, sf), "source_record_id", "person_id")


_DIM = "(select committee_id, arg_max(recipient_name, load_date) filter (recipient_name is not null) as committee_name, max(candidate_id) as candidate_id from contribution where committee_id <> '' group by 1)"


@query("with d as (select committee_id, max(recipient_name) as committee_name, max(nullif(trim(candidate_id), '')) as candidate_id from contribution where committee_id <> '' group by 1), k as (select nullif(trim(candidate_id), '') as candidate_id, max(office) as office from contribution where nullif(trim(candidate_id), '') is not null group by 1) select c.source_record_id, d.committee_name, k.office from (select distinct source_record_id, committee_id from contribution) c left join d using (committee_id) left join k on d.candidate_id = k.candidate_id")
def committee_enrich(spark, sf):
    c = table(spark, sf, "contribution").select("source_record_id", "committee_id", "recipient_name", F.nullif(F.trim("candidate_id"), F.lit("")).alias("candidate_id"), "office")
    committees = c.where("committee_id <> ''").groupBy("committee_id").agg(F.max("recipient_name").alias("committee_name"), F.max("candidate_id").alias("candidate_id"))
    candidates = c.where("candidate_id is not null").groupBy("candidate_id").agg(F.max("office").alias("office"))
    # both dimensions are aggregates; the planner broadcasts them while they are small
    out = c.select("source_record_id", "committee_id").distinct().join(committees, "committee_id", "left").join(candidates, "candidate_id", "left")
    return out.select("source_record_id", "committee_name", "office")


# aggregates


@query("select source_record_id, max(load_date) as load_date, count(*) as n_deliveries from contribution group by 1".replace("max(load_date) as load_date", "cast(max(load_date) as varchar) as load_date"))
def dedupe_latest_filing(spark, sf):
    c = table(spark, sf, "contribution").select("source_record_id", "load_date")
    n = c.groupBy("source_record_id").agg(F.count("*").alias("n_deliveries"))
    latest = R.latest_version(c, "source_record_id", ["load_date"])
    return latest.join(n, "source_record_id").select("source_record_id", F.date_format("load_date", "yyyy-MM-dd HH:mm:ss").alias("load_date"), "n_deliveries")


@query(
    """with r as (select distinct nonprofit_id, filing.object_id as object_id, source, person_name_normalized, coalesce(normalized_title, '') as t, amount, coalesce(city, '') <> '' or coalesce(state, '') <> '' as has_place from nonprofit_record where person_name_normalized <> '')
select object_id, source, person_name_normalized, t as normalized_title, amount, nonprofit_id, n as duplicate_count from (select *, count(*) over w as n, row_number() over (partition by object_id, source, person_name_normalized, t, amount order by has_place desc, nonprofit_id) as rn from r window w as (partition by object_id, source, person_name_normalized, t, amount)) where rn = 1"""
)
def filing_collapse(spark, sf):
    keys = ["object_id", "source", "person_name_normalized", "normalized_title", "amount"]
    has = (F.coalesce("city", F.lit("")) != "") | (F.coalesce("state", F.lit("")) != "")
    n = table(spark, sf, "nonprofit_record").where("person_name_normalized <> ''")
    n = n.select("nonprofit_id", F.coalesce("filing.object_id", F.lit("")).alias("object_id"), "source", "person_name_normalized", F.coalesce("normalized_title", F.lit("")).alias("normalized_title"), F.coalesce("amount", F.lit(-1.0)).alias("amount"), has.alias("has_place")).distinct()
    out = R.collapse_duplicates(n, keys, F.col("has_place"), [F.col("nonprofit_id")])
    return out.select(F.nullif("object_id", F.lit("")).alias("object_id"), "source", "person_name_normalized", "normalized_title", F.nullif("amount", F.lit(-1.0)).alias("amount"), "nonprofit_id", "duplicate_count")


@query("select source_record_id, donor_name_normalized, n_rows from (select distinct source_record_id, donor_name_normalized from contribution) left join (select donor_name_normalized, count(*) as n_rows from (select distinct source_record_id, donor_name_normalized from contribution) where donor_name_normalized is not null group by 1) using (donor_name_normalized) where n_rows > 1")
def name_frequency(spark, sf):
    c = table(spark, sf, "contribution").select("source_record_id", "donor_name_normalized").distinct()
    return R.with_frequency(c, "donor_name_normalized", "n_rows").where("n_rows > 1")


@query("select filing.ein as ein, person_name_normalized, count(distinct filing.tax_period_end) as n_periods from nonprofit_record where person_name_normalized <> '' group by all")
def ein_person_history(spark, sf):
    n = table(spark, sf, "nonprofit_record").where("person_name_normalized <> ''").select(F.col("filing.ein").alias("ein"), "person_name_normalized", F.col("filing.tax_period_end").alias("p"))
    return R.distinct_periods(n, ["ein", "person_name_normalized"], "p", "n_periods")


@query("select committee_id, count(*) as n, round(sum(amount), 2) as total, count(distinct source) as n_sources, array_to_string(list_sort(list(distinct source)), ',') as sources from contribution where committee_id is not null group by 1")
def committee_totals(spark, sf):
    c = table(spark, sf, "contribution").where("committee_id is not null").groupBy("committee_id")
    return c.agg(F.count("*").alias("n"), F.round(F.sum(F.col("amount").cast("decimal(18,2)")), 2).cast("double").alias("total"), F.countDistinct("source").alias("n_sources"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query(
    f"""with h as (select distinct source_record_id, person_id from {_HITS}), c as (select source_record_id, max(amount) as amount, max(source) as source from contribution group by 1)
select person_id, count(*) as n_contributions, round(sum(amount), 2) as total, array_to_string(list_sort(list(distinct source)), ',') as sources from h join c using (source_record_id) group by 1"""
)
def prospect_aggregate(spark, sf):
    h = _hits(spark, sf).select("source_record_id", "person_id").distinct()
    c = table(spark, sf, "contribution").groupBy("source_record_id").agg(F.max("amount").alias("amount"), F.max("source").alias("source"))
    g = h.join(c, "source_record_id").groupBy("person_id")
    return g.agg(F.count("*").alias("n_contributions"), F.round(F.sum(F.col("amount").cast("decimal(18,2)")), 2).cast("double").alias("total"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("select flag, count(*) as n from (select unnest(conflict_flags) as flag from nonprofit_match) where flag is not null group by 1 order by n desc, flag limit 8")
def topk_flags(spark, sf):
    f = table(spark, sf, "nonprofit_match").select(F.explode("conflict_flags").alias("flag")).where("flag is not null").groupBy("flag").agg(F.count("*").alias("n"))
    return R.top_k(f, [F.desc("n"), F.asc("flag")], 8)


@query("select prospect_id, count(*) as n_matches, max(match_confidence) as best_confidence from nonprofit_match where prospect_id is not null group by 1")
def portfolio_count(spark, sf):
    return table(spark, sf, "nonprofit_match").where("prospect_id is not null").groupBy("prospect_id").agg(F.count("*").alias("n_matches"), F.max("match_confidence").alias("best_confidence"))


@query("with d as (select org_ein, prospect_id, max(match_confidence) as best from nonprofit_match where org_ein is not null and prospect_id is not null group by all) select org_ein, prospect_id, best, n_prospects from d join (select org_ein, count(*) as n_prospects from d group by 1) using (org_ein)")
def foundation_prospects(spark, sf):
    """Membership, a row per foundation and prospect, with how many each foundation has."""
    m = table(spark, sf, "nonprofit_match").where("org_ein is not null and prospect_id is not null").groupBy("org_ein", "prospect_id").agg(F.max("match_confidence").alias("best"))
    return R.with_frequency(m, "org_ein", "n_prospects")


# set operations


@query("select source, source_record_id from contribution union all select 'snapshot', source_record_id from contribution_snapshot")
def union_sources(spark, sf):
    a = table(spark, sf, "contribution").select("source", "source_record_id")
    return a.unionByName(table(spark, sf, "contribution_snapshot").select(F.lit("snapshot").alias("source"), "source_record_id"))


@query("select match_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(evidence_signals, []), coalesce(conflict_flags, [])))), ';') as flags from (select distinct match_id, evidence_signals, conflict_flags from nonprofit_match)")
def flags_union(spark, sf):
    none = F.array().cast("array<string>")
    m = table(spark, sf, "nonprofit_match").select("match_id", "evidence_signals", "conflict_flags").distinct()
    return m.select("match_id", F.array_join(F.array_sort(F.array_union(F.coalesce("evidence_signals", none), F.coalesce("conflict_flags", none))), ";").alias("flags"))
