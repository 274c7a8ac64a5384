"""Queries of the operators for training data, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsieve.llm.addresses import place_pairs, same_places
from kinsieve.llm.canonical import map_to_reference
from kinsieve.llm.leakage import find_leaks
from kinsieve.llm.packing import pack
from kinsieve.llm.persons import given_names, linked_sources, person_clusters, read_people, variant_pairs
from kinsieve.llm.spans import drop_repeated, shared_runs, stretches
from kinsieve.llm.truth import FILLERS, truth_discovery
from kinsieve.session import table

SURVIVING_FIELDS = ["irs_person_address", "person_city_state", "title", "org_ein", "amount", "tax_period"]
EARLIEST = "timestamp_ntz '0001-01-01 00:00:00'"


def _survivors(spark: SparkSession, sf: str, decisive: bool) -> DataFrame:
    m = table(spark, sf, "nonprofit_match")
    fields = {f: F.col(f) for f in SURVIVING_FIELDS}
    fields["amount"] = F.when(~F.isnan("amount"), F.col("amount"))
    rank = [F.coalesce("match_confidence", F.lit(-1)), F.coalesce(F.col("loaded_at").cast("timestamp_ntz"), F.expr(EARLIEST))]
    weight = (F.coalesce("match_confidence", F.lit(0)) + 10) / 110.0
    return truth_discovery(m, F.col("record_fingerprint"), F.col("match_id"), F.col("source_section"), fields, rank if decisive else None, weight)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _survivors(spark, sf, True).select(F.col("grp").alias("record_fingerprint"), "field_name", F.col("row_id").alias("match_id"))


def p6_voted(spark: SparkSession, sf: str) -> DataFrame:
    """The same groups where the votes decide, weighted by confidence and learnt reliability."""
    return _survivors(spark, sf, False).select(F.col("grp").alias("record_fingerprint"), "field_name", "value", F.round("support", 3).alias("support"))


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    kinds = [(r.capacity_id, r.max_tokens) for r in table(spark, sf, "pack_capacity").select("capacity_id", "max_tokens").distinct().collect()]
    return pack(table(spark, sf, "documents"), "doc_id", "n_tokens", sorted(kinds))


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf).withColumnRenamed("item_id", "doc_id")


def p8_totals(spark: SparkSession, sf: str) -> DataFrame:
    """What must come out whatever the packing: every document, every token, no overfull container."""
    caps = table(spark, sf, "pack_capacity").select("capacity_id", "max_tokens").distinct()
    bins = _packed(spark, sf).groupBy("capacity_id", "container_id").agg(F.countDistinct("item_id").alias("d"), F.sum("piece_size").alias("fill"), F.count("*").alias("n"))
    return (
        bins.join(F.broadcast(caps), "capacity_id")
        .groupBy("capacity_id")
        .agg(F.sum("n").alias("n_pieces"), F.sum("fill").alias("n_tokens"), F.sum(F.when(F.col("fill") > F.col("max_tokens"), 1).otherwise(0)).cast("bigint").alias("overfull"))
    )


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return find_leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_item"), "item_id", "text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf: str) -> DataFrame:
    """For each held-out item the documents it leaked into."""
    return _leaks(spark, sf).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    found = stretches(shared_runs(table(spark, sf, "documents"), "doc_id", "text", 40, "word"), 40)
    return found.select("doc_id", F.col("start_unit").alias("start_word"), F.col("n_units").alias("n_words"))


def p10_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each text the runs of three sentences cover that an earlier document holds."""
    return drop_repeated(table(spark, sf, "documents"), "doc_id", "text", 3, "sentence").select("doc_id", "n_units", "removed_units")


QUERIES = {
    "p6_found": p6_found,
    "p6_voted": p6_voted,
    "p8_pack": p8_pack,
    "p8_totals": p8_totals,
    "p9_found": p9_found,
    "p9_items": p9_items,
    "p10_found": p10_found,
    "p10_sentences": p10_sentences,
}

def _voted_sql(rounds: int) -> str:
    """The estimates unrolled: more rounds than are needed change nothing."""
    union = " union all ".join(f"select fp, match_id, source, w, '{f}' as field_name, {'amount_text' if f == 'amount' else f} as raw from m" for f in SURVIVING_FIELDS)
    out = f"""
with m as (select distinct lower(trim(record_fingerprint)) as fp, match_id, coalesce(source_section, '') as source, (coalesce(match_confidence, 0) + 10) / 110.0 as w,
  cast(amount as varchar) as amount_text, {", ".join(f for f in SURVIVING_FIELDS if f != "amount")} from nonprofit_match where trim(record_fingerprint) <> ''),
g as (select fp from m group by fp having count(distinct match_id) >= 2),
c as (select * from ({union}) join g using (fp) where raw is not null and regexp_matches(raw, '[\\p{{L}}\\p{{N}}]') and lower(trim(raw)) not in ({_FILLER_SQL})),
k as (select fp, field_name, match_id, source, w, raw, coalesce(nullif(regexp_replace(lower(raw), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ''), raw) as value from c),
v as (select fp, field_name, value, source, sum(cast(w as double)) as w, min(match_id) as row_id, arg_min(raw, match_id) as raw from k group by all),
t0 as (select distinct source, cast(0.75 as double) as rel from v)"""
    for n in range(rounds):
        out += f""",
s{n} as (select fp, field_name, value, round(sum(w * rel), 9) as support, min(row_id) as row_id, arg_min(raw, row_id) as raw from v join t{n} using (source) group by all),
w{n} as (select * from (select *, row_number() over (partition by fp, field_name order by support desc, row_id, raw desc, value desc) as rn from s{n}) where rn = 1),
t{n + 1} as (select source, 0.5 + 0.5 * (round(sum(case when v.value = w{n}.value then w else 0.0 end), 9) + 1) / (round(sum(w), 9) + 2) as rel from v join w{n} using (fp, field_name) group by source)"""
    return out + f" select fp as record_fingerprint, field_name, raw as value, round(support, 3) as support from w{rounds - 1}"


_FILLER_SQL = ", ".join(f"'{w}'" for w in FILLERS)
_GRAMS = r"""
with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
i as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_item),
dg as (select distinct doc_id, array_to_string(w[s:s + 9], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 8, 1))) as s from d)),
ig as (select distinct item_id, array_to_string(w[s:s + 9], ' ') as g from (select item_id, w, unnest(range(1, greatest(len(w) - 8, 1))) as s from i))
"""
SQL = {
    "p6_found": f"""
with m as (select *, lower(trim(record_fingerprint)) as fp, cast(amount as varchar) as amount_text from nonprofit_match where trim(record_fingerprint) <> ''),
b as (select fp from m group by fp having count(distinct match_id) >= 2),
c as ({" union all ".join(f"select fp, '{f}' as field_name, match_id, match_confidence, loaded_at, {'amount_text' if f == 'amount' else f} as v from m" for f in SURVIVING_FIELDS)}),
k as (select *, row_number() over (partition by fp, field_name order by coalesce(match_confidence, -1) desc, loaded_at desc nulls last, match_id) as rn
  from c join b using (fp) where v is not null and regexp_matches(v, '[\\p{{L}}\\p{{N}}]') and lower(trim(v)) not in ({_FILLER_SQL}))
select fp as record_fingerprint, field_name, match_id from k where rn = 1""".replace("\\\\p", "\\p"),
    "p6_voted": _voted_sql(8),
    "p8_totals": """
select capacity_id, cast(sum(greatest(ceil(coalesce(n_tokens, 0) / max_tokens), 1)) as bigint) as n_pieces, cast(sum(coalesce(n_tokens, 0)) as bigint) as n_tokens, cast(0 as bigint) as overfull
from documents, pack_capacity group by capacity_id""",
    "p9_found": _GRAMS + "select distinct doc_id, item_id from dg join ig using (g)",
    "p9_items": _GRAMS + "select item_id, count(distinct doc_id) as n_docs, min(doc_id) as first_doc from dg join ig using (g) group by item_id",
    "p10_sentences": r"""
with d as (select doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]*(?:[.!?]+["'')\]]*|\n|$)'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as u from documents where doc_id is not null),
r as (select doc_id, s, array_to_string(u[s:s + 2], chr(1)) as g from (select doc_id, u, unnest(range(1, greatest(len(u) - 1, 1))) as s from d)),
k as (select g, min(doc_id) as f from r group by g having min(doc_id) <> max(doc_id)),
c as (select distinct doc_id, s + o as at from (select doc_id, s, unnest([0, 1, 2]) as o from r join k using (g) where doc_id <> f))
select d.doc_id, cast(coalesce(len(u), 0) as integer) as n_units, cast(coalesce(n, 0) as integer) as removed_units from d left join (select doc_id, count(*) as n from c group by 1) using (doc_id)""",
    "p10_found": r"""
with d as (select doc_id, list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> '') as w from documents where text is not null),
r as (select doc_id, s, array_to_string(w[s:s + 39], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 38, 1))) as s from d)),
k as (select g from r group by g having min(doc_id) <> max(doc_id)),
u as (select distinct doc_id, s from r join k using (g)),
v as (select *, sum(case when s > p + 40 then 1 else 0 end) over (partition by doc_id order by s) as st from (select *, lag(s) over (partition by doc_id order by s) as p from u))
select doc_id, cast(min(s) - 1 as integer) as start_word, cast(max(s) - min(s) + 40 as integer) as n_words from v group by doc_id, st""",
}


def _latest(df: DataFrame, key: str, columns: list[str], version: str) -> DataFrame:
    """One row per key: the one loaded last (of equal ones the greatest), folded before the shuffle."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(version, *columns)).alias("r")).select(key, *[f"r.{c}" for c in columns])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    c = _latest(table(spark, sf, "contribution"), "source_record_id", ["employer_raw"], "load_date")
    p = _latest(table(spark, sf, "prospect"), "prospect_id", ["company_raw"], "updated_at")
    typed = c.select(F.lit("contribution").alias("src"), F.col("source_record_id").alias("rec_id"), F.col("employer_raw").alias("typed")).unionByName(
        p.select(F.lit("prospect").alias("src"), F.col("prospect_id").alias("rec_id"), F.col("company_raw").alias("typed"))
    )
    return map_to_reference(typed, "typed", table(spark, sf, "employer_ref")).select("src", "rec_id", "employer_id")


def addresses(spark: SparkSession, sf: str) -> DataFrame:
    p = _latest(table(spark, sf, "prospect"), "prospect_id", ["address", "city", "state", "zip"], "updated_at")
    n = _latest(table(spark, sf, "nonprofit_record"), "nonprofit_id", ["street", "city", "state", "zip"], "loaded_at")
    a = _latest(table(spark, sf, "property_address"), "address_id", ["line1", "city", "state", "zip"], "loaded_at")

    def as_records(df: DataFrame, kind: str, key: str, line: str) -> DataFrame:
        return df.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("rec"), F.col(line).alias("line"), "city", "state", "zip")

    return as_records(p, "prospect", "prospect_id", "address").unionByName(as_records(n, "nonprofit", "nonprofit_id", "street")).unionByName(as_records(a, "property", "address_id", "line1"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return place_pairs(same_places(addresses(spark, sf)))


QUERIES |= {"p2_found": p2_found, "p3_found": p3_found}


def _industries(spark: SparkSession, sf: str) -> list[str]:
    """The industries of the reference list, fixed in number."""
    return sorted(r[0] for r in table(spark, sf, "employer_ref").select("industry").distinct().collect() if r[0])


def donors(spark: SparkSession, sf: str) -> DataFrame:
    c = _latest(table(spark, sf, "contribution"), "source_record_id", ["donor_name_raw", "city", "state", "zip", "employer_raw", "occupation_raw"], "load_date")
    return c.select(
        F.concat(F.lit("contribution:"), "source_record_id").alias("rec"),
        F.col("donor_name_raw").alias("name"),
        "city",
        "state",
        "zip",
        F.array("employer_raw").alias("employers"),
        F.col("occupation_raw").alias("occupation"),
        F.lit(None).cast("string").alias("address"),
        F.lit(None).cast("string").alias("org"),
    )


def _prospects(spark: SparkSession, sf: str) -> DataFrame:
    return _latest(
        table(spark, sf, "prospect"), "prospect_id", ["name_raw", "alias_names", "company_raw", "other_companies", "address", "city", "state", "zip"], "updated_at"
    ).withColumn("employers", F.array_compact(F.array_union(F.array("company_raw"), F.coalesce("other_companies", F.array().cast("array<string>")))))


def officers(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nonprofit_record").withColumn("org_name", F.col("filing.org_name"))
    n = _latest(n, "nonprofit_id", ["person_name", "city", "state", "zip", "street", "org_name"], "loaded_at")
    return n.select(
        F.concat(F.lit("nonprofit:"), F.col("nonprofit_id").cast("string")).alias("rec"),
        F.col("person_name").alias("name"),
        "city",
        "state",
        "zip",
        F.array().cast("array<string>").alias("employers"),
        F.lit(None).cast("string").alias("occupation"),
        F.col("street").alias("address"),
        F.col("org_name").alias("org"),
    )


def aliases(spark: SparkSession, sf: str) -> DataFrame:
    p = _prospects(spark, sf)
    return p.select("*", F.posexplode("alias_names").alias("at", "name")).select(
        F.concat_ws(":", F.lit("alias"), "prospect_id", (F.col("at") + 1).cast("string")).alias("rec"),
        "name",
        "city",
        "state",
        "zip",
        "employers",
        F.lit(None).cast("string").alias("occupation"),
        "address",
        F.lit(None).cast("string").alias("org"),
    )


def name_clusters(spark: SparkSession, sf: str) -> DataFrame:
    given = given_names(table(spark, sf, "contribution"), "donor_name_raw")
    records = donors(spark, sf).unionByName(officers(spark, sf)).unionByName(aliases(spark, sf))
    return person_clusters(read_people(records, given, _industries(spark, sf)))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = variant_pairs(name_clusters(spark, sf))
    # two aliases of one prospect are no case
    of = lambda c: F.substring_index(c, ":", 2)
    return pairs.where(~(F.startswith("rec_a", F.lit("alias:")) & (of("rec_a") == of("rec_b"))))


QUERIES |= {"p1_found": p1_found}


def _linked(spark: SparkSession, sf: str) -> DataFrame:
    given, industries = given_names(table(spark, sf, "contribution"), "donor_name_raw"), _industries(spark, sf)
    p = _prospects(spark, sf).select(
        F.concat(F.lit("l:"), "prospect_id").alias("rec"),
        F.col("name_raw").alias("name"),
        "city",
        "state",
        "zip",
        "employers",
        F.lit(None).cast("string").alias("occupation"),
        "address",
        F.lit(None).cast("string").alias("org"),
    )
    c = donors(spark, sf).withColumn("rec", F.regexp_replace("rec", "^contribution", "r"))
    people = read_people(p.unionByName(c), given, industries)
    return linked_sources(people.withColumn("side", F.substring("rec", 1, 1)))


def p5_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Each match with its confidence, the marginal probability."""
    m = _linked(spark, sf).where("probability >= 0.5")
    return m.select(F.expr("substring(left_rec, 3)").alias("prospect_id"), F.expr("substring(right_rec, 3)").alias("source_record_id"), F.round("probability", 4).alias("confidence"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_matches(spark, sf).select("prospect_id", "source_record_id")


QUERIES |= {"p5_found": p5_found, "p5_matches": p5_matches}
