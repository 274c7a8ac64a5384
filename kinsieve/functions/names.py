"""Names as column expressions: parsing, variants, owners. Everything stays in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinsieve.functions.rules import NAME_SUFFIXES, NICKNAMES, OWNER_ABBREVIATIONS, OWNER_KINDS

_SUFFIX = rf"(?i)\b({NAME_SUFFIXES})\.?(?=\s|\z)"
_EMPTY = "array<string>"
VARIANT_ORDER = ["nickname", "dehyphenated", "initial_variant", "middle_dropped", "suffix_stripped", "exact"]


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_segment(c: Column) -> Column:
    """Lower case, no points, no blanks around hyphens."""
    return collapse_ws(F.regexp_replace(F.replace(F.lower(c), F.lit("."), F.lit("")), r"\s*-\s*", "-"))


def strip_suffixes(c: Column) -> Column:
    return collapse_ws(F.regexp_replace(c, _SUFFIX, ""))


def last_suffix(c: Column) -> Column:
    """The last suffix in the text, '' where there is none."""
    found = F.regexp_extract_all(c, F.lit(_SUFFIX), F.lit(0))
    return F.coalesce(normalize_segment(F.try_element_at(found, F.lit(-1))), F.lit(""))


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def _parts(first: Column, middle: Column, last: Column, suffix: Column) -> Column:
    f, m, z, s = (normalize_segment(x) for x in (first, middle, last, suffix))
    return F.struct(
        f.alias("first_name"),
        m.alias("middle_name"),
        F.substring(m, 1, 1).alias("middle_initial"),
        z.alias("last_name"),
        s.alias("suffix"),
        collapse_ws(F.concat_ws(" ", f, z)).alias("normalized"),
        F.array_join(F.filter(F.array(f, m, z, s), lambda x: x != ""), " ").alias("normalized_full"),
    )


def parse_fec_name(c: Column) -> Column:
    """'LAST, FIRST MIDDLE SUFFIX' as a struct; null without a comma or without a part on either side."""
    raw = collapse_ws(F.coalesce(c, F.lit("")))
    cut = F.split(raw, ",", 2)
    last, rest = F.get(cut, F.lit(0)), F.coalesce(F.get(cut, F.lit(1)), F.lit(""))
    pieces = words(strip_suffixes(rest))
    parsed = _parts(F.get(pieces, F.lit(0)), F.array_join(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), " "), last, last_suffix(rest))
    return F.when((F.length(raw) >= 3) & F.contains(raw, F.lit(",")) & (last != "") & (F.size(pieces) > 0), parsed)


def parse_person_name(c: Column) -> Column:
    """As above where there is a comma, else 'FIRST MIDDLE LAST SUFFIX' of at least two words."""
    raw = collapse_ws(F.coalesce(c, F.lit("")))
    pieces = words(strip_suffixes(raw))
    n = F.size(pieces)
    parsed = _parts(F.get(pieces, F.lit(0)), F.array_join(F.slice(pieces, 2, F.greatest(n - 2, F.lit(0))), " "), F.get(pieces, n - 1), last_suffix(raw))
    return F.when(F.contains(raw, F.lit(",")), parse_fec_name(c)).when((F.length(raw) >= 3) & (n >= 2), parsed)


def nicknames(c: Column) -> Column:
    """The other names of the groups that a given name is in; an empty array for all others."""
    # one SQL text, as a literal map of so many calls would be slow to build
    table = F.expr("map(" + ", ".join(f"'{n}', array({', '.join(repr(o) for o in own)})" for n, own in sorted(NICKNAMES.items())) + ")")
    return F.coalesce(F.try_element_at(table, c), F.array().cast(_EMPTY))


def name_variants(c: Column) -> Column:
    """array<struct<value, variant_type, ord>> of the spellings under which a name may be recorded. A
    value may occur more than once; of equal ones the greatest ord holds."""
    cleaned = F.lower(collapse_ws(F.replace(F.coalesce(c, F.lit("")), F.lit(","), F.lit(""))))
    bare = strip_suffixes(cleaned)
    parsed = parse_person_name(c)
    none = F.array().cast("array<struct<value:string,variant_type:string,ord:int>>")

    def entry(value: Column, kind: str, order: int) -> Column:
        return F.struct(value.alias("value"), F.lit(kind).alias("variant_type"), F.lit(order).alias("ord"))

    def one(when: Column, value: Column, kind: str, order: int) -> Column:
        return F.when(when, F.array(entry(value, kind, order))).otherwise(none)

    out = [one(cleaned != "", cleaned, "exact", 0), one((bare != "") & (bare != cleaned) & (F.length(bare) >= 4), bare, "suffix_stripped", 1)]
    hyphen_last = F.contains(F.element_at(F.split(cleaned, " "), -1), F.lit("-"))
    for k, base in enumerate((cleaned, bare)):
        holds = base != "" if k == 0 else (base != "") & (bare != cleaned)
        ws = F.split(base, " ")
        n, at = F.size(ws), 10 * (k + 1)
        open_ = collapse_ws(F.replace(base, F.lit("-"), F.lit(" ")))
        out.append(one(holds & F.contains(base, F.lit("-")) & (F.length(open_) >= 4), open_, "dehyphenated", at))
        ends = F.concat_ws(" ", F.get(ws, F.lit(0)), F.get(ws, n - 1))
        out.append(one(holds & (n >= 3) & ~hyphen_last & (F.length(ends) >= 4), ends, "middle_dropped", at + 1))
        rest = F.array_join(F.slice(ws, 2, F.greatest(n - 1, F.lit(0))), " ")
        kinds = nicknames(F.get(ws, F.lit(0)))
        out.append(F.when(holds & (n >= 2), F.transform(kinds, lambda x: entry(F.concat_ws(" ", x, rest), "nickname", at + 2))).otherwise(none))
        out.append(F.when(holds & (n >= 3), F.transform(kinds, lambda x: entry(F.concat_ws(" ", x, F.get(ws, n - 1)), "nickname", at + 3))).otherwise(none))
    good = parsed.isNotNull() & (parsed["first_name"] != "") & (parsed["last_name"] != "")
    out.append(one(good, F.concat_ws(" ", parsed["first_name"], parsed["last_name"]), "exact", 30))
    with_initial = F.concat_ws(" ", parsed["first_name"], parsed["middle_initial"], parsed["last_name"])
    out.append(one(good & (parsed["middle_name"] != ""), with_initial, "initial_variant", 31))
    return F.concat(*out)


def filed_name_variants(c: Column) -> Column:
    """array<string> of the spellings under which filings may name a person. Unlike `name_variants` the
    nicknames apply to every spelling so far, and hyphens are opened behind a dropped middle name too. A
    double surname is never cut to its last part."""
    cleaned = F.lower(collapse_ws(F.replace(F.coalesce(c, F.lit("")), F.lit(","), F.lit(""))))
    bare = strip_suffixes(cleaned)
    forms = F.when((bare != cleaned) & (F.length(bare) >= 4), F.array(cleaned, bare)).otherwise(F.array(cleaned))
    double = F.contains(F.element_at(F.split(cleaned, " "), -1), F.lit("-"))
    opened = lambda x: collapse_ws(F.replace(x, F.lit("-"), F.lit(" ")))
    ws = lambda x: F.split(x, " ")
    ends = lambda x: F.concat_ws(" ", F.get(ws(x), F.lit(0)), F.element_at(ws(x), -1))
    cut = F.filter(forms, lambda x: ~double & (F.size(ws(x)) >= 3))
    cut_open = F.filter(F.transform(F.filter(forms, lambda x: F.contains(x, F.lit("-"))), opened), lambda x: ~double & (F.size(ws(x)) >= 3))
    short = F.concat(F.transform(cut, ends), F.transform(cut_open, ends))
    plain = F.concat(forms, F.transform(F.filter(forms, lambda x: F.contains(x, F.lit("-"))), opened), short, F.transform(short, opened))
    plain = F.array_distinct(F.filter(plain, lambda x: (x == cleaned) | (F.length(x) >= 4)))
    rest = lambda x: F.array_join(F.slice(ws(x), 2, F.greatest(F.size(ws(x)) - 1, F.lit(0))), " ")
    long = F.filter(plain, lambda x: F.size(ws(x)) >= 2)
    nicked = F.flatten(F.transform(long, lambda x: F.transform(nicknames(F.get(ws(x), F.lit(0))), lambda n: F.concat_ws(" ", n, rest(x)))))
    nicked_ends = F.flatten(F.transform(F.filter(long, lambda x: F.size(ws(x)) >= 3), lambda x: F.transform(nicknames(F.get(ws(x), F.lit(0))), lambda n: F.concat_ws(" ", n, F.element_at(ws(x), -1)))))
    return F.filter(F.array_distinct(F.concat(plain, F.filter(F.concat(nicked, nicked_ends), lambda x: F.length(x) >= 4))), lambda x: x != "")


def is_nickname_of(a: Column, b: Column) -> Column:
    x, y = F.lower(a), F.lower(b)
    return (x == y) | F.array_contains(nicknames(x), y)


def variant_priority(kind: Column) -> Column:
    """Greater is nearer to the name as written; 0 for an unknown kind."""
    out = F.lit(0)
    for n, k in enumerate(VARIANT_ORDER, 1):
        out = F.when(kind == k, n).otherwise(out)
    return out


def reversed_key(c: Column) -> Column:
    """'last first ...' of a name of two words or more."""
    ws = words(F.lower(collapse_ws(c)))
    return F.when(F.size(ws) >= 2, F.concat_ws(" ", F.element_at(ws, -1), F.array_join(F.slice(ws, 1, F.size(ws) - 1), " ")))


def expand_abbreviations(c: Column) -> Column:
    """struct<cleaned, found>: owner abbreviations written out, and which were there, in order."""
    text, found = c, []
    for short, long in OWNER_ABBREVIATIONS.items():
        found.append(F.when(F.regexp_like(text, F.lit(rf"\b{short}\b")), F.lit(short)))
        text = F.regexp_replace(text, rf"\b{short}\b", long)
    return F.struct(collapse_ws(text).alias("cleaned"), F.array_compact(F.array(*found)).alias("found"))


def classify_owner(c: Column) -> Column:
    out = F.lit("individual")
    for kind, pattern in reversed(OWNER_KINDS):
        out = F.when(F.regexp_like(c, F.lit(f"(?i){pattern}")), F.lit(kind)).otherwise(out)
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit("unknown")).otherwise(out)


def split_owners(c: Column, kind: Column) -> Column:
    """The owners in one field; later ones of one or two words take the surname of the first."""
    parts = F.filter(F.transform(F.split(c, r"(?i)\s+(?:&|AND)\s+"), lambda x: F.trim(x)), lambda x: x != "")
    surname = F.get(F.split(F.trim(F.get(parts, F.lit(0))), r"\s+"), F.lit(0))

    def named(x, i):
        ws = F.split(x, r"\s+")
        short = (i > 0) & (F.size(ws) <= 2) & ~F.contains(F.get(ws, F.lit(0)), F.lit(",")) & (surname != "")
        return F.when(short, collapse_ws(F.concat_ws(" ", surname, x))).otherwise(x)

    alone = kind.isin("llc", "corporation") | ~F.regexp_like(c, F.lit(r"(?i)\s(&|AND)\s")) | (F.size(parts) < 2)
    return F.when(alone, F.array(F.trim(c))).otherwise(F.transform(parts, named))


def trust_person(c: Column) -> Column:
    """The person behind a trust's or trustee's name, parsed; null where the name holds none."""
    trustee = F.regexp_extract(c, r"(?i)^(.+?)\s+(?:TTEE|TR|TRS|TRUSTEE|TRUSTEES)\z", 1)
    trust = F.regexp_extract(c, r"(?i)^(.+?)\s+(?:REVOCABLE|IRREVOCABLE|LIVING|FAMILY)\s+TRUST", 1)
    return F.when(trustee != "", parse_person_name(trustee)).when(trust != "", parse_person_name(trust))


def parse_last_first(c: Column) -> Column:
    """'LAST FIRST MIDDLE' without a comma."""
    ws = words(collapse_ws(c))
    turned = F.concat_ws(" ", F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, 1, 1))
    return F.when(F.size(ws) >= 2, parse_person_name(turned))


def parse_owners(c: Column) -> Column:
    """array<struct<raw, person, extracted_from>> of an owner field: care-of tails cut, abbreviations
    written out, firms left out, trusts and estates resolved, joint owners split."""
    initial = collapse_ws(F.coalesce(c, F.lit("")))
    bare = F.trim(F.get(F.split(initial, r"(?i)\s+(?:%|C/O)\s+"), F.lit(0)))
    cleaned = expand_abbreviations(F.upper(bare))["cleaned"]
    kind = classify_owner(cleaned)
    estate = F.trim(F.regexp_replace(cleaned, r"(?i)\bESTATE OF\b", ""))

    def entry(raw, person, source):
        return F.struct(raw.alias("raw"), person.alias("person"), source.alias("extracted_from"))

    owners = split_owners(cleaned, kind)
    # the text was upper-cased, so only a comma tells 'LAST, FIRST' from 'LAST FIRST'
    people = F.transform(
        owners,
        lambda x: entry(
            x,
            F.when(F.contains(x, F.lit(",")), parse_person_name(x)).otherwise(F.coalesce(parse_last_first(x), parse_person_name(x))),
            F.when(F.size(owners) > 1, F.lit("co_owner")).otherwise(F.lit("direct")),
        ),
    )
    found = (
        F.when((initial == "") | kind.isin("llc", "corporation"), F.filter(people, lambda x: F.lit(False)))
        .when(kind == "trust", F.array(entry(cleaned, trust_person(cleaned), F.lit("trust_name"))))
        .when(kind == "estate", F.array(entry(initial, parse_person_name(estate), F.lit("trustee_field"))))
        .otherwise(people)
    )
    return F.filter(found, lambda x: x["person"].isNotNull())


def try_person(c: Column) -> Column:
    """A filed officer's name, parsed: dates after it cut off, entries that name nobody and entries with
    digits refused."""
    text = collapse_ws(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\s+AS\s+OF\s+\w+\s+\d{4}\s*\z", ""))
    nobody = F.upper(text).isin("VACANT", "NONE", "N/A", "NA", "NOT APPLICABLE", "TBD", "UNKNOWN")
    return F.when((F.length(text) >= 3) & ~nobody & ~F.regexp_like(text, F.lit(r"\d")), parse_person_name(text))


def full_name(first: Column, nickname: Column, middle: Column, last: Column, suffix: Column) -> Column:
    """A name from its fields, missing ones left out."""
    return collapse_ws(F.concat_ws(" ", *[F.nullif(F.trim(x), F.lit("")) for x in (first, nickname, middle, last, suffix)]))


def letters_only(c: Column) -> Column:
    """Lower case letters and blanks without suffix words, for counting distinct people."""
    ws = words(collapse_ws(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z ]", " ")))
    return F.array_join(F.filter(ws, lambda w: ~w.isin("jr", "sr", "ii", "iii", "iv", "md", "phd", "esq", "mr", "mrs", "ms", "dr")), " ")
