"""Pieces of DuckDB SQL for the queries that check the plans. RE2 knows no lookahead, so a suffix takes
the blank behind it along and gives it back."""

from __future__ import annotations

from kinsieve.functions.rules import LEGAL_SUFFIXES, NAME_SUFFIXES, NICKNAMES, STATES

_SUFFIX = rf"(?i)\b({NAME_SUFFIXES})\.?(\s|$)"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def ws(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def segment(x: str) -> str:
    return ws(rf"regexp_replace(replace(lower({x}), '.', ''), '\s*-\s*', '-', 'g')")


def stripped(x: str) -> str:
    return ws(rf"regexp_replace({x}, '{_SUFFIX}', '\2', 'g')")


def last_suffix(x: str) -> str:
    return f"coalesce(lower(regexp_extract_all({x}, '{_SUFFIX}', 1)[-1]), '')"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


_COLUMNS = """{first} as first_name, {middle} as middle_name, left({middle}, 1) as middle_initial, {last} as last_name, suf as suffix,
  {norm} as normalized, array_to_string(list_filter([{first}, {middle}, {last}, suf], lambda x: x <> ''), ' ') as normalized_full"""


def parsed(source: str, both: bool) -> str:
    """A query (k, v, first_name, ...) over source(k, v); both: names without a comma too."""
    first, middle, last = segment("p[1]"), segment("array_to_string(p[2:], ' ')"), segment("z")
    cols = _COLUMNS.format(first=first, middle=middle, last=last, norm=ws(f"concat_ws(' ', {first}, {last})"))
    fec = f"""select k, v, {cols} from (select k, v, z, {words(stripped('rest'))} as p, {last_suffix('rest')} as suf from (
      select k, v, raw[:instr(raw, ',') - 1] as z, raw[instr(raw, ',') + 1:] as rest from (select k, v, {ws("coalesce(v, '')")} as raw from {source}) where length(raw) >= 3 and contains(raw, ',')) where z <> '') where len(p) > 0"""
    if not both:
        return fec
    middle, last = segment("array_to_string(p[2:-2], ' ')"), segment("p[-1]")
    cols = _COLUMNS.format(first=first, middle=middle, last=last, norm=ws(f"concat_ws(' ', {first}, {last})"))
    plain = f"""select k, v, {cols} from (select k, v, {words(stripped('raw'))} as p, {last_suffix('raw')} as suf from (
      select k, v, {ws("coalesce(v, '')")} as raw from {source}) where length(raw) >= 3 and not contains(raw, ',')) where len(p) >= 2"""
    return f"{fec} union all {plain}"


def legal_stripped(x: str) -> str:
    return "lower(" + ws(rf"regexp_replace(regexp_replace(coalesce({x}, ''), '(?i)\b({LEGAL_SUFFIXES})\b', '', 'g'), '[.,]', '', 'g')") + ")"


def state(x: str) -> str:
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in STATES.items())
    return f"case lower(trim(coalesce({x}, ''))) {cases} else upper(trim(coalesce({x}, ''))) end"


def city(x: str) -> str:
    return ws(rf"regexp_replace(upper(coalesce({x}, '')), '[^A-Z\s]', '', 'g')")


def zip5(x: str) -> str:
    d = rf"regexp_replace(coalesce({x}, ''), '\D', '', 'g')"
    return f"case when length({d}) < 5 then '' else left({d}, 5) end"


def free(x: str) -> str:
    return ws(f"regexp_replace(replace(lower(coalesce({x}, '')), '&', ' and '), '[^a-z0-9]+', ' ', 'g')")


def classes(x: str, rules: list[tuple[str, str]], default: str) -> str:
    cases = " ".join(f"when regexp_matches({x}, '{p}') then '{k}'" for k, p in rules)
    return f"case {cases} else {default} end"


def nickname_rows() -> str:
    return ", ".join(f"('{n}', '{o}')" for n, own in sorted(NICKNAMES.items()) for o in own)
