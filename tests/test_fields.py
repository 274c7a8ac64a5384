import datetime as dt

import pytest
from pyspark.sql import functions as F

from kinsieve.functions import fields as X


def values(frame, schema, rows, fn):
    names = [p.split()[0] for p in schema.split(", ")]
    return [r.x for r in frame(schema, *rows).select(fn(*map(F.col, names)).alias("x")).collect()]


def test_employers(frame):
    got = values(frame, "a string, b string", [("Google", "GOOGLE INC"), ("Google", "Microsoft"), ("Google", "RETIRED"), ("Google", ""), (None, "X"), ("Acme Labs", "Acme"), ("Acme Labs", "Acme Steel")], X.employer_status)
    assert got == ["confirmed", "mismatch", "non_informative", "missing", "missing", "likely", "weak_overlap"]
    assert values(frame, "a string", [("Google Inc.",), ("Smith & Co.",), (None,)], X.strip_legal_suffixes) == ["google", "smith &", ""]
    best = values(frame, "a array<string>, b string", [(["Acme", "Google LLC"], "google"), ([], "google"), ([None, ""], "x")], X.best_employer)
    assert best[0].company == "Google LLC" and best[0].status == "confirmed" and best[1] is None and best[2] is None


def test_places(frame):
    assert values(frame, "a string", [("kentucky",), ("ky",), ("Narnia",), (None,)], X.normalize_state) == ["KY", "KY", "NARNIA", ""]
    assert values(frame, "a string", [("St. Louis",)], X.normalize_city) == ["ST LOUIS"]
    assert values(frame, "a string", [("40202-1234",), ("1234",), (None,)], X.normalize_zip5) == ["40202", "", ""]
    schema = "a string, b string, c string, d string, e string, f string"
    rows = [("X", "KY", "40202", "Y", "OH", "40202-1"), ("X", "KY", "", "x", "Kentucky", ""), ("X", "KY", "", "Y", "KY", ""), ("X", "KY", "", "X", "OH", ""), ("X", "", "", "X", "KY", "40202"), (None,) * 6]
    assert values(frame, schema, rows, X.location_status) == ["zip_match", "city_state_match", "state_match", "state_mismatch", "city_match", "no_data"]


def test_addresses(frame):
    a = values(frame, "a string", [("1 Main St., Austin, TX 78701",), ("1 Main St",), ("",), (None,)], X.normalize_address)
    assert a[0].normalized_key == "1 MAIN ST|AUSTIN|TX|78701" and a[1].line1 == "1 MAIN ST" and a[2] is None and a[3] is None
    rows = [("UNKNOWN, Austin, TX", "2 B, Austin, TX 1", "3 C, Reno, NV"), ("UNKNOWN, Austin, TX", "2 B, Reno, NV", "3 C, Austin, TX"), ("UNKNOWN, Austin, TX", "2 B, Waco, TX", None), ("1 A, Austin, TX 78701", "1 A, Austin, TX 78701", None), (None, "x", "y")]
    assert values(frame, "a string, b string, c string", rows, X.address_tier) == ["mailing_city_state", "situs_city_state", "mailing_state", "mailing_exact", "mismatch"]


def test_text_and_dates(frame):
    assert values(frame, "a string, b string", [("Trustee", "officer"), ("", "donor"), ("CFO", ""), ("Nurse", ""), ("Clerk", ""), (None, None)], X.title_class) == ["board_trustee", "board_trustee", "senior_staff", "professional_staff", "frontline_or_operational", "frontline_or_operational"]
    assert values(frame, "a string", [("Attorney",), ("RETIRED",), ("Wizard",), (None,)], X.occupation_class) == ["legal", None, None, None]
    assert values(frame, "a string, b string", [("Acme Inc", "ACME"), ("Acme Steel Works", "Acme Steel Mill"), ("Acme", "Zenith"), ("", "x")], X.org_agreement) == ["equal", "two_tokens", "none", "none"]
    assert values(frame, "a string, b string", [("Smithson", "Smithson Family Fund"), ("Li", "Li Family Fund"), (None, None)], X.names_family_foundation) == [True, False, False]
    days = values(frame, "a string", [("2025-01-31",), ("2025/01/31",), ("1/31/2025",), ("01312025",), ("20250131",), ("13312025",), ("",), (None,)], X.parse_date)
    assert days == [dt.date(2025, 1, 31)] * 5 + [None] * 3
    assert values(frame, "a double", [(1234.5,), (None,)], X.format_currency) == ["$1,234.50", "$0.00"]
    assert values(frame, "a string", [("$1,200",), ("x",), (None,)], X.safe_number) == [1200.0, 0.0, 0.0]
    assert values(frame, "a array<string>", [(["B", "a", ""],)], X.owner_fingerprint) == ["a|b"]
    assert values(frame, "a date", [(dt.date(2025, 1, 31),)], X.next_day) == ["2025/02/01"]


@pytest.mark.parametrize("parts,key", [(("a", None, " "), "a|-|-")])
def test_record_key(frame, parts, key):
    assert values(frame, "a string, b string, c string", [parts], X.record_key) == [key]
