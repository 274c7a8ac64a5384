import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinsieve.operators.snapshot_diff import snapshot_diff
from kinsieve.sources.grammar import FEC_SCHEMA, PROSPECT_CSV_SCHEMA, is_calendar_day, parse_files, parse_lines, parse_record, parse_text

SNAP = "n int, k string, v string, w string, t int, changed_fields string"


def diff(df):
    out = snapshot_diff(df, "k", "n", {"v": F.col("v"), "w": F.col("w")}, version="t")
    return {(r.record_key, r.snapshot_no): (r.change_kind, tuple(r.changed_fields)) for r in out.collect()}


def test_snapshot_diff(frame):
    rows = [
        (1, "same", "a", None, 1, "x"), (2, "same", "a", "", 9, "y"), (2, "same", "a", "", 9, "y"),
        (1, "gone", "a", "b", 1, None), (2, "new", "a", "b", 1, None), (1, "mod", "a", "b", 1, None), (2, "mod", "c", "b", 2, None), (2, "mod", "a", "b", 1, None),
        (2, None, "a", "b", 1, None),
    ]
    assert diff(frame(SNAP, *rows)) == {("gone", 2): ("removed", ()), ("new", 2): ("added", ()), ("mod", 2): ("changed", ("v",))}


def test_snapshot_diff_gaps_and_empty(frame, spark):
    assert diff(spark.createDataFrame([], SNAP)) == {}
    assert diff(frame(SNAP, (1, "a", "x", "", 1, None))) == {}
    assert diff(frame(SNAP, (1, "a", "x", "", 1, None), (5, "b", "x", "", 1, None))) == {("a", 5): ("removed", ()), ("b", 5): ("added", ())}


def test_snapshot_diff_hot_key(spark):
    base = spark.range(3000).select(((F.col("id") % 2) + 1).cast("int").alias("n"), F.lit("hot").alias("k"), F.col("id").cast("string").alias("v"), F.lit("w").alias("w"), F.col("id").cast("int").alias("t"))
    assert diff(base) == {("hot", 2): ("changed", ("v",))}


def csv(line):
    return parse_record(line, PROSPECT_CSV_SCHEMA).reason


def test_csv_grammar():
    assert csv('X1,"Doe, Jane",Acme,"1 Main\nApt 2",Reno,NV') is None
    assert csv('X1,"Jane ""J"" Doe",,,,') is None
    assert csv('X1,Jane Doe,a,b,c,"NV') == "broken_quoting"
    assert csv('X1,Jane "J" Doe,a,b,c,NV') == "broken_quoting"
    assert csv('X1,"Jane" Doe,a,b,c,NV') == "broken_quoting"
    assert csv("X1,Jane Doe,a,b,c") == "wrong_column_count"
    assert csv(None) == csv("") == "wrong_column_count"
    assert csv(" ,Jane Doe,a,b,c,NV") == csv("X1,Jane,a,b,c,NV") == csv("X1,Jane Doe,a,b,c,nv") == "invalid_value"
    assert csv("X1,Jane Doe,a,b,c, NV ") is None
    assert parse_record('X1,"Doe, J",,,,', PROSPECT_CSV_SCHEMA).cells[1] == "Doe, J"


def fec(**over):
    cells = dict.fromkeys(FEC_SCHEMA.names, "")
    cells |= {"entity": "IND", "name": "DOE, JANE", "state": "NV", "zip": "89501", "date": "02282025", "amount": "25.00", "sub_id": "1"} | over
    return parse_record("|".join(cells.values()), FEC_SCHEMA).reason


def test_fec_grammar():
    assert fec() is None and fec(date="", zip="", state="", entity="") is None and fec(memo_text='say "hi') is None and fec(amount="-5") is None
    for bad in ({"date": "02302025"}, {"date": "2025-01-01"}, {"amount": "1.234"}, {"amount": ""}, {"amount": "."}, {"zip": "8950"}, {"state": "Nv"}, {"entity": "XXX"}, {"name": " "}, {"sub_id": "1a"}):
        assert fec(**bad) == "invalid_value", bad
    assert parse_record("a|b", FEC_SCHEMA).reason == "wrong_column_count"
    assert is_calendar_day("02292024") and not is_calendar_day("02292025") and not is_calendar_day("01010000")


def test_recovery_behind_a_broken_quote():
    text = 'X1,Jane Doe,a,b,c,NV\nX2,"Jane Doe,a,b,c,NV\nX3,Jon Roe,"a\nX9,b",b,c,NV\n\nX4,Jim Poe,a,b,c\nX5,Jo Low,a,b,c,NV'
    got = [(p.cells[0] if p.cells else None, p.reason) for _, p in parse_text(text, PROSPECT_CSV_SCHEMA)]
    assert got == [("X1", None), (None, "broken_quoting"), ("X3", None), (None, "wrong_column_count"), ("X5", None)]
    assert list(parse_text(None, PROSPECT_CSV_SCHEMA)) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",)), max_size=12), min_size=6, max_size=6))
def test_quoted_round_trip(cells):
    line = ",".join('"' + c.replace('"', '""') + '"' for c in cells)
    p = parse_record(line, PROSPECT_CSV_SCHEMA)
    assert p.reason in (None, "invalid_value") and (p.cells is None or list(p.cells) == cells)


def test_parse_lines_and_files(frame, spark):
    d = frame("raw_ref string, line string, cells string", ("a", "X1,Jane Doe,a,b,c,NV", "z"), ("b", None, None), ("c", "é" * 70000, None))
    got = {r.raw_ref: r.reason for r in parse_lines(d, "raw_ref", "line", PROSPECT_CSV_SCHEMA).collect()}
    assert got == {"a": None, "b": "wrong_column_count", "c": "wrong_column_count"}
    assert parse_lines(spark.createDataFrame([], "raw_ref string, line string"), "raw_ref", "line", FEC_SCHEMA).count() == 0
    f = parse_files(frame("name string, text string", ("f", "X1,Jane Doe,a,b,c,NV\nX2,J,a,b,c,NV")), "name", "text", PROSPECT_CSV_SCHEMA)
    assert [(r.raw_ref, r.reason) for r in f.collect()] == [("f:0", None), ("f:21", "invalid_value")]


def test_operators(frame):
    from kinsieve.operators import changes as C
    from kinsieve.operators import records as R
    from kinsieve.operators import textsearch as T

    m = frame("v double", 5.0, 1.0, 9.0, 2.0, None)
    assert R.upper_median(m, "v").first().median == 5.0
    d = frame("k string, t int, v string", ("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, "z"), (None, 3, "n"))
    assert {(r.k, r.v) for r in R.latest_version(d, "k", ["t"]).collect()} == {("a", "y"), ("b", "z")}
    docs = frame("id int, text string", (1, "We met Jane Doe, then JANE DOE again"), (2, ""), (3, None))
    found = T.search(docs, "id", "text", frame("p string", "jane doe", "doe then"), "p", [2]).collect()
    assert {(r.text_id, r.pattern, r["at"]) for r in found} == {(1, "jane doe", 2), (1, "jane doe", 5), (1, "doe then", 3)}
    near = T.nearest(frame("k int, at int", (1, 10), (1, 50), (2, 1)), frame("k int, at int", (1, 20), (1, 48)), ["k"])
    assert [(r.k, r.distance) for r in near.collect()] == [(1, 2)]
    cur = frame("id string, o string, s string", ("1", "a", "x"), ("2", "b", None), ("3", "c", "y"))
    pri = frame("id string, o string, s string", ("1", "a", "z"), ("2", "b", None))
    got = {r.id: r.change_type for r in C.classify_changes(cur, pri, "id", {"owner_change": ["o"], "sale_update": ["s"]}).collect()}
    assert got == {"1": "sale_update", "2": "no_change", "3": "new_to_cache"}
    w = C.advance_watermarks(frame("fips string, last_completed string", ("1", "2025-01-01"), ("2", "2025-01-01")), frame("fips string, status string, start_date string, end_date string", ("1", "complete", "2025-01-02", "2025-01-08"), ("2", "partial", "2025-01-02", "2025-01-08")), "fips")
    assert {(r.fips, r.last_completed, r.status) for r in w.collect()} == {("1", "2025-01-08", "complete"), ("2", "2025-01-01", "partial")}


def test_dates_are_days():
    assert dt.date(2024, 2, 29)
