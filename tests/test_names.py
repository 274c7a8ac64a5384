from pyspark.sql import functions as F

from kinsieve.functions import names as N


def one(frame, value, fn, *more):
    return frame("a string, b string", (value, more[0] if more else None)).select(fn(*([F.col("a"), F.col("b")] if more else [F.col("a")])).alias("x")).first().x


def test_parse_fec_name(frame):
    p = one(frame, "SMITH, JOHN A JR", N.parse_fec_name)
    assert (p.first_name, p.middle_name, p.last_name, p.suffix, p.normalized) == ("john", "a", "smith", "jr", "john smith")
    assert one(frame, "DE LA CRUZ, MARIA", N.parse_fec_name).last_name == "de la cruz"
    for bad in ("ACTBLUE", "", None, ",", "SMITH,", "a,"):
        assert one(frame, bad, N.parse_fec_name) is None


def test_parse_person_name(frame):
    assert one(frame, "John Michael Smith Jr", N.parse_person_name).normalized_full == "john michael smith jr"
    assert one(frame, "Smith", N.parse_person_name) is None
    assert one(frame, "Mary Ann O - Neil", N.parse_person_name) is not None


def variants(frame, name):
    rows = frame("a string", (name,)).select(F.explode(N.name_variants(F.col("a"))).alias("v")).select("v.*").collect()
    out = {}
    for r in sorted(rows, key=lambda r: r.ord):
        out[r.value] = r.variant_type
    return out


def test_variants(frame):
    v = variants(frame, "Christopher Smith")
    assert "chris smith" in v and "tina smith" not in v and "christina smith" not in v
    v = variants(frame, "William Johnson")
    assert {"bill johnson", "will johnson", "billy johnson"} <= set(v)
    assert variants(frame, "John Smith Jr")["john smith"] == "exact"
    v = variants(frame, "John Michael Smith")
    assert v["john smith"] == "exact" and v["john m smith"] == "initial_variant"
    assert variants(frame, "Ann Smith-Jones")["ann smith jones"] == "dehyphenated"
    assert variants(frame, "") == {} and variants(frame, None) == {}


def test_nickname_and_priority(frame):
    d = frame("a string, b string", ("bill", "william"), ("bill", "robert"), ("ann", "ann"))
    assert [r.x for r in d.select(N.is_nickname_of(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, True]
    d = frame("a string", ("exact",), ("nickname",), ("none",))
    assert [r.x for r in d.select(N.variant_priority(F.col("a")).alias("x")).collect()] == [6, 1, 0]


def test_owners(frame):
    split = lambda v: one(frame, v, lambda c: N.split_owners(c, N.classify_owner(c)))
    assert split("SMITH JOHN & JANE") == ["SMITH JOHN", "SMITH JANE"]
    assert split("WILLIAMS ROBERT & JONES MARY ANN") == ["WILLIAMS ROBERT", "JONES MARY ANN"]
    assert split("SMITH & SONS LLC") == ["SMITH & SONS LLC"]
    p = one(frame, "JOHN A SMITH REVOCABLE TRUST", N.trust_person)
    assert (p.first_name, p.last_name) == ("john", "smith")
    p = one(frame, "SMITH JOHN A TRUSTEE", N.trust_person)
    assert (p.first_name, p.middle_name, p.last_name) == ("smith", "john", "a")
    got = one(frame, "SMITH JOHN A & JANE", N.parse_owners)
    assert [o.person.last_name for o in got] == ["smith", "smith"] and got[0].person.first_name == "john"
    assert one(frame, "SMITH HOLDINGS LLC", N.parse_owners) == []
    assert one(frame, None, N.parse_owners) == []
    kinds = {"X REVOCABLE TRUST": "trust", "X LLC": "llc", "X INC": "corporation", "ESTATE OF X": "estate", "SMITH JOHN & JANE": "individual", "A AND B": "joint", "": "unknown"}
    for text, kind in kinds.items():
        assert one(frame, text, N.classify_owner) == kind


def test_officer_and_letters(frame):
    assert one(frame, "JANE DOE AS OF MARCH 2025", N.try_person).normalized == "jane doe"
    for bad in ("VACANT", "n/a", "SEE 4", "", None):
        assert one(frame, bad, N.try_person) is None
    assert one(frame, "Doe, Jane M.D.", N.letters_only) == "doe jane m d"
    assert one(frame, "John Q Public", N.reversed_key) == "public john q"
