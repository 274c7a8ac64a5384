import json

from pyspark.sql import functions as F

from kinsieve.operators import textcontext as T
from kinsieve.sources import paging


def test_context(frame):
    def one(text, fn, *more):
        return frame("t string", (text,)).select(fn(F.col("t"), F.expr("locate('jane doe', lower(t))"), F.lit(8), *more).alias("x")).first().x

    assert one("met Jane Doe, who", T.at_word_boundaries) and not one("met Jane Doeson", T.at_word_boundaries) and one("Jane Doe", T.at_word_boundaries)
    assert one("the report names Jane Doe among others", T.in_prose) and not one("X1 Jane Doe Y2", T.in_prose)
    assert one("#%$#@^&*(^%$#@!~~~~ Jane Doe ^%$#@!^&*()_+|}{", T.in_encoded_section) and not one("the filing shall name Jane Doe as officer of the company", T.in_encoded_section)
    assert one("signed Jane Doe, attorney-in-fact for John", T.signed_for) and not one("/s/ Jane Doe", T.signed_for)
    assert one("Mary Jane Doe spoke", T.part_of_longer_name) and one("Jane Doe Smith spoke", T.part_of_longer_name) and not one("CEO Jane Doe spoke", T.part_of_longer_name)
    acme = F.lit("Acme Steel Inc")
    assert one("Jane Doe, president of Zenith Mills, said", T.with_another_firm, acme) and not one("Jane Doe, president of Acme Steel, said", T.with_another_firm, acme)
    assert one("Jane Doe - Zenith Mills", T.with_another_firm, acme) and not one("Jane Doe, formerly president of Zenith Mills", T.with_another_firm, acme)
    texts = frame("id int, body string", (1, "the report names Jane Doe among the other officers of the company"), (2, "Mary Jane Doe"), (3, None))
    found = frame("text_id int, pattern string, company string", (1, "jane doe", "Acme"), (2, "jane doe", None), (3, "jane doe", None))
    assert {r.text_id: r.credible for r in T.credible_mentions(found, texts, "id", "body").collect()} == {1: True, 2: False}
    # every place is tested, not the first one only
    twice = frame("id int, body string", (1, "Mary Jane Doe spoke. " + "x" * 3000 + " Later the report names Jane Doe among the other officers of the company"))
    got = T.credible_mentions(found.where("text_id = 1"), twice, "id", "body").orderBy("place").collect()
    assert [(r.place, r.credible) for r in got] == [(6, False), (3046, True)]


def test_paging(spark, frame, tmp_path):
    def fetch(url, key):
        if key == "bad":
            return 401, ""
        return (500, "") if url.endswith("3") else (200, json.dumps({"url": url}))

    requests = frame("page_key string, page int, url string", *[("a", i, f"u{i}") for i in range(1, 5)])
    got = {r.page: (r.status, r.body is not None, r.attempts) for r in paging.fetch_pages(requests, fetch, ["bad", "good"], sleep=lambda s: None).collect()}
    assert got[3] == (500, False, 4) and all(got[i][:2] == (200, True) for i in (1, 2, 4))
    cache = str(tmp_path / "cache")
    assert paging.scan(spark, requests, cache, fetch, ["good"], sleep=lambda s: None).count() == 3
    assert [r.page for r in paging.resume(requests, spark.read.parquet(cache)).collect()] == [3]
    pages = {"a": {"n": 1, "next": "b"}, "b": {"n": 2}}
    assert paging.follow_links("a", lambda u, k: (200, json.dumps(pages[u])), "")[1] == "complete"
    assert paging.follow_links("a", lambda u, k: (200, json.dumps(pages[u])), "", most=1)[1] == "partial"


def test_command_line(spark, tmp_path):
    from kinsieve.__main__ import main

    (tmp_path / "p.csv").write_text("prospect_id,name,company,city,state,zip\nP1,Jane Doe,Acme Inc,Reno,NV,89501\n")
    line = "C1|N|Q1|P|1|15|IND|DOE, JANE|RENO|NV|89501|ACME INC|BOSS|03042025|250||t|1|||99"
    (tmp_path / "lines.txt").write_text(line + "\n")
    assert main(["contributions", "--prospects", str(tmp_path / "p.csv"), "--input", str(tmp_path / "lines.txt"), "--output", str(tmp_path / "out")]) == 0
    rows = spark.read.csv(str(tmp_path / "out" / "rows"), header=True).collect()
    assert [(r.prospect_id, r.employer_status, r.location_status) for r in rows] == [("P1", "confirmed", "zip_match")]
    assert main(["validate", "--prospects", str(tmp_path / "p.csv"), "--output", str(tmp_path / "bad")]) == 0
