import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from kinsieve.operators import records
from kinsieve.plans import domain

PROSPECT = "prospect_id string, last_name string, address string, city string, state string, zip string"
PROPERTY = "address_id long, line1 string, city string, state string, zip string"


@pytest.fixture
def same_as_sql(spark, tmp_path):
    """same_as_sql(query, table=DataFrame, ...): whether a query over the tables has the rows of its SQL."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, df in tables.items():
            df.write.parquet(f"{tmp_path}/{t}.parquet")
            con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        return Counter(map(tuple, domain.QUERIES[name](spark, str(tmp_path)).collect())) == Counter(con.sql(domain.SQL[name]).fetchall())

    return run


def test_address_tiers_are_those_of_the_pairs(frame, same_as_sql):
    rng = random.Random(3)
    some = lambda *xs: rng.choice([None, "", *xs])
    typed = [f"{line}, {c}, {s} {z}" for line in ("1 Main St.", "UNKNOWN", "2 B") for c in ("Austin", "Reno") for s in ("TX", "NV", "") for z in ("78701", "")]
    prospects = [(f"P{i}", "x", rng.choice([None, " ", ",", ", ,", "1 Main St", *typed]), None, None, some("78701", "89501-1", "12")) for i in range(150)]
    properties = [(i, some("1 Main St", "2 B", ","), some("Austin", "Reno"), some("TX", "NV"), some("78701", "89501")) for i in range(150)]
    properties += [(i, None, None, None, None) for i in range(900, 910)]
    assert same_as_sql("address_tier", prospect=frame(PROSPECT, *prospects), property_address=frame(PROPERTY, *properties))


def test_address_tiers_are_counted_without_pairs(spark):
    """3.6e9 pairs of one key."""
    side = spark.range(60_000).select(F.lit("40202").alias("z"), F.when(F.col("id") < 20_000, F.col("id").cast("string")).alias("a"), F.lit("KY").alias("b"))
    got = {r.tier: r.n for r in records.count_tiers(side, side, "z", {"a": ["a"], "b": ["b"]}, "none").collect()}
    assert got == {"a": 20_000, "b": 60_000**2 - 20_000}


def test_location_support_of_odd_rows(frame, same_as_sql):
    rng = random.Random(5)
    places = lambda: (rng.choice([None, "", "1 Main St.", "2 B"]), rng.choice([None, "", "Austin", "RENO "]), rng.choice([None, "", "TX", "texas", "NV"]), rng.choice([None, "78701", "78701-2", "1"]))
    # one prospect with two spellings of a name is two rows
    prospects = [("P0", name, "1 Main St", "Austin", "TX", "78701") for name in ("Orr", "ORR")] + [(f"P{i % 40}", rng.choice(["Orr", "orr", "Lee", "", None]), *places()) for i in range(90)]
    filed = [(i, rng.choice(["ORR", "Lee", "", None]), *places(), rng.choice([None, ("Austin", "TX"), ("Reno", ""), (None, "NV")])) for i in range(90)]
    schema = "nonprofit_id long, last_name string, street string, city string, state string, zip string, filing struct<org_city string, org_state string>"
    assert same_as_sql("location_support", prospect=frame(PROSPECT, *prospects), nonprofit_record=frame(schema, *filed))


def test_pairs_of_one_key_are_spread(spark):
    side = lambda n, c: spark.range(n).select((F.col("id") % 10 > 0).alias("k"), F.col("id").alias(c))
    got = records.spread_join(side(300, "a"), side(200, "b"), "k", cell=40)
    by = Counter(r.p for r in got.where("k").select(F.spark_partition_id().alias("p")).collect())
    assert got.count() == got.distinct().count() == 270 * 180 + 30 * 20 and len(by) == 4 and max(by.values()) < 0.6 * 270 * 180
