"""Relational operators over records: latest version, collapse, frequencies, blocking, enrichment.

All keys go by hash; duplicates fold in partial aggregates or window group limits, so a hot key costs
rows only where the result has them. Null keys never match.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinsieve.functions.names import name_variants, variant_priority
from kinsieve.session import partitions


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by `order`, which must end in something unique. The planner limits
    each partition's groups before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def latest_version(df: DataFrame, key: str, version: list[str]) -> DataFrame:
    """One row per key, all columns: the greatest by `version`; of equal ones the greatest values. It is
    a partial aggregate, so redeliveries of a hot key fold before the shuffle."""
    plain = [c for c, t in df.dtypes if not t.startswith("map") and c not in (key, *version)]
    held = [c for c, t in df.dtypes if t.startswith("map")]
    best = F.max_by(F.struct(*plain, *held, *version), F.struct(*version, *plain)).alias("_best")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, "_best.*").select(*df.columns)


def collapse_duplicates(df: DataFrame, keys: list[str], prefer: Column, order: list[Column]) -> DataFrame:
    """One row per key and how many there were: the first row for which `prefer` holds, else the first."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("duplicate_count"))
    return keep_best(df, keys, [prefer.cast("int").desc(), *order]).join(counts, keys)


def with_frequency(df: DataFrame, key: str, name: str) -> DataFrame:
    """How many rows share the key: an aggregate joined back, which a hot key does not skew as a window
    would."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name))
    return df.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def distinct_periods(df: DataFrame, keys: list[str], period: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.countDistinct(period).alias(name))


def variant_index(people: DataFrame, person_id: str, name: str, aliases: str | None = None, shortest: int = 4) -> DataFrame:
    """(block_key, person_id, variant_type): every spelling under which a person may be recorded, of the
    name and of the aliases. Of one spelling of one name the last rule names its kind."""
    names = people.select(F.col(person_id).alias("person_id"), F.col(name).alias("n"))
    if aliases:
        names = names.unionByName(people.select(F.col(person_id).alias("person_id"), F.explode(aliases).alias("n")))
    spelled = names.where("trim(n) <> ''").distinct().select("person_id", "n", F.explode(name_variants(F.col("n"))).alias("v"))
    last = spelled.groupBy("person_id", "n", F.col("v.value").alias("block_key")).agg(F.max_by("v.variant_type", "v.ord").alias("variant_type"))
    return last.where(F.length("block_key") >= shortest).select("block_key", "person_id", "variant_type").distinct()


def block_join(records: DataFrame, key: str, index: DataFrame) -> DataFrame:
    """Records by the people who may be named by their key. The index goes by hash or broadcast as its
    size tells the planner; a popular name is split by adaptive execution."""
    return records.join(index.withColumnRenamed("block_key", key), key)


def best_variant(hits: DataFrame, record_id: str) -> DataFrame:
    """One hit per record and person, the one nearest to the name as written."""
    return keep_best(hits, [record_id, "person_id"], [variant_priority(F.col("variant_type")).desc(), F.col("variant_type")])


def new_rows(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Rows whose key the earlier delivery did not have."""
    return current.join(previous.select(key).distinct(), key, "left_anti")


def only_known(records: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """Rows whose key is among the known ones, as a semi join."""
    return records.join(known.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_semi")


def collisions(matches: DataFrame, record_key: str, person: str) -> DataFrame:
    """Records claimed for more than one person, with how many."""
    return matches.groupBy(record_key).agg(F.countDistinct(person).alias("n_people")).where("n_people > 1")


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows by an order that ends in something unique: a bounded heap per task."""
    return df.orderBy(*order).limit(k)


def upper_median(df: DataFrame, value: str, buckets: int = 4096) -> DataFrame:
    """(median, n_values): the element at n/2, counted from 0, of the sorted numbers, exactly; null and 0
    where there is none. Counts per bucket of the range tell which bucket holds it, and its range is cut
    again until it is one value. The driver sees counts of at most `buckets` rows a round."""
    spark = df.sparkSession
    v = df.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    lo, hi, total = v.agg(F.min("v"), F.max("v"), F.count("*")).first()
    before, at = 0, total // 2
    while total and lo < hi:
        bucket = F.least(F.floor((F.col("v") - lo) / (hi - lo) * buckets), F.lit(buckets - 1))
        counts = v.where(F.col("v").between(lo, hi)).groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        for r in sorted(counts.collect()):
            if before + r.n > at:
                lo, hi = r.lo, r.hi
                break
            before += r.n
    return spark.createDataFrame([(lo, total)], "median double, n_values bigint")


def grants_of_matched(matches: DataFrame, grants: DataFrame, ein: str, person: str, order: list[Column]) -> DataFrame:
    """grants joined by EIN to the foundations that somebody was matched to: how many people, the first of
    them by `order`, and whether the link is ambiguous. People fold to one row per foundation before the
    join; a list of all of them would have no bound (it is matches itself)."""
    best = keep_best(matches.where(F.col(ein) != ""), [ein, person], [*order, F.asc(person)])
    first = keep_best(best, [ein], [*order, F.asc(person)]).select(ein, F.col(person).alias("first_" + person))
    counts = best.groupBy(ein).agg(F.count("*").alias("n_people"))
    status = F.when(F.col("n_people") > 1, "ambiguous_foundation_link").otherwise("verified_foundation_link")
    return grants.join(counts.join(first, ein), ein).withColumn("link_status", status)


def first_delivery(rows: DataFrame, key: str, day: str, days: int = 90) -> DataFrame:
    """Where nothing was delivered before, only dated rows of the last `days` before the newest count."""
    newest = rows.agg(F.max(day).alias("_newest"))
    return rows.where(F.col(day).isNotNull()).join(F.broadcast(newest)).where(F.col(day) >= F.date_sub("_newest", days)).drop("_newest").dropDuplicates([key])


def since_cursor(rows: DataFrame, key: str, posted: str, cursor: str | None, seen: DataFrame, overlap: int = 1, days: int = 90) -> DataFrame:
    """Rows from a day before the cursor on that were not seen yet; without a cursor those of the last days."""
    if cursor is None:
        return first_delivery(rows, key, posted, days)
    return new_rows(rows.where(F.col(posted) >= F.date_sub(F.lit(cursor).cast("date"), overlap)), seen, key)


def spread_join(left: DataFrame, right: DataFrame, key: str, cell: int = 1000) -> DataFrame:
    """left.join(right, key) where all pairs of a key are wanted: a key's pairs are laid out in cells of about
    `cell` rows of either side, a task has some of them, and a row goes to each cell of its line. Tables of
    few bytes and many pairs are so spread over all tasks, however the pairs fall on keys."""
    count = lambda df, n: df.groupBy(key).agg(F.ceil(F.count("*") / cell).cast("int").alias(n))
    sizes = count(left, "_a").join(count(right, "_b"), key)
    width = partitions(left.sparkSession)

    def dealt(df: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        at = F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), F.col(own)).cast("int")
        rows = df.join(sizes, key).select(*df.columns, at.alias(names[0]), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(names[1]))
        return rows.repartition(width, key, "_i", "_j")

    return dealt(left, "_a", "_b", ("_i", "_j")).join(dealt(right, "_b", "_a", ("_j", "_i")), [key, "_i", "_j"]).drop("_i", "_j")


def count_tiers(left: DataFrame, right: DataFrame, key: str, tiers: dict[str, list[str]], rest: str) -> DataFrame:
    """(tier, n): the pairs of left and right with one key by the first tier whose columns agree, null
    agreeing with nothing; `rest` for pairs that agree in none. Tiers without a pair have no row.

    No pair is formed. The pairs that agree in all columns of some tiers at once are counted from how often
    either side has the values, and the first tier follows by inclusion and exclusion.
    """
    columns = list(dict.fromkeys(c for own in tiers.values() for c in own))
    names = list(tiers)
    on = [key, "at", *[f"c{i}" for i in range(len(columns))]]
    subsets = [s for n in range(len(names) + 1) for s in combinations(range(len(names)), n)]

    def counted(df: DataFrame, n: str) -> DataFrame:
        alike = df.where(F.col(key).isNotNull()).groupBy(key, *columns).agg(F.count("*").alias("n"))
        shapes = []
        for at, subset in enumerate(subsets):
            used = {c for i in subset for c in tiers[names[i]]}
            shape = F.struct(F.lit(at).alias("at"), *[(F.col(c) if c in used else F.lit("")).alias(f"c{i}") for i, c in enumerate(columns)])
            shapes.append(F.when(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in sorted(used)], F.lit(True)), shape))
        rows = alike.select(key, "n", F.explode(F.array_compact(F.array(*shapes))).alias("s")).select(key, "n", "s.*")
        return rows.groupBy(*on).agg(F.sum("n").alias(n))

    agreeing = counted(left, "nl").join(counted(right, "nr"), on).groupBy("at").agg(F.sum(F.col("nl") * F.col("nr")).alias("n"))
    # a set of tiers counts for its last one, and against what is left, with the sign of its size
    share = lambda tier, sign: F.struct(F.lit(tier).alias("tier"), F.lit(sign).alias("sign"))
    shares = [F.array(*[share(names[s[-1]], -((-1) ** len(s)))] if s else [], share(rest, (-1) ** len(s))) for s in subsets]
    signed = agreeing.select("n", F.explode(F.get(F.array(*shares), F.col("at"))).alias("s")).groupBy("s.tier").agg(F.sum(F.col("n") * F.col("s.sign")).alias("n"))
    return signed.where("n > 0")
