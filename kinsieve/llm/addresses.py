"""Same postal address written differently: rewrites are mined, applied, and mined again.

1. Addresses are read (`places.read_address`) into zip, number, unit and street words.
2. Two forms that agree in zip, number and all street words but one show how that word is written:
   each such slot is a vote for its pair of words. A pair is kept if the words share their slots
   significantly more often than chance (log-likelihood ratio) and often enough for the rarer of them;
   spellings near each other need less. The rarer word is rewritten to the more frequent one.
3. The words are rewritten and the mining starts again, as corrected words let further slots agree,
   until a round finds no new rewrite.
4. Words left over that are one typing error away from a single frequent word are corrected. Frequent
   is a share of all words, 1 in 10,000, which bounds how many are sent out.
5. Forms with the same zip, number, unit and rewritten words are one place. A residual step joins
   forms that differ by one typing error in one word, or lack up to two words, where that is
   unambiguous. Records without a zip are placed by city and state.

Defined cases: fields without an address (null, blank, fillers, no number) take no part; a unit against
none or another one is another place; repeated rows of a key count once; a box is a place of its own.
Forms are distinct before any comparison, so copies of one address cost nothing, and slots are grouped
by hash; a slot counts each pair of its distinct words, and one of many words is split over tasks.
"""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsieve.llm.edit import typo_distance
from kinsieve.llm.groups import UnionFind, by_group
from kinsieve.llm.places import city_key, fold, read_address
from kinsieve.session import discard, materialize, partitions

CHUNK = 64  # words of a slot whose pairs one row makes
SIGNIFICANT, NEARLY = 10.83, 3.84  # chi-square, one degree of freedom: 0.001 and 0.05
_READ = "rec string, zip string, number string, unit string, words array<string>, city string, state string"


def read_all(records: DataFrame) -> DataFrame:
    """records(rec, line, city, state, zip) -> the parts of those that hold an address."""

    def run(batches):
        for pdf in batches:
            out = []
            for rec, line, city, state, z in zip(pdf["rec"], pdf["line"], pdf["city"], pdf["state"], pdf["zip"]):
                a = read_address(line, z)
                if a:
                    s = fold(state)
                    c = city_key(city)
                    if not c and a[4]:
                        rest = a[4].split()
                        if len(rest) > 1 and len(rest[-1]) == 2:
                            s, rest = s or rest[-1], rest[:-1]
                        c = city_key(" ".join(rest))
                    out.append((rec, a[0], a[1], a[2], a[3], c, s))
            yield pd.DataFrame(out, columns=["rec", "zip", "number", "unit", "words", "city", "state"])

    return records.repartition(partitions(records.sparkSession), "rec").mapInPandas(run, _READ)


def _log_likelihood(both, a, b, n):
    """Dunning's ratio of the 2x2 table of slots."""

    def term(x, e):
        return F.when(x > 0, x * F.log(x / e)).otherwise(0.0)

    only_a, only_b, none = a - both, b - both, F.greatest(n - a - b + both, F.lit(0.0))
    return 2 * (term(both, a * b / n) + term(only_a, a * (n - b) / n) + term(only_b, (n - a) * b / n) + term(none, (n - a) * (n - b) / n))


def mine(forms: DataFrame, least: float = 0.15) -> DataFrame:
    """(word, meant): the rewrites that forms(zip, number, words) show."""
    slot = F.transform(
        F.sequence(F.lit(0), F.size("words") - 1),
        lambda i: F.struct(F.get("words", i).alias("word"), F.array_join(F.array_sort(F.filter("words", lambda x, j: j != i)), " ").alias("others")),
    )
    slots = (
        forms.where("size(words) > 1")
        .select("zip", "number", F.explode(slot).alias("s"))
        .groupBy("zip", "number", "s.others")
        .agg(F.collect_set("s.word").alias("ws"))
        .where("size(ws) > 1")
        .select("ws")
    )
    slots = materialize(slots, "slots")
    total = slots.count()
    used = slots.select(F.explode("ws").alias("word")).groupBy("word").agg(F.count("*").cast("double").alias("n"))
    spoken = forms.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("f"))
    stats = used.join(spoken, "word")
    # every pair of a slot counts; slots of many words are split, so that their pairs are made by several tasks
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.size("ws") - 1) / CHUNK).cast("int"))).alias("c")
    large = slots.where(F.size("ws") > CHUNK).select("ws", chunk).repartition(partitions(forms.sparkSession), F.xxhash64("ws", "c"))
    parts = slots.where(F.size("ws") <= CHUNK).select("ws", F.lit(0).alias("c")).unionByName(large)
    pairs = (
        parts.select("ws", F.explode(F.slice("ws", F.col("c") * CHUNK + 1, F.lit(CHUNK))).alias("a"))
        .select("a", F.explode("ws").alias("b"))
        .where("a < b")
        .groupBy("a", "b")
        .agg(F.count("*").cast("double").alias("both"))
    )
    x, y = stats.select(*[F.col(c).alias(f"a_{c}" if c != "word" else "a") for c in stats.columns]), stats.select(*[F.col(c).alias(f"b_{c}" if c != "word" else "b") for c in stats.columns])
    scored = pairs.join(x, "a").join(y, "b").withColumn("g", _log_likelihood(F.col("both"), F.col("a_n"), F.col("b_n"), F.lit(float(max(total, 1)))))
    share = F.col("both") / F.least("a_n", "b_n")
    edits = F.levenshtein("a", "b")
    rare = F.least("a_f", "b_f") * 5 <= F.greatest("a_f", "b_f")
    near = (edits <= F.when(F.least(F.length("a"), F.length("b")) >= 6, 2).otherwise(1)) & (F.least(F.length("a"), F.length("b")) >= 4)
    # what is left of a word once its other spellings are rewritten: stray neighbours, few among all its uses
    uses = F.col("both") / F.least("a_f", "b_f")
    kept = scored.where(((F.col("g") > SIGNIFICANT) & (F.col("both") >= 3) & (share >= least) & (uses >= 0.04)) | ((F.col("g") > NEARLY) & near & rare & (share >= 0.5)))
    a_rarer = (F.col("a_f") < F.col("b_f")) | ((F.col("a_f") == F.col("b_f")) & (F.col("a") > F.col("b")))
    return (
        kept.select(
            F.when(a_rarer, F.col("a")).otherwise(F.col("b")).alias("word"),
            F.when(a_rarer, F.col("b")).otherwise(F.col("a")).alias("meant"),
            F.greatest("a_f", "b_f").alias("f"),
            "g",
        )
        .groupBy("word")
        .agg(F.max(F.struct("f", "g", "meant")).getField("meant").alias("meant"))
    )


def _rewrite(forms: DataFrame, rewrites: DataFrame) -> DataFrame:
    """forms(id, ..., words) with each word rewritten."""
    words = forms.select("id", F.posexplode("words").alias("at", "word")).join(rewrites, "word", "left")
    new = words.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("meant", "word").alias("word")))).alias("ws"))
    return forms.drop("words").join(new.select("id", F.col("ws.word").alias("words")), "id")


def split_joined(forms: DataFrame) -> DataFrame:
    """Words typed without a blank, where both parts are frequent by themselves and more so than the
    whole. Frequent: a share of 1 in 2000 of all words, so at most 2000 words are sent out."""
    spoken = forms.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("f"))
    total = spoken.agg(F.sum("f")).first()[0] or 0
    frequent = {r.word: r.f for r in spoken.where(F.col("f") >= max(total / 2000, 3)).collect()}

    def run(batches):
        memo: dict[str, list[str]] = {}

        def parts(w: str) -> list[str]:
            if w not in memo:
                own = frequent.get(w, 0)
                cut = [(min(frequent[w[:i]], frequent[w[i:]]), i) for i in range(2, len(w) - 1) if w[:i] in frequent and w[i:] in frequent and len(w[:i]) > 2]
                best = max(cut, default=(0, 0))
                got = [w[: best[1]], w[best[1] :]] if best[0] > own else [w]
                if len(memo) >= 300_000:
                    return got
                memo[w] = got
            return memo[w]

        for pdf in batches:
            pdf["words"] = [[p for w in ws for p in parts(w)] for ws in pdf["words"]]
            yield pdf

    return forms.mapInPandas(run, forms.schema)


def frequent_words(forms: DataFrame, share: int = 10_000) -> set[str]:
    """Words that make up at least 1 in `share` of all words, so at most `share` of them."""
    spoken = forms.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("f"))
    total = spoken.agg(F.sum("f")).first()[0] or 0
    return {r.word for r in spoken.where(F.col("f") >= max(total / share, 3)).select("word").collect()}


def correct(forms: DataFrame, frequent: set[str]) -> DataFrame:
    """Words that are not frequent, and that one typing error makes out of exactly one frequent word."""
    by_part: dict[str, list[str]] = {}
    for w in frequent:
        if len(w) > 2:
            for s in {w, *(w[:j] + w[j + 1 :] for j in range(len(w)))}:
                by_part.setdefault(s, []).append(w)
    shared = forms.sparkSession.sparkContext.broadcast((frequent, by_part))

    def run(batches):
        known, parts = shared.value
        memo: dict[str, str] = {}

        def meant(w: str) -> str:
            if w in known or len(w) < 3:
                return w
            if w not in memo:
                near = {c for s in {w, *(w[:j] + w[j + 1 :] for j in range(len(w)))} for c in parts.get(s, ()) if typo_distance(w, c) <= 1}
                got = near.pop() if len(near) == 1 else w
                if len(memo) >= 300_000:
                    return got
                memo[w] = got
            return memo[w]

        for pdf in batches:
            pdf["words"] = [[meant(w) for w in ws] for ws in pdf["words"]]
            yield pdf

    return forms.mapInPandas(run, forms.schema)


def _near_forms(key: tuple, rows: list[tuple], frequent: set[str]):
    """Within one zip, number and unit: forms that one typing error or one missing word sets apart. Two
    frequent words are two words, however near each other."""
    canon = sorted({r[3] for r in rows})
    split = [c.split() for c in canon]
    uf = UnionFind(len(canon))
    signs: dict[tuple, list[int]] = {}
    for n, ws in enumerate(split):
        for i, w in enumerate(ws):
            others = tuple(sorted(ws[:i] + ws[i + 1 :]))
            if len(w) > 2 and w != "pobox":
                for s in {w, *(w[:j] + w[j + 1 :] for j in range(len(w)))}:
                    signs.setdefault((others, s), []).append(n)
    for (others, _), own in signs.items():
        first = own[0]
        for n in own[1:]:
            if n != first and uf.find(n) != uf.find(first):
                a, b = ([w for w in _minus(split[k], others)] for k in (first, n))
                if len(a) == len(b) == 1 and not (a[0] in frequent and b[0] in frequent) and typo_distance(a[0], b[0]) <= 1:
                    uf.join(first, n)
    # one word missing, then two: only where the longer forms that hold all words are one place
    for lacks in (1, 2):
        index: dict[tuple, set[int]] = {}
        for n, ws in enumerate(split):
            if len(ws) > lacks:
                for kept in combinations(sorted(ws), len(ws) - lacks):
                    index.setdefault(kept, set()).add(n)
        for n, ws in enumerate(split):
            longer = {uf.find(k) for k in index.get(tuple(sorted(ws)), ()) if k != n}
            if len(longer) == 1:
                uf.join(n, longer.pop())
    for n, c in enumerate(canon):
        yield (*key, c, canon[uf.find(n)])


def _minus(ws: list[str], others: tuple) -> list[str]:
    left = list(others)
    out = []
    for w in ws:
        if w in left:
            left.remove(w)
        else:
            out.append(w)
    return out


def same_places(records: DataFrame) -> DataFrame:
    """(rec, place) for records(rec, line, city, state, zip) that hold an address; records at one place
    share `place`."""
    read = materialize(read_all(records), "addresses")
    forms = read.groupBy("zip", "number", "words").agg(F.count("*").alias("rows"))
    forms = forms.withColumn("id", F.xxhash64("zip", "number", "words"))
    forms = materialize(split_joined(forms), "forms")
    spent = []
    # ends by itself: rewrites lead to more frequent words, so each round leaves fewer distinct ones
    while True:
        rewrites = materialize(mine(forms.where("zip <> ''").groupBy("zip", "number", "words").agg(F.count("*").alias("rows"))), "rewrites")
        if rewrites.isEmpty():
            break
        new = materialize(_rewrite(forms, rewrites), "forms")
        spent += [forms, rewrites]
        forms = new
    frequent = frequent_words(forms)
    canon = correct(forms, frequent).select("id", F.array_join(F.array_sort("words"), " ").alias("canon"))
    placed = materialize(
        read.withColumn("id", F.xxhash64("zip", "number", "words")).join(canon, "id").select("rec", "zip", "number", "unit", "canon", "city", "state"), "placed"
    )
    for x in spent:
        discard(x)
    known = placed.where("zip <> ''")
    near = by_group(
        known.groupBy("zip", "number", "unit", "canon").agg(F.count("*").alias("n")).select("zip", "number", "unit", "canon"),
        ["zip", "number", "unit"],
        lambda key, rows: _near_forms(key, rows, frequent),
        "zip string, number string, unit string, canon string, street string",
    )
    with_zip = materialize(
        known.join(near, ["zip", "number", "unit", "canon"]).withColumn("place", F.concat_ws("|", "zip", "number", "unit", "street")), "places"
    )
    # without a zip: the place in that state with the same number, unit and street whose city agrees
    streets = with_zip.groupBy("state", "number", "unit", "canon", "city", "place").agg(F.count("*").alias("n"))
    lost = placed.where("zip = ''")
    c = F.levenshtein(F.col("l.city"), F.col("s.city"))
    found = (
        lost.alias("l")
        .join(streets.alias("s"), ["state", "number", "unit", "canon"])
        .where((F.col("l.city") == "") | (F.col("s.city") == "") | (c <= 2))
        .groupBy(F.col("l.rec"))
        .agg(F.min("place").alias("place"), F.max("place").alias("other"))
        .where("place = other")
        .select("rec", "place")
    )
    alone = lost.join(found, "rec", "left_anti").where("city <> ''").select("rec", F.concat_ws("|", F.lit("city"), "city", "state", "number", "unit", "canon").alias("place"))
    return with_zip.select("rec", "place").unionByName(found).unionByName(alone)


def place_pairs(places: DataFrame) -> DataFrame:
    """(rec_a, rec_b): the records at one place, each pair once."""
    a, b = places.alias("a"), places.alias("b")
    return a.join(b, F.col("a.place") == F.col("b.place")).where("a.rec < b.rec").select(F.col("a.rec").alias("rec_a"), F.col("b.rec").alias("rec_b"))
