"""Mapping free-entered employers to a reference list: a BK-tree under the edit metric.

A typed value is read as core words and an industry ("Mororkar", "Laboratories"); legal forms, job
titles, branches and the like are set aside. Core words are looked up in BK-trees over the cores of the
reference list, sharded by length: triangle-inequality pruning returns every core within the radius,
and the shards' winners merge. Of the entries so returned, that of the least distance is meant whose
industry agrees with the typed one; initials of an entry's words stand for it where no other entry has
the same. All other values are reported as not on the list.

The reference list is counted first and broadcast in parts of at most `max_reference` entries; every
part is asked and the parts' winners merge by distance, initials count over all parts. Work is done
once for each distinct value, then for each distinct core, so a value that a third of all rows share
costs one look-up.

Defined cases: null and blank values take no part; equal distances go to the smaller id; an empty reference list maps all to 0.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsieve.llm.edit import ShardedBKTree, typo_distance
from kinsieve.session import materialize, partitions

# Words that carry no identity.
LEGAL = set(
    "inc incorporated llc llp lp co company cos corp corporation group grp gp holdings holding hldgs hldg partners partner ptnrs ptnr ltd limited plc services service svcs svc the and of".split()
)
TITLES = "vp|ceo|cfo|coo|evp|svp|president|owner|partner|manager|director|employee|consultant|founder|attorney|engineer|chairman|principal|staff"
_PREFIX = re.compile(rf"^\s*(?:c/o|d/?b/?a|f/?k/?a|a/?k/?a|div(?:ision|\.)? of|subsidiary of|(?:{TITLES})\s*,|[a-z .]{{2,20}} (?:at|for) )\s*", re.I)
_TAIL = re.compile(r"\([^)]*\)|\s/\s.*$|\s-\s*hq\b.*$|,?\s+dept\b.*$|\bmain office\b|\bbranch\s+\d+.*$|\bhq\s*$", re.I)
_INITIALS = re.compile(r"\b([a-z])\.\s?([a-z])\.(?:\s?([a-z])\.)?(?:\s?([a-z])\.)?(?=\s|,|$)")
_LETTERS = re.compile(r"[a-z]+")
_NO_DIGIT = set("0158").isdisjoint
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGIT = str.maketrans("0158", "olsb")


def plain(text: str) -> str:
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def abbreviates(token: str, word: str) -> bool:
    """Whether the token can stand for the word: cut off, contracted, or mistyped once."""
    if token == word:
        return True
    if len(token) >= 2 and token[0] == word[0] and len(token) < len(word):
        if word.startswith(token):
            return True
        it = iter(word)
        if all(c in it for c in token):
            return len(token) >= 2 and token[-1] in word[1:]
    # another ending of the same stem: laboratory, technology, advisers
    stem = min(len(token), len(word)) - 3
    if stem >= 4 and token[: stem + 1] == word[: stem + 1] and abs(len(token) - len(word)) <= 3:
        return True
    # one edit spares the first letter or the last
    if min(len(token), len(word)) < 4 or abs(len(token) - len(word)) > 1 or (token[0] != word[0] and token[-1] != word[-1]):
        return False
    return (token[:2] == word[:2] or token[-2:] == word[-2:]) and typo_distance(token, word) <= 1


class EmployerReader:
    """Reads a typed value as (core, industry, initials) by the industries of the reference list."""

    def __init__(self, industries: list[str]):
        self.industries = {i: plain(i).lower().split() for i in industries}
        self.initials = {"".join(w[0] for w in ws): i for i, ws in self.industries.items() if len(ws) > 1}
        self.words = {i: [w for w in ws if w != "group"] for i, ws in self.industries.items()}
        # a token can stand for words with its first letter, or mistyped for those with its last two
        self._near: dict[str, list[tuple[str, int, str]]] = {}
        for i, ws in self.industries.items():
            for k, w in enumerate(ws):
                if w != "group":
                    self._near.setdefault(w[0], []).append((i, k, w))
                    self._near.setdefault(w[-2:], []).append((i, k, w))
        self._memo: dict[str, tuple] = {}
        self._legal: dict[str, bool] = {}

    def fits(self, token: str) -> tuple[tuple[str, int], ...]:
        """The industries' words that the token can stand for."""
        got = self._memo.get(token)
        if got is None:
            near = dict.fromkeys([*self._near.get(token[:1], ()), *self._near.get(token[-2:], ())])
            got = tuple((i, k) for i, k, w in near if abbreviates(token, w))
            if len(self._memo) < 200_000:
                self._memo[token] = got
        return got

    def legal_typo(self, token: str) -> bool:
        got = self._legal.get(token)
        if got is None:
            got = any(w.startswith(token) or abs(len(w) - len(token)) <= 1 and typo_distance(token, w) <= 1 for w in LEGAL if len(w) > 3)
            if len(self._legal) < 200_000:
                self._legal[token] = got
        return got

    def tokens(self, value: str) -> list[str]:
        text = plain(value)
        low = text.lower()
        if low != text and text.upper() != text:
            text = _CAMEL.sub(" ", text)
        # most values have none of what the patterns look for
        if any([x in low for x in ("(", "/", "hq", "dept", "main office", "branch")]):
            text = _TAIL.sub(" ", text)
        if "/" in low or "," in low or " of " in low or " at " in low or " for " in low or low.lstrip()[:3] in ("dba", "fka", "aka"):
            for _ in range(2):
                text = _PREFIX.sub("", text)
        text = text.lower()
        if "&" in text or "'" in text:
            text = text.replace("nat'l", "national").replace("&", " ")
        if "." in text:
            text = _INITIALS.sub(lambda m: "".join(x for x in m.groups() if x), text)
        if "'" in text:
            text = re.sub(r"'s\b", "", text).replace("'", "")
        if not _NO_DIGIT(text):
            text = re.sub(r"(?<=[a-z])[0158]|[0158](?=[a-z])", lambda m: m.group().translate(_DIGIT), text)
        out = _LETTERS.findall(text)
        return ["national" if t == "natl" else t for t in out]

    def read(self, value: str) -> tuple[str, str, str]:
        """core words joined by a blank; the industries that the rest can mean, joined by '|', or '';
        the value as initials or ''."""
        tokens = self.tokens(value)
        letters = "".join(tokens)
        initials = letters if 2 <= len(letters) <= 6 and (len(tokens) == 1 or all(len(t) == 1 for t in tokens)) else ""
        rest = [t for t in tokens if t not in LEGAL]
        best: dict[str, tuple[tuple[int, int], int, int]] = {}
        for n, t in enumerate(rest):
            for industry, k in self.fits(t):
                span = self._phrase(rest, n, industry, self.words[industry]) if k == 0 else None
                if span and span[0] < len(rest):
                    best[industry] = max(best.get(industry, ((0, 0), 0, 0)), ((span[1], span[0]), n, n + span[0]))
        last = rest[-1] if len(rest) > 1 else ""
        for i, industry in ((i, x) for i, x in self.initials.items() if last and i == last):
            best[industry] = max(best.get(industry, ((0, 0), 0, 0)), ((9, 1), len(rest) - 1, len(rest)))
        if not best:
            return " ".join(rest), "", initials
        top = max(v[0] for v in best.values())
        exact = top[0] >= 10
        _, lo, hi = max(best.values())
        meant = sorted(i for i, v in best.items() if v[1:] == (lo, hi) and (not exact or v[0] == top))
        # what follows the industry is a legal form, mistyped or cut off; a value may begin with the industry
        core = rest[:lo] or rest[hi:]
        if lo:
            # another word behind it is part of the name: "X Pet Care" is no pharmaceutical firm
            core = core + [t for t in rest[hi:] if len(t) > 3 and not self.legal_typo(t)]
        return " ".join(core), "|".join(meant), initials

    def _phrase(self, rest: list[str], at: int, industry: str, words: list[str]) -> tuple[int, int] | None:
        """(tokens, weight) of the industry's words from a position on; the last words may be cut off at
        the end of the value, to a letter or altogether."""
        weight = 0
        for k, w in enumerate(words):
            if at + k >= len(rest):
                return (k, weight) if k else None
            t = rest[at + k]
            if (industry, k) in self.fits(t):
                weight += 10 if t == w else min(len(t), 8) if w.startswith(t) else 2
            elif len(t) == 1 and t == w[0] and at + k == len(rest) - 1 and at + k > 0:
                weight += 1
            else:
                return None
        return len(words), weight


class ReferenceIndex:
    """A part of the reference list by core words and by initials."""

    def __init__(self, entries: list[tuple[int, str, str]], industries: list[str]):
        self.reader = EmployerReader(industries)
        self.by_core: dict[str, list[tuple[int, str]]] = {}
        self.by_initials: dict[str, list[int]] = {}
        for eid, name, industry in sorted(entries):
            rest = [t for t in self.reader.tokens(name) if t not in LEGAL or t in self.reader.industries[industry]]
            ws = self.reader.industries[industry]
            at = next((n for n in range(len(rest), -1, -1) if rest[n : n + len(ws)] == ws), None)
            core = rest[:at] if at is not None else rest
            own = [t for t in core if t not in LEGAL]
            self.by_core.setdefault(" ".join(own), []).append((eid, industry))
            # typed without blanks
            self.by_core.setdefault("".join([*own, *ws]), []).append((eid, industry))
            self.by_initials.setdefault("".join(t[0] for t in [*own, *ws]), []).append(eid)
        self.tree = ShardedBKTree(self.by_core)

    def near(self, core: str) -> list[tuple[int, str]]:
        """(typos, core) of every reference core within the radius of a typed one: one edit, two in a long
        core; a swap of neighbours counts as one and is looked up by swapping back."""
        found: dict[str, int] = {}
        if core in self.by_core:
            found[core] = 0
        if len(core) > 3:
            for d, c in self.tree.within(core, 1 if len(core) < 12 else 2):
                found.setdefault(c, d)
            for n in range(len(core) - 1):
                swapped = core[:n] + core[n + 1] + core[n] + core[n + 2 :]
                if swapped != core and swapped in self.by_core:
                    found[swapped] = 1
            if not found and " " not in core and len(core) > 14:
                # a legal form typed without a blank
                for tail in sorted(LEGAL, key=lambda t: (-len(t), t)):
                    if len(tail) > 1 and core.endswith(tail) and core[: -len(tail)] in self.by_core:
                        return [(0, core[: -len(tail)])]
        return sorted((d, c) for c, d in found.items())

    def entry(self, near: list[tuple[int, str]], industry: str) -> tuple[int, int] | None:
        """(distance, id) of the nearest entry whose industry agrees."""
        meant = industry.split("|")
        return min(((d, eid) for d, core in near for eid, own in self.by_core[core] if not industry or own in meant), default=None)


def map_to_reference(values: DataFrame, value: str, reference: DataFrame, max_reference: int = 50_000, max_industries: int = 5_000) -> DataFrame:
    """values plus employer_id: the entry that each distinct value means, or 0, for
    reference(employer_id, employer_name, industry)."""
    spark = values.sparkSession
    listed = reference.select(F.col("employer_id").cast("bigint").alias("i"), F.col("employer_name").alias("n"), F.col("industry").alias("k")).where("i is not null and n is not null and k is not null")
    parts = max(1, -(-listed.count() // max_reference))
    kinds = listed.select("k").distinct()
    if kinds.count() > max_industries:
        raise ValueError(f"more than {max_industries} industries: the column does not hold kinds of firms")
    industries = sorted(r.k for r in kinds.collect())
    reader = spark.sparkContext.broadcast(EmployerReader(industries))
    width = partitions(spark)

    def read(batches):
        for pdf in batches:
            got = [reader.value.read(v) for v in pdf["v"]]
            yield pd.DataFrame({"v": pdf["v"], "core": [g[0] for g in got], "industry": [g[1] for g in got], "initials": [g[2] for g in got]})

    # spread by another hash than that of the aggregates, whose small partitions are merged to one task
    distinct = values.select(F.col(value).alias("v")).where("trim(v) <> ''").distinct().repartition(width, F.xxhash64("v"))
    parsed = materialize(distinct.mapInPandas(read, "v string, core string, industry string, initials string"), "employers")
    asked = parsed.select("core", "industry", "initials").distinct().repartition(width, F.xxhash64("core"))
    found = None
    for part in range(parts):
        own = listed.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == part) if parts > 1 else listed
        index = spark.sparkContext.broadcast(ReferenceIndex([(r.i, r.n, r.k) for r in own.distinct().collect()], industries))

        def look_up(batches, index=index):
            memo: dict[str, list] = {}
            for pdf in batches:
                memo.clear()
                out = []
                for core, industry, initials in zip(pdf["core"], pdf["industry"], pdf["initials"]):
                    near = memo.get(core)
                    if near is None:
                        near = memo[core] = index.value.near(core)
                    best = index.value.entry(near, industry)
                    short = index.value.by_initials.get(initials, ()) if initials else ()
                    if near or short:
                        out.append((core, industry, initials, *(best or (None, None)), len(near), len(short), min(short, default=0)))
                pdf = pd.DataFrame(out, columns=["core", "industry", "initials", "d", "id", "near", "shorts", "short"])
                yield pdf.astype({"d": "Int32", "id": "Int64", "near": "int32", "shorts": "int32", "short": "int64"})

        more = asked.mapInPandas(look_up, "core string, industry string, initials string, d int, id bigint, near int, shorts int, short bigint")
        found = more if found is None else found.unionByName(more)
    # the parts' winners: the nearest, the smaller id; initials only where nothing is near and one entry has them
    merged = found.groupBy("core", "industry", "initials").agg(F.min(F.when(F.col("d").isNotNull(), F.struct("d", "id"))).getField("id").alias("id"), F.sum("near").alias("near"), F.sum("shorts").alias("shorts"), F.max("short").alias("short"))
    chosen = merged.select("core", "industry", "initials", F.coalesce("id", F.when((F.col("near") == 0) & (F.col("shorts") == 1), F.col("short"))).alias("id"))
    mapped = parsed.join(chosen, ["core", "industry", "initials"], "left").select(F.col("v").alias(value), F.coalesce("id", F.lit(0).cast("bigint")).alias("employer_id"))
    return values.where(f"trim(`{value}`) <> ''").join(mapped, value)
