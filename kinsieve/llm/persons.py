"""Variant spellings of names: sparse n-gram cosine joins of whole names, then average-linkage clustering.

1. Names are read into surname, given names and suffix; given names are corrected by those that the
   corpus uses often (a share of 1 in 5000 bounds how many are sent out) and stand under the formal name.
2. Records that agree in all that is compared are one node, however many they are.
3. Nodes meet in blocks: a place (the first three digits of the zip) and a letter of the given name, of
   each that it may be short for. In a block every whole name (formal given name and surname) is a vector
   of character trigrams weighted by their rarity over all names; an inverted index joins the names
   whose cosine is at least `LEAST`. Only nodes of names joined so are compared any further.
4. Such a pair's evidence adds up: cosine and typing errors of the names, nicknames and initials,
   suffix, zip, employer, occupation, street, organisation. Average linkage merges clusters while their
   mean evidence is positive; pairs that the cosine join left out count against it.
5. Initials and ambiguous short names go to the one cluster they agree with best, if it is one.
6. Clusters of different blocks that share a node, or a surname and an employer or organisation and
   evidence enough, are one.

Hot blocks: the pairs of a block of more than `SPLIT` nodes are dealt to several tasks, which find what
hangs together through evidence that could count; each such part is then clustered by the same rules as a
whole block. The clusters are those of the undivided block, at any size and any `SPLIT`.

Defined cases: null, blank and filler names take no part; a record without any place is compared only
with others without; ties go by node id; repeated rows count once; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsieve.llm.belief import match_probabilities
from kinsieve.llm.canonical import LEGAL, EmployerReader
from kinsieve.llm.edit import levenshtein, masks, typo_distance
from kinsieve.llm.groups import UnionFind, by_group
from kinsieve.llm.names import UNSURE, GivenNames, bases, letters, read_name
from kinsieve.llm.places import city_key, read_address, zip5
from kinsieve.session import discard, materialize

NODE = ["loc", "kind", "letters", "sur", "first", "middle", "suffix", "zip", "emps", "occ", "street", "org"]
FIELDS = NODE[1:2] + NODE[3:]
_READ = "rec string, name string, city string, " + ", ".join(f"{c} string" for c in NODE)
_SAY_NOTHING = set("retired retiredd self employed selfemployed none na unemployed homemaker student unknown requested information info not owner null".split())
_NO_TRADE = ["reti", "home", "stud", "unem", "none", "n/a", "unkn", "self", "requ", "info"]
LEAST = 0.4  # cosine of two whole names that are compared
LEAST_SURNAME = 0.4  # the same of surnames, where a given name is an initial or has several readings
AHEAD = 0.5  # by how much initials and the like agree better with one cluster than with any other
SPLIT = 5000  # nodes of a block in one task
BATCH = 256  # names of small groups that are joined at once
CELLS = 1 << 18  # pairs whose cosines are added up at once
MISSING = -6.0  # evidence of a pair that the cosine join left out, or that contradict each other


def given_names(names: DataFrame, column: str, share: int = 5000) -> list[str]:
    """Words behind a comma that make up 1 in `share` of them, so at most `share` words."""
    words = names.where(F.contains(column, F.lit(","))).select(
        F.explode(F.regexp_extract_all(F.lower(F.substring_index(column, ",", -1)), F.lit("([a-z]+)"), F.lit(1))).alias("w")
    ).where("length(w) > 1")
    counts = materialize(words.groupBy("w").agg(F.count("*").alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = sorted(r.w for r in counts.where(F.col("n") >= max(total / share, 3)).select("w").collect())
    discard(counts)
    return found


class EmployerKey:
    """The words that tell one employer from another, without industries and legal forms."""

    def __init__(self, industries: list[str]):
        self.reader = EmployerReader(industries)
        self._memo: dict[str, str] = {}

    def of(self, value: str) -> str:
        got = self._memo.get(value)
        if got is None:
            tokens = [t for t in self.reader.tokens(value) if t not in LEGAL and t not in ("national", "town", "sons", "shop", "and")]
            if not tokens or all(t in _SAY_NOTHING or len(t) < 3 for t in tokens) or tokens[0] in ("retired", "self", "not", "info", "information", "homemaker", "none"):
                got = ""
            else:
                got = next((t for t in tokens if len(t) > 3 and not self.reader.fits(t)), "")
            if len(self._memo) < 300_000:
                self._memo[value] = got
        return got


_BETWEEN = "\x1f"


def read_people(records: DataFrame, given: list[str], industries: list[str]) -> DataFrame:
    """records(rec, name, city, state, zip, employers array, occupation, address, org) -> the fields
    that are compared. `loc` is empty where the zip is missing."""
    shared = records.sparkSession.sparkContext.broadcast((given, industries))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    trade = F.substring(F.lower(F.trim(text("occupation"))), 1, 4)
    rows = records.where(F.col("name") != "").select(
        "rec",
        "name",
        F.lower(F.trim(text("city"))).alias("city"),
        F.lower(F.trim(text("state"))).alias("state"),
        text("zip").alias("zip"),
        F.array_join(F.coalesce("employers", F.array().cast("array<string>")), _BETWEEN).alias("employers"),
        F.when(~trade.isin(_NO_TRADE), trade).otherwise("").alias("occ"),
        text("address").alias("address"),
        F.substring(F.lower(F.trim(text("org"))), 1, 9).alias("org"),
    )

    def run(batches):
        known, key = GivenNames(shared.value[0]), EmployerKey(shared.value[1])
        # few are distinct; what is remembered is bounded
        wheres: dict[tuple[str, str], str] = {}
        for batch in batches:
            out = []
            if len(wheres) > 200_000:
                wheres.clear()
            for rec, name, city, state, z, employers, occ, address, org in zip(*[c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns]):
                n = read_name(name, known)
                if n is None or not n[1]:
                    continue
                z = z if len(z) == 5 and z.isdecimal() else zip5(z)
                street = ""
                if address:
                    a = read_address(address, z)
                    if a:
                        z, street = z or a[0], f"{a[1]} {a[2]}"
                        if not city and a[4]:
                            city = " ".join(a[4].split()[:-1])
                where = ""
                if city:
                    where = wheres.get((city, state))
                    if where is None:
                        k = city_key(city)
                        where = wheres[city, state] = f"{state}:{k}" if k else ""
                emps = " ".join(dict.fromkeys(k for e in employers.split(_BETWEEN) if (k := key.of(e)))) if employers else ""
                kind, sur, first, middle, suffix = n
                out.append((rec, name, where, z[:3], kind, "0" if kind == "o" else letters(first, middle), sur, first, middle, suffix, z, emps, occ, street, org))
            columns = ["rec", "name", "city", *NODE]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)] or [pa.array([], pa.string()) for _ in columns], columns)

    return rows.mapInArrow(run, _READ)


def with_places(people: DataFrame) -> DataFrame:
    """loc of the records without a zip: the one most others with their city and state have."""
    counted = people.where("loc <> '' and city <> ''").groupBy("city", "loc").agg(F.count("*").alias("n"))
    usual = materialize(counted.groupBy("city").agg(F.max(F.struct("n", "loc")).getField("loc").alias("usual")), "cities")
    lost = people.where("loc = ''").join(usual, "city", "left")
    found = materialize(lost.withColumn("loc", F.coalesce("usual", F.lit("?"))).drop("city", "usual"), "places")
    return people.where("loc <> ''").drop("city").unionByName(found)


# vectors


@lru_cache(100_000)
def formal(first: str) -> str:
    """The given name as it stands in the whole name: formal where there is one reading."""
    name = first.rstrip(UNSURE)
    own = bases(name)
    return next(iter(own)) if len(own) == 1 else name


def whole_name(kind: str, first: str, sur: str) -> str:
    """What a vector is made of: '^given surname$', and ' surname$' where the given name is not sure, as
    in organisations, whose kind is compared by itself."""
    return f" {sur}$" if kind == "o" or not first else f"^{formal(first)} {sur}$"


def grams(name: str) -> set[str]:
    return {name[i : i + 3] for i in range(len(name) - 2)}


class Vectors:
    """Whole names as unit vectors of trigrams, weighted by their rarity."""

    def __init__(self, counts: dict[str, int], total: int):
        # grams of a single typing error are rare without telling much: their weight is that of 1 in 200
        floor = max(total / 200, 1)
        self.idf = {g: math.log(1 + total / max(n, floor)) for g, n in counts.items()}
        self.rare = math.log(1 + total / floor)
        self._memo: dict[str, dict[str, float]] = {}
        known = sorted((int(_codes(g)[0]), x) for g, x in self.idf.items())
        self._known, self._weights = np.array([c for c, _ in known], dtype=np.int64), np.array([x for _, x in known])

    def numbered(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of grams, and what each number weighs."""
        at = np.searchsorted(self._known, codes)
        new = np.append(self._known, -1)[at] != codes
        if not new.any():
            return at, self._weights
        unknown, at[new] = np.unique(codes[new], return_inverse=True)
        at[new] += len(self._known)
        return at, np.concatenate((self._weights, np.full(len(unknown), self.rare)))

    def of(self, name: str) -> dict[str, float]:
        """The weights by gram, the rarest first."""
        got = self._memo.get(name)
        if got is None:
            own = sorted(((self.idf.get(g, self.rare), g) for g in grams(name)), reverse=True)
            norm = math.sqrt(sum([x * x for x, _ in own])) or 1.0
            got = {g: x / norm for x, g in own}
            if len(self._memo) < 100_000:
                self._memo[name] = got
        return got


def gram_counts(people: DataFrame) -> tuple[dict[str, int], int]:
    """In how many of all distinct whole names each trigram is, and how many those are. A trigram is of 26
    letters, a blank and two ends: at most 29^3 rows, whatever the corpus."""
    words = people.select("kind", "first", "sur").distinct()

    def grams_of(batches):
        counts: Counter[str] = Counter()
        for pdf in batches:
            for k, f, w in zip(pdf["kind"], pdf["first"], pdf["sur"]):
                counts.update(grams(whole_name(k, f, w)))
            counts[""] += len(pdf)
        yield pd.DataFrame(list(counts.items()), columns=["g", "n"]).astype({"g": object, "n": "int64"})

    got = {r.g: r.n for r in words.mapInPandas(grams_of, "g string, n bigint").groupBy("g").agg(F.sum("n").alias("n")).collect()}
    return got, got.pop("", 0)


def similar_names(names: list[str], vectors: Vectors, least: float = LEAST, posted: int | None = None) -> dict[tuple[int, int], float]:
    """(i, j), i < j, of the names with a cosine of at least `least`, by an inverted index of their grams.
    Where only the first `posted` names are indexed, pairs have one of them."""
    left, right, cosines = _joined(names, [len(names)], [len(names) if posted is None else posted], vectors, least)
    return {(i, j): c for i, j, c in zip(left.tolist(), right.tolist(), cosines.tolist())}


def _codes(text: str) -> np.ndarray:
    """A number for each three letters that follow one another."""
    c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]


_NO_PAIRS = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))


def _joined(names: list[str], sizes: list[int], posted: list[int], vectors: Vectors, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine), i < j, of the names within each group with a cosine of at least `least`. names: the
    groups one after another, of these sizes; in each only the first `posted` ones are indexed.

    The postings of a gram in a group stand together, so each name meets those before its own; a pair's
    products are added up in a cell, for at most `CELLS` cells (or those of one name) at once."""
    n, length = len(names), np.array([len(x) for x in names])
    codes = _codes("".join(names))
    row = np.repeat(np.arange(n), length)[: len(codes)]
    # a gram ends within its name
    inside = np.arange(len(codes)) < (np.cumsum(length) - 2)[row]
    codes, row = codes[inside], row[inside]
    gram, idf = vectors.numbered(codes)
    group = np.repeat(np.arange(len(sizes)), sizes)
    posting = np.sort((group[row] * len(idf) + gram) * n + row)
    if not len(posting):
        return _NO_PAIRS
    posting = posting[np.concatenate(([True], posting[1:] != posting[:-1]))]
    key, row = np.divmod(posting, n)
    weight = idf[key % len(idf)]
    weight /= np.sqrt(np.bincount(row, weight * weight, n))[row]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    each = np.diff(first, append=len(key))
    start = np.repeat(first, each)
    indexed = np.arange(n) < np.repeat(np.cumsum(sizes) - sizes + posted, sizes)
    met = np.minimum(np.arange(len(key)) - start, np.repeat(np.add.reduceat(indexed[row].astype(np.int64), first), each))
    out = []
    step = max(CELLS // n, 1)
    for low in range(0, n, step):
        asked = np.flatnonzero((met > 0) & (row >= low) & (row < low + step))
        if not len(asked):
            continue
        many = met[asked]
        end = np.cumsum(many)
        left = np.arange(end[-1]) + np.repeat(start[asked] - end + many, many)
        cosines = np.bincount(np.repeat((row[asked] - low) * n, many) + row[left], np.repeat(weight[asked], many) * weight[left])
        found = np.flatnonzero(cosines >= least - 1e-9)
        # at the threshold itself sums of another order must not decide
        for at in np.flatnonzero(cosines[found] < least + 1e-9).tolist():
            i, j = found[at] % n, found[at] // n + low
            cosines[found[at]] = _cosine(names[i], names[j], vectors)
        found = found[cosines[found] >= least]
        out.append((found % n, found // n + low, cosines[found]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else _NO_PAIRS


def alike_names(groups: list[list[str]], vectors: Vectors, least: float = LEAST, person: bool = True, posted: list[int] | None = None) -> Iterator[tuple[int, int, float]]:
    """(i, j, cosine) within each group as `similar_names` gives, numbered over all groups, without pairs
    whose surnames are sure to be two names, so that `unlike` gives None. Where only the first `posted` names
    of each group are indexed, pairs have one of them.

    Small groups are joined together. Of pairs below 0.6, or of firms, the letters that two surnames do not
    share bound their edits from below."""
    batch: list[list[str]] = []
    firsts: list[int] = []
    starts: list[int] = []
    start = size = 0
    for k, names in enumerate(groups):
        if len(names) > 1 and (posted is None or posted[k]):
            if batch and size + len(names) > BATCH:
                yield from _alike(batch, firsts, starts, vectors, least, person)
                batch, firsts, starts, size = [], [], [], 0
            batch.append(names)
            firsts.append(len(names) if posted is None else posted[k])
            starts.append(start)
            size += len(names)
        start += len(names)
    if batch:
        yield from _alike(batch, firsts, starts, vectors, least, person)


def _alike(groups: list[list[str]], posted: list[int], starts: list[int], vectors: Vectors, least: float, person: bool) -> Iterator[tuple[int, int, float]]:
    sizes = [len(g) for g in groups]
    names = [x for g in groups for x in g]
    left, right, cosines = _joined(names, sizes, posted, vectors, least)
    if not len(left):
        return
    n = len(names)
    surnames = [x[x.index(" ") + 1 : -1] for x in names]
    length = np.array([len(s) for s in surnames])
    letter = np.frombuffer("".join(surnames).encode("utf-32-le"), dtype=np.uint32) & 31
    count = np.bincount(np.repeat(np.arange(n) * 32, length) + letter, minlength=n * 32).reshape(n, 32)
    shared = np.minimum(count[left], count[right]).sum(axis=1)
    p, q = length[left], length[right]
    # up to three edits, or one may be a part of the other
    kept = (np.maximum(p, q) - shared < 4) | (shared == np.minimum(p, q))
    if person:
        kept |= cosines >= 0.6
    number = np.arange(n) + np.repeat(np.array(starts) - np.cumsum(sizes) + sizes, sizes)
    left, right = left[kept], right[kept]
    yield from zip(number[left].tolist(), number[right].tolist(), cosines[kept].tolist())


NONE: frozenset[str] = frozenset()


class Evidence:
    """What two records of one block say about being the same person or organisation, added up."""

    __slots__ = ("kind", "first", "bases", "sure", "middle", "suffix", "zip", "emps", "occ", "street", "org", "sur", "name", "short")

    def __init__(self, kind, sur, first, middle, suffix, zip_, emps, occ, street, org):
        self.kind, self.sur, self.middle, self.suffix, self.zip, self.occ, self.street, self.org = kind, sur, middle, suffix, zip_, occ, street, org
        self.first = first.rstrip(UNSURE)
        self.bases = NONE if kind == "o" else bases(self.first)
        self.sure = first != "" if kind == "o" else len(first) > 1 and len(self.bases) == 1 and self.first == first
        self.name, self.short = whole_name(kind, first, sur), f" {sur}$"
        self.emps = emps.split()


def given_score(a: Evidence, b: Evidence) -> float | None:
    """Evidence of the given names, or kinds of firm; None where they exclude each other."""
    x, y = a.first, b.first
    if a.kind == "o":
        return 6.0 if x == y else 4.0 if not x or not y else None
    if not x or not y:
        s = 0.0
    elif len(x) == 1 or len(y) == 1:
        if x == y and len(x) == 1:
            s = 1.5
        else:
            i, full = (x, b) if len(x) == 1 else (y, a)
            if i == full.first[0] or any(i == f[0] for f in full.bases):
                s = 2.0
            else:
                return _by_middle(a, b)
    elif a.bases & b.bases:
        s = 4.0 if x == y else 3.5
    elif not (a.sure and b.sure) and x[:2] == y[:2] and distance(x, y) <= 1:
        s = 3.0
    else:
        return _by_middle(a, b)
    m, n = a.middle, b.middle
    if m and n:
        if m == n:
            s += 3.0 if len(m) > 1 else 2.0
        elif len(m) == 1 or len(n) == 1:
            if m[0] != n[0]:
                return None
            s += 2.0
        elif bases(m) & bases(n) or distance(m, n) <= 1:
            s += 2.5
        else:
            return None
    return s


def _by_middle(a: Evidence, b: Evidence) -> float | None:
    """One goes by the middle name: 'D. Cyrus' and 'Cyrus', 'Cyrus D.' and 'D. Cyrus'."""
    for p, q in ((a, b), (b, a)):
        if len(p.first) == 1 and len(p.middle) > 1 and len(q.first) > 1 and bases(p.middle) & q.bases:
            if not q.middle:
                return 2.0
            if q.middle[0] == p.first:
                return 3.0
    return None


# the same few spellings meet again and again within a place
distance = lru_cache(100_000)(typo_distance)


def same_word(p: str, q: str) -> bool:
    return p == q or (len(p) > 4 and len(q) > 4 and p[:2] == q[:2] and abs(len(p) - len(q)) < 3 and distance(p, q) <= 2) or (min(len(p), len(q)) > 4 and (p.startswith(q) or q.startswith(p)))


_masks = lru_cache(100_000)(masks)


@lru_cache(100_000)
def _letters_in(word: str) -> int:
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 31)
    return out


@lru_cache(200_000)
def edits(p: str, q: str) -> int:
    """Levenshtein distance; a swap of letters, which leaves the same ones, as one."""
    d = levenshtein(p, _masks(p), q)
    return d - 1 if d == 2 and len(p) == len(q) and sorted(p) == sorted(q) else d


def surname_penalty(p: str, q: str, cosine: float) -> float | None:
    """What two spellings of a surname take away; None where they are two surnames."""
    if p == q:
        return 0.0
    a, b = _letters_in(p), _letters_in(q)
    # an edit takes out one letter and brings in one, at most
    d = edits(p, q) if abs(len(p) - len(q)) < 4 and (a & ~b).bit_count() < 4 and (b & ~a).bit_count() < 4 else 9
    if d <= 2:
        return 0.6 * d
    if min(len(p), len(q)) > 4 and (p.startswith(q) or q.startswith(p) or p.endswith(q) or q.endswith(p)):
        # one of two surnames left out
        return 1.0
    if d == 3 or cosine >= 0.6:
        return 3.0
    return None


def unlike(a: Evidence, b: Evidence, cosine: float) -> float | None:
    """What names that are not the same take away, by their cosine; None where they are two names."""
    less = surname_penalty(a.sur, b.sur, cosine if a.kind == "p" else 0.0)
    # the less alike the names are, the less they say
    return None if less is None else less + (1.0 - cosine)


def score(a: Evidence, b: Evidence, less: float = 0.0) -> float | None:
    """Evidence of two nodes, less what their names take away; None where they exclude each other."""
    s = given_score(a, b)
    if s is None:
        return None
    s -= less
    if a.suffix and b.suffix:
        if a.suffix != b.suffix:
            return None
        s += 2.0
    elif a.suffix or b.suffix:
        s -= 0.5
    if a.zip and b.zip:
        s += 0.7 if a.zip == b.zip else -2.0
    if a.emps and b.emps:
        s += 4.0 if any(same_word(p, q) for p in a.emps for q in b.emps) else -2.5
    if a.occ and b.occ:
        s += 1.5 if a.occ == b.occ or distance(a.occ, b.occ) <= 1 else -2.0
    if a.street and b.street:
        s += 5.0 if a.street == b.street else -2.5
    if a.org and b.org and a.org == b.org:
        s += 3.0
    return s - 2.5


def average_linkage(n: int, similar: dict[tuple[int, int], float], threshold: float = 0.0, missing: float = MISSING, large: int = 60, sizes: list[int] | None = None) -> list[int]:
    """Cluster numbers of n nodes: the two clusters with the greatest mean similarity merge while it is
    above the threshold; a pair that is not given counts as `missing`. With `sizes` the nodes are
    clusters already, and `similar` has their means."""
    if n == 1:
        return [0]
    if n == 2:
        return [0, 0] if similar.get((0, 1), missing) > threshold else [0, 1]
    m = np.full((n, n), missing, dtype=np.float32)
    for (i, j), s in similar.items():
        m[i, j] = m[j, i] = s
    np.fill_diagonal(m, -np.inf)
    if n > large:
        return _linkage_by_rows(m, threshold, sizes)
    size, label = np.array(sizes or [1] * n, dtype=float), list(range(n))
    while True:
        at = int(np.argmax(m))
        i, j = divmod(at, n)
        if m[i, j] <= threshold:
            return label
        i, j = min(i, j), max(i, j)
        m[i] = (m[i] * size[i] + m[j] * size[j]) / (size[i] + size[j])
        m[:, i] = m[i]
        m[i, i] = -np.inf
        m[j, :] = m[:, j] = -np.inf
        size[i] += size[j]
        label = [i if x == j else x for x in label]


def _linkage_by_rows(m: np.ndarray, threshold: float, sizes: list[int] | None = None) -> list[int]:
    """The same with each row's best neighbour kept, so a merge costs a row, not the matrix."""
    n = len(m)
    size, up = np.array(sizes or [1] * n, dtype=float), np.arange(n)
    arg = m.argmax(axis=1)
    best = m[np.arange(n), arg]
    while True:
        i = int(best.argmax())
        if best[i] <= threshold:
            break
        i, j = sorted((i, int(arg[i])))
        row = (m[i] * size[i] + m[j] * size[j]) / (size[i] + size[j])
        size[i] += size[j]
        m[i] = m[:, i] = row
        m[i, i] = -np.inf
        m[j, :] = m[:, j] = -np.inf
        best[j], up[j] = -np.inf, i
        for k in np.nonzero((arg == i) | (arg == j))[0]:
            arg[k] = m[k].argmax()
            best[k] = m[k, arg[k]]
        arg[i] = m[i].argmax()
        best[i] = m[i, arg[i]]
        better = m[:, i] > best
        arg[better], best[better] = i, m[better, i]
    label = up.tolist()
    for k in range(n):
        while label[k] != label[label[k]]:
            label[k] = label[label[k]]
    return label


def _grouped(members: list[int], pairs: dict[tuple[int, int], float]) -> list[list[int]]:
    """Average linkage of nodes, by what hangs together through positive evidence: only that can merge."""
    uf = UnionFind(len(members))
    at = {n: k for k, n in enumerate(members)}
    for (i, j), s in pairs.items():
        if s > 0:
            uf.join(at[i], at[j])
    together: dict[int, list[int]] = {}
    for k, n in enumerate(members):
        together.setdefault(uf.find(k), []).append(n)
    out = []
    for own in together.values():
        if len(own) < 3:
            out.append(own)
            continue
        if all(pairs.get((i, j), 0.0) > 0 for p, i in enumerate(own) for j in own[p + 1 :]):
            # no mean of positive evidence is negative
            out.append(own)
            continue
        where = {n: k for k, n in enumerate(own)}
        similar = {(where[i], where[j]): pairs[i, j] for p, i in enumerate(own) for j in own[p + 1 :] if (i, j) in pairs}
        parts: dict[int, list[int]] = {}
        for n, c in zip(own, average_linkage(len(own), similar, missing=MISSING)):
            parts.setdefault(c, []).append(n)
        out.extend(parts.values())
    return out


class Alike:
    """The names of a block that the cosine join brings together, (name, name, cosine): whole names of nodes that
    are sure, of one formal given name, and surnames of which one has nodes that are not sure."""

    def __init__(self, nodes: list[Evidence], vectors: Vectors, least: float = LEAST):
        whole: dict[object, dict[str, None]] = {}
        short: dict[str, bool] = {}
        for e in nodes:
            if e.sure:
                whole.setdefault(e.bases, {})[e.name] = None
            short[e.short] = short.get(e.short, True) and e.sure
        names = sorted(short, key=short.__getitem__)
        # all in one join
        groups = [*map(list, whole.values()), names]
        posted = [*map(len, groups[:-1]), len(names) - sum(short.values())]
        found = list(alike_names(groups, vectors, least, nodes[0].kind == "p", posted))
        flat = [n for g in groups for n in g]
        first = len(flat) - len(names)
        self.whole = [(flat[p], flat[q], c) for p, q, c in found if q < first]
        self.short = [(flat[p], flat[q], c) for p, q, c in found if p >= first and c >= LEAST_SURNAME]


def evidence_pairs(nodes: list[Evidence], vectors: Vectors, least: float = LEAST, chunks: list[int] | None = None, alike: Alike | None = None) -> Iterator[tuple[int, int, float]]:
    """(i, j, evidence), i < j, of the nodes whose names the cosine join brings together. With `chunks`, only
    pairs of nodes of two chunks. `alike` may hold names of other nodes too."""
    alike = alike or Alike(nodes, vectors, least)
    # whole names where both given names are sure, and one formal name; surnames otherwise
    owners: dict[str, list[int]] = {}
    short: dict[str, tuple[list[int], list[int]]] = {}
    for i, e in enumerate(nodes):
        if e.sure:
            owners.setdefault(e.name, []).append(i)
        short.setdefault(e.short, ([], []))[0 if e.sure else 1].append(i)
    near: list[tuple[list[int], list[int], float]] = [(own, own, 1.0) for own in owners.values()]
    near += [(owners[p], owners[q], c) for p, q, c in alike.whole if p in owners and q in owners]
    for xs, us in short.values():
        if us:
            near += [(xs, us, 1.0), (us, us, 1.0)]
    for p, q, c in alike.short:
        if p in short and q in short:
            (xs, us), (ys, vs) = short[p], short[q]
            near += [(us, vs, c), (us, ys, c), (xs, vs, c)]
    for xs, ys, c in near:
        if not xs or not ys:
            continue
        less = 0.0 if c == 1.0 else unlike(nodes[xs[0]], nodes[ys[0]], c)
        if less is None:
            continue
        for i in xs:
            for j in ys:
                if (i < j or xs is not ys) and (chunks is None or chunks[i] != chunks[j]):
                    a, b = (i, j) if i < j else (j, i)
                    s = score(nodes[a], nodes[b], less)
                    yield a, b, MISSING if s is None else s


def hanging_together(nodes: list[Evidence], vectors: Vectors, least: float = LEAST, chunks: list[int] | None = None) -> Iterator[tuple[int, int]]:
    """Pairs (i, first of its part) of the nodes that no cluster can be decided without: positive evidence, and
    between a node that is sure and one that is not all that could be the second best and keep it away."""
    uf = UnionFind(len(nodes))
    for a, b, s in evidence_pairs(nodes, vectors, least, chunks):
        if s > (0.0 if nodes[a].sure == nodes[b].sure else -AHEAD):
            uf.join(a, b)
    for i in range(len(nodes)):
        if uf.find(i) != i:
            yield i, uf.find(i)


def cluster_block(nodes: list[Evidence], vectors: Vectors, least: float = LEAST, alike: Alike | None = None) -> tuple[list[int], list[float]]:
    """For the nodes of a block the number of their cluster (its first member) and how strongly they
    belong to it: infinite, but for initials and the like."""
    n = len(nodes)
    if n == 1:
        return [0], [math.inf if nodes[0].sure else 0.0]
    firm: dict[tuple[int, int], float] = {}
    loose: dict[tuple[int, int], float] = {}
    mixed: dict[int, dict[int, float]] = {}
    for a, b, s in evidence_pairs(nodes, vectors, least, alike=alike):
        if nodes[a].sure and nodes[b].sure:
            firm[a, b] = s
        elif not (nodes[a].sure or nodes[b].sure):
            loose[a, b] = s
        else:
            k, m = (b, a) if nodes[a].sure else (a, b)
            mixed.setdefault(k, {})[m] = s
    done = _grouped([i for i, e in enumerate(nodes) if e.sure], firm)
    strength = [math.inf if e.sure else 0.0 for e in nodes]
    home = {i: k for k, members in enumerate(done) for i in members}
    # initials, ambiguous short names, middle names: to the cluster that they agree with best
    attached: list[tuple[int, list[int]]] = []
    alone: list[list[int]] = []
    for group in _grouped([i for i, e in enumerate(nodes) if not e.sure], loose):
        found = []
        for k in sorted({home[m] for i in group for m in mixed.get(i, ())}):
            got = [mixed.get(i, {}).get(m, MISSING) for i in group for m in done[k]]
            found.append((sum(got) / len(got), k))
        found.sort(reverse=True)
        if found and found[0][0] > 0 and (len(found) == 1 or found[0][0] > found[1][0] + AHEAD):
            attached.append((found[0][1], group))
            for i in group:
                strength[i] = found[0][0]
        else:
            alone.append(group)
    for k, group in attached:
        done[k] = done[k] + group
    label = list(range(n))
    for members in done + alone:
        # named after a node that is sure, where there is one, as others may end up elsewhere
        first = min(members, key=lambda i: (not nodes[i].sure, i))
        for i in members:
            label[i] = first
    return label, strength


def _mean(xs: list[Evidence], ys: list[Evidence], vectors: Vectors) -> float:
    """Mean evidence of two clusters; a contradiction weighs as in average linkage."""
    total = 0.0
    for x in xs:
        for y in ys:
            p, q, least = (x.name, y.name, LEAST) if x.sure and y.sure else (x.short, y.short, LEAST_SURNAME)
            c = 1.0 if p == q else _cosine(p, q, vectors)
            less = 0.0 if c == 1.0 else unlike(x, y, c) if c >= least else None
            s = None if less is None else score(x, y, less)
            total += MISSING if s is None else s
    return total / (len(xs) * len(ys))


def _cosine(p: str, q: str, vectors: Vectors) -> float:
    own = vectors.of(p)
    return sum([x * own[g] for g, x in vectors.of(q).items() if g in own])


def _link_clusters(key: tuple, rows: list[tuple], vectors: Vectors) -> Iterator[tuple]:
    """rows(key, cluster, side, loc, node, FIELDS...), whole clusters: 'm' with each cluster and the one
    it belongs to, 'e' with the evidence of clusters of two sides and places, its sum and number."""
    rows.sort(key=lambda r: (r[1], r[4]))
    found: dict[int, tuple[str, set, list]] = {}
    for r in rows:
        side, locs, ev = found.setdefault(r[1], (r[2], set(), []))
        locs.add(r[3])
        ev.append(Evidence(*r[5:]))
    for side in {x[0] for x in found.values()}:
        own = [c for c, x in found.items() if x[0] == side]
        similar = {}
        for p in range(len(own)):
            for q in range(p + 1, len(own)):
                x, y = found[own[p]], found[own[q]]
                s = _mean(x[2], y[2], vectors)
                # within a place it is decided
                similar[p, q] = min(s, 0.0) if x[1] & y[1] else s
        for c, head in zip(own, average_linkage(len(own), similar, sizes=[len(found[c][2]) for c in own])):
            if c != own[head]:
                yield "m", c, own[head], 0.0, 0
    for lc, (side, llocs, lev) in found.items():
        if side == "l":
            for rc, (other, rlocs, rev) in found.items():
                if other == "r" and not llocs & rlocs:
                    n = len(lev) * len(rev)
                    yield "e", lc, rc, _mean(lev, rev, vectors) * n, n


def components(links: DataFrame) -> DataFrame:
    """(a, root) for links(a, b): the least member of what hangs together, by passing it on until
    nothing changes."""
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")), "roots")
    while True:
        passed = both.join(roots.select(F.col("a").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        new = materialize(roots.join(passed, "a").select("a", F.least("root", "r").alias("root"), (F.col("r") < F.col("root")).alias("moved")), "roots")
        discard(roots)
        roots = new.drop("moved")
        roots._kinsieve_path = new._kinsieve_path
        if new.where("moved").isEmpty():
            discard(both)
            return roots


def _evidence_words(emps: str = "emps", org: str = "org") -> Column:
    # without a lambda, which is not compiled
    none = F.array().cast("array<string>")
    return F.concat(F.when(F.col(emps) != "", F.split(emps, " ")).otherwise(none), F.when(F.col(org) != "", F.array(F.concat(F.lit("@"), F.col(org)))).otherwise(none))


def across_places(nodes: DataFrame, clusters: DataFrame, vectors) -> tuple[DataFrame, DataFrame]:
    """Clusters of two places that share a surname and an employer or organisation, compared whole:
    (cluster, head) of those that belong to another one, and the evidence (a, b, total, n) between sides.
    nodes(node, side, loc, FIELDS...), clusters(node, cluster); both are read several times."""
    posted = nodes.where("emps <> '' or org <> ''").select("node", "loc", "kind", "sur", F.explode(_evidence_words()).alias("word")).select("node", F.xxhash64("loc").alias("place"), F.xxhash64("kind", "sur", "word").alias("key"))
    # most keys are known in one place only
    wide = posted.groupBy("key").agg(F.min("place").alias("least"), F.max("place").alias("most")).where("least <> most").select("key")
    touched = materialize(posted.join(wide, "key").join(clusters, "node").select("key", "cluster").distinct(), "touched")
    fields = ["key", "cluster", "side", "loc", "node", *FIELDS]
    schema = "row string, a bigint, b bigint, total double, n bigint"
    # few clusters are in question, so all their rows are looked up once
    members = materialize(touched.select("cluster").distinct().join(clusters, "cluster").join(nodes, "node").select(*fields[1:]), "members")
    whole = lambda keys: keys.join(members, "cluster").select(*fields)
    link = lambda key, rows: _link_clusters(key, rows, vectors.value)
    links = materialize(by_group(whole(touched), ["key"], link, schema), "across")
    # what hangs together by several keys is decided at once
    together = components(links.where("row = 'm'")).select(F.col("a").alias("cluster"), F.col("root").alias("key"))
    heads = materialize(by_group(whole(together), ["key"], link, schema).where("row = 'm'").select(F.col("a").alias("cluster"), F.col("b").alias("head")), "heads")
    discard(touched)
    discard(members)
    return heads, links.where("row = 'e'").select("a", "b", "total", "n").distinct()


def _dealt(df: DataFrame, blocks: DataFrame, item: str, mine: Column, other: Column) -> DataFrame:
    """df(block, item, ...) by `chunk` of its items, a row for each chunk (`with`) that a task compares it with.
    mine, other: into how many chunks a row and those it is compared with go, by columns of blocks."""
    return df.join(blocks, "block").withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), item), mine).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), other - 1)))


def _chunks(n: str, split: int) -> Column:
    """Two chunks are about `split` items."""
    return F.greatest(F.ceil(F.col(n) * 2 / split), F.lit(1)).cast("int")


def blocks(nodes: DataFrame, vectors, split: int = SPLIT, least: float = LEAST, side: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame | None]:
    """(whole, parts): nodes with `block`, a row for each block that a node stands in. Blocks of more than
    `split` nodes, if any, are in `parts`, with `part` for what hangs together in them (and is of one `side`)."""
    out = nodes.select("*", F.explode(F.array_remove(F.split("letters", ""), "")).alias("letter")).select("*", F.xxhash64("loc", "kind", "letter").alias("block")).drop("letter")
    hot = out.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > split)
    if hot.isEmpty():
        return out, None
    hot = materialize(hot, "hot")
    inside = materialize(out.join(hot.select("block"), "block").withColumn("vertex", F.xxhash64("block", "node")), "inside")
    rows = _dealt(inside, hot.select("block", _chunks("n", split).alias("k")), "node", F.col("k"), F.col("k"))
    rows = rows.select(*side, "block", F.least("chunk", "with").alias("p"), F.greatest("chunk", "with").alias("q"), "node", "vertex", "chunk", *FIELDS)
    at = len(side) + 3

    def join(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        rows.sort(key=lambda r: r[at])
        ev = [Evidence(*r[at + 3 :]) for r in rows]
        for i, j in hanging_together(ev, vectors.value, least, None if key[-2] == key[-1] else [r[at + 2] for r in rows]):
            yield rows[i][at + 1], rows[j][at + 1]

    links = materialize(by_group(rows, [*side, "block", "p", "q"], join, "a bigint, b bigint"), "links")
    roots = components(links).select(F.col("a").alias("vertex"), "root")
    parts = inside.join(roots, "vertex", "left").withColumn("part", F.coalesce("root", "vertex")).drop("vertex", "root")
    return out.join(hot, "block", "left_anti"), materialize(parts, "parts")


def _nodes(people: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, object]:
    """(located, nodes, vectors): the records with their node, the nodes, what names weigh."""
    located = with_places(people).withColumn("node", F.xxhash64(*keys))
    nodes = materialize(located.select("node", *keys).distinct(), "nodes")
    counts, total = gram_counts(nodes)
    return located, nodes, people.sparkSession.sparkContext.broadcast(Vectors(counts, total))


def _shared() -> Column:
    """Whether a node stands in several blocks."""
    return (F.length("letters") > 1).alias("shared")


def settle(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, cluster) and the links (a, b) of clusters that a sure node holds together, for
    found(node, cluster, strength, shared) of all blocks, shared where a node may stand in several of them. A
    node that is not sure goes where it is strongest."""
    alone, found = found.where("not shared").select("node", "cluster"), found.where("shared")
    seen = materialize(found.groupBy("node").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.max("strength").alias("s")), "memberships")
    # few nodes stand in several blocks with unlike clusters
    several = found.join(seen.where("low <> high").select("node"), "node")
    best = several.groupBy("node").agg(F.max(F.struct("strength", "cluster")).alias("b")).select("node", "b.cluster", "b.strength")
    clusters = alone.unionByName(seen.where("low = high").select("node", F.col("low").alias("cluster"))).unionByName(best.select("node", "cluster"))
    held = best.where("strength = double('infinity')").select("node", F.col("cluster").alias("b"))
    links = several.where("strength = double('infinity')").join(held, "node").where("cluster <> b").select(F.col("cluster").alias("a"), "b").distinct()
    return clusters, links


def person_clusters(people: DataFrame, split: int = SPLIT, least: float = LEAST) -> DataFrame:
    """(rec, name, cluster) for people(rec, name, NODE...): records of one person or organisation share
    the cluster."""
    people = materialize(people, "read")
    located, nodes, vectors = _nodes(people, NODE)

    def resolve(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        rows.sort(key=lambda r: r[2])
        labels, strength = cluster_block([Evidence(*r[3:-1]) for r in rows], vectors.value, least)
        for r, c, s in zip(rows, labels, strength):
            yield r[2], rows[c][2], s, r[-1]

    whole, parts = blocks(nodes, vectors, split, least)
    grouped = whole.withColumn("part", F.col("block"))
    if parts is not None:
        grouped = grouped.unionByName(parts)
    grouped = grouped.select("block", "part", "node", *FIELDS, _shared())
    found = materialize(by_group(grouped, ["block", "part"], resolve, "node bigint, cluster bigint, strength double, shared boolean"), "found")
    clusters, links = settle(found)
    clusters = with_heads(clusters, "cluster", components(links).select(F.col("a").alias("cluster"), F.col("root").alias("head")))
    clusters = materialize(clusters, "clusters")
    heads, _ = across_places(nodes.withColumn("side", F.lit("")), clusters, vectors)
    return located.select("rec", "name", "node").join(with_heads(clusters, "cluster", heads), "node").select("rec", "name", "cluster")


def with_heads(df: DataFrame, column: str, heads: DataFrame) -> DataFrame:
    """df with the clusters in a column replaced by the ones they belong to, by heads(cluster, head)."""
    return df.join(heads.withColumnsRenamed({"cluster": column}), column, "left").withColumn(column, F.coalesce("head", column)).drop("head")


def variant_pairs(clusters: DataFrame) -> DataFrame:
    """(rec_a, rec_b): records of one cluster whose names are not the identical string. The clusters
    themselves are the result without any pairs: membership, one row per record."""
    # renamed behind the join, so both sides read one exchange
    a, b = clusters.alias("a"), clusters.alias("b")
    pairs = a.join(b, F.col("a.cluster") == F.col("b.cluster")).where("a.rec < b.rec and a.name <> b.name")
    return pairs.select(F.col("a.rec").alias("rec_a"), F.col("b.rec").alias("rec_b"))


def linked_sources(people: DataFrame, max_rounds: int = 200, split: int = SPLIT) -> DataFrame:
    """(left_rec, right_rec, probability) for people(side, rec, ...) of two sources, side 'l' or 'r'.

    Each source is first clustered by itself, as the same person may be listed under several keys. The
    clusters of a block, or of a surname and employer or organisation in two places, are the candidates;
    their mean evidence is the prior that belief propagation starts from.
    """
    people = materialize(people.where("kind = 'p'"), "read")
    located, nodes, vectors = _nodes(people, ["side", *NODE])

    def resolve(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        rows.sort(key=lambda r: r[1])
        evidence = [Evidence(*r[3:-1]) for r in rows]
        alike = Alike(evidence, vectors.value)
        read = []
        for side in ("l", "r"):
            own = [(r, e) for r, e in zip(rows, evidence) if r[2] == side]
            if own:
                labels, strength = cluster_block([e for _, e in own], vectors.value, alike=alike)
                for (r, e), c, s in zip(own, labels, strength):
                    yield "m", r[1], own[c][0][1], 0, s, int(r[-1])
                    read.append((own[c][0][1], side, e))
        yield from candidates(read, alike)

    def resolve_part(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        # rows(block, node, side, FIELDS..., shared, part)
        rows.sort(key=lambda r: r[1])
        labels, strength = cluster_block([Evidence(*r[3:-2]) for r in rows], vectors.value)
        for r, c, s in zip(rows, labels, strength):
            yield key[0], r[1], rows[c][1], s, int(r[-2])

    def resolve_far(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        # rows(block, p, q, cluster, node, side, FIELDS...)
        rows.sort(key=lambda r: r[4])
        read = [(r[3], r[5], Evidence(*r[6:])) for r in rows]
        yield from candidates(read, Alike([e for _, _, e in read], vectors.value))

    def candidates(read: list[tuple], alike: Alike) -> Iterator[tuple]:
        """Evidence between the clusters of both sides, for (cluster, side, evidence) in the order of nodes."""
        sides: dict[str, dict[int, list[Evidence]]] = {"l": {}, "r": {}}
        for c, side, e in read:
            sides[side].setdefault(c, []).append(e)
        parts = {side: list(groups.items()) for side, groups in sides.items()}
        if not parts["l"] or not parts["r"]:
            return
        # candidates: clusters with names that the cosine join brings together; two given names that are
        # sure and unlike exclude each other
        whole: dict[str, tuple[set[int], set[int]]] = {}
        short: dict[str, tuple[set[int], set[int], set[int], set[int]]] = {}
        for k, side in enumerate(("l", "r")):
            for n, (_, members) in enumerate(parts[side]):
                for e in members:
                    if e.sure:
                        whole.setdefault(e.name, (set(), set()))[k].add(n)
                    short.setdefault(e.short, (set(), set(), set(), set()))[k if e.sure else k + 2].add(n)
        pairs = {(n, m) for ls, rs in whole.values() for n in ls for m in rs}
        for p, q, _ in alike.whole:
            for (ls, _), (_, rs) in ((whole[p], whole[q]), (whole[q], whole[p])):
                if ls and rs:
                    pairs.update((n, m) for n in ls for m in rs)
        loose = [(n, n, 1.0) for n, own in short.items() if own[2] or own[3]]
        for p, q, _ in loose + alike.short:
            for (ls, _, lu, _), (_, rs, _, ru) in ((short[p], short[q]), (short[q], short[p])):
                if lu and (rs or ru):
                    pairs.update((n, m) for n in lu for m in rs | ru)
                if ls and ru:
                    pairs.update((n, m) for n in ls for m in ru)
        for n, m in sorted(pairs):
            (lc, lev), (rc, rev) = parts["l"][n], parts["r"][m]
            size = len(lev) * len(rev)
            mean = _mean(lev, rev, vectors.value)
            # a candidate has a pair of records that do not exclude each other
            if mean > MISSING:
                yield "e", 0, lc, rc, mean * size, size

    schema = "row string, node bigint, cluster bigint, other bigint, total double, n bigint"
    columns = ["block", "node", "side", *FIELDS]
    whole, parts = blocks(nodes, vectors, split, side=("side",))
    got = by_group(whole.select(*columns, _shared()), ["block"], resolve, schema)
    if parts is not None:
        # hot blocks: clusters part by part, then whole clusters of either side are dealt to tasks
        settled = materialize(by_group(parts.select(*columns, _shared(), "part"), ["block", "part"], resolve_part, "block bigint, node bigint, cluster bigint, strength double, shared bigint"), "settled")
        inside = settled.join(parts, ["block", "node"]).select("cluster", *columns)
        sizes = inside.groupBy("block").agg(F.count_if(F.col("side") == "l").alias("nl"), F.count_if(F.col("side") == "r").alias("nr"))
        sizes = sizes.select("block", _chunks("nl", split).alias("kl"), _chunks("nr", split).alias("kr"))
        left, k = F.col("side") == "l", lambda a, b: F.when(F.col("side") == "l", F.col(a)).otherwise(F.col(b))
        rows = _dealt(inside, sizes, "cluster", k("kl", "kr"), k("kr", "kl"))
        rows = rows.select("block", F.when(left, F.col("chunk")).otherwise(F.col("with")).alias("p"), F.when(left, F.col("with")).otherwise(F.col("chunk")).alias("q"), "cluster", "node", "side", *FIELDS)
        far = by_group(rows, ["block", "p", "q"], resolve_far, schema)
        own = settled.select(F.lit("m").alias("row"), "node", "cluster", F.lit(0).cast("bigint").alias("other"), F.col("strength").alias("total"), F.col("shared").alias("n"))
        got = got.unionByName(far).unionByName(own)
    got = materialize(got, "candidates")
    clusters, links = settle(got.where("row = 'm'").select("node", "cluster", F.col("total").alias("strength"), (F.col("n") > 0).alias("shared")))
    roots = materialize(components(links).select(F.col("a").alias("cluster"), F.col("root").alias("head")), "roots")
    clusters = materialize(with_heads(clusters, "cluster", roots), "clusters")
    heads, far = across_places(nodes, clusters, vectors)
    edges = got.where("row = 'e'").select(F.col("cluster").alias("lc"), F.col("other").alias("rc"), "total", "n")
    edges = with_heads(with_heads(edges, "lc", roots), "rc", roots).unionByName(far.withColumnsRenamed({"a": "lc", "b": "rc"}))
    # the parts of a cluster in several blocks weigh by the pairs that were compared
    edges = with_heads(with_heads(edges, "lc", heads), "rc", heads).groupBy("lc", "rc").agg((F.sum("total") / F.sum("n")).alias("score"))
    matched = match_probabilities(edges, "lc", "rc", "score", max_rounds=max_rounds)
    members = located.select("rec", "node", "side").join(with_heads(clusters, "cluster", heads), "node")
    left = members.where("side = 'l'").select(F.col("rec").alias("left_rec"), F.col("cluster").alias("lc"))
    right = members.where("side = 'r'").select(F.col("rec").alias("right_rec"), F.col("cluster").alias("rc"))
    return matched.join(left, "lc").join(right, "rc").select("left_rec", "right_rec", "probability")
