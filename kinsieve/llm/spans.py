"""Long exact spans shared between records: sliding runs of consecutive units, hashed and joined.

A unit is a word (between blanks and line breaks) or a sentence. A run of `n` units that occurs in two
documents makes its units shared; the maximal stretches of shared units come out, and for each run
whether its document is the first that holds it, so that the other copies can be removed.

Hashing every run of a corpus would move a row per unit. Instead a first pass moves winnowed anchors
only: of the hashes of half-runs it keeps the least of every window, so each run of n units holds at
least one anchor that depends on its own content alone, and two copies of a run hold the same one.
Documents without an anchor that recurs elsewhere leave here. Only the runs around a recurring anchor
are then hashed in full and joined. Copies of a hash are counted by partial aggregates, so a notice in
a third of all documents costs a row for each of its places, never a pair.

Defined cases: null and empty texts and texts of fewer than n units share nothing; a run repeated only
within one document is not shared; repeated rows of one document id count as one document (their runs
are the same); equal runs are decided by 64 bits of hash, then confirmed by a second, independent hash.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinsieve.session import materialize

_BLANKS = re.compile(r"[ \t\r\n\f\v]+")
_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+[\"')\]]*|\n|$)")
# odd multipliers, invertible modulo 2**64
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_INV1, _INV2 = pow(_B1, -1, 1 << 64), pow(_B2, -1, 1 << 64)


def split_units(text: str | None, unit: str) -> list[str]:
    if not isinstance(text, str):
        return []
    if unit == "word":
        return [w for w in _BLANKS.split(text) if w]
    return [s for m in _SENTENCE.finditer(text) if (s := m.group().strip())]


class _Powers:
    def __init__(self, base: int, inverse: int):
        self.base, self.inverse, self.size = np.uint64(base), np.uint64(inverse), 0
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size > len(self.up):
            size = max(size, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, self.base)]), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, self.inverse)]), dtype=np.uint64)
        return self.up, self.down


_P1, _P2 = _Powers(_B1, _INV1), _Powers(_B2, _INV2)


def rolling(hashes: np.ndarray, n: int, powers: _Powers) -> np.ndarray:
    """A hash of every run of n units, in one pass over prefix sums."""
    m = len(hashes)
    if m < n:
        return np.zeros(0, np.uint64)
    up, down = powers.get(m + 1)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:m], dtype=np.uint64)])
        x = (prefix[n:] - prefix[:-n]) * down[: m - n + 1]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return x


def anchors(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions, hashes, length) of the winnowed half-runs: the least of every window of them, ties
    included, such that each run of n units covers a whole window."""
    k = (n + 1) // 2
    x = rolling(hashes, k, _P1)
    window = n - k + 1
    if len(x) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), k
    least = np.lib.stride_tricks.sliding_window_view(x, window).min(axis=1)
    # a half-run is kept if it is the least of some window that holds it
    spread = np.full(len(x), 0, np.uint64)
    view = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    spread = np.lib.stride_tricks.sliding_window_view(view, window).max(axis=1)
    at = np.nonzero(x == spread)[0]
    return at, x[at], k


def _unit_hashes(units: list[str], memo: dict[str, int]) -> np.ndarray:
    out = []
    for u in units:
        h = memo.get(u)
        if h is None:
            h = xxhash.xxh3_64_intdigest(u)
            if len(memo) < 200_000:
                memo[u] = h
        out.append(h)
    return np.array(out, dtype=np.uint64)


HOT = 1000  # a hash that makes up more than 1 in HOT of all rows is hot: there are fewer than HOT of them


def _join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], total: int, how: str) -> DataFrame:
    """rows joined to counted(keys, n, ...), where n is how many of the `total` rows have the keys. The hot
    ones, fewer than HOT rows by their definition, are broadcast, so their rows stay where they are."""
    hot = F.broadcast(counted.where(F.col("n") > total / HOT).drop("n"))
    cold = counted.where(F.col("n") <= total / HOT).drop("n")
    return rows.join(hot, keys, how).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how))


def shared_runs(docs: DataFrame, doc_id: str, text: str, n: int, unit: str = "word") -> DataFrame:
    """(doc_id, start, first_doc): every run of n units that occurs in another document too, by the
    position of its first unit; first_doc is the least document id that holds the run."""
    base = docs.select(docs[doc_id].cast("bigint").alias("d"), docs[text].alias("t")).where("d is not null and length(t) > 0")

    def marks(batches):
        memo: dict[str, int] = {}
        for pdf in batches:
            ds, hs = [], []
            for d, t in zip(pdf["d"], pdf["t"]):
                _, h, _ = anchors(_unit_hashes(split_units(t, unit), memo), n)
                h = np.unique(h)
                hs.append(h.view(np.int64))
                ds.append(np.full(len(h), d, np.int64))
            yield pd.DataFrame({"d": np.concatenate(ds), "h": np.concatenate(hs)} if ds else {"d": np.zeros(0, np.int64), "h": np.zeros(0, np.int64)})

    marked = materialize(base.mapInPandas(marks, "d bigint, h bigint"), "anchors")
    recurring = marked.groupBy("h").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("h", "n")
    # bounded by the anchors of one document
    wanted = _join_counted(marked, recurring, ["h"], marked.count(), "left_semi").groupBy("d").agg(F.collect_set("h").alias("hs"))

    def runs(batches):
        memo: dict[str, int] = {}
        for pdf in batches:
            out = []
            for d, t, want in zip(pdf["d"], pdf["t"], pdf["hs"]):
                x = _unit_hashes(split_units(t, unit), memo)
                at, h, k = anchors(x, n)
                at = at[np.isin(h.view(np.int64), np.asarray(want, dtype=np.int64))]
                first, second = rolling(x, n, _P1), rolling(x, n, _P2)
                if not len(at) or not len(first):
                    continue
                edge = np.zeros(len(first) + 1, np.int64)
                np.add.at(edge, np.maximum(at - (n - k), 0), 1)
                np.add.at(edge, np.minimum(at + 1, len(first)), -1)
                s = np.nonzero(np.cumsum(edge[:-1]) > 0)[0]
                out.append(pd.DataFrame({"d": np.full(len(s), d, np.int64), "s": s.astype(np.int32), "h": first[s].view(np.int64), "g": second[s].view(np.int64)}))
            yield pd.concat(out) if out else pd.DataFrame({"d": np.zeros(0, np.int64), "s": np.zeros(0, np.int32), "h": np.zeros(0, np.int64), "g": np.zeros(0, np.int64)})

    hashed = materialize(base.join(wanted, "d").mapInPandas(runs, "d bigint, s int, h bigint, g bigint"), "runs")
    shared = hashed.groupBy("h", "g").agg(F.min("d").alias("first_doc"), F.max("d").alias("hi"), F.count("*").alias("n")).where("first_doc <> hi").select("h", "g", "first_doc", "n")
    return _join_counted(hashed, shared, ["h", "g"], hashed.count(), "inner").select(F.col("d").alias("doc_id"), F.col("s").alias("start"), "first_doc").distinct()


def stretches(runs: DataFrame, n: int) -> DataFrame:
    """(doc_id, start_unit, n_units): the maximal stretches that runs of n units cover. One document is
    one window; a text bounds it."""
    w = W.partitionBy("doc_id").orderBy("start")
    return (
        runs.select("doc_id", "start")
        .distinct()
        .withColumn("fresh", (F.col("start") > F.lag("start").over(w) + n).cast("int"))
        .withColumn("stretch", F.sum(F.coalesce("fresh", F.lit(0))).over(w))
        .groupBy("doc_id", "stretch")
        .agg(F.min("start").alias("start_unit"), (F.max("start") - F.min("start") + n).cast("int").alias("n_units"))
        .drop("stretch")
    )


def drop_repeated(docs: DataFrame, doc_id: str, text: str, n: int = 3, unit: str = "sentence") -> DataFrame:
    """(doc_id, n_units, removed_units, kept_text): every text without the units that a run covers which
    another document, with a smaller id, holds too; the first copy of a run stays."""
    repeats = shared_runs(docs, doc_id, text, n, unit).where("first_doc <> doc_id")
    starts = repeats.groupBy("doc_id").agg(F.collect_set("start").alias("starts"))
    joined = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("t")).where("doc_id is not null").join(starts, "doc_id", "left")

    def cut(batches):
        for pdf in batches:
            out = []
            for d, t, s in zip(pdf["doc_id"], pdf["t"], pdf["starts"]):
                units = split_units(t, unit)
                gone = {i for a in (s if s is not None else ()) for i in range(a, a + n)}
                out.append((d, len(units), len(gone), " ".join(u for i, u in enumerate(units) if i not in gone)))
            yield pd.DataFrame(out, columns=["doc_id", "n_units", "removed_units", "kept_text"]).astype({"n_units": "int32", "removed_units": "int32"})

    return joined.mapInPandas(cut, "doc_id bigint, n_units int, removed_units int, kept_text string")
