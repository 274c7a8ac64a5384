"""Evaluation texts leaking into training text: a BM25 inverted index with block-max WAND, then an exact check.

The test items are indexed: for each word the list of its items with their BM25 weights, the greatest
weight in the list, and the greatest in every block of items. Every training text is a query. As in
WAND, the lists of its words that are too light to reach any threshold together bring up no pivot; the
heavier lists do. An item is dropped where its weights so far and the greatest of the light lists fall
short of its threshold, then where the light lists' block maxima do, and only what passes both is
scored in full. The threshold of an item is the least score that `span` consecutive words of it can
have: a text that holds such a span scores at least that, so no case is lost. What is retrieved is
checked word for word, and the longest shared run reported.

Size bound of what is broadcast: `group` items at a time. A larger held-out set is split by hash of the
item id; each part is collected, broadcast and searched by itself, and the results are put together.

Defined cases: null and empty texts match nothing; an item with fewer than `span` words cannot leak by
this rule; a repeated item or document id counts once; words are the maximal runs of letters and
digits of the lower-cased text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
_WEIGHT = itemgetter(2)
_SLACK = 1e-6


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if isinstance(text, str) else []


class BlockMaxIndex:
    """Items by ordinal, the greatest thresholds first, so that those of a block are near each other."""

    def __init__(self, items: list[tuple[int, str]], span: int, block: int = 8, k1: float = 1.2, b: float = 0.75):
        self.span, self.block = span, block
        texts = [(i, w) for i, t in items if len(w := words(t)) >= span]
        n = len(texts)
        mean = sum(len(w) for _, w in texts) / n if n else 1
        df = Counter(t for _, w in texts for t in set(w))
        idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
        scored = []
        for i, w in texts:
            own = {t: idf[t] * c * (k1 + 1) / (c + k1 * (1 - b + b * len(w) / mean)) for t, c in Counter(w).items()}
            runs = [w[s : s + span] for s in range(len(w) - span + 1)]
            scored.append((min(sum(own[t] for t in set(r)) for r in runs) - _SLACK, i, w, own))
        scored.sort(key=lambda x: (-x[0], x[1]))
        self.ids = [i for _, i, _, _ in scored]
        self.words = [w for _, _, w, _ in scored]
        self.least = [x for x, _, _, _ in scored]
        # the runs of an item by the words they need
        self.runs = [[(frozenset(w[s : s + span]), f" {' '.join(w[s : s + span])} ") for s in range(len(w) - span + 1)] for w in self.words]
        self.block_least = [min(self.least[e : e + block]) for e in range(0, n, block)]
        # the lists: items, weights, greatest weight, greatest weight by block
        self.lists: dict[str, tuple[list[int], list[float], float, list[float]]] = {}
        for j, (_, _, _, own) in enumerate(scored):
            for t, x in own.items():
                at, ws, _, _ = self.lists.setdefault(t, ([], [], 0.0, []))
                at.append(j)
                ws.append(x)
        for t, (at, ws, _, _) in self.lists.items():
            top = [0.0] * len(self.block_least)
            for j, x in zip(at, ws):
                top[j // block] = max(top[j // block], x)
            self.lists[t] = (at, ws, max(ws), top)

    def retrieve(self, present: set[str]) -> list[tuple[int, float]]:
        """(ordinal, score) of every item whose score for a text of these words reaches its threshold."""
        if not self.ids:
            return []
        lists = [self.lists[t] for t in self.lists.keys() & present]
        floor = self.least[-1]  # no threshold is below the last item's
        total = sum(x[2] for x in lists)
        if total < floor:
            return []
        # Weak and: the lightest lists, which together stay below every threshold, bring up no pivot.
        lists.sort(key=_WEIGHT)
        light, n = 0.0, 0
        while n < len(lists) and light + lists[n][2] < floor:
            light += lists[n][2]
            n += 1
        rest, least, block = lists[:n], self.least, self.block
        pivots: dict[int, float] = {}
        for at, ws, _, _ in lists[n:]:
            for j, x in zip(at, ws):
                pivots[j] = pivots.get(j, 0.0) + x
        found, bounds = [], {}
        for j, score in pivots.items():
            if score + light < least[j]:
                continue
            # block maxima: what the light lists can add to an item of this block
            k = j // block
            more = bounds.get(k)
            if more is None:
                more = bounds[k] = sum([x[3][k] for x in rest])
            if score + more < least[j]:
                continue
            for at, ws, _, top in rest:
                if top[k]:
                    i = bisect_left(at, j)
                    if i < len(at) and at[i] == j:
                        score += ws[i]
            if score >= least[j]:
                found.append((j, score))
        return found

    def search(self, tokens: list[str]) -> list[tuple[int, float, int]]:
        """(item, score, words of the longest shared run) of the items that share `span` consecutive words
        with the text."""
        if len(tokens) < self.span:
            return []
        present, text, hits = set(tokens), None, []
        for j, score in self.retrieve(present):
            for need, run in self.runs[j]:
                if need <= present:
                    text = text or f" {' '.join(tokens)} "
                    if run in text:
                        hits.append((self.ids[j], score, self._longest(j, text)))
                        break
        return hits

    def _longest(self, j: int, text: str) -> int:
        w, best = self.words[j], self.span
        for s in range(len(w) - self.span + 1):
            while s + best < len(w) and f" {' '.join(w[s : s + best + 1])} " in text:
                best += 1
        return best


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, span: int = 10, group: int = 20_000) -> DataFrame:
    """(doc_id, item_id, score, n_words): every document that contains `span` consecutive words of an
    item, with the BM25 score and the length of the longest shared run."""
    spark = docs.sparkSession
    held = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).groupBy(F.col(item_id).cast("bigint").alias("i")).agg(F.max(item_text).alias("t"))
    parts = max(1, math.ceil(held.count() / group))
    queries = docs.select(docs[doc_id].cast("bigint").alias("d"), docs[text].alias("t")).where("d is not null and t is not null")
    out = None
    for part in range(parts):
        own = held.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == part) if parts > 1 else held
        shared = spark.sparkContext.broadcast(BlockMaxIndex(sorted((r.i, r.t) for r in own.collect()), span))

        def run(batches, shared=shared):
            index = shared.value
            for pdf in batches:
                found = [(d, i, s, n) for d, t in zip(pdf["d"], pdf["t"]) for i, s, n in index.search(words(t))]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "score", "n_words"]).astype({"doc_id": "int64", "item_id": "int64", "score": "float64", "n_words": "int32"})

        found = queries.mapInPandas(run, "doc_id bigint, item_id bigint, score double, n_words int")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("n_words").alias("n_words"))
