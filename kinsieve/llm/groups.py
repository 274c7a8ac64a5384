"""Python over the groups of a sorted partition, without a call per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinsieve.session import partitions


def by_group(df: DataFrame, keys: list[str], fn: Callable[[tuple, list[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """fn(key, rows) for each group; rows are tuples in df's column order. Groups are brought together
    by hash and sorted, which spills; a group itself is held in memory, so callers fold copies before
    and give keys whose groups their rules keep small."""
    where = [df.columns.index(k) for k in keys]
    width, names = partitions(df.sparkSession), StructType.fromDDL(schema).names

    def run(batches):
        key, rows, out = None, [], []
        for pdf in batches:
            for row in zip(*[pdf[c].tolist() for c in pdf.columns]):
                k = tuple(row[i] for i in where)
                if k != key:
                    if rows:
                        out.extend(fn(key, rows))
                    key, rows = k, []
                rows.append(row)
                if len(out) >= 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if rows:
            out.extend(fn(key, rows))
        if out:
            yield pd.DataFrame(out, columns=names)

    # another hash than the planner's own, whose exchange it would merge to a few tasks
    return df.repartition(width, F.xxhash64(*keys)).sortWithinPartitions(*keys).mapInPandas(run, schema)


class UnionFind:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
