"""Filling fixed-capacity containers: hierarchical residual packing.

Each partition packs its items best-fit, the largest first. Bins that are nearly full are final. The
others move up as items of their own, to fewer and fewer partitions, where best fit combines them
again, until one partition holds them all. A task never holds more than about `leaf_rows` of them: the
first level has partitions enough for that, and where the underfull bins are too many for fewer tasks,
they are dealt anew among as many, until a round leaves no fewer of them. Only underfull bins ever move.

Defined cases: an item larger than the capacity is split into pieces of the full capacity and one
rest, every other item stays whole; an item of size 0, null or below takes no room but gets a
container; a repeated id is packed once for each row; an empty table gives no rows. Item order does
not matter: ties go by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsieve.session import discard, materialize, partitions

_SCHEMA = "capacity_id int, capacity int, fill int, final boolean, bin string, items array<struct<id:bigint,piece:int,size:int>>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices per bin, best fit over sizes in the given order; no size exceeds the capacity. The open
    residuals are the bits of one integer: the tightest bin that fits is its lowest bit from `size` up."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = {}
    mask = 0
    for i, size in enumerate(sizes):
        fits = mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            stack = room[left]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << left)
            bins[b].append(i)
        else:
            b, left = len(bins), capacity
            bins.append([i])
        left -= size
        room.setdefault(left, []).append(b)
        mask |= 1 << left
    return bins


def _pack(level: int, nearly: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: dict[tuple[int, int], list[tuple[int, int, int, list]]] = {}
        for pdf in batches:
            for cid, cap, fill, items in zip(pdf["capacity_id"], pdf["capacity"], pdf["fill"], pdf["items"]):
                first = items[0]
                rows.setdefault((cid, cap), []).append((-fill, first["id"], first["piece"], items))
        part = TaskContext.get().partitionId()
        for (cid, cap), own in sorted(rows.items()):
            own.sort(key=lambda r: r[:3])
            out = []
            for n, members in enumerate(best_fit([-r[0] for r in own], cap)):
                fill = -sum(own[i][0] for i in members)
                out.append((cid, cap, fill, fill >= nearly * cap, f"{cid}-{level}-{part}-{n}", [x for i in members for x in own[i][3]]))
            for at in range(0, len(out), 5000):
                yield pd.DataFrame(out[at : at + 5000], columns=["capacity_id", "capacity", "fill", "final", "bin", "items"])

    return run


def pack(items: DataFrame, item_id: str, size: str, capacities: list[tuple[int, int]], nearly: float = 0.995, fan_in: int = 4, leaf_rows: int = 200_000) -> DataFrame:
    """(capacity_id, item_id, piece_no, piece_size, container_id) for every item and capacity.

    capacities: (id, size) of each container kind, a handful. leaf_rows bounds the bins in one task.
    """
    spark = items.sparkSession
    width = max(partitions(spark), -(-items.count() * len(capacities) // leaf_rows))
    n = F.greatest(F.coalesce(F.col(size).cast("int"), F.lit(0)), F.lit(0))
    kinds = F.array(*[F.struct(F.lit(i).cast("int").alias("capacity_id"), F.lit(c).cast("int").alias("capacity")) for i, c in capacities])
    # the pieces of an item: full ones, then the rest; an item of size 0 is one piece
    rows = (
        items.select(F.col(item_id).cast("bigint").alias("id"), n.alias("n"))
        .where("id is not null")
        .select("id", "n", F.explode(kinds).alias("k"))
        .select("id", "n", "k.*")
        .select("id", "n", "capacity_id", "capacity", F.explode(F.sequence(F.lit(0), F.greatest(F.expr("(n + capacity - 1) div capacity"), F.lit(1)) - 1)).alias("piece"))
        .select("capacity_id", "capacity", "id", F.col("piece").cast("int").alias("piece"), F.least(F.col("n") - F.col("piece") * F.col("capacity"), F.col("capacity")).cast("int").alias("fill"))
        .repartition(width, "id")
        .select("capacity_id", "capacity", "fill", F.array(F.struct("id", "piece", F.col("fill").alias("size"))).alias("items"))
    )
    done, level, before = [], 0, None
    while True:
        packed = materialize(rows.mapInPandas(_pack(level, nearly), _SCHEMA), f"bins{level}")
        if width == 1:
            done.append(packed)
            break
        left = packed.where("not final")
        count = left.count()
        fewer = max(width // fan_in, -(-count // leaf_rows), 1)
        if fewer >= width and before is not None and count >= before:
            # dealt anew, none of them could be combined
            done.append(packed)
            break
        done.append(packed.where("final"))
        width, level, before = min(fewer, width), level + 1, count
        # by hash of the bin, so that a lost task is redone over the same rows
        rows = left.repartition(width, F.xxhash64("bin", F.lit(level))).select("capacity_id", "capacity", "fill", "items")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("capacity_id", F.col("bin").alias("container_id"), F.explode("items").alias("i")).select(
        "capacity_id", F.col("i.id").alias("item_id"), F.col("i.piece").alias("piece_no"), F.col("i.size").alias("piece_size"), "container_id"
    )
