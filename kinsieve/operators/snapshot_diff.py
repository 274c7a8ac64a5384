"""What changed between full snapshots of a keyed table.

Every row of a snapshot is unpivoted into cells (key, field, value) and one key-presence marker.
A cell counts +1 in the comparison that its snapshot ends and -1 in the one that it begins, so the
cells that did not change sum to zero. The nonzero sums that are left say all: a presence of +1 is
an added record, of -1 a removed one, and a record whose presence cancels but whose fields do not is
a changed one, those fields being the changed ones. No snapshot is joined with another.

Defined cases: null and '' are the same value; a null key takes no part; of several rows of a key in
one snapshot the one with the greatest `version` counts (nulls lowest, then the greatest values, so
the choice does not depend on the order of rows); an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_PRESENT = "\x00present"


def snapshot_diff(df: DataFrame, key: str, snapshot: str, fields: Mapping[str, Column], version: str | None = None) -> DataFrame:
    """(record_key, snapshot_no, change_kind, changed_fields) for every record that differs between a
    snapshot and the one delivered before it; snapshot_no is the later one.

    fields: name -> expression of the compared value; changed_fields lists those names, sorted, and
    is empty for added and removed records.
    """
    names = list(fields)
    rows = df.select(
        F.col(key).cast("string").alias("k"),
        F.col(snapshot).alias("s"),
        (F.col(version) if version else F.lit(0)).alias("v"),
        F.struct(*[F.coalesce(e.cast("string"), F.lit("")).alias(f"f{i}") for i, e in enumerate(fields.values())]).alias("r"),
    ).where(F.col("k").isNotNull() & F.col("s").isNotNull())
    # Copies and outdated versions fold together before the shuffle, so a key with very many rows stays small.
    latest = rows.groupBy("k", "s").agg(F.max(F.struct("v", "r")).getField("r").alias("r"))
    # As many rows as there were deliveries: a bound that does not follow the number of records.
    places = W.orderBy("s")
    order = rows.select("s").distinct().select("s", F.lead("s").over(places).alias("following"), F.lag("s").over(places).isNull().alias("opening"))
    ends = latest.join(F.broadcast(order), "s").repartition("k")
    # One exchange on the key serves both aggregations below.
    sides = ends.select(
        "k",
        "r",
        F.explode(
            F.array_compact(
                F.array(
                    # the first delivery is compared with none
                    F.when(~F.col("opening"), F.struct(F.col("s").alias("no"), F.lit(1).alias("sign"))),
                    F.when(F.col("following").isNotNull(), F.struct(F.col("following").alias("no"), F.lit(-1).alias("sign"))),
                )
            )
        ).alias("e"),
    )
    cells = F.array(
        F.struct(F.lit(_PRESENT).alias("field"), F.lit("").alias("value")),
        *[F.struct(F.lit(n).alias("field"), F.col(f"r.f{i}").alias("value")) for i, n in enumerate(names)],
    )
    sums = (
        sides.select("k", F.col("e.no").alias("no"), F.col("e.sign").alias("sign"), F.explode(cells).alias("c"))
        .groupBy("k", "no", "c.field", "c.value")
        .agg(F.sum("sign").alias("n"))
        .where("n <> 0")
    )
    present = F.coalesce(F.max(F.when(F.col("field") == _PRESENT, F.col("n"))), F.lit(0))
    return (
        sums.groupBy("k", "no")
        .agg(present.alias("p"), F.array_sort(F.collect_set(F.when(F.col("field") != _PRESENT, F.col("field")))).alias("changed"))
        .select(
            F.col("k").alias("record_key"),
            F.col("no").alias("snapshot_no"),
            F.when(F.col("p") > 0, "added").when(F.col("p") < 0, "removed").otherwise("changed").alias("change_kind"),
            F.when(F.col("p") == 0, F.col("changed")).otherwise(F.array().cast("array<string>")).alias("changed_fields"),
        )
    )
