"""Consecutive numbers in a global order, without one task that sees all rows.

Rows are range-partitioned and sorted; a row's place in its partition comes from
the partition's own counter and the partitions' offsets from one count for
each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

_PLACE = (1 << 33) - 1


def number_rows(df: DataFrame, order: list[Column], name: str, first: int = 0) -> DataFrame:
    """df with the column `name`: first, first + 1, ... in the given order, which should have no ties."""
    keys = {f"__order{i}": c for i, c in enumerate(order)}
    keyed = df.withColumns(keys)
    ranged = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    # written once: a second run of the range partitioning could draw other bounds
    placed = stored(ranged.withColumn("__n", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__n", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__first"))
    joined = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return joined.withColumn(name, (F.col("__first") + F.col("__n").bitwiseAND(F.lit(_PLACE)) + F.lit(first)).cast("long")).drop("__part", "__n", "__first")
