"""Consecutive numbers in a global order, without a global sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.storage import materialise


def dense_ids(rows: DataFrame, order: Sequence[str | Column], name: str, kind: str = "long") -> DataFrame:
    """Adds ``name``: 0, 1, ... in ``order``, ascending with nulls first where only a name is given; ties in any order.

    Range partitions are sorted and written; a number is the rows of the partitions
    before plus the place in its own.  Only one count per partition is gathered
    by the window.
    """
    asc = [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order]
    place = rows.repartitionByRange(*asc).sortWithinPartitions(*asc).withColumn("_at", F.monotonically_increasing_id())
    written = materialise(place, "ordered").withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = written.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = written.join(parts.select("_part", "_before"), "_part")
    local = F.col("_at").bitwiseAND((1 << 33) - 1)
    return joined.withColumn(name, (F.col("_before") + local).cast(kind)).drop("_at", "_part", "_before")
