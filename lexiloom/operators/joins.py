"""Joins of token rows with a table of their keys, in which no hot key meets in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.storage import shuffled

#: A key is split if it holds more than this part of the rows, so there are at most so many such keys.
PARTS = 10_000


def fits_broadcast(table: DataFrame) -> bool:
    """Whether the planner takes a table to be small enough to be sent to every executor."""
    size = table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    limit = table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(size) <= limit


def split_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", heavy: bool = False) -> DataFrame:
    """``rows`` joined to ``table`` on ``key``, of which the table has each value once; ``how``: inner, left or left_semi.

    A table that is small enough is left to the planner, which broadcasts it.  Beyond
    that, a key that holds more than 1 / ``PARTS`` of the rows is spread over parts of about that
    size, and its row of the table is repeated for them.  There are fewer than
    ``PARTS`` such keys, so they may be broadcast, and fewer than twice as many repeated rows.
    ``heavy``: the result is worked on at length, so its partitions are not merged by their bytes.
    Rows with a null key have no partner.  ``rows`` is read twice, so a stream is joined as it comes.
    """
    if rows.isStreaming or fits_broadcast(table):
        return rows.join(table, key, how)
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    hot = F.broadcast(counts.filter(F.col("_n") * PARTS > total).select(key, F.ceil(F.col("_n") * PARTS / total).cast("int").alias("_parts")))
    others = [c for c in rows.columns if c != key]
    part = F.coalesce(F.pmod(F.xxhash64(*others), F.col("_parts")), F.lit(0)).cast("int") if others else F.lit(0)
    spread = rows.join(hot, key, "left").withColumn("_part", part).drop("_parts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    repeated = table.join(hot, key, "left").withColumn("_part", every).drop("_parts")
    if heavy:
        spread = shuffled(spread, key, "_part")
    return spread.join(repeated, [key, "_part"], how).drop("_part")
