"""Problem 4: the most frequent items of a large column.

Method: exact spillable aggregation.  ``groupBy`` counts with map-side combining,
its hash partitions spill to disk, every partition keeps its best k and one
final ordered limit merges them.  Memory per task is bounded by Spark's
aggregation buffers, not by the number of distinct values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_items(rows: DataFrame, column: str) -> DataFrame:
    """Exact number of rows of every non-null value: the column and ``n_rows``."""
    return rows.select(column).filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))


def frequent_items(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent values with their counts.

    Returns the column and ``n_rows LONG``; ties are resolved by the larger value.
    Nulls are ignored, repeated rows count as they stand, an empty table gives no
    rows.  The ordered limit keeps k rows per partition and k in the end.
    """
    return count_items(rows, column).orderBy(F.col("n_rows").desc(), F.col(column).desc()).limit(k)


def notable_items(rows: DataFrame, column: str, permille: int) -> DataFrame:
    """Values that make up at least ``permille`` thousandths of the non-null rows.

    Returns the column, ``n_rows LONG`` and ``share DOUBLE``.  At most
    1000 / permille values can reach the share, so the limit drops none.
    """
    total = rows.agg(F.count(column).alias("n")).scalar()
    best = frequent_items(rows, column, 1000 // permille)
    return best.filter(F.col("n_rows") * 1000 >= total * permille).withColumn("share", F.col("n_rows") / total)
