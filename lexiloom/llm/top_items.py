"""Problem 2: the top N items within every group.

Method: statistics-guided skipping.  The rows are written once, clustered by
group and sorted by descending score, in small row groups.  A task that selects
from such files reads their row groups in descending maximum score and leaves
out those whose maximum lies strictly below the N-th score that every one of their groups has
reached.  The footer tells the group of a row group that has one only; the groups of others are read from
their key columns, and only if the footer's maximum makes it worth while.

Skew: range partitioning by group and score cuts a hot group into many files, by
score.  A task goes through a fixed number of neighbouring files and passes the thresholds on from file to file; what it selects,
at most N items per group and task, is merged by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.storage import new_path

#: Rows of a row group of the clustered table.
ROW_GROUP_ROWS = 4_000
#: Files of the clustered table that one task goes through, passing thresholds on.
TASK_FILES = 4

_NULLABLE = {pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype()}.get


def cluster_by_group(rows: DataFrame, keys: list[str], item: str, score: str) -> str:
    """Write ``rows`` clustered by group, best scores first; returns the folder."""
    best_first = [*(F.col(k).asc_nulls_first() for k in keys), F.col(score).desc(), F.col(item).desc()]
    path = new_path(rows.sparkSession, "clustered")
    ordered = rows.repartitionByRange(*best_first).sortWithinPartitions(*best_first)
    ordered.write.option("parquet.block.row.count.limit", ROW_GROUP_ROWS).parquet(path)
    return path


def plan_row_groups(meta: pq.FileMetaData, keys: list[str], score: str) -> list[tuple[float, tuple | None, int]]:
    """(maximum score, the only group or None for several, row group), best first."""
    column = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
    plan = []
    for g in range(meta.num_row_groups):
        stats = {k: meta.row_group(g).column(column[k]).statistics for k in [*keys, score]}
        known = all(s is not None and s.has_min_max for s in stats.values())
        top = stats[score].max if known else float("inf")
        pure = known and all(stats[k].min == stats[k].max and stats[k].null_count == 0 for k in keys)
        plan.append((top, tuple(stats[k].min for k in keys) if pure else None, g))
    return sorted(plan, key=lambda x: (-x[0], x[2]))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a file that Spark names; Hadoop's names of an object store are those of the store itself."""
    scheme, rest = uri.split(":", 1)
    return pafs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


def _name(values) -> tuple:
    return tuple(None if pd.isna(x) else x.item() if hasattr(x, "item") else x for x in values)


def _later(one: tuple, other: tuple) -> bool:
    """Whether a group comes after another; nulls come first."""
    for x, y in zip(one, other):
        if x != y:
            return y is None or x is not None and x > y
    return False


def _groups(table: pq.ParquetFile, g: int, keys: list[str]) -> list[tuple]:
    """The groups of a row group, from its key columns alone."""
    rows = table.read_row_group(g, columns=keys).to_pandas(types_mapper=_NULLABLE)
    return [_name(x) for x in rows.drop_duplicates().itertuples(index=False)]


def _cut(rows: pd.DataFrame, keys: list[str], item: str, score: str, n: int) -> pd.DataFrame:
    """The best ``n`` items of every group, groups in order, each item once."""
    rows = rows.sort_values([*keys, score, item], ascending=[True] * len(keys) + [False, False], kind="stable", na_position="first")
    return rows.drop_duplicates([*keys, item]).groupby(keys, sort=False, dropna=False).head(n)


def select_top(files: list[str], keys: list[str], item: str, score: str, n: int, seen: dict | None = None) -> Iterator[pd.DataFrame]:
    """The best ``n`` items of every group over these files, which come in the order of their groups, in frames.

    Groups are clustered, so all but the first and the last of a row group are
    complete in it; only the best rows of those two are kept, each with the score that
    its n-th item has reached.  After a file only its last group can come again, so
    no more than the groups that cross row groups of one file are held.  ``seen``, if given, counts the row groups read and skipped.
    """
    seen = {} if seen is None else seen
    best: dict[tuple, pd.DataFrame] = {}
    reached: dict[tuple, float] = {}
    for uri in files:
        fs, path = file_system(uri)
        last = None
        with fs.open_input_file(path) as source:
            table = pq.ParquetFile(source)
            for top, group, g in plan_row_groups(table.metadata, keys, score):
                held = [group] if group is not None else _groups(table, g, keys) if reached and top < max(reached.values()) else [None]
                if all(top < reached.get(k, float("-inf")) for k in held):
                    seen["skipped"] = seen.get("skipped", 0) + 1
                    continue
                seen["read"] = seen.get("read", 0) + 1
                rows = table.read_row_group(g, columns=[*keys, item, score]).to_pandas(types_mapper=_NULLABLE)
                rows = _cut(rows, keys, item, score, n)
                number = rows.groupby(keys, sort=False, dropna=False).ngroup()
                yield rows[(number > 0) & (number < number.max())]
                for k in {0, int(number.max())}:
                    part = rows[number == k]
                    name = _name(part.iloc[0][keys])
                    if k == number.max() and (last is None or _later(name, last)):
                        last = name
                    if name in best:
                        part = _cut(pd.concat([best[name], part]), keys, item, score, n)
                    best[name] = part
                    if len(part) == n:
                        reached[name] = float(part[score].iloc[-1])
        for name in [k for k in best if k != last]:
            yield best.pop(name)
            reached.pop(name, None)
    yield from best.values()


def top_items(rows: DataFrame, keys: list[str], item: str, score: str, n: int) -> DataFrame:
    """Places 1 to ``n`` of the items of every group.

    Returns the keys, ``place INT``, the item and its score.  The order is by
    score descending, then item descending by code points.  An item that occurs
    several times in a group counts once, with its highest score.  Rows whose
    score is null or NaN or whose item is null are ignored; a null key is a group
    like any other.  Groups of fewer than ``n`` items list them all.  Other columns
    are not read.  An empty table gives no rows.  Eager: writes the clustered table.
    """
    spark = rows.sparkSession
    valid = rows.select(*keys, item, score).filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(item).isNotNull())
    valid = valid.withColumn(score, F.col(score) + F.lit(0.0))  # one zero only
    clustered = spark.read.schema(valid.schema).parquet(cluster_by_group(valid, keys, item, score))
    files = sorted(clustered.inputFiles())
    # a task for every few files, however many cores there are: what it holds does not grow with the data
    runs = [(files[i : i + TASK_FILES],) for i in range(0, len(files), TASK_FILES)]
    tasks = spark.createDataFrame(runs or [([],)], "files array<string>").repartition(max(1, len(runs)))

    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for names in batch["files"]:
                yield from select_top(list(names), keys, item, score, n)

    local = tasks.mapInPandas(select, valid.schema)
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(item).desc())
    once = local.groupBy(*keys, item).agg(F.max(score).alias(score))
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).select(*keys, "place", item, score)
