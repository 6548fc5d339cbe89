"""Shared working storage for stages that must outlive a lost executor.

Everything a later stage reads back is written to the folder named by
``spark.checkpoint.dir``.  A folder of our own is only made for a local master, where
one machine holds driver and workers; on a cluster a session without one raises.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read and write; raises where a cluster's session names none."""
    folder = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"{_CONF} must name a folder that all machines of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
        spark.conf.set(_CONF, folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below this application's part of the shared folder."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lexiloom/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: later stages depend on files, not on executors.  The files
    stay until :func:`discard` or :func:`clear`.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._working_path = path
    return written


def discard(df: DataFrame | None) -> None:
    """Remove the files of a frame that :func:`materialise` made; any other frame is left alone."""
    path = getattr(df, "_working_path", None)
    if path:
        _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Remove all working tables of this application."""
    _delete(spark, _own_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` in at least as many partitions as there are cores.

    For heavy work on an input of few splits; an input that has enough of them is left alone.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def shuffled(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` partitioned by ``keys``, in the number of partitions of a shuffle.

    For heavy work on few bytes: that number is kept, where partitions that a join or an
    aggregation makes of its own accord are merged by their size in bytes.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables: a parquet file or a folder of them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows
