"""Stopword lists."""

from __future__ import annotations

from collections.abc import Iterable
from importlib import resources
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def read_stopwords(path: str | Path, charset: str = "UTF-8") -> list[str]:
    """The lines of a file, one word each; blank lines are no words."""
    return [w for w in Path(path).read_text(charset).splitlines() if w]


def default_stopwords() -> list[str]:
    """The built-in list: English function words, by part of speech."""
    lines = resources.files("lexiloom.resources").joinpath("stopwords.txt").read_text("utf-8").splitlines()
    return sorted({w for line in lines if not line.startswith("#") for w in line.split()})


def stopword_table(spark: SparkSession, words: Iterable[str]) -> DataFrame:
    """One column ``token``, each word once; a local relation, whose size the planner knows."""
    return spark.createDataFrame(pa.table({"token": pa.array(sorted(set(words)), pa.string())}))
