"""Text files as documents: one line, one document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators.ordering import dense_ids


def read_lines(spark: SparkSession, path: str | Sequence[str], charset: str = "UTF-8") -> DataFrame:
    """``doc_id LONG, text STRING`` of every line, in the order of files and lines.

    Lines end in LF, CR or CR LF; blank lines are empty documents; a last line
    without an end counts.  A missing path raises.  UTF-8 files are read in splits; any
    other charset is decoded file by file, with U+FFFD for malformed bytes.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if charset.upper().replace("_", "-") in ("UTF-8", "UTF8"):
        lines = spark.read.text(paths).select("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))
        return dense_ids(lines, ["file_path", "file_block_start", "line"], "doc_id").select("doc_id", "text")

    def decode(batches):
        for batch in batches:
            texts = [x.decode(charset, "replace").replace("\r\n", "\n").replace("\r", "\n") for x in batch["content"]]
            yield batch.drop(columns="content").assign(lines=[x.removesuffix("\n").split("\n") if x else [] for x in texts])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    lines = files.mapInPandas(decode, "path string, lines array<string>").select("path", F.posexplode("lines").alias("line", "text"))
    return dense_ids(lines, ["path", "line"], "doc_id").select("doc_id", "text")


def from_texts(spark: SparkSession, texts: Sequence[str]) -> DataFrame:
    """Documents of a list; the place in it is the id."""
    return spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string")
