"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks of a byte-level BPE vocabulary, one "token rank" line each; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How such a vocabulary cuts text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def token_sizes(documents: DataFrame, keep: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id LONG``, the columns of ``keep`` and ``size LONG``, the tokens of the text.

    A null text has size 0.  The vocabulary's file is read on the driver and
    broadcast; its size is that of the vocabulary, whatever the data.
    """
    keep = keep or []
    ranks = documents.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    rows = documents.select(F.col("doc_id").cast("long"), *keep, "text")
    fields = rows.drop("text").schema
    schema = fields.add("size", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(ranks.value)
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(x)) if x else 0 for x in batch["text"].to_pylist()]
            kept = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sizes, pa.int64())], [*kept.schema.names, "size"])

    return rows.mapInArrow(run, schema)
