"""Preprocessing of a stream of documents: the stages that need no other document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.vocabulary import encode
from lexiloom.plans.pipeline import Pipeline


def stream_tokens(documents: DataFrame, pipeline: Pipeline | None = None) -> DataFrame:
    """``doc_id, pos, token`` of a streaming frame ``doc_id, text``; cleaned, tokenised, without stopwords."""
    pipeline = pipeline or Pipeline.default()
    rows = pipeline.tokenise(documents)
    return rows.filter(~F.col("token").isin(list(pipeline.stopwords))) if pipeline.stopwords else rows


def stream_encoded(documents: DataFrame, dictionary: DataFrame, pipeline: Pipeline | None = None) -> DataFrame:
    """``doc_id, pos, word_id`` against a fixed dictionary; other tokens are left out."""
    return encode(stream_tokens(documents, pipeline), dictionary)


def stream_frequencies(documents: DataFrame, time: str, window: str = "1 day", delay: str = "1 day", pipeline: Pipeline | None = None) -> DataFrame:
    """``window, token, freq``: term counts by window of a timestamp column, late rows up to ``delay``."""
    pipeline = pipeline or Pipeline.default()
    timed = documents.withWatermark(time, delay).select(F.struct("doc_id", time).alias("doc_id"), "text")
    rows = stream_tokens(timed, pipeline).select(F.col(f"doc_id.{time}").alias(time), "token")
    return rows.groupBy(F.window(time, window), "token").agg(F.count(F.lit(1)).alias("freq"))
