"""Tokenising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.binding import let


def split_tokens(text: Column, delimiter: str = " ") -> Column:
    """Split at a regular expression.

    Trailing empty tokens are dropped, leading and inner ones kept.  A text without
    the delimiter is one token, so an empty text is one empty token; a text of
    delimiters alone has no tokens.  Null gives null.
    """
    last = lambda parts: F.coalesce(F.array_max(F.transform(parts, lambda x, i: F.when(x != "", i + 1))), F.lit(0))
    whole = lambda parts: (F.size(parts) == 1) | (F.element_at(parts, -1) != "")
    # the text is named, and worked out, once
    return let(F.split(text, delimiter), lambda parts: F.when(whole(parts), parts).otherwise(F.slice(parts, 1, last(parts))))


def token_rows(documents: DataFrame) -> DataFrame:
    """``doc_id, tokens`` to one row per token: ``doc_id, pos, token``."""
    return documents.select("doc_id", F.posexplode("tokens").alias("pos", "token"))


def join_tokens(tokens: DataFrame) -> DataFrame:
    """Token rows back to texts: ``doc_id, text``, tokens in order of ``pos`` joined by spaces."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "token")))
    return tokens.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["token"]), " ").alias("text"))
