"""Stopwords, term statistics, token filters, dictionary and encoding."""

from __future__ import annotations

import logging
from collections.abc import Iterable
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.joins import split_join
from lexiloom.operators.ordering import dense_ids
from lexiloom.sources.stopwords import default_stopwords, stopword_table
from lexiloom.storage import materialise

log = logging.getLogger(__name__)


def remove_stopwords(tokens: DataFrame, words: Iterable[str] | None = None) -> DataFrame:
    """Token rows without those of the list (the built-in one if none is given); exact and case-sensitive."""
    stop = stopword_table(tokens.sparkSession, default_stopwords() if words is None else words)
    return tokens.join(stop, "token", "left_anti").select(tokens.columns)


def empty_documents(doc_ids: DataFrame, tokens: DataFrame) -> DataFrame:
    """Documents that no token row is left of."""
    return doc_ids.select("doc_id").join(tokens.select("doc_id"), "doc_id", "left_anti")


def warn_of_empty(doc_ids: DataFrame, tokens: DataFrame) -> int:
    """Log and return the number of documents without tokens."""
    n = empty_documents(doc_ids, tokens).count()
    if n:
        log.warning("%d documents are empty after the removal of stopwords", n)
    return n


def term_statistics(tokens: DataFrame) -> DataFrame:
    """``token, freq, doc_freq``.

    The counts by document come first, with map-side combining, so a frequent token
    never gathers its documents in one place.
    """
    by_doc = tokens.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return by_doc.groupBy("token").agg(F.sum("n").alias("freq"), F.count(F.lit(1)).alias("doc_freq"))


@dataclass(frozen=True)
class TokenFilter:
    """Bounds a token has to keep; None is no bound.  ``*_share`` are fractions of all documents, empty ones included."""

    max_freq: int | None = None
    min_freq: int | None = None
    max_share: float | None = None
    min_share: float | None = None
    max_docs: int | None = None
    min_docs: int | None = None
    max_length: int | None = None
    min_length: int | None = None

    @staticmethod
    def default() -> TokenFilter:
        """At least 10 occurrences in 5 documents, at most nine tenths of the documents, 3 letters."""
        return TokenFilter(min_freq=10, max_share=0.9, min_docs=5, min_length=3)

    #: Values that a bound takes when it is switched on without one.
    SWITCHED_ON = {"max_freq": 1_000_000, "min_freq": 10, "max_share": 0.9, "min_share": 0.01, "max_docs": 100_000, "min_docs": 5, "max_length": 50, "min_length": 3}

    def use(self, **on: bool) -> TokenFilter:
        """Switch bounds on, with the value they have or their usual one, or off."""
        return replace(self, **{k: (getattr(self, k) if getattr(self, k) is not None else self.SWITCHED_ON[k]) if v else None for k, v in on.items()})

    def bounds(self) -> dict[str, float]:
        return {f.name: v for f in fields(self) if (v := getattr(self, f.name)) is not None}

    def keeps(self, n_docs: Column | int) -> Column:
        """Whether a row of term statistics keeps all bounds."""
        share = F.col("doc_freq") / n_docs
        value = {"freq": F.col("freq"), "share": share, "docs": F.col("doc_freq"), "length": F.length("token")}
        keep = F.lit(True)
        for name, bound in self.bounds().items():
            side, what = name.split("_")
            keep = keep & (value[what] <= bound if side == "max" else value[what] >= bound)
        return keep


def kept_terms(statistics: DataFrame, doc_ids: DataFrame, bounds: TokenFilter) -> DataFrame:
    """The tokens that keep the bounds, with their statistics."""
    n_docs = doc_ids.agg(F.count(F.lit(1)).alias("n")).scalar() if {"max_share", "min_share"} & {*bounds.bounds()} else 1
    return statistics.filter(bounds.keeps(n_docs))


def filter_tokens(tokens: DataFrame, doc_ids: DataFrame, bounds: TokenFilter) -> DataFrame:
    """Token rows whose token keeps the bounds; statistics are taken once, of all rows given.

    Eager: the rows are written, as both the statistics and the result read them.
    """
    if not bounds.bounds():
        return tokens
    tokens = materialise(tokens, "unfiltered")
    kept = kept_terms(term_statistics(tokens), doc_ids, bounds)
    return split_join(tokens, materialise(kept.select("token"), "kept"), "token", "left_semi").select(tokens.columns)


def require_tokens(tokens: DataFrame) -> DataFrame:
    """The same rows; raises if there are none."""
    if tokens.isEmpty():
        raise ValueError("no tokens are left: the documents are empty or the filters too strict")
    return tokens


def kept_and_total(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row ``kept, total``."""
    total = before.agg(F.count(F.lit(1)).alias("total"))
    return after.agg(F.count(F.lit(1)).alias("kept")).withColumn("total", total.scalar())


def build_dictionary(tokens: DataFrame) -> DataFrame:
    """``word_id INT, token, freq LONG``: dense ids by first occurrence, in order of document, then position."""
    first = tokens.groupBy("token").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count(F.lit(1)).alias("freq"))
    flat = first.select("token", "freq", F.col("first.doc_id").alias("doc_id"), F.col("first.pos").alias("pos"))
    return dense_ids(flat, ["doc_id", "pos"], "word_id", "int").select("word_id", "token", "freq")


def encode(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Token rows to ``doc_id, pos, word_id``; tokens that the dictionary lacks are left out."""
    return split_join(tokens, dictionary.select("word_id", "token"), "token").select("doc_id", "pos", "word_id")


def decode(corpus: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The inverse of :func:`encode`."""
    return split_join(corpus, dictionary.select("word_id", "token"), "word_id").select("doc_id", "pos", "token")


def known_tokens(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Token rows that the dictionary has."""
    return split_join(tokens, dictionary.select("token"), "token", "left_semi").select(tokens.columns)


def look_up(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds ``word_id``, null where the dictionary lacks the token."""
    return tokens.join(dictionary, "token", "left").select(*tokens.columns, "word_id")
