"""From texts to an encoded corpus: clean, tokenise, drop stopwords, filter, encode."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import DEFAULT_STEPS, NOOP_STEPS, Step, clean
from lexiloom.functions.tokens import split_tokens
from lexiloom.operators.vocabulary import TokenFilter, build_dictionary, encode, filter_tokens, remove_stopwords, require_tokens, warn_of_empty
from lexiloom.sources.stopwords import default_stopwords
from lexiloom.sources.text_files import from_texts, read_lines
from lexiloom.storage import materialise


@dataclass(frozen=True)
class Corpus:
    """An encoded corpus.

    ``tokens``: ``doc_id, pos, word_id``; ``dictionary``: ``word_id, token``; ``doc_index``: ``doc_id``, documents without
    tokens included.
    """

    tokens: DataFrame
    dictionary: DataFrame
    doc_index: DataFrame


@dataclass(frozen=True)
class Pipeline:
    """Four stages, each replaceable (``dataclasses.replace``)."""

    steps: Sequence[Step] = DEFAULT_STEPS
    delimiter: str = " "
    stopwords: Sequence[str] = field(default_factory=default_stopwords)
    bounds: TokenFilter = field(default_factory=TokenFilter.default)

    @staticmethod
    def default() -> Pipeline:
        return Pipeline()

    @staticmethod
    def noop() -> Pipeline:
        """White space is collapsed, nothing else is changed."""
        return Pipeline(NOOP_STEPS, " ", (), TokenFilter())

    def tokenise(self, documents: DataFrame) -> DataFrame:
        """``doc_id, pos, token`` before stopwords; a null text is an empty document."""
        cleaned = documents.select("doc_id", clean(F.coalesce("text", F.lit("")), self.steps).alias("text"))
        # split inside the generator: over a column of arrays the planner would infer a filter that cleans every text again
        return cleaned.select("doc_id", F.posexplode(split_tokens(F.col("text"), self.delimiter)).alias("pos", "token"))

    def tokens(self, documents: DataFrame) -> DataFrame:
        """``doc_id, pos, token`` after stopwords and filters."""
        rows = self.tokenise(documents)
        if self.stopwords:
            rows = remove_stopwords(rows, self.stopwords)
        return filter_tokens(rows, documents, self.bounds)

    def run(self, documents: DataFrame) -> Corpus:
        """The encoded corpus; raises if no token is left.  Eager: tokens and dictionary are written."""
        index = documents.select("doc_id")
        tokens = require_tokens(materialise(self.tokens(documents), "tokens"))
        warn_of_empty(index, tokens)
        dictionary = materialise(build_dictionary(tokens).select("word_id", "token"), "dictionary")
        return Corpus(materialise(encode(tokens, dictionary), "corpus"), dictionary, index)

    def run_texts(self, spark: SparkSession, texts: Sequence[str]) -> Corpus:
        return self.run(from_texts(spark, texts))

    def run_file(self, spark: SparkSession, path: str, charset: str = "UTF-8") -> Corpus:
        return self.run(materialise(read_lines(spark, path, charset), "lines"))
