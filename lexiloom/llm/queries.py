"""Queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.distinctive_terms import residual_idf, typical_terms
from lexiloom.llm.equal_looking import consistent_texts, disguised_copies
from lexiloom.llm.format_copies import collapse_copies, copy_pairs
from lexiloom.llm.frequent_items import notable_items
from lexiloom.llm.language_id import LanguageModel, document_languages, mislabelled_paragraphs, refine_language_model, train_language_model
from lexiloom.llm.mixing import mix_report, mix_sources
from lexiloom.llm.packing import fill_report, pack
from lexiloom.llm.reading_level import bands, reading_levels, train_reading_model
from lexiloom.llm.term_frequency import mark_terms, ngram_frequency
from lexiloom.llm.token_sizes import token_sizes
from lexiloom.llm.top_items import top_items
from lexiloom.storage import materialise, read_table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that are too rare or too common to be worth keeping."""
    frequency = ngram_frequency(read_table(spark, d, "tokens"))
    marked = mark_terms(frequency, read_table(spark, d, "doc_index"))
    return marked.filter("mark IS NOT NULL").select(F.col("term").alias("token"), "mark")


def p1_term_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct token with its occurrences, records and mark."""
    marked = mark_terms(ngram_frequency(read_table(spark, d, "tokens")), read_table(spark, d, "doc_index"))
    return marked.select(F.col("term").alias("token"), "occurrences", "records", "mark")


def p1_bigram_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of neighbouring tokens that occurs more than once, with its occurrences and records."""
    pairs = ngram_frequency(read_table(spark, d, "tokens"), max_n=2)
    return pairs.filter("n = 2 AND occurrences > 1").select("term", "occurrences", "records")


def p1_bigram_marks(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of neighbouring tokens, those that occur once included, with its occurrences, records and mark."""
    pairs = ngram_frequency(read_table(spark, d, "tokens"), max_n=2).filter("n = 2")
    return mark_terms(pairs, read_table(spark, d, "doc_index")).select("term", "occurrences", "records", "mark")


def p1_repeated_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Every sequence of 2 to 5 neighbouring tokens that occurs more than once, with its occurrences and records."""
    repeated = ngram_frequency(read_table(spark, d, "tokens"), max_n=5).filter("n > 1 AND occurrences > 1")
    return repeated.select("n", "term", "occurrences", "records")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Places 1 to 10 of the terms of every topic of every run."""
    rows = read_table(spark, d, "term_scores").filter("topic IS NOT NULL")
    return top_items(rows, ["run_id", "topic"], "term", "score", 10).select("run_id", "topic", "place", "term")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Copies hidden by formatting, with the document that is kept."""
    return copy_pairs(read_table(spark, d, "documents"))


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """Documents that have copies, with the number of copies."""
    return collapse_copies(read_table(spark, d, "documents"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Words that make up at least 0.2 % of all rows."""
    return notable_items(read_table(spark, d, "corpus"), "word_id", 2).select("word_id")


def p4_notable_words(spark: SparkSession, d: str) -> DataFrame:
    """The same words with their counts and shares."""
    words = notable_items(read_table(spark, d, "corpus"), "word_id", 2)
    return words.select("word_id", "n_rows", F.round("share", 8).alias("share"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that look like another one but are stored differently."""
    return disguised_copies(read_table(spark, d, "documents"))


def p5_consistent_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text in one form."""
    return consistent_texts(read_table(spark, d, "documents")).select("doc_id", "text")


def _languages(spark: SparkSession, d: str) -> LanguageModel:
    samples = read_table(spark, d, "lang_samples")
    return refine_language_model(train_language_model(samples), samples, read_table(spark, d, "documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs in another language than the one the document's label names."""
    found = mislabelled_paragraphs(read_table(spark, d, "documents"), _languages(spark, d))
    return found.select("doc_id", "seg_no", "lang").distinct()


def p6_document_languages(spark: SparkSession, d: str) -> DataFrame:
    """The main language of every document, with a confidence."""
    return document_languages(read_table(spark, d, "documents"), _languages(spark, d))


def _distinctive(spark: SparkSession, d: str) -> DataFrame:
    sizes = read_table(spark, d, "models").select("run_id", F.col("n_topics").alias("n_records"))
    return residual_idf(read_table(spark, d, "phi"), "run_id", "topic", "word_id", "phi", sizes)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Words that are typical of a topic as against the run's other topics."""
    return typical_terms(_distinctive(spark, d), "phi", 0.002, 0.3).select("run_id", "topic", "word_id")


def p7_distinctive_words(spark: SparkSession, d: str) -> DataFrame:
    """Every word of every topic with its score."""
    scored = _distinctive(spark, d)
    return scored.select("run_id", "topic", "word_id", "phi", F.round("total", 14).alias("total"), "records", F.round("ridf", 6).alias("ridf"), F.round("score", 9).alias("score"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = materialise(token_sizes(read_table(spark, d, "documents")), "token-sizes")
    return pack(sizes, read_table(spark, d, "pack_specs"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document's place in the containers of every capacity."""
    return _packed(spark, d)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of every capacity are."""
    return fill_report(_packed(spark, d), read_table(spark, d, "pack_specs"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used in the mix."""
    return mix_sources(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of the mix that each source reaches."""
    targets = read_table(spark, d, "mix_targets")
    return mix_report(materialise(mix_sources(read_table(spark, d, "documents"), targets), "mixture"), targets)


def _reading(spark: SparkSession, d: str, english_only: bool = False) -> DataFrame:
    model = train_reading_model(read_table(spark, d, "reading_samples"))
    return reading_levels(read_table(spark, d, "documents"), model, _languages(spark, d), english_only)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """English documents whose sentences are mostly easy, or mostly hard."""
    return bands(_reading(spark, d, english_only=True))


def p10_reading_level(spark: SparkSession, d: str) -> DataFrame:
    """The level of every document and the spread of its sentences' surprisal."""
    return _reading(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("p") and k[1:2].isdigit()}
