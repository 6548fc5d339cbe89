"""Counts over an encoded corpus: ``doc_id, pos, word_id, topic``.

Rows whose topic is null are not assigned yet and count for no topic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_corpus(corpus: DataFrame) -> DataFrame:
    """Rows with a word, each (document, position) once, with its smallest word and topic."""
    rows = corpus.filter("word_id IS NOT NULL").groupBy("doc_id", "pos")
    return rows.agg(F.min("word_id").alias("word_id"), F.min("topic").alias("topic"))


def assigned(corpus: DataFrame) -> DataFrame:
    return corpus.filter("topic IS NOT NULL")


def document_lengths(corpus: DataFrame, doc_index: DataFrame) -> DataFrame:
    """``doc_id, n_tokens`` of every document of the index, empty ones included."""
    counts = corpus.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"))
    return doc_index.select("doc_id").join(counts, "doc_id", "left").select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def topic_counts(corpus: DataFrame) -> DataFrame:
    """``topic, n``."""
    return assigned(corpus).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


def word_topic_counts(corpus: DataFrame) -> DataFrame:
    """``word_id, topic, n``, without zeros."""
    return assigned(corpus).groupBy("word_id", "topic").agg(F.count(F.lit(1)).alias("n"))


def document_topic_counts(corpus: DataFrame) -> DataFrame:
    """``doc_id, topic, n``, without zeros."""
    return assigned(corpus).groupBy("doc_id", "topic").agg(F.count(F.lit(1)).alias("n"))


def _dense(n_topics: int) -> Column:
    """Of rows ``topic, n``: the counts of all topics in their order, as an aggregate."""
    held = F.map_from_entries(F.collect_list(F.struct("topic", "n")))
    at = lambda m: F.transform(F.sequence(F.lit(0), F.lit(n_topics - 1)), lambda k: F.coalesce(F.try_element_at(m, k), F.lit(0)))
    # the map is bound once
    return F.get(F.transform(F.array(held), at), F.lit(0))


def count_vectors(counts: DataFrame, key: str, n_topics: int) -> DataFrame:
    """Of counts ``key, topic, n``: the key and ``counts``, one number for each topic."""
    return counts.groupBy(key).agg(_dense(n_topics).alias("counts"))


def topic_totals(corpus: DataFrame, n_topics: int) -> Column:
    """The tokens of every topic as one array, a scalar."""
    return totals_of(topic_counts(corpus), n_topics)


def totals_of(counts: DataFrame, n_topics: int) -> Column:
    """As :func:`topic_totals`, of counts by topic and whatever else."""
    return counts.groupBy("topic").agg(F.sum("n").alias("n")).agg(_dense(n_topics).alias("totals")).scalar()


def all_counts(corpus: DataFrame) -> DataFrame:
    """The counts by document, topic, word and topic, and document and topic, in one pass.

    ``kind`` is ``doc``, ``topic``, ``word_topic`` or ``doc_topic``.
    """
    sets = assigned(corpus).groupingSets([["doc_id"], ["topic"], ["word_id", "topic"], ["doc_id", "topic"]], "doc_id", "word_id", "topic")
    counted = sets.agg(F.count(F.lit(1)).alias("n"), F.grouping_id("doc_id", "word_id", "topic").alias("g"))
    kind = F.when(F.col("g") == 3, "doc").when(F.col("g") == 6, "topic").when(F.col("g") == 4, "word_topic").otherwise("doc_topic")
    return counted.select(kind.alias("kind"), "doc_id", "word_id", "topic", "n")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """``n_tokens, n_docs``."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def longest(lengths: DataFrame) -> DataFrame:
    """One row ``max_length``: the longest document plus one, 0 without documents."""
    return lengths.agg((F.coalesce(F.max("n_tokens"), F.lit(-1)) + 1).alias("max_length"))


def mean_length(lengths: DataFrame) -> DataFrame:
    """One row ``mean_length``, 0 without documents."""
    return lengths.agg(F.coalesce(F.avg("n_tokens"), F.lit(0.0)).alias("mean_length"))


def document_topic_histogram(corpus: DataFrame, doc_index: DataFrame, n_topics: int) -> DataFrame:
    """``topic, n, n_docs``: documents that hold n tokens of a topic, n = 0 included.

    The zeros are what the documents of the index leave over, so no grid of
    documents and topics is made.
    """
    held = document_topic_counts(corpus).groupBy("topic", "n").agg(F.count(F.lit(1)).alias("n_docs"))
    docs = doc_index.agg(F.count(F.lit(1)).alias("n")).scalar()
    topics = corpus.sparkSession.range(n_topics).select(F.col("id").cast("int").alias("topic"))
    some = held.groupBy("topic").agg(F.sum("n_docs").alias("some"))
    zero = topics.join(some, "topic", "left").select("topic", F.lit(0).cast("long").alias("n"), (docs - F.coalesce("some", F.lit(0))).alias("n_docs"))
    return held.union(zero.filter("n_docs > 0"))


def highest_bucket(histogram: DataFrame, n_topics: int) -> DataFrame:
    """``topic, max_count``: the most tokens of the topic that a document has, -1 without documents."""
    topics = histogram.sparkSession.range(n_topics).select(F.col("id").cast("int").alias("topic"))
    return topics.join(histogram.groupBy("topic").agg(F.max("n").alias("m")), "topic", "left").select("topic", F.coalesce("m", F.lit(-1)).alias("max_count"))


def corpus_scalars(corpus: DataFrame, dictionary: DataFrame, doc_index: DataFrame) -> DataFrame:
    """One row ``n_docs, n_words, n_tokens``."""
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return corpus.agg(F.count(F.lit(1)).alias("n_tokens")).select(count(doc_index).alias("n_docs"), count(dictionary).alias("n_words"), "n_tokens")
