"""Distributions, term scores, perplexity and sampled averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.binding import let
from lexiloom.operators.counts import count_vectors, document_topic_counts, totals_of, word_topic_counts
from lexiloom.operators.ordering import dense_ids
from lexiloom.storage import materialise, shuffled


def phi_vectors(corpus: DataFrame, dictionary: DataFrame, n_topics: int, beta: float = 0.2) -> DataFrame:
    """``word_id, phi ARRAY<DOUBLE>, mean_log`` of every word of the dictionary: (n_wk + beta) / (n_k + beta V) of each topic.

    ``mean_log`` is the mean logarithm of phi over the topics, taken from the counts in ascending order:
    words of equal counts have the same one to the last bit, whichever topics hold them.
    """
    return phi_vectors_of(word_topic_counts(corpus), dictionary, n_topics, beta)


def phi_vectors_of(word_counts: DataFrame, dictionary: DataFrame, n_topics: int, beta: float = 0.2) -> DataFrame:
    """As :func:`phi_vectors`, of counts ``word_id, topic, n``."""
    n_words = dictionary.agg(F.count(F.lit(1)).alias("v")).scalar()
    held = count_vectors(word_counts, "word_id", n_topics)
    full = shuffled(dictionary.select("word_id"), "word_id").join(held, "word_id", "left")
    # without assigned tokens the totals are null
    total = F.coalesce(totals_of(word_counts, n_topics), F.array_repeat(F.lit(0).cast("long"), n_topics))
    full = full.select("word_id", F.coalesce("counts", F.array_repeat(F.lit(0).cast("long"), n_topics)).alias("n"))
    added = lambda ns, more: F.aggregate(ns, F.lit(0.0), lambda s, n: s + F.ln(n + more))
    # the denominators and their logarithms are the same for all words: a table of one row
    below = dictionary.sparkSession.range(1).select(total.alias("n_k"), (F.lit(beta) * n_words).alias("b"))
    below = below.select(let(F.col("b"), lambda b: F.transform("n_k", lambda n: n + b)).alias("below"), let(F.col("b"), lambda b: added("n_k", b)).alias("logs"))
    full = full.withColumns({c: below.select(c).scalar() for c in below.columns})
    mean = (added(F.array_sort("n"), F.lit(beta)) - F.col("logs")) / n_topics
    phis = let(F.col("below"), lambda d: F.transform("n", lambda n, k: (n + F.lit(beta)) / F.get(d, k)))
    return full.select("word_id", phis.alias("phi"), mean.alias("mean_log"))


def phi(corpus: DataFrame, dictionary: DataFrame, n_topics: int, beta: float = 0.2) -> DataFrame:
    """``word_id, topic, phi`` for every word of the dictionary and every topic."""
    return by_topic(phi_vectors(corpus, dictionary, n_topics, beta), "word_id", "phi")


def by_topic(vectors: DataFrame, key: str, value: str) -> DataFrame:
    """One row for each topic of an array: the key, ``topic`` and the value."""
    return vectors.select(key, F.posexplode(value).alias("topic", value))


def theta_vectors(corpus: DataFrame, doc_index: DataFrame, alpha: Sequence[float]) -> DataFrame:
    """``doc_id, theta ARRAY<DOUBLE>`` of every document of the index: (n_dk + alpha_k) / (n_d + sum alpha) of each topic."""
    held = count_vectors(document_topic_counts(corpus), "doc_id", len(alpha))
    full = shuffled(doc_index.select("doc_id"), "doc_id").join(held, "doc_id", "left")
    full = full.select("doc_id", F.coalesce("counts", F.array_repeat(F.lit(0).cast("long"), len(alpha))).alias("n"))
    n_d = lambda ns: F.aggregate(ns, F.lit(0).cast("long"), lambda s, n: s + n) + F.lit(float(sum(alpha)))
    shares = lambda ns, below, a: F.transform(ns, lambda n, k: (n + F.get(a, k)) / below)
    weights = F.array(*map(F.lit, map(float, alpha)))
    return full.select("doc_id", let(F.col("n"), lambda ns: let(n_d(ns), lambda below: let(weights, lambda a: shares(ns, below, a)))).alias("theta"))


def theta(corpus: DataFrame, doc_index: DataFrame, alpha: Sequence[float]) -> DataFrame:
    """``doc_id, topic, theta`` for every document of the index and every topic."""
    return by_topic(theta_vectors(corpus, doc_index, alpha), "doc_id", "theta")


def _mean_log(phi: Column) -> Column:
    # added in order of phi, so that equal counts give the same mean to the last bit
    return F.aggregate(F.array_sort(phi), F.lit(0.0), lambda s, x: s + F.ln(x)) / F.size(phi)


def geometric_mean(vectors: DataFrame) -> DataFrame:
    """``word_id, geomean``: exp of the mean log over the topics of a word; of ``word_id, phi ARRAY<DOUBLE>``."""
    return vectors.select("word_id", F.exp(_mean_log(F.col("phi"))).alias("geomean"))


def column_sum(phi_rows: DataFrame) -> DataFrame:
    """``topic, phi_sum``."""
    return phi_rows.groupBy("topic").agg(F.sum("phi").alias("phi_sum"))


def column(phi_rows: DataFrame, topic: int) -> DataFrame:
    """``word_id, phi`` of one topic."""
    return phi_rows.filter(F.col("topic") == topic).select("word_id", "phi")


def term_scores(phi_rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``word_id, topic, term, score``: phi ln(phi / geometric mean of the word).

    The logarithms are added in order of phi: words of equal counts have equal scores, to the last bit.
    """
    words = phi_rows.groupBy("word_id").agg(F.sort_array(F.collect_list(F.struct("phi", "topic"))).alias("each"))
    mean = F.aggregate("each", F.lit(0.0), lambda s, x: s + F.ln(x["phi"])) / F.size("each")
    rows = words.select("word_id", mean.alias("mean"), F.inline("each"))
    scored = rows.select("word_id", "topic", (F.col("phi") * (F.ln("phi") - F.col("mean"))).alias("score"))
    return scored.join(dictionary, "word_id").select("word_id", "topic", F.col("token").alias("term"), "score")


def vector_scores(vectors: DataFrame, dictionary: DataFrame) -> DataFrame:
    """As :func:`term_scores`, of ``word_id, phi ARRAY<DOUBLE>``, with ``mean_log`` if there is one: nothing is grouped, the terms are joined to words, not to words and topics."""
    mean = F.col("mean_log") if "mean_log" in vectors.columns else _mean_log(F.col("phi"))
    words = vectors.select("word_id", "phi", mean.alias("mean")).join(dictionary.select("word_id", "token"), "word_id")
    # exploded first: the scores are then plain arithmetic on rows
    rows = words.select("word_id", F.col("token").alias("term"), "mean", F.posexplode("phi").alias("topic", "phi"))
    return rows.select("word_id", "topic", "term", (F.col("phi") * (F.ln("phi") - F.col("mean"))).alias("score"))


def top_terms(scores: DataFrame, n: int) -> DataFrame:
    """``topic, rank, term, score``: best ``n`` terms of each topic, all of them if n <= 0; ties by term, descending.

    A bounded n is cut down in every partition before the topics are brought together.
    All terms are ranked by their place in the order of all topics, which no single task sorts.
    """
    best_first = F.col("score").desc(), F.col("term").desc()
    if n > 0:
        ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(*best_first)))
        return ranked.filter(F.col("rank") <= n).select("topic", "rank", "term", "score")
    placed = materialise(dense_ids(scores.select("topic", "term", "score"), ["topic", *best_first], "place"), "ranked")
    first = placed.groupBy("topic").agg(F.min("place").alias("first"))
    return placed.join(first, "topic").select("topic", (F.col("place") - F.col("first") + 1).cast("int").alias("rank"), "term", "score")


def topics_nested(top: DataFrame) -> DataFrame:
    """``topic, terms ARRAY<STRUCT<term, score>>`` in order of rank."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "term", "score")))
    return top.groupBy("topic").agg(F.transform(ordered, lambda x: F.struct(x["term"].alias("term"), x["score"].alias("score"))).alias("terms"))


def topic_words(nested: DataFrame) -> DataFrame:
    """``topic, words ARRAY<STRING>``."""
    return nested.select("topic", F.transform("terms", lambda x: x["term"]).alias("words"))


def topic_display(nested: DataFrame) -> DataFrame:
    """``topic, display``: ``<topic> : [term : score, ...]`` with three decimals."""
    shown = F.array_join(F.transform("terms", lambda x: F.format_string("%s : %.3f", x["term"], x["score"])), ", ")
    return nested.select("topic", F.concat(F.col("topic").cast("string"), F.lit(" : ["), shown, F.lit("]")).alias("display"))


def assigned_perplexity(corpus: DataFrame, n_words: Column | int, alpha: Sequence[float], beta: float = 0.2) -> DataFrame:
    """One row ``perplexity``: exp of minus the mean log of phi theta at each token's own topic; null without tokens.

    The logarithm of a product is a sum, so words and documents are added up apart.
    """
    return perplexity_of(word_topic_counts(corpus), document_topic_counts(corpus), n_words, alpha, beta)


def perplexity_of(word_counts: DataFrame, doc_counts: DataFrame, n_words: Column | int, alpha: Sequence[float], beta: float = 0.2) -> DataFrame:
    """As :func:`assigned_perplexity`, of counts ``word_id, topic, n`` and ``doc_id, topic, n``."""
    weight = F.element_at(F.array(*map(F.lit, map(float, alpha))), F.col("topic") + 1)
    of_topic = word_counts.groupBy("topic").agg(F.sum("n").alias("n_k"), F.sum(F.col("n") * F.ln(F.col("n") + F.lit(beta))).alias("s"))
    words = of_topic.agg(F.sum(F.col("s") - F.col("n_k") * F.ln(F.col("n_k") + F.lit(beta) * n_words)).alias("log_phi"), F.sum("n_k").alias("n"))
    of_doc = doc_counts.groupBy("doc_id").agg(F.sum("n").alias("n_d"), F.sum(F.col("n") * F.ln(F.col("n") + weight)).alias("s"))
    docs = of_doc.agg(F.sum(F.col("s") - F.col("n_d") * F.ln(F.col("n_d") + F.lit(float(sum(alpha))))).alias("log_theta"))
    return words.crossJoin(docs).select(F.exp(-F.try_divide(F.col("log_phi") + F.col("log_theta"), F.col("n"))).alias("perplexity"))


def accumulate(samples: Sequence[DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """Sum of a value over several sampled frames: the keys, ``<value>_sum`` and ``samples``."""
    rows = samples[0]
    for more in samples[1:]:
        rows = rows.union(more.select(rows.columns))
    return rows.groupBy(*keys).agg(F.sum(value).alias(f"{value}_sum"), F.count(F.lit(1)).cast("int").alias("samples"))


def add_vectors(one: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """The key and the sums, place by place, of two frames of arrays that hold the same keys, each once."""
    both = one.select(key, F.col(value).alias("_one")).join(other.select(key, F.col(value).alias("_other")), key)
    return both.select(key, F.zip_with("_one", "_other", lambda a, b: a + b).alias(value))


def mean_of_samples(sums: DataFrame, value: str, samples: int) -> DataFrame:
    """The sampled mean; raises before the first sample."""
    if samples < 1:
        raise ValueError("the model has no samples yet: train past the burn-in")
    return sums.withColumn(value, F.col(f"{value}_sum") / samples).drop(f"{value}_sum")


def sums_of_model(rows: DataFrame, value: str, samples: Column | int) -> DataFrame:
    """The sums that a saved mean and its number of samples stand for."""
    return rows.withColumn(f"{value}_sum", F.col(value) * samples).drop(value)
