"""New documents from a trained model.

Every draw is a column expression on a hash of its key, so the same seed gives the
same documents on any cluster.  A word is found by descending a tree of cumulated
probabilities, one join and one bisection within a node for each level; a node has at most
``FANOUT`` entries, so the tree grows with the vocabulary by levels only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.binding import let
from lexiloom.functions.rng import uniform_fine
from lexiloom.functions.tokens import join_tokens
from lexiloom.operators.joins import split_join
from lexiloom.operators.ordering import dense_ids
from lexiloom.storage import materialise

#: Entries of a node of the tree of words.
FANOUT = 256
#: Standard deviations about the mean that the table of a Poisson distribution covers.
SPREAD = 12


def poisson_table(mean: float) -> tuple[int, list[float]]:
    """The smallest number of the table, and the probabilities of that many at most, of one more at most, ..."""
    if not mean > 0:
        return 0, [1.0]
    low = max(0, math.floor(mean - SPREAD * math.sqrt(mean)))
    high = math.ceil(mean + SPREAD * math.sqrt(mean)) + SPREAD
    return low, list(accumulate(math.exp(n * math.log(mean) - mean - math.lgamma(n + 1)) for n in range(low, high + 1)))


def bisected(sums: Column, goal: Column, size: int) -> Column:
    """The first place of an ascending array that reaches ``goal``, the last one at most; ``size``: the longest array."""
    return let(sums, lambda s: let(goal, lambda g: _bisected(s, g, size)))


def _bisected(sums: Column, goal: Column, size: int) -> Column:
    steps = F.sequence(F.lit(1), F.lit(max(1, math.ceil(math.log2(max(size, 2))) + 1)))
    start = F.struct(F.lit(0).alias("low"), (F.size(sums) - 1).alias("up"))

    def step(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["up"], 1)
        there = F.get(sums, middle) >= goal
        return F.struct(F.when(there, s["low"]).otherwise(F.least(middle + 1, s["up"])).alias("low"), F.when(there, middle).otherwise(s["up"]).alias("up"))

    return F.aggregate(steps, start, step)["low"]


def _level(entries: DataFrame, *kept: str) -> DataFrame:
    """Entries ``topic, at, mass`` gathered to nodes: ``key`` (topic and node), ``upto``, ``masses``, ``mass``, and arrays of ``kept``."""
    node = F.floor(F.col("at") / F.lit(FANOUT)).cast("long")
    rows = entries.groupBy("topic", node.alias("node")).agg(F.sort_array(F.collect_list(F.struct("at", "mass", *kept))).alias("r"))
    masses = rows.select("topic", "node", F.col("r.mass").alias("masses"), *(F.col(f"r.{c}").alias(c) for c in kept))
    # the running sums, one after another as the masses come
    sums = F.aggregate("masses", F.array().cast("array<double>"), lambda s, m: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)) + m)))
    level = masses.select(F.struct("topic", "node").alias("key"), "topic", "node", "masses", sums.alias("upto"), *kept)
    return level.withColumn("mass", F.element_at("upto", -1))


def word_tree(phi: DataFrame) -> list[DataFrame]:
    """The levels of the tree over ``word_id, topic, phi``, the root first; words are in the order of their ids."""
    words = dense_ids(phi.select("word_id").distinct(), ["word_id"], "at").select("word_id", "at")
    entries = split_join(phi, words, "word_id").select("topic", "at", F.col("phi").alias("mass"), "word_id")
    levels = [materialise(_level(entries, "word_id"), "words")]
    while not levels[0].filter("node > 0").isEmpty():
        levels.insert(0, materialise(_level(levels[0].select("topic", F.col("node").alias("at"), "mass")), "nodes"))
    return levels


def generate_documents(spark: SparkSession, n_docs: int, weights: Sequence[float], phi: DataFrame, mean_length: float, seed: int = 0) -> DataFrame:
    """``doc_id, pos, word_id`` of ``n_docs`` new documents.

    A document's length follows a Poisson distribution of the given mean, the topic of
    each token the weights, its word that topic's phi.  ``phi``: ``word_id, topic, phi``.  Documents
    of length 0 have no rows.  Eager: the tree of words is written.
    """
    weights = np.asarray(weights, float)
    if (weights < 0).any() or not weights.sum() > 0:
        raise ValueError("weights must be non-negative with a positive sum")
    n_topics = phi.agg((F.max("topic") + 1).alias("k")).first()["k"] or 0
    if len(weights) != n_topics:
        raise ValueError(f"{len(weights)} weights for {n_topics} topics")
    low, table = poisson_table(mean_length)
    numbers = lambda xs: F.array(*map(F.lit, xs))
    docs = spark.range(n_docs).select(F.col("id").alias("doc_id"), numbers(table).alias("_table"))
    docs = docs.select("doc_id", (F.lit(low) + bisected(F.col("_table"), uniform_fine(seed, F.lit("length"), "doc_id"), len(table))).alias("n"))
    tokens = docs.filter("n > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"), numbers(np.cumsum(weights).tolist()).alias("_w"))
    drawn = uniform_fine(seed, F.lit("topic"), "doc_id", "pos") * F.element_at("_w", -1)
    tokens = tokens.select("doc_id", "pos", bisected(F.col("_w"), drawn, len(weights)).alias("topic"))
    tokens = tokens.withColumns({"node": F.lit(0).cast("long"), "u": uniform_fine(seed, F.lit("word"), "doc_id", "pos")})
    levels = word_tree(phi)
    for k, level in enumerate(levels):
        last = k == len(levels) - 1
        at = tokens.withColumn("key", F.struct("topic", "node")).drop("topic", "node")
        at = split_join(at, level.select("key", "upto", "masses", *(["word_id"] if last else [])), "key")
        goal = F.col("u") * F.element_at("upto", -1) if k == 0 else F.col("u")
        at = at.withColumn("x", goal)
        at = at.withColumn("hit", bisected(F.col("upto"), F.col("x"), FANOUT))
        if last:
            return at.select("doc_id", "pos", F.get("word_id", F.col("hit")).alias("word_id"))
        rest = F.col("x") - (F.get("upto", F.col("hit")) - F.get("masses", F.col("hit")))
        tokens = at.select("doc_id", "pos", F.col("key.topic").alias("topic"), (F.col("key.node") * FANOUT + F.col("hit")).alias("node"), rest.alias("u"))
    raise AssertionError("a tree has a level")


def generate_texts(spark: SparkSession, n_docs: int, tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``doc_id, text`` of generated tokens; a document without tokens is an empty text."""
    texts = join_tokens(split_join(tokens, dictionary.select("word_id", "token"), "word_id").select("doc_id", "pos", "token"))
    ids = spark.range(n_docs).select(F.col("id").alias("doc_id"))
    return ids.join(texts, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
