"""Collapsed Gibbs sampling.

``synchronous_sweep`` is plain DataFrame work: every token is drawn from the counts of the
sweep before.  Training sweeps by ``sweep_block``: a document's tokens are drawn in
order, each from the document's counts as they stand; of the words' counts a block of
documents holds those of its own words, which it takes from all documents before the
sweep and brings up to date from position to position (AD-LDA).

Blocks follow from document ids, so a sweep gives the same topics however the rows
are partitioned, and a vocabulary of any size is swept alike.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.binding import let
from lexiloom.functions.rng import uniform, uniform_int, uniforms_of
from lexiloom.operators.counts import count_vectors, document_topic_counts, topic_totals, word_topic_counts
from lexiloom.operators.joins import split_join
from lexiloom.storage import spread

#: Positions of one document that are swept together; what a longer one holds elsewhere is a snapshot, like the words' counts.
CHUNK = 1 << 16
#: Tokens of a block, on average.
BLOCK_TOKENS = 1 << 17
#: Columns of the sampler's state: a row is a part of a document (``first``: words, ``second``: their topics) or, where
#: ``word_id`` is not null, a block's counts of a word (``first``: topics, ``second``: tokens of them).
STATE = "block int, doc_id long, chunk int, word_id int, first array<int>, second array<int>"


def init_topics(corpus: DataFrame, n_topics: int, seed: int = 0) -> DataFrame:
    """The corpus with a uniformly drawn topic for every token."""
    return corpus.withColumn("topic", uniform_int(n_topics, seed, "doc_id", "pos"))


def conditional(corpus: DataFrame, n_words: Column | int, alpha: Sequence[float], beta: float = 0.2) -> DataFrame:
    """``doc_id, pos, word_id, topic, weights``: the unnormalised probability of each topic of each token, the token itself not counted.

    The counts of a word and of a document travel as one array each; a token stays one row.
    """
    n_topics = len(alpha)
    by_doc = count_vectors(document_topic_counts(corpus), "doc_id", n_topics).withColumnRenamed("counts", "_d")
    by_word = count_vectors(word_topic_counts(corpus), "word_id", n_topics).withColumnRenamed("counts", "_w")
    tokens = split_join(spread(corpus.select("doc_id", "pos", "word_id", "topic")), by_doc, "doc_id")
    tokens = split_join(tokens, by_word, "word_id", heavy=True)
    tokens = tokens.withColumns({"_t": topic_totals(corpus, n_topics), "_v": F.lit(beta) * n_words, "_a": F.array(*map(F.lit, map(float, alpha)))})

    def weights(a: Column, t: Column, v: Column) -> Column:
        own = lambda k: F.when(k == F.col("topic"), 1).otherwise(0)
        return F.transform("_d", lambda n, k: (n - own(k) + F.get(a, k)) * (F.get("_w", k) - own(k) + F.lit(beta)) / (F.get(t, k) - own(k) + v))

    bound = let(F.col("_a"), lambda a: let(F.col("_t"), lambda t: let(F.col("_v"), lambda v: weights(a, t, v))))
    return tokens.select("doc_id", "pos", "word_id", "topic", bound.alias("weights"))


def draw(weights: DataFrame, keys: Sequence[str], category: str, weight: str, u: Column, name: str) -> DataFrame:
    """The keys and ``name``: the first category whose running weight reaches u times the total, the last one at most."""
    running = Window.partitionBy(*keys).orderBy(category).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*keys).orderBy(category).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = weights.withColumns({"_c": F.sum(weight).over(running), "_s": F.sum(weight).over(total), "_u": u})
    reached = F.min(F.when(F.col("_c") >= F.col("_u") * F.col("_s"), F.col(category)))
    return summed.groupBy(*keys).agg(F.coalesce(reached, F.max(category)).alias(name))


def reached(weights: Column, goal: Column) -> Column:
    """The first place of an array of weights whose running sum reaches ``goal``, the last one at most."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("below"))

    def step(s: Column, w: Column) -> Column:
        upto = s["sum"] + w
        return F.struct(upto.alias("sum"), (s["below"] + F.when(upto < goal, 1).otherwise(0)).alias("below"))

    return F.least(F.aggregate(weights, start, step)["below"], F.size(weights) - 1)


def synchronous_sweep(corpus: DataFrame, n_words: Column | int, alpha: Sequence[float], beta: float = 0.2, seed: int = 0, sweep: int = 1) -> DataFrame:
    """``doc_id, pos, word_id, topic``: every token redrawn from the counts before the sweep."""
    total = lambda ws: F.aggregate(ws, F.lit(0.0), lambda s, w: s + w)
    u = uniform(seed, sweep, "doc_id", "pos")
    topic = let(F.col("weights"), lambda ws: let(u * total(ws), lambda goal: reached(ws, goal)))
    return conditional(corpus, n_words, alpha, beta).select("doc_id", "pos", "word_id", topic.alias("topic"))


# --- training ---------------------------------------------------------------------


def first_state(tokens: DataFrame, n_blocks: int) -> DataFrame:
    """The state of tokens ``doc_id, pos, word_id, topic``; columns as in ``STATE``."""
    chunk = F.floor(F.col("pos") / F.lit(CHUNK)).cast("int")
    block = F.pmod(F.xxhash64("doc_id", "chunk"), F.lit(n_blocks)).cast("int")
    placed = tokens.withColumn("chunk", chunk).withColumn("block", block)
    rows = F.sort_array(F.collect_list(F.struct("pos", "word_id", "topic")))
    docs = placed.groupBy("block", "doc_id", "chunk").agg(rows.alias("r"))
    parts = [F.col(f"r.{c}").alias(name) for c, name in (("word_id", "first"), ("topic", "second"))]
    held = placed.groupBy("block", "word_id", "topic").agg(F.count(F.lit(1)).cast("int").alias("n"))
    none = lambda kind: F.lit(None).cast(kind)
    return docs.select("block", "doc_id", "chunk", none("int").alias("word_id"), *parts).union(_by_word(held, "block", "word_id").select("block", none("long"), none("int"), "word_id", "first", "second"))


def _by_word(counts: DataFrame, *keys: str) -> DataFrame:
    """Counts ``keys, topic, n`` as two arrays ``first`` and ``second``, without zeros."""
    rows = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("topic", "n"))).alias("r"))
    return rows.select(*keys, F.col("r.topic").alias("first"), F.col("r.n").alias("second"))


def state_docs(state: DataFrame) -> DataFrame:
    return state.filter("word_id IS NULL").select("block", "doc_id", "chunk", "first", "second")


def state_counts(state: DataFrame) -> DataFrame:
    """``block, word_id, topic, n`` of every block."""
    rows = state.filter("word_id IS NOT NULL").select("block", "word_id", F.explode(F.arrays_zip("first", "second")).alias("x"))
    return rows.select("block", "word_id", F.col("x.first").alias("topic"), F.col("x.second").alias("n"))


def state_word_counts(state: DataFrame) -> DataFrame:
    """``word_id, topic, n`` over all blocks."""
    return state_counts(state).groupBy("word_id", "topic").agg(F.sum("n").alias("n"))


def state_topics(state: DataFrame) -> DataFrame:
    """``doc_id, topic`` of every token."""
    return state_docs(state).select("doc_id", F.explode("second").alias("topic"))


def sweep_block(docs: pd.DataFrame, words: pd.DataFrame, totals: Sequence[float], alpha: Sequence[float], beta: float, n_words: int, seed: int, sweep: int) -> list[np.ndarray]:
    """New topics of the documents of a block, one array for each row of ``docs``.

    ``docs``: ``doc_id, chunk, first`` (words) ``, second`` (topics) ``, elsewhere`` (the document's counts in other chunks, or null);
    ``words``: ``word_id, first`` (topics) ``, second`` (their tokens among all documents); ``totals``: all tokens of each topic.
    """
    flat = lambda arrays: np.concatenate([np.asarray(x, np.int64) for x in arrays])
    length = np.array([len(x) for x in docs["first"]])
    elsewhere = {i: np.asarray(x) for i, x in enumerate(docs["elsewhere"]) if x is not None}
    held = words["word_id"].to_numpy(), np.array([len(x) for x in words["first"]]), flat(words["first"]), flat(words["second"])
    topics = sweep_tokens(docs["doc_id"].to_numpy(), docs["chunk"].to_numpy(), length, flat(docs["first"]), flat(docs["second"]), elsewhere, *held, totals, alpha, beta, n_words, seed, sweep)
    return np.split(topics, np.cumsum(length)[:-1])


#: A position is drawn token by token, not in numpy, from where this many numbers or fewer make up its weights.
FEW_WEIGHTS = 96


def sweep_tokens(doc_id: np.ndarray, chunk: np.ndarray, length: np.ndarray, words: np.ndarray, topics: np.ndarray, elsewhere: dict[int, np.ndarray], word_id: np.ndarray, held: np.ndarray, of_topics: np.ndarray, counts: np.ndarray, totals: Sequence[float], alpha: Sequence[float], beta: float, n_words: int, seed: int, sweep: int) -> np.ndarray:
    """New topics of the tokens of a block, document by document.

    A document has ``doc_id, chunk, length`` and so many of ``words`` and ``topics``; ``elsewhere`` has, by its place, its counts in other
    chunks.  A word has ``word_id`` and ``held``, so many of ``of_topics`` and their ``counts``.

    The i-th tokens of all documents are drawn together: each is taken out of the
    counts, which include all draws of the positions before, and drawn with the number that
    (seed, sweep, document, chunk, place in it) gives; then all are put back.
    """
    n_topics = len(alpha)
    # longest first, so that the documents that reach a position come first
    order = np.lexsort((chunk, doc_id, -length))
    rank = np.argsort(order)
    owner = np.repeat(rank, length)
    place = np.arange(len(words)) - np.repeat(np.cumsum(length) - length, length)
    vocabulary = np.sort(word_id)
    of_word = np.zeros((len(vocabulary), n_topics))
    of_word[np.repeat(np.searchsorted(vocabulary, word_id), held), of_topics] = counts
    of_word += beta
    of_doc = np.bincount(owner * n_topics + topics, minlength=len(order) * n_topics).reshape(-1, n_topics) + np.asarray(alpha, float)
    for k, more in elsewhere.items():
        of_doc[rank[k]] += more
    of_topic = np.asarray(totals, float) + beta * n_words
    u = uniforms_of([f"{seed}:{sweep}:{d}:{c}" for d, c in zip(doc_id.tolist(), chunk.tolist())], length)
    # position by position, and in a position document by document
    at = np.lexsort((owner, place))
    word, topic, u = np.searchsorted(vocabulary, words[at]), topics[at].astype(np.int64), u[at]
    reach = np.bincount(place)
    # with a positive beta no count is zero, so that nothing is divided by it
    few = int(np.count_nonzero(reach * (n_topics + 4) > FEW_WEIGHTS)) if beta > 0 else len(reach)
    rows, start = np.arange(len(order)), 0
    for active in reach[:few].tolist():
        end = start + active
        w, k, r = word[start:end], topic[start:end], rows[:active]
        p = of_doc[:active] * of_word[w]
        p /= of_topic
        p[r, k] = (of_doc[r, k] - 1) * (of_word[w, k] - 1) / (of_topic[k] - 1)
        if n_topics < active:
            for t in range(1, n_topics):
                p[:, t] += p[:, t - 1]
            goal, new = u[start:end] * p[:, -1], np.zeros(active, np.int64)
            for t in range(n_topics - 1):
                new += p[:, t] < goal
        else:
            np.cumsum(p, axis=1, out=p)
            new = np.minimum((p < (u[start:end] * p[:, -1])[:, None]).sum(axis=1), n_topics - 1)
        of_doc[r, k] -= 1
        of_doc[r, new] += 1
        np.add.at(of_word, (w, k), -1)
        np.add.at(of_word, (w, new), 1)
        of_topic += np.bincount(new, minlength=n_topics) - np.bincount(k, minlength=n_topics)
        topic[start:end] = new
        start = end
    if start < len(word):
        kinds, rest = np.unique(word[start:], return_inverse=True)
        topic[start:] = _sweep_few(reach[few:].tolist(), rest.tolist(), topic[start:].tolist(), u[start:].tolist(), of_doc[: reach[few]].tolist(), of_word[kinds].tolist(), of_topic.tolist())
    out = np.empty(len(words), np.int32)
    out[at] = topic
    return out


def _sweep_few(reach: list[int], word: list[int], topic: list[int], u: list[float], of_doc: list[list[float]], of_word: list[list[float]], of_topic: list[float]) -> list[int]:
    """As the positions before, in the same order of every sum, token by token: for positions that few documents reach."""
    last, start = len(of_topic) - 1, 0
    rows = [of_word[w] for w in word]
    for active in reach:
        end = start + active
        drawn = []
        for d, c, k, x in zip(of_doc, rows[start:end], topic[start:end], u[start:end]):
            p = [a * b / t for a, b, t in zip(d, c, of_topic)]
            p[k] = (d[k] - 1) * (c[k] - 1) / (of_topic[k] - 1)
            upto = list(accumulate(p))
            drawn.append(bisect_left(upto, x * upto[last], 0, last))
        moved = [0] * (last + 1)
        for d, c, k in zip(of_doc, rows[start:end], topic[start:end]):
            d[k] -= 1
            c[k] -= 1
            moved[k] -= 1
        for d, c, k in zip(of_doc, rows[start:end], drawn):
            d[k] += 1
            c[k] += 1
            moved[k] += 1
        of_topic = [t + m for t, m in zip(of_topic, moved)]
        topic[start:end] = drawn
        start = end
    return topic


def _tally(words: np.ndarray, topics: np.ndarray, n_topics: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a block, where each begins among their counts, and these: topics and tokens of them."""
    key, n = np.unique(words.astype(np.int64) * n_topics + topics, return_counts=True)
    ids, starts = np.unique(key // n_topics, return_index=True)
    return ids.astype(np.int32), starts.astype(np.int32), (key % n_topics).astype(np.int32), n.astype(np.int32)


def block_counts(words: list[np.ndarray], topics: list[np.ndarray], n_topics: int) -> pd.DataFrame:
    """``word_id, first, second`` of the documents of a block."""
    ids, starts, first, second = _tally(np.concatenate(words), np.concatenate(topics), n_topics)
    return pd.DataFrame({"word_id": ids, "first": np.split(first, starts[1:]), "second": np.split(second, starts[1:])})


def parallel_sweep(state: DataFrame, n_words: int, alpha: Sequence[float], beta: float, seed: int, sweep: int, n_blocks: int, chunked: bool) -> DataFrame:
    """The state after one sweep over all documents.

    Every block is swept against the counts that its words have in all documents before
    the sweep; a block gives a word's counts as one row, so a frequent word meets in no
    one place.  ``chunked``: whether any document has more than one chunk.
    """
    n_topics = len(alpha)
    counts = state_counts(state)
    totals = [0.0] * n_topics
    for r in counts.groupBy("topic").agg(F.sum("n").alias("n")).collect():  # one row for each topic
        totals[r["topic"]] = float(r["n"])
    shared = _by_word(counts.groupBy("word_id", "topic").agg(F.sum("n").cast("int").alias("n")), "word_id")
    words = state.filter("word_id IS NOT NULL").select(F.col("block").alias("of_block"), "word_id").join(shared, "word_id")
    docs = state_docs(state)
    elsewhere = F.lit(None).cast("array<int>")
    if chunked:
        tokens = docs.select("doc_id", "chunk", F.explode("second").alias("topic"))
        long = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("doc_id")
        per = tokens.join(long, "doc_id", "left_semi").groupBy("doc_id", "chunk", "topic").agg(F.count(F.lit(1)).alias("n"))
        own = per.groupBy("doc_id", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("topic", "n"))).alias("own"))
        whole = count_vectors(per.groupBy("doc_id", "topic").agg(F.sum("n").alias("n")), "doc_id", n_topics)
        rest = F.transform("counts", lambda n, k: (n - F.coalesce(F.try_element_at("own", k), F.lit(0))).cast("int"))
        docs = docs.join(own.join(whole, "doc_id").select("doc_id", "chunk", rest.alias("elsewhere")), ["doc_id", "chunk"], "left")
        elsewhere = F.col("elsewhere")
    alpha = [float(a) for a in alpha]

    def run(key: tuple, held: pa.Table, known: pa.Table) -> pa.Table:
        numbers = lambda t, name: t[name].combine_chunks().to_numpy(zero_copy_only=False)
        flat = lambda t, name: pc.list_flatten(t[name]).combine_chunks().to_numpy(zero_copy_only=False)
        lengths = lambda t: pc.list_value_length(t["first"]).combine_chunks().to_numpy(zero_copy_only=False)
        more = {i: np.asarray(x) for i, x in enumerate(held["elsewhere"].to_pylist()) if x is not None} if chunked else {}
        words, length = flat(held, "first"), lengths(held)
        topics = sweep_tokens(numbers(held, "doc_id"), numbers(held, "chunk"), length, words, flat(held, "second"), more, numbers(known, "word_id"), lengths(known), flat(known, "first"), flat(known, "second"), totals, alpha, beta, n_words, seed, sweep)
        ids, starts, first, second = _tally(words, topics, n_topics)
        ends = np.r_[0, np.cumsum(length), len(words) + np.r_[starts[1:], len(first)]].astype(np.int32)
        lists = lambda *parts: pa.ListArray.from_arrays(ends, np.concatenate(parts).astype(np.int32))
        none = lambda n, kind: pa.nulls(n, kind)
        joined = lambda one, other: pa.concat_arrays([one, other])
        return pa.table({
            "block": pa.array(np.full(len(length) + len(ids), key[0].as_py(), np.int32)),
            "doc_id": joined(held["doc_id"].combine_chunks(), none(len(ids), pa.int64())),
            "chunk": joined(held["chunk"].combine_chunks(), none(len(ids), pa.int32())),
            "word_id": joined(none(len(length), pa.int32()), pa.array(ids)),
            "first": lists(words, first), "second": lists(topics, second),
        })

    # few bytes but much work: one partition for each block or two, up to as many as a shuffle has
    spark = state.sparkSession
    partitions = min(2 * n_blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))
    left = docs.select("block", "doc_id", "chunk", "first", "second", elsewhere.alias("elsewhere")).repartition(partitions, "block").groupBy("block")
    return left.cogroup(words.groupBy("of_block")).applyInArrow(run, STATE)
