"""Training a topic model, its schedule and its results."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import alpha as prior
from lexiloom.operators import counts, gibbs, scores
from lexiloom.operators.generate import generate_documents, generate_texts
from lexiloom.plans.pipeline import Corpus
from lexiloom.storage import discard, materialise

log = logging.getLogger(__name__)

# Hyperparameters and the usual training schedule.
FIRST_ALPHA = 0.1
BETA = 0.2
BURN_IN, SAMPLE_LAG, OPTIMISE_LAG, PERPLEXITY_LAG, THRESHOLD = 100, 20, 40, 10, 1e-4


@dataclass(frozen=True)
class Schedule:
    """When a cycle, counted from 0, does more than sweep."""

    burn_in: int = BURN_IN
    sample_lag: int = SAMPLE_LAG
    optimise_lag: int = OPTIMISE_LAG
    perplexity_lag: int = PERPLEXITY_LAG
    threshold: float = THRESHOLD

    def __post_init__(self) -> None:
        for name in ("sample_lag", "optimise_lag", "perplexity_lag"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")

    def optimises(self, cycle: int) -> bool:
        return cycle >= self.burn_in and cycle % self.optimise_lag == 0

    def samples(self, cycle: int) -> bool:
        return cycle >= self.burn_in and cycle % self.sample_lag == 0

    def checks(self, cycle: int) -> bool:
        return cycle % self.perplexity_lag == 0

    def kind(self, cycle: Column) -> Column:
        """The label of a cycle."""
        return (
            F.when(cycle < self.burn_in, "burn-in")
            .when(cycle % self.sample_lag == 0, "sampling")
            .when(cycle % self.optimise_lag == 0, "optimising")
            .otherwise("sample-lagging")
        )


@dataclass(frozen=True)
class Model:
    """A snapshot: further training makes a new one.

    ``state``: the sampler's rows (``gibbs.STATE``); ``phi_sum``: ``word_id, phi_sum ARRAY<DOUBLE>``; ``theta_sum``: ``doc_id, theta_sum
    ARRAY<DOUBLE>``, both null before the first sample; ``n_blocks``: blocks of documents; ``chunked``: whether a document has more than one chunk;
    ``history``: (cycle, kind, perplexity or None, seconds).
    """

    state: DataFrame
    dictionary: DataFrame
    doc_index: DataFrame
    alpha: tuple[float, ...]
    beta: float = BETA
    seed: int = 0
    samples: int = 0
    cycles: int = 0
    n_blocks: int = 1
    chunked: bool = False
    phi_sum: DataFrame | None = None
    theta_sum: DataFrame | None = None
    history: tuple[tuple[int, str, float | None, float], ...] = ()

    @property
    def n_topics(self) -> int:
        return len(self.alpha)

    @property
    def mean_seconds(self) -> float:
        """Seconds of a cycle on average; 0 before the first one."""
        return sum(h[3] for h in self.history) / max(1, len(self.history))

    def corpus(self) -> DataFrame:
        """``doc_id, pos, word_id, topic``; positions are counted anew in each chunk of a document."""
        docs = gibbs.state_docs(self.state)
        rows = docs.select("doc_id", "chunk", F.posexplode(F.arrays_zip("first", "second")).alias("at", "x"))
        return rows.select("doc_id", (F.col("chunk") * gibbs.CHUNK + F.col("at")).alias("pos"), F.col("x.first").alias("word_id"), F.col("x.second").alias("topic"))

    def n_words(self) -> Column:
        return self.dictionary.agg(F.count(F.lit(1)).alias("n")).scalar()

    def _means(self, sums: DataFrame | None, value: str) -> DataFrame:
        if sums is None or not self.samples:
            raise ValueError("the model has no samples yet: train past the burn-in")
        return sums.select(sums.columns[0], F.transform(f"{value}_sum", lambda x: x / self.samples).alias(value))

    def phi(self) -> DataFrame:
        """``word_id, topic, phi``, the mean over the samples."""
        return scores.by_topic(self._means(self.phi_sum, "phi"), "word_id", "phi")

    def theta(self) -> DataFrame:
        """``doc_id, topic, theta``, the mean over the samples."""
        return scores.by_topic(self._means(self.theta_sum, "theta"), "doc_id", "theta")

    def top_terms(self, n: int = 10) -> DataFrame:
        """``topic, rank, term, score``; all terms if n <= 0."""
        return scores.top_terms(scores.vector_scores(self._means(self.phi_sum, "phi"), self.dictionary), n)

    def topics(self, n: int = 10) -> DataFrame:
        return scores.topics_nested(self.top_terms(n))

    def log_topics(self, n: int = 10) -> None:
        for r in scores.topic_display(self.topics(n)).orderBy("topic").toLocalIterator():
            log.info(r["display"])

    def perplexity(self) -> float | None:
        """Of the current counts, at each token's own topic; None without tokens."""
        n_words = self.dictionary.count()
        by_doc = counts.document_topic_counts(gibbs.state_topics(self.state))
        return scores.perplexity_of(gibbs.state_word_counts(self.state), by_doc, n_words, self.alpha, self.beta).first()["perplexity"]

    def mean_length(self) -> float:
        lengths = counts.document_lengths(self.corpus(), self.doc_index)
        return float(counts.mean_length(lengths).first()["mean_length"])

    def generate(self, n_docs: int, weights: Sequence[float] | None = None, seed: int | None = None) -> DataFrame:
        """``doc_id, pos, word_id`` of new documents; the topics' weights are alpha unless they are given."""
        spark = self.state.sparkSession
        return generate_documents(spark, n_docs, self.alpha if weights is None else weights, materialise(self.phi(), "phi"), self.mean_length(), self.seed if seed is None else seed)

    def generate_texts(self, n_docs: int, weights: Sequence[float] | None = None, seed: int | None = None) -> DataFrame:
        """``doc_id, text`` of new documents."""
        return generate_texts(self.state.sparkSession, n_docs, self.generate(n_docs, weights, seed), self.dictionary)

    def save(self, path: str) -> None:
        """Write the model as a folder of parquet tables; a folder that exists raises."""
        parts = {"state": self.state, "dictionary": self.dictionary, "doc_index": self.doc_index.select("doc_id"), "phi_sum": self.phi_sum, "theta_sum": self.theta_sum}
        for name, df in parts.items():
            if df is not None:
                df.write.parquet(f"{path}/{name}")
        meta = {k: getattr(self, k) for k in ("alpha", "beta", "seed", "samples", "cycles", "n_blocks", "chunked", "history")} | {"sums": self.phi_sum is not None}
        self.state.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        """A saved model, ready to be trained on."""
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        sums = meta.pop("sums")
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        meta |= {"alpha": tuple(meta["alpha"]), "history": tuple(map(tuple, meta["history"]))}
        return Model(read("state"), read("dictionary"), read("doc_index"), phi_sum=read("phi_sum") if sums else None, theta_sum=read("theta_sum") if sums else None, **meta)


def new_model(corpus: Corpus, n_topics: int, seed: int = 0) -> Model:
    """Random topics for every token, flat priors.  Eager: the sampler's state is written.

    The tokens, not the cluster, say how many blocks there are.
    """
    n_blocks = max(1, -(-corpus.tokens.count() // gibbs.BLOCK_TOKENS))
    chunked = not corpus.tokens.filter(F.col("pos") >= gibbs.CHUNK).isEmpty()
    state = gibbs.first_state(gibbs.init_topics(corpus.tokens, n_topics, seed), n_blocks)
    return Model(materialise(state, "state"), corpus.dictionary, corpus.doc_index, (FIRST_ALPHA,) * n_topics, seed=seed, n_blocks=n_blocks, chunked=chunked)


def optimised_alpha(model: Model) -> tuple[float, ...]:
    """The prior after the usual iterations."""
    corpus = gibbs.state_topics(model.state)
    lengths = counts.length_histogram(counts.document_lengths(corpus, model.doc_index))
    held = counts.document_topic_counts(corpus).groupBy("topic", "n").agg(F.count(F.lit(1)).alias("n_docs"))
    by_topic: list[dict[int, int]] = [{} for _ in model.alpha]
    for r in held.toLocalIterator():
        by_topic[r["topic"]][r["n"]] = r["n_docs"]
    return tuple(prior.optimise_alpha(model.alpha, {r["n_tokens"]: r["n_docs"] for r in lengths.toLocalIterator()}, by_topic))


def sampled(model: Model) -> Model:
    """One more sample of phi and theta."""
    new = {
        "phi": scores.phi_vectors_of(gibbs.state_word_counts(model.state), model.dictionary, model.n_topics, model.beta).drop("mean_log"),
        "theta": scores.theta_vectors(gibbs.state_topics(model.state), model.doc_index, model.alpha),
    }
    sums = {}
    for value, rows in new.items():
        name = f"{value}_sum"
        rows, old = rows.withColumnRenamed(value, name), getattr(model, name)
        sums[name] = materialise(rows if old is None else scores.add_vectors(old, rows, rows.columns[0], name), f"{value}-sum")
    return replace(model, samples=model.samples + 1, **sums)


def swept(model: Model, cycle: int, n_words: int) -> Model:
    """One sweep over all tokens, written to the shared folder."""
    state = gibbs.parallel_sweep(model.state, n_words, model.alpha, model.beta, model.seed, cycle, model.n_blocks, model.chunked)
    return replace(model, state=materialise(state, "state"))


def train(model: Model, cycles: int, schedule: Schedule | None = None) -> Model:
    """``cycles`` more cycles; ends early once the perplexity hardly changes.

    A cycle is a sweep; then, as the schedule says, the prior is optimised, a sample
    is taken and the perplexity is checked.  The check that ends training does not count its
    cycle, so training on repeats it.  ``train(model, 0)`` changes nothing.  Tables of the
    cycles between are removed; those of the model given stay.
    """
    given = model
    schedule = schedule or Schedule()
    n_words = model.dictionary.count()
    before = 0.0
    for cycle in range(model.cycles, model.cycles + cycles):
        began = time.time()
        last = model
        model = swept(model, cycle, n_words)
        if schedule.optimises(cycle):
            model = replace(model, alpha=optimised_alpha(model))
        if schedule.samples(cycle):
            model = sampled(model)
        kind = "burn-in" if cycle < schedule.burn_in else "sampling" if schedule.samples(cycle) else "optimising" if schedule.optimises(cycle) else "sample-lagging"
        for part in ("state", "phi_sum", "theta_sum"):
            old = getattr(last, part)
            if old is not getattr(given, part) and old is not getattr(model, part):
                discard(old)
        now = model.perplexity() if schedule.checks(cycle) else None
        model = replace(model, history=(*model.history, (cycle, kind, now, time.time() - began)))
        log.info("cycle %d: %s, perplexity %s, %.1f s", *model.history[-1])
        if now is not None:
            if abs(before - now) < schedule.threshold:
                break
            before = now
        model = replace(model, cycles=cycle + 1)
    return model
