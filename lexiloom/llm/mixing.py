"""Problem 9: mixing sources to target weights.

Method: soft-membership mixing.  A naive Bayes classifier over the tokens of a
public tokenizer, fitted on labelled rows, predicts which source a document without
a usable label belongs to; a labelled document belongs to its source.  Projected-gradient
least squares then fits a rate between 0 and the permitted repeats for every
document, so that the expected tokens of each source match its target.

The gradient needs the sources' expected totals only.  A pass adds them up over
the table of memberships; the next pass replays the few vectors that were applied
so far, so no rates have to be kept.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.token_sizes import VOCABULARY, load_encoding
from lexiloom.storage import materialise

log = logging.getLogger(__name__)

#: At most so many labelled rows are fitted, chosen by hash.
MAX_SAMPLES = 5_000
#: Added to every token count of the classifier.
SMOOTHING = 0.5
#: Tokens of a document that count as independent evidence.
EVIDENCE = 40.0
#: Passes of the projected gradient at most, and the change of a rate at which it ends.
MAX_PASSES = 30
TOLERANCE = 1e-6
#: Documents of a source that are rounded together, on average.
BUCKET_ROWS = 1 << 20
#: The class of sources without a target.
OTHER = ""


def source_name(label: Column) -> Column:
    """One spelling of a source: lower case, outer space removed, words joined by underscores."""
    return F.regexp_replace(F.lower(F.trim(label)), r"[\s_-]+", "_")


@dataclass(frozen=True)
class SourceModel:
    """Log probabilities of tokens by source."""

    sources: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray

    def posterior(self, ids: list[list[int]]) -> np.ndarray:
        """Membership of texts in the sources; a text without tokens follows the prior."""
        owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        flat = np.fromiter((t for x in ids for t in x), np.int64, len(owner))
        size = np.bincount(owner, minlength=len(ids))
        score = np.stack([np.bincount(owner, self.log_prob[flat, k], len(ids)) for k in range(len(self.sources))], axis=1)
        score *= (np.minimum(size, EVIDENCE) / np.maximum(size, 1))[:, None]
        score += self.log_prior
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)


def train_source_model(documents: DataFrame, sources: list[str], vocabulary: str = VOCABULARY, max_samples: int = MAX_SAMPLES) -> SourceModel:
    """Fit on documents whose label names a source, at most ``max_samples``, chosen by hash; other labels form the class ``OTHER``."""
    name = source_name(F.col("source"))
    labelled = documents.filter("source IS NOT NULL AND text IS NOT NULL").select(F.when(name.isin(*sources), name).otherwise(OTHER).alias("source"), "text")
    rows = labelled.orderBy(F.xxhash64("text"), "text").limit(max_samples).collect()
    encoding = load_encoding(Path(vocabulary).read_bytes())
    classes = (*sources, OTHER)
    counts = np.full((encoding.n_vocab, len(classes)), SMOOTHING)
    docs = np.full(len(classes), SMOOTHING)
    for r in rows:
        k = classes.index(r["source"])
        docs[k] += 1
        counts[:, k] += np.bincount(encoding.encode_ordinary(r["text"]), minlength=encoding.n_vocab)
    return SourceModel(classes, np.log(docs / docs.sum()), np.log(counts / counts.sum(axis=0)).astype(np.float32))


def memberships(documents: DataFrame, targets: list[tuple[str, float, int]], model: SourceModel, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, size LONG, member ARRAY<DOUBLE>, most DOUBLE`` of every document with tokens.

    ``source`` is the label's source, or the most probable one; ``member`` the shares in the
    sources of ``targets``; ``most`` the repeats that ``source`` permits, 0 for one without target.
    """
    names = [t[0] for t in targets]
    shared = documents.sparkSession.sparkContext.broadcast((model, Path(vocabulary).read_bytes()))
    permitted = np.array([float(t[2]) for t in targets] + [0.0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, ranks = shared.value
        encoding = load_encoding(ranks)
        classes = [*names, OTHER]
        place = {s: k for k, s in enumerate(classes)}
        for batch in batches:
            ids = [encoding.encode_ordinary(x) for x in batch["text"]]
            member = np.zeros((len(ids), len(classes)))
            label = [None if s is None else place.get(s, len(names)) for s in batch["label"]]
            blank = [k for k, s in enumerate(label) if s is None]
            if blank:
                member[blank] = known.posterior([ids[k] for k in blank])
            told = [k for k, s in enumerate(label) if s is not None]
            member[told, [label[k] for k in told]] = 1.0
            best = member.argmax(axis=1)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": [classes[k] for k in best], "size": [len(x) for x in ids], "member": list(member[:, : len(names)]), "most": permitted[best]})

    rows = documents.filter("text <> '' AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), source_name(F.col("source")).alias("label"), "text")
    return rows.mapInPandas(run, "doc_id long, source string, size long, member array<double>, most double").filter("size > 0")


def _rates(member: np.ndarray, most: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the projected steps."""
    rate = np.minimum(1.0, most)
    for step in steps:
        rate = np.clip(rate - member @ step, 0.0, most)
    return rate


def fit_rates(profile: DataFrame, goals: np.ndarray) -> list[np.ndarray]:
    """Projected-gradient steps that bring the expected tokens of each source to its goal.

    ``profile``: ``member, most, tokens``.  The step is scaled by each source's tokens, so
    sources of any size converge alike.  Rates that still move after ``MAX_PASSES`` passes are
    reported, with what is left to the goals, as a warning.
    """

    def totals(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            expected, held = np.zeros(len(goals)), np.zeros(len(goals))
            for batch in batches:
                if len(batch):
                    member = np.stack(batch["member"].to_numpy())
                    tokens = batch["tokens"].to_numpy(float)
                    expected += (_rates(member, batch["most"].to_numpy(), steps) * tokens) @ member
                    held += tokens @ member
            yield pd.DataFrame({"k": np.arange(len(goals)), "expected": expected, "held": held})

        sums = profile.mapInPandas(run, "k long, expected double, held double").groupBy("k").agg(F.sum("expected").alias("expected"), F.sum("held").alias("held")).orderBy("k").collect()
        return np.array([r["expected"] for r in sums]), np.array([r["held"] for r in sums])

    steps: list[np.ndarray] = []
    for _ in range(MAX_PASSES):
        expected, held = totals(steps)
        step = np.where(held > 0, (expected - goals) / np.maximum(held, 1), 0.0)
        if steps and np.allclose(step, steps[-1], atol=TOLERANCE) or np.abs(step).max(initial=0) < TOLERANCE:
            break
        steps.append(step)
    else:
        log.warning("rates still move after %d passes; tokens left to the goals: %s", MAX_PASSES, np.round(goals - expected, 1).tolist())
    return steps


def reachable_total(profile: DataFrame, shares: np.ndarray) -> int:
    """The largest total at which every source that has documents reaches its share within the repeats permitted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        room = np.zeros(len(shares))
        for batch in batches:
            if len(batch):
                room += (batch["most"].to_numpy() * batch["tokens"].to_numpy(float)) @ np.stack(batch["member"].to_numpy())
        yield pd.DataFrame({"k": np.arange(len(shares)), "room": room})

    sums = profile.mapInPandas(run, "k long, room double").groupBy("k").agg(F.sum("room").alias("room")).orderBy("k").collect()
    room = np.array([r["room"] for r in sums]) if sums else np.zeros(len(shares))
    wanted = (room >= 1) & (shares > 0)
    return int((room[wanted] / shares[wanted]).min(initial=np.inf)) if wanted.any() else 0


def rounded_copies(rated: DataFrame) -> DataFrame:
    """Adds ``copies``: the rate rounded down or up so that a source's tokens come out as its rates say.

    The documents of a source are gone through from the largest to the smallest, and each is rounded so
    that the tokens owed so far come nearest to nothing; what is left in the end is about
    the size of the smallest.  A source is cut into buckets of about ``BUCKET_ROWS`` documents by hash, so
    none meets in one task.
    """
    n_buckets = max(1, -(-rated.count() // BUCKET_ROWS))
    placed = rated.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(n_buckets)).cast("int"))
    ordered = placed.repartition("source", "bucket").sortWithinPartitions("source", "bucket", F.col("size").desc(), "doc_id", "rate")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, owed = None, 0.0
        for batch in batches:
            copies = []
            for source, bucket, size, rate in zip(batch["source"], batch["bucket"], batch["size"].tolist(), batch["rate"].tolist()):
                if (source, bucket) != group:
                    group, owed = (source, bucket), 0.0
                whole = int(rate)
                owed += (rate - whole) * size
                more = rate > whole and owed >= size / 2
                owed -= size if more else 0
                copies.append(whole + more)
            yield batch.drop(columns="bucket").assign(copies=np.array(copies, np.int32))

    return ordered.mapInPandas(run, "doc_id long, source string, size long, rate double, copies int")


def mix_sources(documents: DataFrame, mix_targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY, model: SourceModel | None = None) -> DataFrame:
    """How often each document is used: ``doc_id, source, size, rate, copies``.

    ``mix_targets`` (``source, target_share, max_repeats``) is a table of a few rows.
    ``total_tokens`` is the size aimed at; if it is not given, the largest at which every source that
    has documents reaches its share (:func:`reachable_total`).  ``copies`` is ``rate`` rounded within the source
    (:func:`rounded_copies`), never above ``max_repeats``.  Documents without tokens or ``doc_id`` and targets with a null have no
    part; a source without target is not used; rows that repeat a document count
    as they stand.  Eager: the memberships are written, every pass is a job.
    """
    spark = documents.sparkSession
    rows = mix_targets.filter("source IS NOT NULL AND target_share IS NOT NULL AND max_repeats IS NOT NULL")
    targets = sorted((r["source"], float(r["target_share"]), int(r["max_repeats"])) for r in rows.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").collect())
    if not targets:
        return spark.createDataFrame([], "doc_id long, source string, size long, rate double, copies int")
    model = model or train_source_model(documents, [t[0] for t in targets], vocabulary)
    member = materialise(memberships(documents, targets, model, vocabulary), "members")
    # documents of one membership share their rate
    profile = materialise(member.groupBy("member", "most").agg(F.sum("size").alias("tokens")), "profile")
    shares = np.array([t[1] for t in targets])
    goals = shares * (reachable_total(profile, shares) if total_tokens is None else total_tokens)
    steps = fit_rates(profile, goals)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.drop(columns=["member", "most"]).assign(rate=_rates(np.stack(batch["member"].to_numpy()), batch["most"].to_numpy(), steps))

    rated = member.mapInPandas(run, "doc_id long, source string, size long, rate double")
    return rounded_copies(materialise(rated, "rated"))


def mix_report(mixed: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """By source of the targets: the share aimed at and the one reached.

    ``source, target_share, max_repeats, available_tokens, expected_tokens, mixed_tokens, share``.
    """
    sums = mixed.groupBy("source").agg(F.sum("size").alias("available_tokens"), F.sum(F.col("rate") * F.col("size")).alias("expected_tokens"), F.sum(F.col("copies") * F.col("size")).alias("mixed_tokens"))
    total = mixed.agg(F.sum(F.col("copies") * F.col("size")).alias("total")).scalar()
    targets = mix_targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return targets.join(sums, "source", "left").select("source", "target_share", "max_repeats", zero("available_tokens"), zero("expected_tokens"), zero("mixed_tokens"), F.coalesce(F.try_divide("mixed_tokens", total), F.lit(0.0)).alias("share"))
