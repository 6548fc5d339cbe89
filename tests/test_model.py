"""Counts, scores, the sampler, training and generation."""

import hashlib
import math
import random
import time
from collections import Counter
from itertools import accumulate
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.functions.rng import uniform, uniform_int, uniforms, uniforms_of
from lexiloom.operators import alpha as prior
from lexiloom.operators import counts as C
from lexiloom.operators import generate
from lexiloom.operators import gibbs as G
from lexiloom.operators import scores as S
from lexiloom.operators.generate import generate_documents, generate_texts, poisson_table
from lexiloom.plans import lda
from lexiloom.plans.pipeline import Corpus, Pipeline

KINDS = ["a b c d filler".split(), "1 2 3 4 filler".split(), "a b 3 4 filler".split()]
SHORT = lda.Schedule(burn_in=10, sample_lag=5, optimise_lag=20, perplexity_lag=10)


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(kind) for _ in range(rng.randint(3, 99))) for kind in (rng.choice(KINDS[:2] * 3 + KINDS[2:]) for _ in range(100))]
    corpus = Pipeline.noop().run_texts(spark, texts)
    return lda.train(lda.new_model(corpus, 2, seed=3), 26, SHORT)


def test_topics_are_recovered(trained):
    tops = {}
    for r in trained.top_terms(4).collect():
        tops.setdefault(r["topic"], set()).add(r["term"])
    assert sorted(map(sorted, tops.values())) == [["1", "2", "3", "4"], ["a", "b", "c", "d"]]


def test_working_tables(spark):
    from lexiloom.storage import materialise, shared_dir

    first = lda.new_model(Pipeline.noop().run_texts(spark, ["a b", "b c"]), 2)
    folder = Path(shared_dir(spark).removeprefix("file://")) / "lexiloom" / spark.sparkContext.applicationId
    before = {*folder.iterdir()}
    last = lda.train(first, 5, lda.Schedule(1, 1, 1, 1))
    assert len({*folder.iterdir()} - before) == 3 and before <= {*folder.iterdir()}
    assert first.corpus().count() == last.corpus().count() == 4 and last.phi().count() == 6
    assert materialise(spark.range(3), "x").count() == 3


def test_invariants(trained):
    assert trained.samples == 4 and trained.cycles == 26 and min(trained.alpha) > 0
    assert [h[1] for h in trained.history[9:12]] == ["burn-in", "sampling", "sample-lagging"]
    for r in S.column_sum(trained.phi()).collect():
        assert math.isclose(r["phi_sum"], 1, abs_tol=1e-9)
    for r in trained.theta().groupBy("doc_id").agg(F.sum("theta").alias("s")).collect():
        assert math.isclose(r["s"], 1, abs_tol=1e-9)
    n = trained.corpus().count()
    assert C.topic_counts(trained.corpus()).agg(F.sum("n")).first()[0] == n
    assert trained.history[0][2] > trained.history[-6][2]


def test_reload(spark, trained, tmp_path):
    path = str(tmp_path / "model")
    trained.save(path)
    again = lda.Model.load(spark, path)
    assert math.isclose(again.perplexity(), trained.perplexity(), rel_tol=1e-12)
    assert (again.alpha, again.samples, again.cycles) == (trained.alpha, trained.samples, trained.cycles)
    more = lda.train(again, 1, SHORT)
    assert more.cycles == 27 and again.cycles == 26


def test_generation(spark, trained):
    tops = {r["topic"]: [] for r in trained.top_terms(1).collect()}
    for r in trained.top_terms(4).collect():
        tops[r["topic"]].append(r["term"])
    texts = [r["text"].split() for r in trained.generate_texts(10, [1.0, 0.0]).collect()]
    assert len(texts) == 10
    assert set(tops[0]) <= {w for x in texts for w in x}
    assert sum(w in tops[1] for x in texts for w in x) <= 0.05 * sum(map(len, texts))
    with pytest.raises(ValueError):
        trained.generate(1, [1.0])


def test_ranks_of_close_scores(spark):
    from lexiloom.plans.queries import QUERIES

    # word w of the first 30 has its own counts, the other 30 have equal ones; all scores are far below the eighth decimal
    rng = random.Random(6)
    counts = [[rng.randint(0, 9) for _ in range(12)] for _ in range(30)] + [[3, 0, 1, 7, 0, 2, 5, 4, 6, 1, 0, 8]] * 30
    rows = [(w, k, (n + 0.2) / (2e9 + k % 5)) for w, c in enumerate(counts) for k, n in enumerate(c)]
    rng.shuffle(rows)
    words = spark.createDataFrame([(w, f"t{w:02}") for w in range(60)], "word_id int, token string")
    scored = S.term_scores(spark.createDataFrame(rows, "word_id int, topic int, phi double"), words)
    tied = scored.filter("word_id >= 30").groupBy("topic").agg(F.countDistinct("score").alias("n")).collect()
    assert [r["n"] for r in tied] == [1] * 12
    ln = {w: [math.log(p) for _, _, p in sorted(r for r in rows if r[0] == w)] for w in range(60)}
    score = {(w, k): p * (ln[w][k] - math.fsum(ln[w]) / 12) for w, k, p in rows}
    got = {(r["topic"], r["rank"]): r["term"] for r in S.top_terms(scored, 0).collect()}
    for k in range(12):
        best = sorted(range(60), key=lambda w: (float(f"{score[w, k]:.11e}"), w), reverse=True)
        assert [got[k, i + 1] for i in range(60)] == [f"t{w:02}" for w in best]
    assert "top_terms_ranked" in QUERIES


def test_no_samples(spark):
    model = lda.new_model(Pipeline.noop().run_texts(spark, ["a b", "b c"]), 2)
    with pytest.raises(ValueError):
        model.phi()
    assert lda.train(model, 0) == model
    assert lda.train(model, 1).corpus().count() == 4 and model.mean_seconds == 0
    with pytest.raises(ValueError):
        lda.Schedule(sample_lag=0)


def test_draws_do_not_depend_on_partitions(spark):
    rows = spark.range(1000).select(uniform(1, "id").alias("u"), uniform_int(5, 1, "id").alias("k"))
    again = spark.range(1000).repartition(7).select(uniform(1, "id").alias("u"), uniform_int(5, 1, "id").alias("k"))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, again.collect()))
    assert {r["k"] for r in rows.collect()} == set(range(5))


def brute_generated(phi, weights, n_docs, mean, seed):
    """The same draws, one by one."""
    u = lambda *key: int(hashlib.md5(":".join(map(str, (seed, *key))).encode()).hexdigest()[:13], 16) / 2**52
    pick = lambda probabilities, x: min(sum(s < x for s in accumulate(probabilities)), len(probabilities) - 1)
    words = sorted({w for w, _, _ in phi})
    of = {k: [p for w in words for v, t, p in phi if (v, t) == (w, k)] for k in range(len(weights))}
    low, upto = poisson_table(mean)
    for d in range(n_docs):
        for pos in range(low + min(sum(s < u("length", d) for s in upto), len(upto) - 1)):
            k = pick(weights, u("topic", d, pos) * sum(weights))
            yield d, pos, words[pick(of[k], u("word", d, pos) * sum(of[k]))]


@pytest.mark.parametrize("fanout", [2, 7, 256])
def test_generation_against_brute_force(spark, monkeypatch, fanout):
    monkeypatch.setattr(generate, "FANOUT", fanout)
    rng = random.Random(8)
    rows = [(3 * w, k, rng.random() / 50 if rng.random() < 0.9 else 0.0) for w in range(90) for k in range(3)]
    phi = spark.createDataFrame(rows, "word_id int, topic int, phi double")
    weights = [0.2, 0.5, 0.3]
    got = sorted(map(tuple, generate_documents(spark, 30, weights, phi, 12.5, 5).collect()))
    assert got == sorted(brute_generated(rows, weights, 30, 12.5, 5))
    again = generate_documents(spark, 30, weights, phi.repartition(5, "topic"), 12.5, 5)
    assert sorted(map(tuple, again.collect())) == got
    none = generate_documents(spark, 3, [1.0, 1.0, 0.0], phi, 0.0)
    words = spark.createDataFrame([(0, "x")], "word_id int, token string")
    assert [r["text"] for r in generate_texts(spark, 3, none, words).collect()] == ["", "", ""]


@pytest.mark.parametrize("mean", [0.3, 40.0, 2000.0])
def test_poisson(mean):
    low, upto = poisson_table(mean)
    share = np.diff([0.0, *upto])
    numbers = np.arange(low, low + len(share))
    assert abs(upto[-1] - 1) < 1e-9 and abs(share @ numbers - mean) < 1e-6 * mean + 1e-9 and abs(share @ (numbers - mean) ** 2 - mean) < 1e-5 * mean


def test_optimise_alpha():
    lengths, topics = {5: 3, 0: 2, 2: 4}, [{0: 2, 3: 3}, {2: 7}]
    alpha = [0.1, 0.1]
    for _ in range(10):
        total = sum(alpha)
        below = sum(n * sum(1 / (j + total) for j in range(size)) for size, n in lengths.items()) - 1
        alpha = [a * (sum(n * sum(1 / (j + a) for j in range(c)) for c, n in h.items()) + 1.001) / below for a, h in zip(alpha, topics)]
    assert np.allclose(prior.optimise_alpha([0.1, 0.1], lengths, topics), alpha)
    assert prior.optimise_alpha([1.0, 1.0], {1: 1}, [{}, {}], 1) == [0.1, 0.1]  # negative


def brute_sweep(docs, totals, of_word, alpha, beta, n_words, seed, sweep):
    """``docs``: (doc_id, chunk, words, topics, counts elsewhere); position by position, plainly."""
    n_topics = len(alpha)
    of_word = {w: list(c) for w, c in of_word.items()}
    totals = list(totals)
    topics = [list(t) for _, _, _, t, _ in docs]
    of_doc = [[t.count(k) + (e[k] if e else 0) for k in range(n_topics)] for t, (*_, e) in zip(topics, docs)]
    for i in range(max(len(t) for t in topics)):
        fresh = {}
        for j, (d, c, words, _, _) in enumerate(docs):
            if i < len(words):
                old = topics[j][i]
                own = [k == old for k in range(n_topics)]
                p = [(of_doc[j][k] - own[k] + alpha[k]) * (of_word[words[i]][k] - own[k] + beta) / (totals[k] - own[k] + beta * n_words) for k in range(n_topics)]
                u = int(hashlib.md5(f"{seed}:{sweep}:{d}:{c}:{i}".encode()).hexdigest()[:8], 16) / 2**32
                upto = list(accumulate(p))
                fresh[j] = old, min(sum(x < u * upto[-1] for x in upto), n_topics - 1)
        for j, (old, new) in fresh.items():
            for counts in (of_doc[j], of_word[docs[j][2][i]], totals):
                counts[old] -= 1
                counts[new] += 1
            topics[j][i] = new
    return topics


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=12), min_size=1, max_size=8), st.integers(0, 9))
def test_kernel_against_brute_force(texts, seed):
    rng = np.random.default_rng(seed)
    alpha, beta = [0.1, 0.4, 0.2], 0.2
    docs = [(7 * j, j % 2, words, rng.integers(0, 3, len(words)).tolist(), [2, 0, 5] if j == 1 else None) for j, words in enumerate(texts)]
    of_word = {w: (rng.integers(0, 3, 3) + [sum(v == w and z == k for _, _, ws, ts, _ in docs for v, z in zip(ws, ts)) for k in range(3)]).tolist() for w in {w for x in texts for w in x}}
    totals = [sum(c[k] for c in of_word.values()) + 4 for k in range(3)]
    frame = pd.DataFrame([(d, c, np.array(w, np.int32), np.array(t, np.int32), None if e is None else np.array(e)) for d, c, w, t, e in docs], columns=["doc_id", "chunk", "first", "second", "elsewhere"])
    frame["elsewhere"] = frame["elsewhere"].astype(object).where(frame["elsewhere"].notna(), None)
    words = pd.DataFrame([(w, np.flatnonzero(c), np.array(c)[np.flatnonzero(c)]) for w, c in sorted(of_word.items(), reverse=True)], columns=["word_id", "first", "second"])
    got = G.sweep_block(frame, words, totals, alpha, beta, 9, seed, 3)
    assert [x.tolist() for x in got] == brute_sweep(docs, totals, of_word, alpha, beta, 9, seed, 3)
    tally = G.block_counts([d[2] for d in docs], got, 3)
    assert sum(int(x.sum()) for x in tally["second"]) == sum(map(len, texts))


@pytest.mark.parametrize("few", [0, 24, 10**9])
@pytest.mark.parametrize("n_topics", [1, 3, 20])
def test_positions_that_few_documents_reach(monkeypatch, few, n_topics):
    monkeypatch.setattr(G, "FEW_WEIGHTS", few)
    rng = np.random.default_rng(n_topics)
    alpha = [0.1 + k / 7 for k in range(n_topics)]
    docs = [(3 * j, 0, rng.integers(0, 6, n).tolist(), rng.integers(0, n_topics, n).tolist(), None) for j, n in enumerate([1, 90, 5, 5, 33, 2, 1, 7])]
    of_word = {w: [sum((v, z) == (w, k) for _, _, ws, ts, _ in docs for v, z in zip(ws, ts)) for k in range(n_topics)] for w in range(6)}
    totals = np.sum([*of_word.values()], axis=0).tolist()
    frame = pd.DataFrame([(d, c, np.array(w), np.array(t), e) for d, c, w, t, e in docs], columns=["doc_id", "chunk", "first", "second", "elsewhere"])
    words = pd.DataFrame([(w, np.flatnonzero(c), np.array(c)[np.flatnonzero(c)]) for w, c in of_word.items()], columns=["word_id", "first", "second"])
    got = G.sweep_block(frame, words, totals, alpha, 0.2, 6, 4, 2)
    assert [x.tolist() for x in got] == brute_sweep(docs, totals, of_word, alpha, 0.2, 6, 4, 2)


def test_numbers_hashed_together():
    prefixes = [f"{s}:{d}" for s in (0, -3, 2**62) for d in (0, -7, 123_456_789, 2**63 - 1)] + ["x" * 50, "\u00e9"]
    for chosen, counts in ((prefixes, [0, 1, 2, 9, 10, 11, 99, 100, 101, 1000, 17_000, 3, 4, 5]), (prefixes[:9], [65_536, 0, 1, 12, 100, 7, 10, 9, 1]), (prefixes[:2], [0, 0])):
        assert uniforms_of(chosen, counts).tolist() == [u for p, n in zip(chosen, counts) for u in uniforms(p, n)]


def test_time_of_a_long_document():
    # before, every position cost some forty times its number
    n = 20_000
    docs = pd.DataFrame({"doc_id": [1], "chunk": [0], "first": [np.arange(n) % 50], "second": [np.arange(n) % 3], "elsewhere": [None]})
    words = pd.DataFrame({"word_id": range(50), "first": [np.arange(3)] * 50, "second": [np.full(3, n // 50)] * 50})

    def seconds(f):
        times = []
        for _ in range(3):
            began = time.perf_counter()
            f()
            times.append(time.perf_counter() - began)
        return min(times)

    assert seconds(lambda: G.sweep_block(docs, words, [n] * 3, [0.1] * 3, 0.2, 50, 1, 1)) < 12 * seconds(lambda: uniforms("1:1:1:0", n))


def test_perplexity_counts_words_and_documents_apart(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(G, "CHUNK", 40)
    rng = random.Random(4)
    model = lda.new_model(Pipeline.noop().run_texts(spark, [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 130))) for _ in range(40)]), 3, seed=2)
    rows = model.corpus().collect()
    wk, dk, k, d = (Counter(f(r) for r in rows) for f in (lambda r: (r["word_id"], r["topic"]), lambda r: (r["doc_id"], r["topic"]), lambda r: r["topic"], lambda r: r["doc_id"]))
    logs = [math.log((wk[r["word_id"], r["topic"]] + 0.2) / (k[r["topic"]] + 0.2 * 8) * (dk[r["doc_id"], r["topic"]] + 0.1) / (d[r["doc_id"]] + 0.3)) for r in rows]
    assert abs(model.perplexity() - math.exp(-sum(logs) / len(rows))) < 1e-9
    n_words = model.dictionary.count()
    plan = S.assigned_perplexity(model.corpus(), n_words, model.alpha, model.beta)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate [" in x and "doc_id" in x and "word_id" in x]


def test_sweeps_do_not_depend_on_partitions(spark, monkeypatch):
    from dataclasses import replace

    monkeypatch.setattr(G, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(G, "CHUNK", 40)
    rng = random.Random(9)
    corpus = Pipeline.noop().run_texts(spark, [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 130))) for _ in range(40)])
    model = lda.new_model(corpus, 3, seed=2)
    assert model.chunked and model.state.select("block").distinct().count() > 3
    topics = []
    for n in (1, 4):
        spread = replace(model, state=model.state.repartition(n))
        swept = lda.swept(lda.swept(spread, 0, 8), 1, 8)
        topics.append(sorted(map(tuple, swept.corpus().collect())))
        # what the blocks say of the words is what the documents hold
        held = G.state_counts(swept.state).groupBy("word_id", "topic").agg(F.sum("n").alias("n"))
        assert sorted(map(tuple, held.collect())) == sorted(map(tuple, C.word_topic_counts(swept.corpus()).collect()))
    assert topics[0] == topics[1] and len(topics[0]) == corpus.tokens.count()
    assert {(d, p): w for d, p, w, _ in topics[0]} == {(r["doc_id"], r["pos"]): r["word_id"] for r in corpus.tokens.collect()}
    assert topics[0] != sorted(map(tuple, model.corpus().collect()))


def test_large_vocabulary(spark):
    # more than five million cells of words and topics
    tokens = spark.range(120_000).select((F.col("id") / 60).cast("long").alias("doc_id"), (F.col("id") % 60).cast("int").alias("pos"), (F.col("id") * 7 % 110_000).cast("int").alias("word_id"))
    words = spark.range(110_000).select(F.col("id").cast("int").alias("word_id"), F.col("id").cast("string").alias("token"))
    model = lda.new_model(Corpus(tokens, words, tokens.select("doc_id").distinct()), 50)
    swept = lda.swept(model, 0, 110_000)
    moved = swept.corpus().join(model.corpus().withColumnRenamed("topic", "old"), ["doc_id", "pos", "word_id"]).filter("topic <> old").count()
    assert swept.corpus().count() == 120_000 and 60_000 < moved < 120_000


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "doc_id long, pos int, word_id int, topic int")
    index = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert sorted(map(tuple, C.document_lengths(none, index).collect())) == [(1, 0), (2, 0)]
    assert C.longest(C.document_lengths(none, index.limit(0))).first()[0] == 0
    assert C.mean_length(C.document_lengths(none, index.limit(0))).first()[0] == 0
    assert S.assigned_perplexity(none, 5, [0.1, 0.1]).first()[0] is None
    assert sorted(map(tuple, C.document_topic_histogram(none, index, 2).collect())) == [(0, 0, 2), (1, 0, 2)]
