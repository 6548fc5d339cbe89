"""Problems 1, 2, 4 and 7 against brute force."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import distinctive_terms, frequent_items, term_frequency, top_items


def brute_ngrams(rows, max_n):
    docs = defaultdict(dict)
    for d, p, t in sorted((r for r in rows if None not in r and r[2]), key=lambda r: (r[0], r[1], r[2])):
        docs[d].setdefault(p, t)
    occurrences, records = Counter(), Counter()
    for held in docs.values():
        grams = Counter()
        for p in held:
            for n in range(1, max_n + 1):
                if all(p + k in held for k in range(n)):
                    grams[n, " ".join(held[p + k] for k in range(n))] += 1
        occurrences.update(grams)
        records.update(grams.keys())
    return sorted((n, t, c, records[n, t]) for (n, t), c in occurrences.items())


def token_rows(seed=1, docs=40, longest=60):
    rng = random.Random(seed)
    rows = [(d, p, rng.choice(["a", "b", "c d", "é", "", None, "hot", "hot", "hot"])) for d in range(docs) for p in range(rng.randint(0, longest))]
    rows += rng.sample(rows, 100) + [(None, 1, "x"), (1, None, "x"), (3, 2, "zz"), (3, 2, "zz")]
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, pos int, token string"


@pytest.mark.parametrize("chunk", [1 << 16, 7])
@pytest.mark.parametrize("max_n", [1, 3])
def test_ngrams(spark, monkeypatch, chunk, max_n):
    monkeypatch.setattr(term_frequency, "CHUNK", chunk)
    rows = token_rows()
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit(1), "term": F.lit("x"), "record": F.lit("y")})
    if chunk == 7:  # the workers import the module with its usual value
        blocks = term_frequency._count_blocks
        monkeypatch.setattr(term_frequency, "_count_blocks", lambda n: _chunked(blocks(n), chunk))
    got = sorted(map(tuple, term_frequency.ngram_frequency(frame, max_n).select("n", "term", "occurrences", "records").collect()))
    assert got == brute_ngrams(rows, max_n)


@pytest.mark.parametrize("size", [1, 2, 40, 300])
def test_suffix_order(size):
    rng = np.random.default_rng(size)
    codes = np.tile(rng.integers(0, 3, -(-size // 3)), 3)[:size]  # long repeats
    ends = np.unique(np.r_[rng.integers(1, size + 1, 3), size])
    end = ends[np.searchsorted(ends, np.arange(size), side="right")]
    suffix = lambda i: tuple(codes[i : end[i]].tolist())
    order, ranks = term_frequency.suffix_order(codes, end)
    assert [suffix(i) for i in order] == sorted(map(suffix, range(size)))
    pairs = rng.integers(0, size, (2, 200))
    shared = [next((k for k, (x, y) in enumerate(zip(suffix(i), suffix(j))) if x != y), min(len(suffix(i)), len(suffix(j)))) for i, j in pairs.T]
    assert term_frequency.common_prefix(ranks, end, *pairs).tolist() == shared


def test_all_bigrams_are_marked(spark, tmp_path):
    from lexiloom.llm.queries import queries

    rows = [*token_rows(), (0, 1000, "seen"), (0, 1001, "once")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/tokens.parquet")
    spark.createDataFrame([(d,) for d in range(40)], "doc_id long").write.parquet(f"{tmp_path}/doc_index.parquet")
    mark = lambda c, r: "common" if r * 100 > 90 * 40 else "rare" if c < 10 or r < 5 else None
    expected = sorted((t, c, r, mark(c, r)) for n, t, c, r in brute_ngrams(rows, 2) if n == 2)
    assert ("seen once", 1, 1, "rare") in expected
    assert sorted(map(tuple, queries()["p1_bigram_marks"](spark, str(tmp_path)).collect()), key=lambda r: r[0]) == expected


def _chunked(run, chunk):
    def with_chunk(batches):
        from lexiloom.llm import term_frequency as module

        before, module.CHUNK = module.CHUNK, chunk
        try:
            yield from run(batches)
        finally:
            module.CHUNK = before

    return with_chunk


def test_no_tokens(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert term_frequency.ngram_frequency(empty).count() == 0
    marked = term_frequency.mark_terms(term_frequency.ngram_frequency(empty), spark.range(0))
    assert marked.count() == 0


def test_marks(spark):
    rows = [(d, 0, "all") for d in range(100)] + [(d, 1, "some") for d in range(50)] + [(d, 2, "few") for d in range(4)] + [(d % 5, 10 + d, "nine") for d in range(9)]
    frequency = term_frequency.ngram_frequency(spark.createDataFrame(rows, SCHEMA))
    marks = {r["term"]: r["mark"] for r in term_frequency.mark_terms(frequency, spark.range(100)).collect()}
    assert marks == {"all": "common", "some": None, "few": "rare", "nine": "rare"}


def test_top_items(spark):
    rng = random.Random(2)
    rows = [(rng.choice([7, 7, 7, rng.randint(0, 30), None]), rng.choice([0, 1, None]), rng.choice(["é", "z", "Z", "", "ﬀ", "😀"]) + str(rng.randint(0, 40)), rng.choice([None, float("nan"), -0.0, 0.0, rng.randint(-5, 5) / 4])) for _ in range(4000)]
    rows += rows[:500] + [(1, 1, None, 9.0)]
    frame = spark.createDataFrame(rows, "g long, k int, item string, score double").withColumn("place", F.lit("extra"))
    got = sorted(map(repr, (tuple(r) for r in top_items.top_items(frame, ["g", "k"], "item", "score", 10).select("g", "k", "place", "item", "score").collect())))
    best = {}
    for g, k, item, score in rows:
        if item is not None and score is not None and score == score:
            best[g, k, item] = max(best.get((g, k, item), score), score) + 0.0
    groups = defaultdict(list)
    for (g, k, item), score in best.items():
        groups[g, k].append((score, item))
    expected = [(g, k, place, item, score) for (g, k), held in groups.items() for place, (score, item) in enumerate(sorted(held, reverse=True)[:10], 1)]
    assert got == sorted(map(repr, expected))
    assert top_items.top_items(frame.limit(0), ["g", "k"], "item", "score", 10).count() == 0


def test_top_items_skip(spark, monkeypatch):
    monkeypatch.setattr(top_items, "ROW_GROUP_ROWS", 1000)
    frame = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50 + 2).alias("g"), F.col("id").cast("string").alias("item"), (F.col("id") * 7919 % 60_013).cast("double").alias("score"))
    files = sorted(spark.read.parquet(top_items.cluster_by_group(frame, ["g"], "item", "score")).inputFiles())
    seen = {}
    list(top_items.select_top(files, ["g"], "item", "score", 10, seen))
    assert seen["skipped"] >= 15
    # a row group of several groups is left out if all of them are full; one that holds a group not met before is not
    few = frame.filter("g <= 4").withColumn("score", F.when(F.col("g") == 1, F.col("score")).otherwise(F.col("score") - 1e6))
    files = sorted(spark.read.parquet(top_items.cluster_by_group(few.coalesce(1), ["g"], "item", "score")).inputFiles())
    got = pd.concat(top_items.select_top(files, ["g"], "item", "score", 5))
    assert got.groupby("g").size().to_dict() == {g: 5 for g in (1, 2, 3, 4)}
    tied = frame.withColumn("score", F.lit(1.0))
    got = [r["item"] for r in top_items.top_items(tied, ["g"], "item", "score", 3).filter("g = 1").orderBy("place").collect()]
    assert got == sorted((str(x) for x in range(0, 60_000, 3)), reverse=True)[:3]


def test_mixed_row_groups(tmp_path):
    # row groups of two groups each, both of which are full after the first
    rows = [(g, f"i{k}", float(100 - k)) for k in range(12) for g in (1, None)]
    table = pa.table({"g": pa.array([r[0] for r in rows], pa.int64()), "item": [r[1] for r in rows], "score": [r[2] for r in rows]})
    pq.write_table(table, tmp_path / "a.parquet", row_group_size=6)
    seen = {}
    got = pd.concat(top_items.select_top([f"file://{tmp_path}/a.parquet"], ["g"], "item", "score", 3, seen))
    assert seen == {"read": 1, "skipped": 3} and len(got) == 6 and got["score"].min() == 98
    assert top_items._later((1, 2), (1, None)) and not top_items._later((None, 9), (1, None)) and not top_items._later((1, 2), (1, 2))


def test_row_groups_are_skipped_in_the_given_table(spark):
    path = "/root/testdata/sf0.1/term_scores.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    rows = spark.read.parquet(path).filter("topic IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)").select("run_id", "topic", "term", "score")
    files = sorted(spark.read.parquet(top_items.cluster_by_group(rows, ["run_id", "topic"], "term", "score")).inputFiles())
    seen = {}
    list(top_items.select_top(files, ["run_id", "topic"], "term", "score", 10, seen))
    assert seen["skipped"] > 0


def test_typical_terms_lose_nothing(spark):
    rng = random.Random(5)
    rows = [(run, topic, word, rng.choice([0.0001, 0.0019, 0.002, 0.003, 0.02, 0.3]) * rng.choice([1, 1, 0.999, 1.3])) for run in range(4) for word in range(300) for topic in rng.sample(range(20), rng.randint(1, 20))]
    frame = spark.createDataFrame(rows, "run long, topic int, word int, phi double")
    sizes = spark.createDataFrame([(r, 20) for r in range(3)], "run long, n_records int")
    scored = distinctive_terms.residual_idf(frame, "run", "topic", "word", "phi", sizes)
    found = distinctive_terms.typical_terms(scored, "phi", 0.002, 0.3)
    total = defaultdict(float)
    for run, topic, word, phi in rows:
        total[run, word] += phi
    expected = sorted((run, topic, word) for run, topic, word, phi in rows if phi >= 0.002 and phi >= 0.3 * total[run, word])
    assert sorted((r["run"], r["topic"], r["word"]) for r in found.collect()) == expected
    assert "ridf" in found._jdf.queryExecution().optimizedPlan().toString() or "log2" in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_frequent(spark):
    rng = random.Random(4)
    values = [rng.choice([1, 1, 1, 2, None, rng.randint(3, 5000)]) for _ in range(6000)]
    frame = spark.createDataFrame([(v,) for v in values], "w int").withColumn("n_rows", F.lit("x"))
    counts = Counter(v for v in values if v is not None)
    expected = sorted(((c, v) for v, c in counts.items()), reverse=True)
    assert [(r["n_rows"], r["w"]) for r in frequent_items.frequent_items(frame, "w", 20).collect()] == expected[:20]
    total = sum(counts.values())
    assert {r["w"] for r in frequent_items.notable_items(frame, "w", 2).collect()} == {v for v, c in counts.items() if c * 1000 >= 2 * total}
    assert frequent_items.notable_items(frame.limit(0), "w", 2).count() == 0


def test_distinctive(spark):
    rows = [(1, t, 1, 0.01) for t in range(4)] + [(1, 0, 2, 0.02), (1, 0, 2, 0.02), (1, 1, 3, None), (1, 2, 3, float("nan")), (None, 1, 1, 0.1), (1, 1, None, 0.1), (2, 0, 1, 0.5), (1, 3, 4, -1.0)]
    frame = spark.createDataFrame(rows, "run long, topic int, word int, phi double").withColumns({"total": F.lit("x"), "records": F.lit("x")})
    sizes = spark.createDataFrame([(1, 4)], "run long, n_records int")
    got = {(r["run"], r["topic"], r["word"]): r for r in distinctive_terms.residual_idf(frame, "run", "topic", "word", "phi", sizes).collect()}
    assert {*got} == {(1, t, 1) for t in range(4)} | {(1, 0, 2), (2, 0, 1)}
    assert got[1, 0, 2]["score"] > 10 * abs(got[1, 0, 1]["score"]) and got[1, 0, 2]["records"] == 1
    assert got[2, 0, 1]["score"] is None and abs(got[1, 0, 1]["total"] - 0.04) < 1e-12
    assert distinctive_terms.residual_idf(frame.limit(0), "run", "topic", "word", "phi", sizes).count() == 0
