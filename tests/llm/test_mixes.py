"""Problems 8 and 9."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.llm import mixing, packing
from lexiloom.llm.token_sizes import VOCABULARY, load_encoding, token_sizes


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 64))
def test_best_two_fit(sizes, capacity):
    patterns = packing.best_two_fit(Counter(sizes), capacity)
    used = Counter()
    for p in patterns:
        assert sum(p.sizes) <= capacity and p.times >= 1
        for s in p.sizes:
            used[s] += p.times
    assert used == Counter(sizes)
    # no worse than twice the least number of bins
    assert sum(p.times for p in patterns) <= max(1, 2 * -(-sum(sizes) // capacity))


def test_improves_on_greedy():
    # greedy alone fills 6 + 3; the pair 2 + 2 fits the gap of 4 exactly
    patterns = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert patterns[0].sizes == (6, 2, 2)
    with pytest.raises(ValueError):
        packing.best_two_fit({11: 1}, 10)


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 500)
    rng = random.Random(1)
    rows = [(k, rng.choice([7, 7, 7, rng.randint(1, 90), 1000, 64, None, 0])) for k in range(3000)] + [(None, 5)]
    items = spark.createDataFrame(rows, "doc_id long, size long").withColumns({"spec_id": F.lit("x"), "place": F.lit("x"), "full": F.lit(0)})
    specs = spark.createDataFrame([(1, 64), (2, 100), (3, 0), (4, None)], "spec_id int, capacity int")
    packed = packing.pack(items, specs).collect()
    for spec_id, capacity in ((1, 64), (2, 100)):
        bins, docs = Counter(), defaultdict(list)
        for r in packed:
            if r["spec_id"] == spec_id:
                bins[r["bin_id"]] += r["size"]
                docs[r["doc_id"]].append((r["piece"], r["size"]))
        assert max(bins.values()) <= capacity and {*bins} == {*range(len(bins))}
        for k, size in rows:
            if k is None or not size:
                assert k is None or k not in docs
                continue
            pieces = sorted(docs[k])
            assert [p for p, _ in pieces] == [*range(-(-size // capacity))] and sum(s for _, s in pieces) == size
            assert all(s == capacity for _, s in pieces[:-1])
        assert sum(bins.values()) / (len(bins) * capacity) > 0.97
    assert {r["spec_id"] for r in packed} == {1, 2}
    assert packing.pack(items.limit(0), specs).count() == 0
    assert packing.pack(items, specs.limit(0)).count() == 0


def test_sizes(spark):
    texts = ["one two", "", None, "ü" * 3000, "<|endoftext|>"]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string").withColumn("size", F.lit("x"))
    encoding = load_encoding(open(VOCABULARY, "rb").read())
    assert [r["size"] for r in token_sizes(frame).orderBy("doc_id").collect()] == [len(encoding.encode_ordinary(x or "")) for x in texts]


TARGETS = [("big", 0.5, 1), ("small", 0.3, 2), ("tiny", 0.2, 3), ("none", 0.0, 4)]


def sources(spark, n=3000):
    rng = random.Random(2)
    words = {"big": "alpha beta gamma", "small": "cat dog bird", "tiny": "uno dos tres", "rest": "x y z"}
    rows = []
    for k in range(n):
        name = rng.choices([*words], [80, 12, 2, 6])[0]
        text = " ".join(rng.choice(words[name].split()) for _ in range(rng.randint(5, 40)))
        label = rng.choice([name, name.upper(), f" {name}", None])
        rows.append((k, text, label))
    rows += [(n, None, "big"), (n + 1, "", "big"), (None, "alpha", "big")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "member": F.lit(1), "rate": F.lit("x")})


def test_mix(spark):
    frame = sources(spark)
    targets = spark.createDataFrame([*TARGETS, (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    size = mixing.mix_sources(frame, targets).agg(F.sum("size")).first()[0]
    mixed = mixing.mix_sources(frame, targets, total_tokens=size)
    rows = mixed.collect()
    most = {s: m for s, _, m in TARGETS} | {"": 0}
    assert all(0 <= r["copies"] <= most[r["source"]] and 0 <= r["rate"] <= most[r["source"]] for r in rows)
    assert len(rows) == 3000
    report = {r["source"]: r for r in mixing.mix_report(mixed, targets.filter("source IS NOT NULL")).collect()}
    total = sum(r["size"] for r in rows)
    assert abs(report["big"]["expected_tokens"] - 0.5 * total) < 0.02 * total
    # what repeats do not permit stays below the target, at the cap
    assert report["tiny"]["expected_tokens"] == pytest.approx(3 * report["tiny"]["available_tokens"])
    assert report["none"]["share"] == 0 and sum(r["share"] for r in report.values()) == pytest.approx(1)
    assert abs(report["big"]["mixed_tokens"] - report["big"]["expected_tokens"]) < 0.05 * total
    # of its own accord the mix is as large as every source with documents permits
    own = {r["source"]: r for r in mixing.mix_report(mixing.mix_sources(frame, targets), targets.filter("source IS NOT NULL")).collect()}
    assert {s: r["share"] for s, r in own.items()} == pytest.approx({"big": 0.5, "small": 0.3, "tiny": 0.2, "none": 0.0}, abs=0.005)
    assert own["tiny"]["mixed_tokens"] == pytest.approx(3 * own["tiny"]["available_tokens"], rel=0.01)
    # the labels' words tell the documents without a label apart
    half = mixing.mix_sources(frame, targets, total_tokens=total // 20)
    shares = {r["source"]: r["expected_tokens"] / (total // 20) for r in mixing.mix_report(half, targets.filter("source IS NOT NULL")).collect()}
    assert shares == pytest.approx({"big": 0.5, "small": 0.3, "tiny": 0.2, "none": 0.0}, abs=0.02)


def test_rounded_copies(spark):
    rng = random.Random(3)
    rows = [(k, "ab"[k % 2], rng.randint(1, 500), rng.choice([0.0, 0.25, 1.0, 1.6, 3.0])) for k in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long, rate double")
    got = mixing.rounded_copies(frame.repartition(3)).collect()
    assert len(got) == 4000 and all(int(r["rate"]) <= r["copies"] <= -(-r["rate"] // 1) for r in got)
    for s in "ab":
        expected = sum(size * rate for _, source, size, rate in rows if source == s)
        assert abs(sum(r["size"] * r["copies"] for r in got if r["source"] == s) - expected) < 100


def test_no_documents(spark):
    frame = sources(spark).limit(0)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mixed = mixing.mix_sources(frame, targets)
    assert mixed.count() == 0 and mixing.mix_report(mixed, targets).count() == 4
    assert mixing.mix_sources(frame, targets.limit(0)).count() == 0
