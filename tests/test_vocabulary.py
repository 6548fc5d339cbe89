"""Stopwords, filters, dictionary, encoding, ordering and sources."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiloom.functions.tokens import token_rows
from lexiloom.operators import joins
from lexiloom.operators import vocabulary as V
from lexiloom.operators.ordering import dense_ids
from lexiloom.plans.pipeline import Pipeline
from lexiloom.sources import stopwords, text_files


def tokens_of(spark, *docs):
    return token_rows(spark.createDataFrame([(k, list(x)) for k, x in enumerate(docs)], "doc_id long, tokens array<string>"))


def by_doc(tokens, n):
    out = {k: [] for k in range(n)}
    for r in tokens.orderBy("doc_id", "pos").collect():
        out[r["doc_id"]].append(r["token"])
    return [out[k] for k in range(n)]


def test_default_stopwords(spark):
    words = stopwords.default_stopwords()
    assert len(words) == len(set(words)) < 200 and all(w.isalpha() and w == w.lower() for w in words)
    tokens = tokens_of(spark, ["document", "did", "does"], ["those", "with", "what"])
    assert by_doc(V.remove_stopwords(tokens), 2) == [["document"], []]
    assert V.warn_of_empty(spark.range(2).select(F.col("id").alias("doc_id")), V.remove_stopwords(tokens)) == 1


def test_own_stopwords(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("a\n\nThe\n")
    assert stopwords.read_stopwords(path) == ["a", "The"]
    tokens = tokens_of(spark, ["a", "the", "The", "b", "b"])
    assert by_doc(V.remove_stopwords(tokens, stopwords.read_stopwords(path)), 1) == [["the", "b", "b"]]
    path.write_text("did\ndoes\nput\nque\nwhat\nfür\n", "cp1252")
    listed = stopwords.read_stopwords(path, "cp1252")
    assert listed[-1] == "für"
    tokens = tokens_of(spark, ["document", "did", "does"], ["put", "que", "what"])
    assert by_doc(V.remove_stopwords(tokens, listed), 2) == [["document"], []]


@pytest.mark.parametrize(
    ("bounds", "docs", "after"),
    [
        ({"max_freq": 3}, ("aab", "aab"), ("b", "b")),
        ({"min_freq": 3}, ("aab", "aab"), ("aa", "aa")),
        ({"max_share": 0.5}, ("aab", "aac"), ("b", "c")),
        ({"min_share": 0.51}, ("aab", "aac"), ("aa", "aa")),
        ({"max_docs": 1}, ("aab", "aac"), ("b", "c")),
        ({"min_docs": 2}, ("aab", "aac"), ("aa", "aa")),
    ],
)
def test_filters(spark, bounds, docs, after):
    tokens = tokens_of(spark, *docs)
    ids = spark.range(len(docs)).select(F.col("id").alias("doc_id"))
    assert by_doc(V.filter_tokens(tokens, ids, V.TokenFilter(**bounds)), len(docs)) == [list(x) for x in after]


def test_length_filters(spark):
    tokens = tokens_of(spark, ["a", "a", "bbbb"], ["a", "a", "cccc"])
    ids = spark.range(2).select(F.col("id").alias("doc_id"))
    assert by_doc(V.filter_tokens(tokens, ids, V.TokenFilter(max_length=3)), 2) == [["a", "a"], ["a", "a"]]
    assert by_doc(V.filter_tokens(tokens, ids, V.TokenFilter(min_length=3)), 2) == [["bbbb"], ["cccc"]]


def test_filter_switches():
    bounds = V.TokenFilter.default().use(max_freq=True, min_docs=False)
    assert bounds.bounds() == {"max_freq": 1_000_000, "min_freq": 10, "max_share": 0.9, "min_length": 3}


def test_dictionary_and_encoding(spark):
    tokens = tokens_of(spark, ["b", "a", "b"], [], ["c", "a"])
    words = V.build_dictionary(tokens)
    assert {r["word_id"]: r["token"] for r in words.collect()} == {0: "b", 1: "a", 2: "c"}
    encoded = V.encode(tokens, words)
    assert sorted(map(tuple, encoded.collect())) == [(0, 0, 0), (0, 1, 1), (0, 2, 0), (2, 0, 2), (2, 1, 1)]
    assert sorted(map(tuple, V.decode(encoded, words).collect())) == sorted(map(tuple, tokens.collect()))
    asked = spark.createDataFrame([("a",), ("zz",)], "token string")
    assert {r["token"]: r["word_id"] for r in V.look_up(asked, words).collect()} == {"a": 1, "zz": None}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_split_join(spark, monkeypatch, how):
    monkeypatch.setattr(joins, "PARTS", 20)
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 40).cast("string")).alias("k"), "id")
    table = spark.createDataFrame(pa.table({"k": ["hot", "4", "none"], "v": [1, 2, 3]}))
    expected = sorted(map(repr, rows.join(table, "k", how).collect()))
    assert joins.fits_broadcast(table)
    monkeypatch.setattr(joins, "fits_broadcast", lambda _: False)
    got = joins.split_join(rows, table, "k", how)
    assert sorted(map(repr, got.collect())) == expected
    assert "cartesian" not in got._jdf.queryExecution().executedPlan().toString().lower()


def test_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from lexiloom.storage import shared_dir

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, getConf=lambda: {}))
    for master in ("yarn", "spark://a:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))


def test_text_is_cleaned_once(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string").repartition(3)
    plan = Pipeline.default().tokenise(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 6


def test_dense_ids(spark):
    rows = spark.range(10_000).select((F.col("id") * 7919 % 10_007).alias("x"))
    got = sorted((r["x"], r["n"]) for r in dense_ids(rows, ["x"], "n").collect())
    assert [n for _, n in got] == list(range(10_000))
    assert dense_ids(rows.limit(0), ["x"], "n").count() == 0


def test_lines(spark, tmp_path):
    path = tmp_path / "docs.txt"
    path.write_bytes("one\r\n\r\ntwo\rthrée".encode())
    assert sorted(map(tuple, text_files.read_lines(spark, str(path)).collect())) == [(0, "one"), (1, ""), (2, "two"), (3, "thrée")]
    path.write_bytes("a\né\n".encode("cp1252"))
    assert sorted(map(tuple, text_files.read_lines(spark, str(path), "cp1252").collect())) == [(0, "a"), (1, "é")]
    with pytest.raises(Exception):
        text_files.read_lines(spark, str(tmp_path / "missing")).count()


def test_pipeline(spark, tmp_path):
    corpus = Pipeline.noop().run_texts(spark, ["a  b", None, "b c"])
    assert sorted(r["token"] for r in corpus.dictionary.collect()) == ["", "a", "b", "c"]
    assert corpus.doc_index.count() == 3
    with pytest.raises(ValueError):
        Pipeline.default().run_texts(spark, ["a b", ""])
    path = tmp_path / "docs.txt"
    path.write_text("x y\ny z\n")
    assert Pipeline.noop().run_file(spark, str(path)).tokens.count() == 4
