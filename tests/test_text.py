"""Cleaning and tokenising."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions.tokens import join_tokens, split_tokens, token_rows

GOLDEN = [
    ("hello http://www.google.com world", "hello world"),
    ("hello https://www.example.com/a/b world", "hello world"),
    ("hello https://www.example.com/a?b=c&d=e world", "hello world"),
    *((f"a{c}b", "a b") for c in ",:;.!?/"),
    ("a-b", "a-b"),
    ("a'b", "a'b"),
    ("a£$%b", "ab"),
    ("a%^&*()b", "ab"),
    ("a+={}[]b", "ab"),
    ("a~><\\|b", "ab"),
    ("a`¬`b", "ab"),
    (" 0 ", ""),
    ("0", ""),
    (" 000 ", ""),
    ("0 1 000 hell0 0", "hell0"),
    ("0 1 000 0hell 0", "0hell"),
    ("  hello   world  ", "hello world"),
    ("hello \r world", "hello world"),
    ("hello \t\t world", "hello world"),
    ("\r\n hello \n world \n\r", "hello world"),
    ("hello\nworld", "helloworld"),
    ("", ""),
    (None, None),
]


def test_default_cleaning(spark):
    rows = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(GOLDEN)], "k int, text string")
    got = {r["k"]: r["c"] for r in rows.select("k", T.clean(F.col("text")).alias("c")).collect()}
    assert [got[k] for k in range(len(GOLDEN))] == [b for _, b in GOLDEN]


def test_own_steps(spark):
    rows = spark.createDataFrame([("Ab c",), (None,)], "text string")
    steps = (T.lower_case, T.python_step(lambda x: x[::-1]))
    assert [r[0] for r in rows.select(T.clean(F.col("text"), steps)).collect()] == ["c ba", None]


def java_split(text: str, delimiter: str) -> list[str]:
    if not re.search(delimiter, text):
        return [text]
    parts = re.split(delimiter, text)
    while parts and not parts[-1]:
        parts.pop()
    return parts


@pytest.mark.parametrize("delimiter", [" ", "[,;]+"])
def test_split(spark, delimiter):
    @settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
    @given(st.lists(st.text("ab ,;\n", max_size=12), min_size=1, max_size=80))
    def check(texts):
        rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, text string")
        got = {r["k"]: r["t"] for r in rows.select("k", split_tokens(F.col("text"), delimiter).alias("t")).collect()}
        assert [got[k] for k in range(len(texts))] == [java_split(x, delimiter) for x in texts]

    check()


def test_split_cases(spark):
    cases = {"document 1 test": ["document", "1", "test"], "7 don't 8-9 ": ["7", "don't", "8-9"], "": [""], " ": [], " a": ["", "a"]}
    rows = spark.createDataFrame([(x,) for x in cases], "text string")
    assert {r[0]: r[1] for r in rows.select("text", split_tokens(F.col("text"))).collect()} == cases


def test_tokens_and_back(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "b"]), (2, [])], "doc_id long, tokens array<string>")
    tokens = token_rows(docs)
    assert sorted(map(tuple, tokens.collect())) == [(1, 0, "b"), (1, 1, "a"), (1, 2, "b")]
    assert [tuple(r) for r in join_tokens(tokens).collect()] == [(1, "b a b")]
