"""Cleaning steps: functions from a string column to a string column.

A null text stays null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Step = Callable[[Column], Column]

# The patterns of the cleaning steps.
URL = r"(?<!\S)\S+://\S+"  # tried where a run of other than white space begins, so that a long run is searched once
SPACED_PUNCTUATION = "[!,.?/:;_]"
UNWANTED = "[^a-zA-Z0-9-' ]"
WHOLE_NUMBER = "(?<= |^)[0-9]+(?= |$)"
OUTER_BLANK = r"^[\x00-\x20]+|[\x00-\x20]+$"
WHITE_SPACE = r"[ \t\n\x0B\f\r]+"


def lower_case(text: Column) -> Column:
    """Lower case, whatever the machine's locale."""
    return F.lower(text)


def remove_urls(text: Column) -> Column:
    """Delete ``scheme://...`` with all that is glued to it."""
    return F.regexp_replace(text, URL, "")


def punctuation_to_space(text: Column) -> Column:
    """Each of ``! , . ? / : ; _`` becomes a space."""
    return F.regexp_replace(text, SPACED_PUNCTUATION, " ")


def keep_plain_characters(text: Column) -> Column:
    """Delete all but ASCII letters and digits, ``-``, ``'`` and the space; line breaks and tabs go too."""
    return F.regexp_replace(text, UNWANTED, "")


def remove_numbers(text: Column) -> Column:
    """Delete numbers that stand alone between spaces or ends; the spaces stay."""
    return F.regexp_replace(text, WHOLE_NUMBER, "")


def collapse_white_space(text: Column) -> Column:
    """Trim control characters and spaces, then one space for each run of ASCII white space."""
    return F.regexp_replace(F.regexp_replace(text, OUTER_BLANK, ""), WHITE_SPACE, " ")


DEFAULT_STEPS: tuple[Step, ...] = (lower_case, remove_urls, punctuation_to_space, keep_plain_characters, remove_numbers, collapse_white_space)
NOOP_STEPS: tuple[Step, ...] = (collapse_white_space,)


def python_step(function: Callable[[str], str]) -> Step:
    """A step from a plain function on strings, run in Arrow batches; nulls are passed by."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action="ignore")

    return run


def clean(text: Column, steps: Sequence[Step] = DEFAULT_STEPS) -> Column:
    """The steps in their order."""
    return reduce(lambda column, step: step(column), steps, text)
