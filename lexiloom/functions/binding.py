"""Naming a value within an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for a row.

    A column that a lambda names is put in its place by the planner, and so worked out for
    every element; one that is bound here is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
