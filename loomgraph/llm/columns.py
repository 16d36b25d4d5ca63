"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once a row, however often a lambda inside uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
