"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often it is used, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once a row, also where a later filter asks for it: nothing is pushed below a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))
