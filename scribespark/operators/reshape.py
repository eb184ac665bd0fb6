"""Wide tables (a column a model) to long ones and back, and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def model_columns(df: DataFrame, part: str = "whisper") -> list[str]:
    """The columns that hold a model's results."""
    return [c for c in df.columns if part in c.lower()]


def display_name(column: Column) -> Column:
    """whisper_tinyEn_transcription -> Tinyen."""
    short = F.replace(F.replace(column, F.lit("whisper_"), F.lit("")), F.lit("_transcription"), F.lit(""))
    return F.initcap(F.replace(short, F.lit("_"), F.lit(" ")))


def melt(df: DataFrame, keys: list[str], columns: list[str], name: str = "column_name", value: str = "value") -> DataFrame:
    """A row for each key and column."""
    return df.unpivot(keys, columns, name, value)


def pivoted(df: DataFrame, keys: list[str], column: str, values: list[str], cell: Column) -> DataFrame:
    """A column for each of ``values``; named beforehand, so no job is spent on finding them."""
    return df.groupBy(*keys).pivot(column, values).agg(cell)


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first by ``order``."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_place")
