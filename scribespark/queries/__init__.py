"""Queries over the test tables, one for each key of the registry, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scribespark.queries import accuracy, flags, json_columns, loading, service, streams  # noqa: F401
from scribespark.queries.registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["wer_summary"](spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "flagship"]
