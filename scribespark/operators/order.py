"""Running numbers and order statistics of whole groups, without a group in one task."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribespark.sources import files


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """df in the order of ``keys``, dealt out by ranges and written, with ``_row`` in that order and ``_range``.

    Rows with equal keys are told apart by a hash of the row and, equal rows, by where they come from, so a frequent key is dealt to
    many tasks. Only equal rows may change places when a task runs again.
    """
    order = [*keys, "_tie", "_id"]
    tied = df.withColumns({"_tie": F.xxhash64(*df.columns), "_id": F.monotonically_increasing_id()})
    ranged = tied.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie", "_id").withColumn("_row", F.monotonically_increasing_id())
    return files.snapshot(ranged, f"{files.shared_dir(df.sparkSession)}/placed-{uuid.uuid4().hex}").withColumn("_range", F.shiftright("_row", 33))


def _with_sums(rows: DataFrame, sums: DataFrame, by: list[str]) -> DataFrame:
    """rows with the figures of their group and range."""
    sums = sums.select(*(F.col(k).alias(f"_by_{k}") for k in by), F.col("_range").alias("_of"), *(c for c in sums.columns if c not in (*by, "_range")))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in by), F.col("_range") == F.col("_of"))
    return rows.join(sums, same)


def _placed(df: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """df with ``_at``, the place from 0 within ``by`` in ``order``, and ``_n``, the rows of ``by``.

    A row for each group and range (as many as there are tasks and groups) says how many come before.
    """
    rows = _dealt(df, [*by, *order])
    sums = rows.groupBy(*by, "_range").agg(F.min("_row").alias("_first"), F.count("*").alias("_held"))
    group = Window.partitionBy(*by)
    sums = sums.withColumn("_before", F.sum("_held").over(group.orderBy("_range")) - F.col("_held")).withColumn("_n", F.sum("_held").over(group))
    out = _with_sums(rows, sums, by).withColumn("_at", F.col("_row") - F.col("_first") + F.col("_before"))
    return out.select(*df.columns, "_at", "_n")


def numbered(df: DataFrame, order: list[str], name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with ``name``: the place of each row from 0, in ``order``, within ``by``; nulls are a group and come first."""
    return _placed(df, order, list(by)).withColumnRenamed("_at", name).drop("_n")


def order_stats(rows: DataFrame, by: list[str], value: str, share: float = 0.0, least: int = 0, weight: str | None = None) -> DataFrame:
    """n, mean, median, lo, hi of the values of each group without its outermost ones, and p95 of all of them.

    Where a group has more than ``least`` values, max(1, floor(share * n)) are cut off at either end (none if
    ``share`` is 0). p95 is the value at place floor(0.95 * n) from 0, untrimmed. Null values don't count. ``weight``: how many
    values a row stands for.
    """
    # equal values are one row with their number, however many there are
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_x")).agg((F.sum(weight) if weight else F.count("*")).alias("_c"))
    held = _dealt(counted, [*by, "_x"])
    sums = held.groupBy(*by, "_range").agg(F.sum("_c").alias("_held"))
    group = Window.partitionBy(*by)
    sums = sums.select(*by, "_range", (F.sum("_held").over(group.orderBy("_range")) - F.col("_held")).alias("_before"), F.sum("_held").over(group).alias("_n"))
    within = Window.partitionBy(*by, "_range").orderBy("_row")
    placed = _with_sums(held.withColumn("_upto", F.sum("_c").over(within)), sums, by)
    at, n, c, x = F.col("_before") + F.col("_upto") - F.col("_c"), F.col("_n"), F.col("_c"), F.col("_x")
    cut: Column = F.when(n > least, F.greatest(F.lit(1), F.floor(n * share))).otherwise(0) if share else F.lit(0)
    # of places at .. at + c - 1, those from a to b
    among = lambda a, b: F.greatest(F.lit(0), F.least(at + c - 1, b) - F.greatest(at, a) + 1)
    inside = among(cut, n - cut - 1)
    # the middle stays the middle when both ends are cut alike
    low, high = F.floor((n - 1) / 2), F.floor(n / 2)
    middle = F.when((among(low, low) > 0) | (among(high, high) > 0), x)
    kept = F.when(inside > 0, x)
    p95 = F.floor(n * 0.95)
    figures = [F.sum("_c").alias("n"), (F.sum(inside * x) / F.sum(inside)).alias("mean"), F.avg(middle).alias("median"), F.min(kept).alias("lo"), F.max(kept).alias("hi"), F.max(F.when(among(p95, p95) > 0, x)).alias("p95")]
    return placed.groupBy(*by).agg(*figures)
