"""Summaries of word error rates by model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scribespark.functions.wer import quality_band
from scribespark.operators.quantiles import kept, quantiles, tallied


def _figures(values: DataFrame, by: str) -> DataFrame:
    """n, mean, std (sample), lo and hi of a table from ``tallied``; squares are taken from the mean on."""
    x, c = F.col("x"), F.col("c")
    known = values.groupBy(by).agg(F.sum("c").alias("n"), (F.sum(x * c) / F.sum("c")).alias("mean"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    away = x - F.col("mean")
    spread = _joined(values, known.select(by, "mean"), by).groupBy(by).agg(F.sum(away * away * c).alias("squares"))
    std = F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1)))
    return _joined(known, spread, by).select(by, "n", "mean", std.alias("std"), "lo", "hi")


def _joined(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """Two tables of a row a group; a null group meets itself."""
    right = right.withColumnRenamed(by, "_by")
    return left.join(right, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def summary(scored: DataFrame, by: str = "model", value: str = "wer") -> DataFrame:
    """count, mean, std (sample), min, max, median of percentages, with label, axis cap and band; best first."""
    values = tallied(scored, [by], value)
    stats = _joined(_figures(values, by), quantiles(values, [by], {"median": 0.5}).drop("n"), by)
    return stats.withColumns({"axis_cap": F.least(F.lit(120.0), F.col("hi") + 10), "label": F.format_string("Avg: %.3f", F.col("mean")), "band": quality_band(F.col("mean"))}).orderBy("mean", by)


def describe(scored: DataFrame, by: str = "model", value: str = "wer") -> DataFrame:
    """count, mean, std, min, quartiles (exact, interpolated), max."""
    values = tallied(scored, [by], value)
    stats = _joined(_figures(values, by), quantiles(values, [by]).drop("n"), by)
    return stats.select(by, "n", "mean", "std", "lo", "q25", "q50", "q75", "hi")


def time_stats(rows: DataFrame, by: str, value: str, digits: int = 3) -> DataFrame:
    """count, mean, median, min, max and total of times, rounded; a group without any has a count of 0 and nulls."""
    values = kept(rows, [by], value)
    figures = {"mean": F.avg("x"), "median": F.first("median"), "lo": F.min("x"), "hi": F.max("x"), "total": F.sum("x")}
    found = _joined(values, quantiles(values, [by], {"median": 0.5}).drop("n"), by)
    stats = found.groupBy(by).agg(F.count("*").alias("n"), *(F.round(f, digits).alias(k) for k, f in figures.items()))
    groups = rows.select(F.col(by).alias("_group")).distinct()
    out = groups.join(stats, F.col("_group").eqNullSafe(F.col(by)), "left")
    return out.select(F.col("_group").alias(by), F.coalesce("n", F.lit(0)).alias("n"), *figures)


def histogram(scored: DataFrame, by: str = "model", value: str = "wer", bins: int = 15) -> DataFrame:
    """Density in equal bins over each model's own range, the last bin closed; one value: half a unit around it."""
    rows = tallied(scored, [by], value).select(by, "x", "c")
    edges = rows.groupBy(by).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.sum("c").alias("n"))
    same = F.col("a") == F.col("b")
    edges = edges.select(by, "n", F.when(same, F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(same, F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    edges = edges.withColumn("width", (F.col("b") - F.col("a")) / bins)
    # a row a model: Spark broadcasts it while it is small
    placed = _joined(rows, edges, by).withColumn("bin", F.least(F.floor((F.col("x") - F.col("a")) / F.col("width")), F.lit(bins - 1)).cast("int"))
    counts = placed.groupBy(by, "bin", "n", "a", "width").agg(F.sum("c").alias("in_bin"))
    return counts.select(by, "bin", (F.col("a") + F.col("bin") * F.col("width")).alias("left_edge"), "in_bin", (F.col("in_bin") / (F.col("n") * F.col("width"))).alias("density"))


def boxplot(scored: DataFrame, by: str = "model", value: str = "wer") -> DataFrame:
    """Quartiles, whiskers (the furthest values within 1.5 quartile ranges) and the number of outliers."""
    values = tallied(scored, [by], value)
    q = quantiles(values, [by], {"q1": 0.25, "q2": 0.5, "q3": 0.75}).drop("n")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("x").between(F.col("q1") - reach, F.col("q3") + reach)
    return _joined(values, q, by).groupBy(by, "q1", "q2", "q3").agg(F.min(F.when(inside, F.col("x"))).alias("whisker_low"), F.max(F.when(inside, F.col("x"))).alias("whisker_high"), F.sum(F.when(~inside, F.col("c")).otherwise(0)).alias("outliers"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows there are, how many are kept if each key stays once, and how many repeat a key. Null keys are equal."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_c"))
    return counts.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("rows"), F.count("*").alias("kept"), F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("duplicates"))


def share_by(df: DataFrame, *by: str) -> DataFrame:
    """Count and percentage by group, most frequent first."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), *by)
