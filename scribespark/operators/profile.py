"""What columns hold, in one pass over a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribespark.functions import variant

COUNTS = ("non_null", "null", "empty_dict", "empty_list", "dict", "list")


def _counts(df: DataFrame, name: str) -> list[Column]:
    c = F.col(name)
    if df.schema[name].dataType.simpleString() != "variant":
        zero = F.lit(0).cast("long")
        return [F.count(c), F.count_if(c.isNull()), zero, zero, zero, zero]
    null, empty, obj, lst = variant.is_null(c), variant.is_empty(c), variant.is_object(c), variant.is_list(c)
    return [F.count_if(~null & ~empty), F.count_if(null), F.count_if(obj & empty), F.count_if(lst & empty), F.count_if(obj), F.count_if(lst)]


def column_profile(df: DataFrame) -> DataFrame:
    """A row for each column: COUNTS and the percentage of non-nulls; a single scan whatever their number."""
    each = [F.struct(*(x.cast("long").alias(k) for k, x in zip(COUNTS, _counts(df, c)))).alias(f"c{i}") for i, c in enumerate(df.columns)]
    one = df.agg(F.count("*").alias("total"), *each)
    rows = one.select("total", F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("x")) for i, c in enumerate(df.columns)))).alias("r"))
    pct = F.when(F.col("total") > 0, F.round(F.col("r.x.non_null") * 100.0 / F.col("total"), 2).cast("double")).otherwise(0.0)
    return rows.select("r.column_name", "total", "r.x.*", pct.alias("non_null_pct"))


def completion(df: DataFrame, columns: list[str]) -> DataFrame:
    """model_column, total, with_result, without, pct, error: how far each model's column is filled, in one scan.

    A column that the table lacks has a row with an error and no figures.
    """
    held = [c for c in columns if c in df.columns]
    done = [F.count_if(~variant.is_missing(F.col(c))).alias(f"c{i}") for i, c in enumerate(held)]
    each = [F.struct(F.lit(c).alias("model_column"), F.col("total"), F.col(f"c{i}").alias("with_result"), F.lit(None).cast("string").alias("error")) for i, c in enumerate(held)]
    none = F.lit(None).cast("long")
    each += [F.struct(F.lit(c).alias("model_column"), none.alias("total"), none.alias("with_result"), F.lit(f"Column '{c}' does not exist in table").alias("error")) for c in columns if c not in held]
    rows = df.agg(F.count("*").alias("total"), *done).select(F.explode(F.array(*each)).alias("x")).select("x.*")
    pct = F.when(F.col("total") > 0, F.round(F.col("with_result") * 100.0 / F.col("total"), 2).cast("double")).when(F.col("total") == 0, 0.0)
    return rows.select("model_column", "total", "with_result", (F.col("total") - F.col("with_result")).alias("without"), pct.alias("pct"), "error")
