"""Exact quantiles of groups of any size, by counting.

A value's 64 bits are read as an integer in the order of the values. A round counts the next 16 bits of the
values that share a wanted value's bits so far, which narrows each wanted place to one of 65,536; after four rounds all
bits are known. No row is shuffled: tasks hand on counts, at most 65,536 for each group and wanted place,
however many distinct values there are.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribespark.sources import files

#: Bits that a round finds out.
STEP = 16
_QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def _turned(bits: np.ndarray) -> np.ndarray:
    """Bits of negative values in the order of the values; the same once more gives the bits back."""
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


@F.arrow_udf(T.LongType())
def bits_of(values: pa.Array) -> pa.Array:
    """Doubles as integers in the same order; -0.0 is 0.0, NaN the greatest, null stays null."""
    x = values.fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0
    x = np.where(np.isnan(x), np.nan, x)
    return pa.array(_turned(x.view(np.int64)), mask=values.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(T.DoubleType())
def value_of(bits: pa.Array) -> pa.Array:
    x = bits.fill_null(0).to_numpy(zero_copy_only=False)
    return pa.array(_turned(x).view(np.float64), mask=bits.is_null().to_numpy(zero_copy_only=False))


def kept(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by`` and ``x``, the values that are not null, and ``bits``: written, so that a value is worked out once for all rounds."""
    rows = df.select(*by, F.col(value).cast("double").alias("x"))
    path = f"{files.shared_dir(df.sparkSession)}/values-{uuid.uuid4().hex}"
    return files.snapshot(rows.withColumn("bits", bits_of("x")), path).where("bits is not null")


def tallied(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """As ``kept``, equal values as one row with their number, ``c``: for values of which many are equal, as rates are; the different ones of a task are shuffled."""
    counts = df.select(*by, F.col(value).cast("double").alias("x")).groupBy(*by, "x").agg(F.count("*").alias("c"))
    path = f"{files.shared_dir(df.sparkSession)}/values-{uuid.uuid4().hex}"
    return files.snapshot(counts.withColumn("bits", bits_of("x")), path).where("bits is not null")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys), F.lit(True))


def quantiles(values: DataFrame, by: list[str], shares: dict[str, float] | None = None) -> DataFrame:
    """by, n and the named quantiles (default: quartiles) of a table from ``kept`` or ``tallied``, between neighbours linearly interpolated.

    Null keys are a group of their own; a group without values has no row.
    """
    shares = shares or _QUARTILES
    first, times = F.shiftright("bits", 64 - STEP), F.sum("c") if "c" in values.columns else F.count("*")
    counts = values.groupBy(*by, first.alias("p")).agg(times.alias("c"))
    below = Window.partitionBy(*by).orderBy("p")
    counts = counts.withColumns({"before": F.sum("c").over(below) - F.col("c"), "n": F.sum("c").over(Window.partitionBy(*by))})
    at = {k: (F.col("n") - 1) * F.lit(float(q)) for k, q in shares.items()}
    places = F.array_distinct(F.array(*(f(x).cast("long") for x in at.values() for f in (F.floor, F.ceil))))
    inside = (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("c"))
    wanted = counts.withColumn("place", F.explode(places)).where(inside).select(*by, "n", "place", "p", "before")
    for shift in range(64 - 2 * STEP, -1, -STEP):
        narrowed = wanted.select(*by, "p").distinct()
        rows = values.join(narrowed, _same(values, narrowed, by) & (F.shiftright(values["bits"], shift + STEP) == narrowed["p"]), "left_semi")
        next_ = rows.groupBy(*by, F.shiftright("bits", shift).alias("q")).agg(times.alias("c")).withColumn("of", F.shiftright("q", STEP))
        next_ = next_.withColumn("earlier", F.sum("c").over(Window.partitionBy(*by, "of").orderBy("q")) - F.col("c"))
        found = wanted.join(next_, _same(wanted, next_, by) & (wanted["p"] == next_["of"]))
        before = F.col("before") + F.col("earlier")
        wanted = found.where((F.col("place") >= before) & (F.col("place") < before + F.col("c"))).select(*(wanted[k] for k in by), "n", "place", F.col("q").alias("p"), before.alias("before"))
    known = wanted.select(*by, "n", "place", value_of("p").alias("x"))
    value_at = lambda place: F.max(F.when(F.col("place") == place, F.col("x")))
    out = known.groupBy(*by, "n").agg(*(value_at(f(x)).alias(f"{k}_{f.__name__}") for k, x in at.items() for f in (F.floor, F.ceil)))
    between = {k: F.col(f"{k}_floor") + (F.col(f"{k}_ceil") - F.col(f"{k}_floor")) * (x - F.floor(x)) for k, x in at.items()}
    return out.select(*by, "n", *(F.when(F.col(f"{k}_floor") == F.col(f"{k}_ceil"), F.col(f"{k}_floor")).otherwise(x).alias(k) for k, x in between.items()))
