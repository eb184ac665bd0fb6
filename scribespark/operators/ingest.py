"""Loading only what is new, updates by key, schema steps, manifests, batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribespark.operators.order import numbered


def new_rows(incoming: DataFrame, loaded: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Incoming rows whose key isn't loaded; the first ``most`` by key if asked for."""
    fresh = incoming.join(loaded.select(key), key, "left_anti")
    return fresh.orderBy(key).limit(most) if most is not None else fresh


def last_values(updates: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """key and, for each column, struct(o, v): the value that is last by ``order`` among those that are not null.

    Of equal orders the greatest value is the last. So the last of several tables' last values is that of
    all their updates, however they are split.
    """
    value = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v")))
    return updates.groupBy(key).agg(*(F.max(value(c)).alias(c) for c in columns))


def upsert(table: DataFrame, updates: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """The table with the last value of each column that is not null written over ``columns``: see ``last_values``."""
    return overlaid(table, last_values(updates, key, columns, order), key, columns)


def overlaid(table: DataFrame, last: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The table with ``last_values`` laid over it; keys that it lacks are left out."""
    new = last.select(F.col(key), F.struct(*(F.col(f"{c}.v").alias(c) for c in columns)).alias("_new"))
    joined = table.join(new, key, "left")
    return joined.select(*((F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c) if c in columns else F.col(c)) for c in table.columns))


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds the missing columns as typed nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def add_computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds the computed columns that aren't there yet."""
    return df.withColumns({c: x for c, x in columns.items() if c not in df.columns})


Step = tuple[str, Callable[[list[str]], bool], Callable[[DataFrame], DataFrame]]


def migrate(df: DataFrame, steps: list[Step]) -> DataFrame:
    """Runs each step whose condition on the column names holds; a second run changes nothing."""
    for _, needed, step in steps:
        if needed(df.columns):
            df = step(df)
    return df


def batches(pending: DataFrame, key: str, size: int, group: str) -> DataFrame:
    """Batch number of each pending row within its group, and how many remain after it."""
    placed = numbered(pending, [key], "_at", (group,)).withColumn("batch", F.floor(F.col("_at") / size).cast("int"))
    sums = placed.groupBy(group, "batch").agg(F.count("*").alias("rows"))
    running = F.sum("rows").over(Window.partitionBy(group).orderBy("batch"))
    return sums.withColumns({"done_after": running, "remaining_after": F.sum("rows").over(Window.partitionBy(group)) - running})


def match_by_priority(left: DataFrame, right: DataFrame, on: str, priority: str, value: str, name: str) -> DataFrame:
    """left with the value of the matching right row of least priority (then least value), null if none."""
    best = right.groupBy(on).agg(F.min(F.struct(priority, value)).alias("_m")).select(on, F.col(f"_m.{value}").alias(name))
    return left.join(best, on, "left")


def union_manifests(*manifests: DataFrame) -> DataFrame:
    """One manifest from several; columns that some lack are null there."""
    out = manifests[0]
    for m in manifests[1:]:
        out = out.unionByName(m, allowMissingColumns=True)
    return out


def unknown_names(wanted: DataFrame, known: DataFrame, name: str) -> DataFrame:
    return wanted.select(name).distinct().join(known.select(name), name, "left_anti")
