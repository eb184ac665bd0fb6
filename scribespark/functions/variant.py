"""Dynamic JSON columns: null, text, object, list of objects, empty ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(_kind(v).startswith("OBJECT<"), F.lit(False))


def is_list(v: Column) -> Column:
    return F.coalesce(_kind(v).startswith("ARRAY<"), F.lit(False))


def is_null(v: Column) -> Column:
    """SQL null or a JSON null."""
    return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))


def is_empty(v: Column) -> Column:
    """{} or []."""
    return F.coalesce(F.to_json(v).isin("{}", "[]"), F.lit(False))


def is_missing(v: Column) -> Column:
    """Null, {} and [] all await a result."""
    return is_null(v) | is_empty(v)


def items(v: Column) -> Column:
    """The elements of a list, null for anything else."""
    return F.when(is_list(v), F.try_variant_get(v, "$", "array<variant>"))


def text_of(v: Column) -> Column:
    """The text of a result: itself, its ``text``, its items' texts joined by blanks; else its JSON; '' for null."""
    inner = F.transform(items(v), lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string"))))
    joined = F.array_join(F.filter(inner, lambda t: t.isNotNull()), " ")
    own = F.try_variant_get(v, "$.text", "string")
    return F.when(is_null(v), "").when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")).when(own.isNotNull(), own).when(is_list(v), joined).otherwise(F.to_json(v))


def times_of(v: Column, field: str = "inference_time_seconds") -> Column:
    """The numbers under ``field``: of an object, or of the objects of a list; none otherwise."""
    alone = F.try_variant_get(v, f"$.{field}", "double")
    many = F.transform(items(v), lambda x: F.try_variant_get(x, f"$.{field}", "double"))
    return F.filter(F.when(alone.isNotNull(), F.array(alone)).otherwise(F.coalesce(many, F.array().cast("array<double>"))), lambda x: x.isNotNull())


def as_result(v: Column) -> Column:
    """struct(value, error): an object stays, a list gives its first object, all else an error."""
    first = F.get(items(v), F.lit(0))
    return (
        F.when(is_object(v), F.struct(v.alias("value"), F.lit(None).cast("string").alias("error")))
        .when(is_object(first), F.struct(first.alias("value"), F.lit(None).cast("string").alias("error")))
        .otherwise(F.struct(F.lit(None).cast("variant").alias("value"), F.when(is_list(v), "list without an object").otherwise("not an object").alias("error")))
    )


def media_path(v: Column) -> Column:
    """A media value as a path: its ``path``, or itself if it is text."""
    return F.coalesce(F.try_variant_get(v, "$.path", "string"), F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")))
