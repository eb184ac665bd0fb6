"""Published copies and replicas that catch up with changed, new and removed rows.

A copy is stored in folders by ranges of a hash of its key, with a digest of each range beside it: how many rows it holds and two sums
of their hashes. Two copies are compared from the top: first sums over groups of ranges, then the ranges of groups
that differ. Only ranges that differ are read, and written anew in the replica.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Groups of ranges, and ranges of a group: so many digests at most are compared at once.
GROUPS, RANGES = 64, 64
_DIGESTS = "_range int, rows long, sum_a decimal(38,0), sum_b decimal(38,0)"


def _range_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(GROUPS * RANGES)).cast("int")


def ranged(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("_range", _range_of(key))


def digests(df: DataFrame, key: str) -> DataFrame:
    """_range, rows and two sums of hashes of the rows of each range; the order of rows doesn't matter, repeated rows count."""
    # a null is told from a missing neighbour by its place; maps and variants have no hash
    whole = [F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in df.columns]
    a, b = F.xxhash64(*whole), F.xxhash64(F.lit(1), *whole)
    rows = df.select(_range_of(key).alias("_range"), a.cast("decimal(20,0)").alias("a"), b.cast("decimal(20,0)").alias("b"))
    sums = [F.sum(c).cast("decimal(38,0)").alias(f"sum_{c}") for c in ("a", "b")]
    return rows.groupBy("_range").agg(F.count("*").alias("rows"), *sums)


def _sums(df: DataFrame, by: Column) -> DataFrame:
    return df.groupBy(by.alias("at")).agg(F.sum("rows").alias("rows"), F.sum("sum_a").alias("a"), F.sum("sum_b").alias("b"))


def _unlike(one: DataFrame, other: DataFrame) -> DataFrame:
    """at: where two tables of sums differ, or only one has any."""
    pairs = one.join(other.withColumnsRenamed({c: f"o_{c}" for c in ("rows", "a", "b")}), "at", "full")
    same = F.col("rows").eqNullSafe(F.col("o_rows")) & F.col("a").eqNullSafe(F.col("o_a")) & F.col("b").eqNullSafe(F.col("o_b"))
    return pairs.where(~same).select("at")


def differing(one: DataFrame, other: DataFrame) -> list[int]:
    """The ranges in which two tables of digests differ: at most GROUPS * RANGES numbers."""
    group = F.floor(F.col("_range") / RANGES).cast("int")
    groups = [r["at"] for r in _unlike(_sums(one, group), _sums(other, group)).collect()]
    inside = group.isin(groups)
    return sorted(r["at"] for r in _unlike(_sums(one.where(inside), F.col("_range")), _sums(other.where(inside), F.col("_range"))).collect()) if groups else []


def _digest_path(path: str) -> str:
    return f"{path.rstrip('/')}.digests"


def stored_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_DIGESTS).parquet(_digest_path(path))


def publish(df: DataFrame, path: str, key: str, name: str) -> DataFrame:
    """A copy of a table by ranges of ``key``, with its digests and a record of what it is beside it; returns the copy."""
    spark = df.sparkSession
    ranged(df, key).repartitionByRange("_range", F.xxhash64(key)).write.mode("overwrite").partitionBy("_range").parquet(path)
    copy = read(spark, path, df.schema)
    digests(copy, key).coalesce(1).write.mode("overwrite").parquet(_digest_path(path))
    record = copy.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), F.lit(path).alias("path"), F.lit(df.schema.json()).alias("schema"), F.lit(key).alias("key"), "rows", F.current_timestamp().alias("published_at"))
    record.write.mode("overwrite").json(f"{path.rstrip('/')}.record")
    return copy


def published(spark: SparkSession, path: str) -> DataFrame:
    """The record of a published copy."""
    return spark.read.schema("name string, path string, schema string, key string, rows long, published_at timestamp").json(f"{path.rstrip('/')}.record")


def read(spark: SparkSession, path: str, schema: T.StructType, ranges: list[int] | None = None) -> DataFrame:
    """A copy, or of it only the folders of some ranges."""
    df = spark.read.schema(T.StructType([*schema.fields, T.StructField("_range", T.IntegerType())])).parquet(path)
    return (df if ranges is None else df.where(F.col("_range").isin(ranges))).drop("_range")


def pull(source: DataFrame | str, path: str, key: str, schema: T.StructType | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Brings the replica at ``path`` to the source's state, and returns it: new, changed and removed rows alike.

    ``source``: a table, whose digests take one pass over it, or the path of a published copy, of which only digests and ranges
    that differ are read. A replica that is like its source isn't touched. Ranges are put in place one folder at a time and the
    digests last: a pull that breaks off is made good by the next, which finds the same ranges to differ. Ids of rows should be unique.
    """
    if isinstance(source, str):
        theirs = stored_digests(spark, source)
    else:
        spark, schema = source.sparkSession, source.schema
        theirs = digests(source, key)
    # kept by value: at most GROUPS * RANGES rows, and the files they come from are written below
    theirs = spark.createDataFrame(theirs.select("_range", "rows", "sum_a", "sum_b").collect(), _DIGESTS)
    ranges = differing(theirs, stored_digests(spark, path))
    if ranges:
        news = read(spark, source, schema, ranges) if isinstance(source, str) else ranged(source, key).where(F.col("_range").isin(ranges)).drop("_range")
        ranged(news, key).repartitionByRange("_range", F.xxhash64(key)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_range").parquet(path)
        _remove_empty(spark, path, set(ranges) - {r["_range"] for r in theirs.select("_range").collect()})
        theirs.coalesce(1).write.mode("overwrite").parquet(_digest_path(path))
    return read(spark, path, schema)


def _remove_empty(spark: SparkSession, path: str, ranges: set[int]) -> None:
    """Folders of ranges of which the source has no row any more."""
    for r in ranges:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_range={r}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def changes(source: DataFrame, replica: DataFrame, key: str) -> DataFrame:
    """key and kind (new, changed, removed) of each key by which a replica differs from its source; keys are unique."""
    mark = lambda df, name: df.select(F.col(key), F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in df.columns)).alias(name))
    both = mark(source, "_s").join(mark(replica.select(*source.columns), "_r"), key, "full")
    kind = F.when(F.col("_r").isNull(), "new").when(F.col("_s").isNull(), "removed").when(F.col("_s") != F.col("_r"), "changed")
    return both.select(key, kind.alias("kind")).where("kind is not null")
