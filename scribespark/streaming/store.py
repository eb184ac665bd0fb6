"""What a stream has put out so far, as files of micro-batches that are folded together now and then.

A micro-batch writes a folder named by its number; one that is run again writes it anew. Every ``EVERY``-th also writes what all
batches up to it come to, so a reader has at most that many folders to read. Folders count once Spark has
committed them, and those that a fold covers are removed at the next fold.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

#: Micro-batches between two folds.
EVERY = 16


def _folders(spark: SparkSession, folder: str) -> dict[str, dict[int, str]]:
    """Committed folders by kind (``batch``, ``fold``) and number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[str, dict[int, str]] = {"batch": {}, "fold": {}}
    if fs.exists(path):
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            kind, _, number = name.partition("-")
            if kind in out and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")):
                out[kind][int(number)] = f"{folder}/{name}"
    return out


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Store:
    """Rows of micro-batches below ``folder``; ``merge`` makes one table of the rows of several, in any order and grouping."""

    def __init__(self, folder: str, merge: Callable[[DataFrame], DataFrame], every: int = EVERY):
        self.folder, self.merge, self.every = folder, merge, every

    def put(self, rows: DataFrame, number: int) -> None:
        """Adds a micro-batch; one that an earlier run has folded already changes nothing."""
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch-{number}")
        if number % self.every != self.every - 1:
            return
        self.read(spark, rows.schema, upto=number).write.mode("overwrite").parquet(f"{self.folder}/fold-{number}")
        found = _folders(spark, self.folder)
        covered = max((k for k in found["fold"] if k < number), default=-1)
        for kind, last in (("batch", covered), ("fold", covered - 1)):
            for k, path in found[kind].items():
                if k <= last:
                    _remove(spark, path)

    def read(self, spark: SparkSession, schema, upto: int | None = None) -> DataFrame:
        """What has been put out so far, merged; before anything has, an empty table."""
        found = _folders(spark, self.folder)
        # the fold of a batch that is run again is not read while it is made anew
        fold = max((k for k in found["fold"] if upto is None or k < upto), default=-1)
        paths = [found["fold"][fold]] if fold >= 0 else []
        paths += [p for k, p in found["batch"].items() if k > fold and (upto is None or k <= upto)]
        tables = [spark.read.schema(schema).parquet(p) for p in paths] or [spark.createDataFrame([], schema)]
        return self.merge(reduce(DataFrame.unionByName, tables))
