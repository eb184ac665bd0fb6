"""Readers and writers: CSV, splits, sidecars, run documents, device lines, snapshots."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; in local mode one of our own where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own[app]


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV with a header; quotes inside quotes are doubled, fields may span lines. No inference."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"')


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Committed as a whole by Spark; ``append`` adds files, each with its header."""
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"', quoteAll=True)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A table stored by split; one split reads its folder only."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def list_audio(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    """path, length, modificationTime of matching files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).drop("content")


def read_sidecars(spark: SparkSession, path: str, globs: tuple[str, ...] = ("*.txt",)) -> DataFrame:
    """path and stripped text of each transcript file below a folder whose name matches one of the globs."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"{{{','.join(dict.fromkeys(globs))}}}").text(path, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("text"))


def write_runs(log: DataFrame, run: Column, columns: list[str], path: str) -> None:
    """A JSON document for each run: its configuration, summary and results."""
    results = log.groupBy(run.alias("run")).agg(F.count("*").alias("n"), F.collect_list(F.struct(*columns)).alias("results"))
    results.select(F.struct("run").alias("test_configuration"), F.struct("n").alias("summary"), "results").write.json(path)


def read_runs(spark: SparkSession, path: str, row: T.StructType) -> DataFrame:
    """The results of all run documents, a row each."""
    schema = T.StructType([T.StructField("results", T.ArrayType(row))])
    return spark.read.schema(schema).json(path).select(F.explode("results").alias("r")).select("r.*")


DEVICE = "gpu_index int, name string, memory_used_mb long, memory_total_mb long, gpu_utilization_percent int"


def parse_device_lines(lines: DataFrame, column: str) -> DataFrame:
    """Lines of a device listing (index, name, used, total, utilisation), with the share of memory used."""
    parsed = lines.select(F.from_csv(column, F.lit(DEVICE), {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("x")).select("x.*")
    share = F.when(F.col("memory_total_mb") > 0, F.round(F.col("memory_used_mb") * 100 / F.col("memory_total_mb"), 1)).otherwise(0.0)
    return parsed.withColumn("memory_used_percent", share)


def get_table(spark: SparkSession, name: str | None = None, default: str = "asr.transcripts") -> DataFrame:
    return spark.table(name or default)


def create_table(spark: SparkSession, name: str, schema: str, location: str | None = None) -> None:
    """Creates the namespace, in the folder ``location`` if that is given, and the table, where they aren't there yet."""
    spark.sql(f"create schema if not exists {name.rpartition('.')[0]}" + (f" location '{location}'" if location else ""))
    spark.sql(f"create table if not exists {name} ({schema}) using parquet")


def drop_namespace(spark: SparkSession, name: str) -> None:
    spark.sql(f"drop schema if exists {name} cascade")


def insert(df: DataFrame, name: str) -> None:
    df.write.mode("append").insertInto(name)


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """df as it is now, from files."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def persisted(df: DataFrame) -> DataFrame:
    """df kept by the executors, on their disks where memory is short, for the queries that follow."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def append(df: DataFrame, path: str) -> DataFrame:
    """Adds df's rows to the files of a table, and returns the table."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sample_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """A demo row for each row: an id and a sample transcription."""
    number = F.col(key).cast("long")
    said = F.concat(F.format_string("This is sample transcription %d: ", number), F.coalesce(text, F.lit("")))
    return rows.select(F.format_string("sample_%03d", number).alias("id"), said.alias("transcription"))
