"""Incremental forms: resumable ingest, upserts by batch, windows, monitors, duplicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribespark.operators import ingest, telemetry
from scribespark.streaming.store import EVERY, Store


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def ingest_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Appends what has arrived since the last run; a run without news adds nothing."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()


def run_batches(stream: DataFrame, mode: str, checkpoint: str, put: Callable[[DataFrame, int], None]) -> None:
    """Hands all that is available to ``put``, with its number, micro-batch by micro-batch."""
    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_available(stream: DataFrame, base: DataFrame, folder: str, checkpoint: str, key: str, columns: list[str], order: str, every: int = EVERY) -> DataFrame:
    """The table with all that has arrived, in this run and earlier ones, written over it.

    A micro-batch adds the last value of each key and column (see ``ingest.last_values``) to the changes in ``folder``, which
    are laid over ``base`` when the table is read. The result is that of one ``ingest.upsert`` of all updates, whatever their order and
    the borders of micro-batches. A batch costs what it brings, not what the table holds; changes are folded every ``every`` batches.
    """
    last = ingest.last_values(stream, key, columns, order).schema
    last = T.StructType([stream.schema[key], *(T.StructField(c, last[c].dataType) for c in columns)])
    store = Store(folder, lambda rows: rows.groupBy(key).agg(*(F.max(c).alias(c) for c in columns)), every)
    run_batches(stream, "append", checkpoint, lambda batch, number: store.put(ingest.last_values(batch, key, columns, order), number))
    return ingest.overlaid(base, store.read(base.sparkSession, last), key, columns)


def device_windows(samples: DataFrame, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Device statistics in tumbling windows; samples later than the watermark are dropped."""
    return telemetry.device_stats(samples.withWatermark("ts", late), F.window("ts", length), "gpu_index")


def response_monitor(log: DataFrame, by: str) -> DataFrame:
    """Requests, errors and mean times of all that has been seen so far."""
    ok = F.col("status") == "success"
    return log.groupBy(by).agg(F.count("*").alias("total"), F.count_if(~ok).alias("errors"), F.avg(F.when(ok, F.col("response_time"))).alias("avg_response"), F.avg(F.when(ok, F.col("inference_time_seconds"))).alias("avg_inference"))


def first_seen(rows: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Rows whose key hasn't been seen within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def append_to(stream: DataFrame, out: str, checkpoint: str, *columns: Column | str) -> None:
    """Writes what the stream emits in append mode until all available input is used."""
    (stream.select(*columns) if columns else stream).writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()


def last_state(stream: DataFrame, folder: str, checkpoint: str, key: str, every: int = EVERY) -> DataFrame:
    """The latest row of each key of a stream in update mode; states are folded every ``every`` batches."""
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])
    latest = F.max_by(F.struct(*stream.columns, "_batch"), "_batch")
    store = Store(folder, lambda rows: rows.groupBy(F.col(key).alias("_key")).agg(latest.alias("x")).select("x.*"), every)
    run_batches(stream, "update", checkpoint, lambda batch, number: store.put(batch.withColumn("_batch", F.lit(number).cast("long")), number))
    return store.read(stream.sparkSession, schema).drop("_batch")
