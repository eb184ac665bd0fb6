"""Streaming queries, run over all input there is, and equal to their batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribespark.plans.fixtures import GPU_SQL, LOG_SQL, gpu_samples, request_log, table
from scribespark.queries.accuracy import rounded
from scribespark.queries.loading import label_updates
from scribespark.queries.registry import query
from scribespark.queries.service import _trimmed_sql as trimmed_sql
from scribespark.sources import files
from scribespark.streaming import latency, streams


def _folder(spark: SparkSession, name: str) -> str:
    return f"{files.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _staged(df: DataFrame, name: str, parts: int = 4) -> tuple[DataFrame, str]:
    """df as a stream of files, and a folder for the stream's own files."""
    spark, folder = df.sparkSession, _folder(df.sparkSession, name)
    df.repartition(parts).write.parquet(f"{folder}/in")
    return streams.file_stream(spark, f"{folder}/in", df.schema, files_per_batch=2), folder


@query("select doc_id, lang, n_chars from documents")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingested twice; the second run finds nothing new."""
    stream, folder = _staged(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "ingest")
    for _ in range(2):
        streams.ingest_available(stream, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("select d.doc_id, coalesce(l.quality, case when d.doc_id%3=0 then 9 end) as quality from documents d left join labels l using (doc_id)")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels upserted micro-batch by micro-batch, right and wrong ones in any order; a second run changes nothing."""
    base = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, 9).alias("quality"))
    stream, folder = _staged(label_updates(spark, sf_dir), "upsert")
    for _ in range(2):
        out = streams.upsert_available(stream, base, f"{folder}/changes", f"{folder}/checkpoint", "doc_id", ["quality"], "seq")
    return out


_WINDOWS = """select cast(date_trunc('hour', ts) as varchar) as began, gpu_index, count(*) as samples, min(memory_used_mb) as min_mb, max(memory_used_mb) as max_mb, round(avg(memory_used_mb),6) as avg_mb from gpu group by date_trunc('hour', ts), gpu_index"""


@query("with " + GPU_SQL + f", w as ({_WINDOWS}) select * from w where began < (select cast(date_trunc('hour', max(ts) - interval 1 hour) as varchar) from gpu)")
def stream_device_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed; in one batch, as the samples' files come in no order."""
    samples = gpu_samples(spark, sf_dir)
    folder = _folder(spark, "windows")
    samples.repartition(2).write.parquet(f"{folder}/in")
    stats = streams.device_windows(streams.file_stream(spark, f"{folder}/in", samples.schema))
    began = F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("began")
    streams.append_to(stats, f"{folder}/out", f"{folder}/checkpoint", began, "gpu_index", "samples", "min_mb", "max_mb", "avg_mb")
    return rounded(spark.read.parquet(f"{folder}/out"), "avg_mb")


@query("with " + LOG_SQL + " select replica_id, count(*) as total, count(*) filter (where status<>'success') as errors, round(avg(response_time) filter (where status='success'),6) as avg_response, round(avg(inference_time_seconds) filter (where status='success'),6) as avg_inference from log group by replica_id")
def stream_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, folder = _staged(request_log(spark, sf_dir), "monitor")
    state = streams.last_state(streams.response_monitor(stream, "replica_id"), f"{folder}/states", f"{folder}/checkpoint", "replica_id")
    return rounded(state, "avg_response", "avg_inference")


_RUNNING = [f"{k}_{t}" for t in ("response_time", "inference_time_seconds") for k in ("avg", "median", "min", "max", "p95")]


@query(
    "with " + LOG_SQL + "," + trimmed_sql("response_time", "response_time") + "," + trimmed_sql("inference_time_seconds", "inference_time_seconds")
    + """, c as (select replica_id, count(*) as total, count(*) filter (where status<>'success') as errors from log group by 1)
 select replica_id, total, errors, """ + ", ".join(f"round({x},6) as {x}" for x in _RUNNING) + " from c left join t_response_time using (replica_id) left join t_inference_time_seconds using (replica_id)"
)
def stream_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed times and P95 while requests come in; the state says how often each value came, so all figures are exact."""
    stream, folder = _staged(request_log(spark, sf_dir), "latency")
    state = latency.running(stream, f"{folder}/states", f"{folder}/checkpoint", "replica_id", ["response_time", "inference_time_seconds"])
    return rounded(state, *_RUNNING)


@query("with " + LOG_SQL + " select request_id, replica_id, status from log")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth request comes twice; each is kept once."""
    log = request_log(spark, sf_dir).select("request_id", "replica_id", "status", "finished_at")
    folder = _folder(spark, "dedupe")
    log.unionByName(log.where("request_id % 5 = 0")).repartition(2).write.parquet(f"{folder}/in")
    once = streams.first_seen(streams.file_stream(spark, f"{folder}/in", log.schema), "finished_at", ["request_id"])
    streams.append_to(once, f"{folder}/out", f"{folder}/checkpoint", "request_id", "replica_id", "status")
    return spark.read.parquet(f"{folder}/out")
