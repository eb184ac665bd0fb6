"""Telemetry of the speech service."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scribespark.operators import report, telemetry
from scribespark.operators.asof import asof_join
from scribespark.plans.fixtures import GPU_SQL, LOG_SQL, gpu_samples, request_log, table
from scribespark.queries.accuracy import rounded
from scribespark.queries.registry import query
from scribespark.sources import files



@query("with " + LOG_SQL + " select model, total, ok, failed, round(inference,4) as inference, round(audio,4) as audio, round(case when audio>0 then inference/audio else 0 end,6) as rtf, first_failed from (select coalesce(model,'none') as model, count(*) as total, count(*) filter (where status='success') as ok, count(*) filter (where status<>'success') as failed, coalesce(sum(inference_time_seconds) filter (where status='success'),0) as inference, coalesce(sum(audio_duration) filter (where status='success'),0) as audio, array_to_string(list_sort(list(request_id) filter (where status<>'success'))[1:10],',') || case when count(*) filter (where status<>'success')>10 then ' ... and '||(count(*) filter (where status<>'success')-10)||' more' else '' end as first_failed from log group by 1)")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by model, with the ten first failed requests (no task hands on more than ten a model) and how many more."""
    log = request_log(spark, sf_dir).withColumn("model", F.coalesce("model", F.lit("none")))
    sums = rounded(rounded(telemetry.batch_summary(log, "model"), "inference", "audio", digits=4), "rtf")
    failed = log.where("status <> 'success'").withColumn("at", F.row_number().over(Window.partitionBy("model").orderBy("request_id"))).where("at <= 10")
    firsts = failed.groupBy("model").agg(F.array_join(F.sort_array(F.collect_list("request_id")), ",").alias("first_failed"))
    more = F.when(F.col("failed") > 10, F.format_string(" ... and %d more", F.col("failed") - 10)).otherwise("")
    return sums.join(firsts, "model", "left").withColumn("first_failed", F.concat("first_failed", more))


@query("with " + LOG_SQL + " select coalesce(model,'none') as model, status, count(*) as n, round(100.0*count(*)/sum(count(*)) over (),6) as pct from log group by 1,2")
def models_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = request_log(spark, sf_dir).withColumn("model", F.coalesce("model", F.lit("none")))
    return report.share_by(log, "model", "status").withColumn("pct", F.round(F.col("pct").cast("double"), 6))


def _trimmed_sql(value: str, name: str) -> str:
    inside = "pos >= cut and pos < n-cut"
    return f"""t_{name} as (select replica_id, avg(x) filter (where {inside}) as avg_{name}, median(x) filter (where {inside}) as median_{name}, min(x) filter (where {inside}) as min_{name},
  max(x) filter (where {inside}) as max_{name}, max(x) filter (where pos=floor(n*0.95)) as p95_{name} from (select *, case when n>20 then greatest(1,floor(n*0.01)) else 0 end as cut from (
  select replica_id, {value} as x, count(*) over (partition by replica_id) as n, row_number() over (partition by replica_id order by {value})-1 as pos from log where status='success')) group by replica_id)"""


_TIMES = [f"{a}_{b}" for b in ("response", "inference") for a in ("avg", "median", "min", "max", "p95")]


@query(
    "with " + LOG_SQL + "," + _trimmed_sql("response_time", "response") + "," + _trimmed_sql("inference_time_seconds", "inference") + """,
 c as (select replica_id, count(*) as total, count(*) filter (where status='success') as successes, count(*) filter (where status<>'success') as errors from log group by 1)
 select replica_id, total, successes, errors, round(errors*100/total,6) as error_pct, """ + ", ".join(f"round({x},6) as {x}" for x in _TIMES) + ", round(avg_response-avg_inference,6) as overhead from c left join t_response using (replica_id) left join t_inference using (replica_id)"
)
def latency_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(telemetry.latency(request_log(spark, sf_dir), "replica_id"), "error_pct", *_TIMES, "overhead")


@query(
    "with " + LOG_SQL + """, s as (select response_time as total_time, inference_time_seconds as inference_time, case when audio_duration>0 then inference_time_seconds/audio_duration else 0 end as rtf, audio_duration, text_length from log where status='success'),
 m as (select 'total_time' as metric, total_time as x from s union all select 'inference_time', inference_time from s union all select 'rtf', rtf from s),
 a as (select metric, count(*) as n, round(avg(x),6) as mean, round(median(x),6) as median, round(min(x),6) as lo, round(max(x),6) as hi from m group by metric),
 w as (select (epoch_us(max(finished_at))-epoch_us(min(finished_at)))/1e6 as wall_s from log),
 o as (select count(*) as files, round(sum(audio_duration),4) as total_audio, round(sum(inference_time),4) as total_inference, sum(audio_duration) as ta, cast(sum(text_length) as bigint) as total_text from s)
 select a.*, files, round(wall_s,6) as wall_s, total_audio, total_inference, total_text, round(files/wall_s,9) as files_per_s, round(ta/wall_s,9) as speed_up from a, o, w"""
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = request_log(spark, sf_dir)
    stats = rounded(telemetry.run_stats(log), "mean", "median", "lo", "hi")
    whole = rounded(rounded(rounded(telemetry.throughput(log), "files_per_s", "speed_up", digits=9), "total_audio", "total_inference", digits=4), "wall_s")
    return stats.crossJoin(F.broadcast(whole))


@query(
    "with " + LOG_SQL + """, c as (select replica_id, count(*) as n from log group by 1),
 o as (select cast(sum(n) as bigint) as total, count(*) as replicas, avg(n) as mean, median(n) as median, min(n) as lo, max(n) as hi, coalesce(stddev_samp(n),0) as std from c)
 select total, replicas, round(mean,6) as mean, median, lo, hi, round(std,6) as std, round(hi/mean,6) as balance, replicas=40 as all_used, replicas*3 as capacity,
  round(hi*100/(replicas*3),6) as utilisation_pct, cast(floor(least(replicas*3*0.7,50)) as bigint) as recommended,
  case when hi/mean>2 then 'uneven' when mean>3*0.8 then 'near capacity' else 'has capacity' end as advice from o"""
)
def replica_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(telemetry.replica_balance(request_log(spark, sf_dir), 40), "mean", "std", "balance", "utilisation_pct")


_DEVICE_SQL = "count(*) as samples, min(memory_used_mb) as min_mb, max(memory_used_mb) as max_mb, round(avg(memory_used_mb),6) as avg_mb, round(avg(memory_used_mb*100/memory_total_mb),6) as avg_pct, max(gpu_utilization_percent) as max_util, round(avg(gpu_utilization_percent),6) as avg_util"


@query("with " + GPU_SQL + f" select gpu_index, {_DEVICE_SQL} from gpu group by gpu_index")
def gpu_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in the shape of the log, an array of devices a sample, taken apart again."""
    samples = gpu_samples(spark, sf_dir)
    nested = samples.select("ts", F.array(F.struct(*(c for c in samples.columns if c != "ts"))).alias("gpus"))
    flat = nested.select("ts", F.explode("gpus").alias("g")).select("ts", "g.*")
    return rounded(telemetry.device_stats(flat, "gpu_index"), "avg_mb", "avg_pct", "avg_util")


@query("with " + GPU_SQL + " select gpu_index, 'gpu '||gpu_index as name, memory_used_mb, memory_total_mb, gpu_utilization_percent, round(memory_used_mb*100/memory_total_mb,1) as memory_used_percent from gpu")
def gpu_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as the device tool prints them, parsed."""
    s = gpu_samples(spark, sf_dir)
    line = F.concat_ws(", ", "gpu_index", F.concat(F.lit("gpu "), F.col("gpu_index").cast("string")), "memory_used_mb", "memory_total_mb", "gpu_utilization_percent")
    return files.parse_device_lines(s.select(line.alias("line")), "line")


@query(
    "with " + LOG_SQL + """, r as (select *, row_number() over (order by finished_at, request_id) as completed, count(*) over () as total, epoch_us(min(finished_at) over ()) as b from log),
 p as (select completed, (epoch_us(finished_at)-b)/1e6 as elapsed_s, total-completed as remaining, finished_at from r where completed%100=0),
 """ + GPU_SQL + """, g as (select ts, max(gpu_index) as x from (select ts, gpu_index, row_number() over (partition by ts order by gpu_index desc) as k from gpu) where k=1 group by ts)
 select completed, round(elapsed_s,6) as elapsed_s, round(completed/elapsed_s,9) as throughput, remaining, round(remaining/(completed/elapsed_s),4) as eta_s,
  case when completed%500=0 then (select max(x) from g where g.ts=p.finished_at) end as snapshot_gpu from p"""
)
def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports every 100 completions; every 500, also which device was sampled last."""
    rows = telemetry.progress(request_log(spark, sf_dir)).select("completed", "finished_at", "elapsed_s", "throughput", "remaining", "eta_s")
    seen = asof_join(rows.where("completed % 500 = 0").select("completed", "finished_at"), gpu_samples(spark, sf_dir), "finished_at", "ts", ["gpu_index"])
    seen = seen.select("completed", F.col("sample.gpu_index").alias("snapshot_gpu"))
    out = rows.join(seen, "completed", "left").drop("finished_at")
    return rounded(rounded(rounded(out, "elapsed_s"), "throughput", digits=9), "eta_s", digits=4)


@query(
    "with " + LOG_SQL + "," + GPU_SQL + """, s as (select ts + interval 1234567 microsecond as ts, gpu_index, max(memory_used_mb) as memory_used_mb from gpu group by ts, gpu_index)
 select request_id, log.user_gpu as gpu_index, s.memory_used_mb, cast(epoch_us(finished_at) - epoch_us(s.ts) as bigint) as age_us
 from (select log.*, cast(request_id%4 as int) as user_gpu from log) log asof left join s on log.user_gpu = s.gpu_index and log.finished_at >= s.ts"""
)
def device_at_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every request the last sample of its device before it finished; samples are taken at times of their own."""
    samples = gpu_samples(spark, sf_dir).withColumn("ts", F.col("ts") + F.expr("interval 1234567 microseconds"))
    log = request_log(spark, sf_dir).select("request_id", (F.col("request_id") % 4).cast("int").alias("gpu_index"), "finished_at")
    found = asof_join(log, samples, "finished_at", "ts", ["ts", "memory_used_mb"], by=("gpu_index",))
    age = F.unix_micros("finished_at") - F.unix_micros("sample.ts")
    return found.select("request_id", "gpu_index", "sample.memory_used_mb", age.alias("age_us"))


@query("with " + LOG_SQL + " select request_id as file, status, round(response_time,6) as total_time_seconds, round(inference_time_seconds,6) as inference_time_seconds, audio_duration, model, text_length from log")
def run_json_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log written as JSON documents, a run of at most 1,000 requests each, read again and taken apart."""
    log = request_log(spark, sf_dir).withColumnsRenamed({"request_id": "file", "response_time": "total_time_seconds"})
    columns = ["file", "status", "total_time_seconds", "inference_time_seconds", "audio_duration", "model", "text_length"]
    path = f"{files.shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    files.write_runs(log, F.floor(F.col("file") / 1000), columns, path)
    return rounded(files.read_runs(spark, path, log.select(*columns).schema), "total_time_seconds", "inference_time_seconds")


@query("select status, model, n, attempts from (select case when doc_id%23=0 then 'error' else 'ok' end as status, m.model, count(*) as n, cast(sum(case when doc_id%23=0 then 4 when doc_id%7=0 then 2 else 1 end) as bigint) as attempts from documents, (values ('tiny'),('base'),('small'),('medium'),('large'),('turbo')) m(model) group by all)")
def enrich_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model's column filled by an external call, here one that fails for some documents."""
    from scribespark.operators.enrich import enrich, for_each_model
    from scribespark.plans.fixtures import models

    rows = for_each_model(table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("size")), models(spark))
    done = enrich(rows, ["doc_id", "model"], stub_call, "length int", max_retries=3, concurrency=4)
    status = F.when(F.col("error").isNull(), "ok").otherwise("error")
    return done.groupBy(status.alias("status"), "model").agg(F.count("*").alias("n"), F.sum("attempts").cast("long").alias("attempts"))


@query("select m.model, count(*) as n, count(*) filter (where doc_id%3=0) as before, count(*) filter (where doc_id%3<>0 and doc_id%23<>0) as filled, count(*) filter (where doc_id%3<>0 and doc_id%23=0) as failed, cast(0 as bigint) as pending from documents, (values ('tiny'),('base'),('small'),('medium'),('large'),('turbo')) m(model) group by all")
def enrich_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that are still pending are asked for and added until none is; a second run finds nothing to do."""
    from scribespark.operators.enrich import fill, for_each_model, pending
    from scribespark.plans.fixtures import models

    rows = for_each_model(table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("size")), models(spark))
    path = f"{files.shared_dir(spark)}/filled-{uuid.uuid4().hex}"
    held = rows.where("doc_id % 3 = 0").select("doc_id", "model", F.col("size").alias("length"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts"))
    held.write.parquet(path)
    for _ in range(2):
        done = fill(rows, ["doc_id", "model"], path, stub_call, "length int", commit=10_000, max_retries=1, concurrency=4)
    kinds = [F.count_if(F.col("attempts") == 0).alias("before"), F.count_if((F.col("attempts") > 0) & F.col("error").isNull()).alias("filled"), F.count_if(F.col("error").isNotNull()).alias("failed")]
    left = pending(rows, done, ["doc_id", "model"]).groupBy("model").agg(F.count("*").alias("pending"))
    sums = done.groupBy("model").agg(F.count("*").alias("n"), *kinds)
    return sums.join(left, "model", "left").withColumn("pending", F.coalesce("pending", F.lit(0)))


@query("select case when doc_id%23=0 then 'TimeoutError: no answer' end as error, count(*) as n, cast(sum(case when doc_id%23=0 then 3 when doc_id%7=0 then 2 else 1 end) as bigint) as attempts, cast(sum(case when doc_id%23<>0 then length(text) end) as bigint) as characters from documents group by 1")
def stream_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents asked as a stream; those that fail wait in its state and come back, at last as dead letters. A second run finds nothing new."""
    from scribespark.operators.enrich import enrich_available

    folder = f"{files.shared_dir(spark)}/retry-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("size"))
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    for _ in range(2):
        done = enrich_available(stream, ["doc_id"], stub_call, "length int", f"{folder}/out", f"{folder}/checkpoint", delays=(0.2, 0.4))
    return done.groupBy("error").agg(F.count("*").alias("n"), F.sum("attempts").cast("long").alias("attempts"), F.sum("length").cast("long").alias("characters"))


@query("select source, count(*) as n, count(*) filter (where doc_id%23<>0) as answered, cast(sum(case when doc_id%23=0 then 2 when doc_id%7=0 then 2 else 1 end) as bigint) as attempts from documents group by source")
def enrich_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents asked at one rate for the whole job, which its tasks share out by what each has left."""
    from scribespark.operators.enrich import enrich_at_rate

    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("size"))
    done = enrich_at_rate(rows, ["doc_id", "source"], stub_call, "length int", rate=1e6, max_retries=1, period=0.2)
    return done.groupBy("source").agg(F.count("*").alias("n"), F.count("length").alias("answered"), F.sum("attempts").cast("long").alias("attempts"))


def stub_call(row: dict, attempt: int) -> dict:
    """Stands in for a service: every 23rd document fails always, every 7th at first."""
    if row["doc_id"] % 23 == 0 or (row["doc_id"] % 7 == 0 and attempt == 1):
        raise TimeoutError("no answer")
    return {"length": row["size"]}
