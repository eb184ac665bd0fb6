"""Statistics of a speech service: latencies, balance of replicas, devices, progress of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribespark.operators.order import numbered, order_stats


def latency(log: DataFrame, by: str, share: float = 0.01, least: int = 20) -> DataFrame:
    """Requests, errors, trimmed times of response and inference, and what lies between them; of successes.

    Trimming and P95: see ``order_stats``. Both times are ranked in one pass.
    """
    counts = log.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("successes"), F.count_if(F.col("status") != "success").alias("errors"))
    counts = counts.withColumn("error_pct", F.col("errors") * 100 / F.col("total"))
    times = {"response": "response_time", "inference": "inference_time_seconds"}
    good = log.where("status = 'success'").select(by, *(F.col(c).alias(k) for k, c in times.items())).unpivot([by], list(times), "_kind", "_time")
    stats = order_stats(good, [by, "_kind"], "_time", share, least)
    names = {"avg": "mean", "median": "median", "min": "lo", "max": "hi", "p95": "p95"}
    wide = [F.max(F.when(F.col("_kind") == k, F.col(c))).alias(f"{name}_{k}") for k in times for name, c in names.items()]
    return counts.join(stats.groupBy(by).agg(*wide), by, "left").withColumn("overhead", F.col("avg_response") - F.col("avg_inference"))


def batch_summary(log: DataFrame, *by: str) -> DataFrame:
    """Totals and the real-time factor of a batch: inference over audio of the successes, 0 without audio."""
    good = F.col("status") == "success"
    sums = log.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(good).alias("ok"), F.count_if(~good).alias("failed"), F.coalesce(F.sum(F.when(good, F.col("inference_time_seconds"))), F.lit(0.0)).alias("inference"), F.coalesce(F.sum(F.when(good, F.col("audio_duration"))), F.lit(0.0)).alias("audio"))
    return sums.withColumn("rtf", F.when(F.col("audio") > 0, F.col("inference") / F.col("audio")).otherwise(0.0))


def run_stats(log: DataFrame) -> DataFrame:
    """metric, n, mean, median, lo, hi of total time, inference time and real-time factor of the successes."""
    rtf = F.when(F.col("audio_duration") > 0, F.col("inference_time_seconds") / F.col("audio_duration")).otherwise(0.0)
    rows = log.where("status = 'success'").select(F.col("response_time").alias("total_time"), F.col("inference_time_seconds").alias("inference_time"), rtf.alias("rtf"))
    each = rows.unpivot([], ["total_time", "inference_time", "rtf"], "metric", "x")
    return order_stats(each, ["metric"], "x").drop("p95")


def throughput(log: DataFrame) -> DataFrame:
    """One row: files, seconds between first and last, files a second, sums (sound, inference, characters of text), audio over seconds."""
    wall = F.unix_micros(F.max("finished_at")) - F.unix_micros(F.min("finished_at"))
    good = F.col("status") == "success"
    one = log.agg(F.count_if(good).alias("files"), (wall / 1e6).alias("wall_s"), F.sum(F.when(good, F.col("audio_duration"))).alias("total_audio"), F.sum(F.when(good, F.col("inference_time_seconds"))).alias("total_inference"), F.sum(F.when(good, F.col("text_length"))).alias("total_text"))
    return one.withColumns({"files_per_s": F.try_divide("files", "wall_s"), "speed_up": F.try_divide("total_audio", "wall_s")})


def replica_balance(log: DataFrame, configured: int, per_replica: int = 3) -> DataFrame:
    """One row: requests by replica (mean, median, min, max, sample deviation), balance, capacity, advice."""
    counts = log.groupBy("replica_id").agg(F.count("*").alias("n"))
    one = counts.agg(F.sum("n").alias("total"), F.count("*").alias("replicas"), F.avg("n").alias("mean"), F.median("n").alias("median"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("std"))
    capacity = F.col("replicas") * per_replica
    balance = F.col("hi") / F.col("mean")
    return one.withColumns(
        {
            "balance": balance,
            "all_used": F.col("replicas") == configured,
            "capacity": capacity,
            "utilisation_pct": F.col("hi") * 100 / capacity,
            "recommended": F.floor(F.least(capacity * 0.7, F.lit(50.0))),
            "advice": F.when(balance > 2, "uneven").when(F.col("mean") > per_replica * 0.8, "near capacity").otherwise("has capacity"),
        }
    )


def device_stats(samples: DataFrame, *by: Column | str) -> DataFrame:
    """Memory and utilisation of each device."""
    pct = F.when(F.col("memory_total_mb") > 0, F.col("memory_used_mb") * 100 / F.col("memory_total_mb")).otherwise(0.0)
    return samples.withColumn("pct", pct).groupBy(*by).agg(F.count("*").alias("samples"), F.min("memory_used_mb").alias("min_mb"), F.max("memory_used_mb").alias("max_mb"), F.avg("memory_used_mb").alias("avg_mb"), F.avg("pct").alias("avg_pct"), F.max("gpu_utilization_percent").alias("max_util"), F.avg("gpu_utilization_percent").alias("avg_util"))


def completions(log: DataFrame) -> DataFrame:
    """log with ``completed``: how many requests had finished, in order of time and id."""
    return numbered(log, ["finished_at", "request_id"], "completed").withColumn("completed", F.col("completed") + 1)


def progress(log: DataFrame, every: int = 100) -> DataFrame:
    """A row for every so many completions: elapsed seconds, throughput, how many are left and for how long."""
    done = completions(log)
    whole = log.agg(F.count("*").alias("total"), F.min("finished_at").alias("began"))
    rows = done.where(F.col("completed") % every == 0).crossJoin(F.broadcast(whole))
    elapsed = (F.unix_micros("finished_at") - F.unix_micros("began")) / 1e6
    rows = rows.withColumn("elapsed_s", elapsed).withColumn("throughput", F.when(F.col("elapsed_s") > 0, F.col("completed") / F.col("elapsed_s")).otherwise(0.0))
    return rows.withColumns({"remaining": F.col("total") - F.col("completed"), "eta_s": F.when(F.col("throughput") > 0, (F.col("total") - F.col("completed")) / F.col("throughput")).otherwise(0.0)})
