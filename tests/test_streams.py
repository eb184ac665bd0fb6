"""Streams: results don't depend on the borders of micro-batches, folds lose nothing."""

import bisect
import itertools
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from scribespark.operators import ingest
from scribespark.streaming import latency, store, streams

SCHEMA = "id int, x string, y int, seq int"
UPDATES = [(1, "new", None, 1), (1, None, 4, 2), (2, "b", 1, 5), (2, "a", None, 5), (2, None, 0, 3), (9, "gone", 1, 1)]


def batches(spark, tmp_path, name, parts, every=store.EVERY):
    """The table after micro-batches that bring the given updates, one run of the stream each."""
    base = spark.createDataFrame([(1, "old", 0), (2, None, None), (3, "old", 7)], "id int, x string, y int")
    stream = None
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
        stream = streams.file_stream(spark, f"{tmp_path}/{name}/in", spark.createDataFrame([], SCHEMA).schema)
        out = streams.upsert_available(stream, base, f"{tmp_path}/{name}/changes", f"{tmp_path}/{name}/check", "id", ["x", "y"], "seq", every)
    return sorted(map(tuple, out.collect()))


def test_upserts_do_not_depend_on_batches(spark, tmp_path):
    base = spark.createDataFrame([(1, "old", 0), (2, None, None), (3, "old", 7)], "id int, x string, y int")
    want = sorted(map(tuple, ingest.upsert(base, spark.createDataFrame(UPDATES, SCHEMA), "id", ["x", "y"], "seq").collect()))
    assert want == [(1, "new", 4), (2, "b", 1), (3, "old", 7)]
    orders = [UPDATES, UPDATES[::-1]]
    for k, (order, cut) in enumerate(itertools.product(orders, ([], [1], [1, 2, 4]))):
        parts = [order[a:b] for a, b in zip([0, *cut], [*cut, len(order)])]
        assert batches(spark, tmp_path, f"s{k}", parts, every=2) == want


def test_folds(spark, tmp_path):
    """Batches that are run again, folds half written and folders that folds cover."""
    rows = lambda *x: spark.createDataFrame([(k, v) for k, v in x], "k int, v int")
    folder = f"{tmp_path}/store"
    kept = store.Store(folder, lambda df: df.groupBy("k").agg(F.max("v").alias("v")), every=3)
    assert kept.read(spark, rows((1, 1)).schema).count() == 0
    for n in range(10):
        kept.put(rows((n % 4, n), (7, -n)), n)
        if n in (2, 4, 8):
            kept.put(rows((n % 4, n), (7, -n)), n)  # as after a crash
        want = {k: max(i for i in range(n + 1) if i % 4 == k) for k in range(4) if k <= n} | {7: 0}
        assert dict(map(tuple, kept.read(spark, rows((1, 1)).schema).collect())) == want
    assert {x for x in os.listdir(folder) if not x.startswith(".")} == {"fold-5", "fold-8", "batch-6", "batch-7", "batch-8", "batch-9"}
    os.remove(f"{folder}/fold-8/_SUCCESS")
    assert dict(map(tuple, kept.read(spark, rows((1, 1)).schema).collect())) == want


def test_state_of_many_batches(spark, tmp_path):
    log = [(f"r{i % 3}", "success" if i % 4 else "error", float(i), float(i) / 2) for i in range(24)]
    schema = "replica_id string, status string, response_time double, inference_time_seconds double"
    for k in range(6):
        spark.createDataFrame(log[4 * k : 4 * k + 4], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = streams.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, files_per_batch=1)
    got = streams.last_state(streams.response_monitor(stream, "replica_id"), f"{tmp_path}/s", f"{tmp_path}/c", "replica_id", every=2)
    want = streams.response_monitor(spark.createDataFrame(log, schema), "replica_id")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_running_latencies(spark, tmp_path):
    """The last state against the batch answer: exact for few values, within the sketch's rank error for many, whatever the batches."""
    rng = random.Random(3)
    log = [("busy", "success", rng.lognormvariate(0, 1)) for _ in range(40_000)] + [("calm", rng.choice(["success", "error"]), float(rng.randint(0, 9))) for _ in range(300)]
    log += [("few", "success", float(k)) for k in range(20)] + [("one", "success", 2.5), ("none", "error", 1.0), ("blank", "success", None)]
    log += [("some", "success", rng.lognormvariate(0, 1)) for _ in range(3000)] + [("some", "success", float("inf"))]
    rng.shuffle(log)
    schema = "replica_id string, status string, t double"
    for k in range(5):
        spark.createDataFrame(log[k::5], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = streams.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, files_per_batch=1)
    got = {r.replica_id: r for r in latency.running(stream, f"{tmp_path}/s", f"{tmp_path}/c", "replica_id", ["t"], every=3).collect()}
    assert set(got) == {"busy", "calm", "few", "one", "none", "blank", "some"}
    for name, r in got.items():
        own = sorted(x for k, status, x in log if k == name and status == "success" and x not in (None, float("inf")))
        n = len(own)
        assert (r.total, r.errors) == (sum(k == name for k, _, _ in log), sum(k == name and s == "error" for k, s, _ in log))
        if not n:
            assert r.avg_t is None and r.p95_t is None
            continue
        cut = max(1, n // 100) if n > 20 else 0
        mid = own[cut : n - cut]
        want = {"median_t": (own[(n - 1) // 2] + own[n // 2]) / 2, "min_t": mid[0], "max_t": mid[-1], "p95_t": own[int(0.95 * n)]}
        for c, x in want.items():
            if n <= latency.K:
                assert r[c] == pytest.approx(x)
            else:
                assert abs(bisect.bisect_left(own, r[c]) - bisect.bisect_left(own, x)) <= latency.RANK_ERROR * n + 1
        assert r.avg_t == pytest.approx(statistics.fmean(mid), rel=0.005 if n > latency.K else 1e-9)


def test_latencies_of_many_values_are_exact(spark, tmp_path):
    """More different values of a key than a sketch would hold, some of them often, over several micro-batches."""
    rng = random.Random(8)
    log = [("busy", "success", rng.choice([rng.random(), float(rng.randint(0, 3))])) for _ in range(30_000)]
    schema = "replica_id string, status string, t double"
    for k in range(3):
        spark.createDataFrame(log[k::3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = streams.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, files_per_batch=1)
    r = latency.running(stream, f"{tmp_path}/s", f"{tmp_path}/c", "replica_id", ["t"], every=2).first()
    own = sorted(x for _, _, x in log)
    n = len(own)
    mid = own[n // 100 : n - n // 100]
    assert (r.total, r.median_t, r.min_t, r.max_t, r.p95_t) == (n, (own[(n - 1) // 2] + own[n // 2]) / 2, mid[0], mid[-1], own[int(0.95 * n)])
    assert r.avg_t == pytest.approx(statistics.fmean(mid), rel=1e-12)
