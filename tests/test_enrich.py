"""Enrichment that survives being killed, one rate for all tasks, retries on a stream."""

import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scribespark.operators import enrich


def test_shares_of_a_round():
    assert enrich.dealt(10, [3, 0, 4]) == [3, 0, 4]
    assert enrich.dealt(10, [30, 0, 10]) == [8, 0, 2] and sum(enrich.dealt(7, [5, 5, 5])) == 7
    for budget in range(1, 20):
        for waiting in ([1, 1, 1], [100, 1, 0, 3], [0, 0], [9] * 5):
            shares = enrich.dealt(budget, waiting)
            assert sum(shares) == min(budget, sum(waiting)) and all(s <= w for s, w in zip(shares, waiting))


def logged(folder):
    """A call that notes when it was made, and fails as often as the row says."""

    def call(row, attempt):
        with open(f"{folder}/{os.getpid()}-{time.monotonic_ns()}-{row['id']}", "w") as f:
            f.write(f"{time.time()} {attempt}")
        if attempt <= row["fails"]:
            raise ValueError("busy")
        return {"y": row["id"] * 10}

    return call


def calls(folder):
    """When each call was made, and for which row."""
    return [(t, k) for t, k, _ in attempts(folder)]


def attempts(folder):
    return sorted((float(t), int(x.rpartition("-")[2]), int(n)) for x in os.listdir(folder) for t, n in [open(f"{folder}/{x}").read().split()])


def test_one_rate_for_all_tasks(spark, tmp_path):
    """Skewed tasks, one without rows: in no second more calls than the rate, and the busy task takes what others leave."""
    rows = spark.range(60).select("id", F.when(F.col("id") % 10 == 3, 1).otherwise(0).alias("fails"))
    spread = rows.repartition(1)  # enrich_at_rate deals rows out anew
    got = {r.id: (r.y, r.error, r.attempts) for r in enrich.enrich_at_rate(spread, ["id"], logged(str(tmp_path)), "y int", rate=40.0, max_retries=1, tasks=3, period=0.5).collect()}
    assert got == {k: (k * 10, None, 2 if k % 10 == 3 else 1) for k in range(60)}
    at = [t for t, _ in calls(tmp_path)]
    assert len(at) == 66
    for t in at:
        assert sum(t <= x < t + 0.5 for x in at) <= 2 * 20  # two rounds touch any such stretch
    assert at[-1] - at[0] >= 1.0 and at[-1] - at[0] < 30


def test_rate_with_errors_and_without_rows(spark, tmp_path):
    rows = spark.range(3).select("id", F.lit(9).alias("fails"))
    got = enrich.enrich_at_rate(rows, ["id"], logged(str(tmp_path)), "y int", rate=100.0, max_retries=2, backoff=0.1, tasks=2, period=0.1).collect()
    assert {(r.id, r.error, r.attempts) for r in got} == {(k, "ValueError: busy", 3) for k in range(3)}
    assert enrich.enrich_at_rate(rows.limit(0), ["id"], logged(str(tmp_path)), "y int", rate=5.0, tasks=2).count() == 0


def test_killed_fill_keeps_what_was_committed(spark, tmp_path):
    """A run that dies halfway; the rerun asks only for what was not committed."""
    (tmp_path / "calls").mkdir()
    rows = spark.range(64).select("id", F.lit(0).alias("fails"))
    spark.createDataFrame([], "id long, y int, error string, attempts int").write.parquet(f"{tmp_path}/done")
    steps = []

    def dying(some, *args, **options):
        steps.append(some.count())
        if len(steps) == 3:
            raise RuntimeError("killed")
        return enrich.enrich(some, *args, **options)

    with pytest.raises(Exception):
        enrich.fill(rows, ["id"], f"{tmp_path}/done", logged(str(tmp_path / "calls")), "y int", commit=8, enricher=dying)
    kept = {r.id for r in spark.read.parquet(f"{tmp_path}/done").collect()}
    assert len(kept) == sum(steps[:2]) and 0 < len(kept) < 40
    assert Counter(k for _, k in calls(tmp_path / "calls")) == Counter(kept)
    done = enrich.fill(rows, ["id"], f"{tmp_path}/done", logged(str(tmp_path / "calls")), "y int", commit=8)
    assert Counter(r.id for r in done.collect()) == Counter(range(64)) == Counter(k for _, k in calls(tmp_path / "calls"))


def test_retries_on_a_stream(spark, tmp_path):
    """Failed rows come back after 1, 2, 4 steps, then as dead letters; a restart in between loses and repeats none."""
    (tmp_path / "calls").mkdir()
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 99), (5, 0), (5, 0)], "id long, fails int")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    run = lambda seconds: enrich.enrich_available(stream, ["id"], logged(str(tmp_path / "calls")), "y int", f"{tmp_path}/out", f"{tmp_path}/check", (2.0, 4.0, 8.0), seconds)
    # stopped once the first attempts are through
    began = time.monotonic()
    while len(calls(tmp_path / "calls")) < 5 and time.monotonic() - began < 60:
        run(6.0)
    first = run(0.1).count()
    assert 0 < first < 5
    done = run(120.0)
    assert sorted((r.id, r.y, r.error, r.attempts) for r in done.collect()) == [(1, 10, None, 1), (2, 20, None, 2), (3, 30, None, 3), (4, None, "ValueError: busy", 4), (5, 50, None, 1)]
    # a micro-batch that was cut off asks again, and nothing but its last answer counts
    made = {n: t for t, k, n in attempts(tmp_path / "calls") if k == 4}
    assert sorted(made) == [1, 2, 3, 4] and all(made[n + 1] - made[n] >= 0.9 * d for n, d in zip((1, 2, 3), (2, 4, 8)))
    assert [r.id for r in enrich.dead_letters(done).collect()] == [4]
    assert run(60.0).count() == 5


def test_timers_go_on_after_a_clean_stop(spark, tmp_path):
    """All micro-batches committed, rows waiting, nothing new: the next run still asks again, and ends. Nulls and long integers stay so."""
    (tmp_path / "calls").mkdir()
    big = 2**60 + 1
    rows = spark.createDataFrame([(1, 1, big), (2, 9, None), (3, 0, big), (None, 0, None)], "id long, fails int, x long")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    noted = logged(str(tmp_path / "calls"))

    def call(row, attempt):
        noted({**row, "id": row["id"] or 0}, attempt)
        return {"y": row["x"]}

    run = lambda seconds, **options: enrich.enrich_available(stream, ["id"], call, "y long", f"{tmp_path}/out", f"{tmp_path}/check", (30.0,), seconds, **options)
    # one micro-batch, then nothing for an hour
    first = run(25.0, every="1 hour")
    assert [{x for x in os.listdir(f"{tmp_path}/check/{d}") if x.isdigit()} for d in ("offsets", "commits")] == [{"0"}] * 2
    assert first.where("id = 2").count() == 0
    began = time.monotonic()
    done = run(120.0)
    assert time.monotonic() - began < 115
    assert sorted((r.id or 0, r.y, r.error, r.attempts) for r in done.collect()) == [(0, None, None, 1), (1, big, None, 2), (2, None, "ValueError: busy", 2), (3, big, None, 1)]


def test_committed_without_a_micro_batch_a_step(spark, tmp_path):
    """One job for all steps; when a task dies, the files of those that ended stay, and the rerun asks for the rest only."""
    (tmp_path / "calls").mkdir()
    rows = spark.range(64).select("id", F.lit(0).alias("fails"))
    spark.createDataFrame([], "id long, y int, error string, attempts int").write.parquet(f"{tmp_path}/done")
    noted = logged(str(tmp_path / "calls"))

    def dying(row, attempt):
        if len(os.listdir(tmp_path / "calls")) >= 40:
            raise SystemExit("killed")
        return noted(row, attempt)

    tracker, group = spark.sparkContext.statusTracker(), "fill"
    spark.sparkContext.setJobGroup(group, group)
    with pytest.raises(Exception):
        enrich.fill(rows, ["id"], f"{tmp_path}/done", dying, "y int", commit=8)
    kept = {r.id for r in spark.read.parquet(f"{tmp_path}/done").collect()}
    assert 0 < len(kept) < 64
    asked = Counter(k for _, k in calls(tmp_path / "calls"))
    done = enrich.fill(rows, ["id"], f"{tmp_path}/done", noted, "y int", commit=8)
    assert Counter(r.id for r in done.collect()) == Counter(range(64))
    assert all(n == asked[k] for k, n in Counter(k for _, k in calls(tmp_path / "calls")).items() if k in kept)
    # eight steps are no eight jobs
    assert len(tracker.getJobIdsForGroup(group)) < 24
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_state_a_group_of_keys(spark, tmp_path):
    """Rows that wait share states and timers: as many as there are groups, not rows; none is lost and none is asked twice in a step."""
    (tmp_path / "calls").mkdir()
    rows = spark.range(60).select(F.greatest("id", F.lit(3)).alias("id"), F.when((F.col("id") % 2 == 0) & (F.col("id") > 3), 1).otherwise(0).alias("fails"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    asked = enrich.enrich_stream(stream, ["id"], logged(str(tmp_path / "calls")), "y int", (3.0,), buckets=2)
    query = asked.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="0.5 seconds").start(f"{tmp_path}/out")
    end = time.monotonic() + 60
    while time.monotonic() < end and query.isActive and not ((last := query.lastProgress) and not last.numInputRows and not last.stateOperators[0].numRowsTotal):
        time.sleep(0.1)
    held = [x.stateOperators[0].numRowsTotal for x in query.recentProgress]
    query.stop()
    assert held and max(held) == 2
    assert Counter(k for _, k in calls(tmp_path / "calls")) == Counter({k: 2 - k % 2 for k in range(3, 60)})
    done = {r.id: (r.y, r.error) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert done == {k: (10 * k, None) for k in range(3, 60)}
