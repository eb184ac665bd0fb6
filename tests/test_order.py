"""As-of joins, exact quantiles by counting and places of rows, with skewed keys, ties and nulls."""

import math
import random
import statistics
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from scribespark.operators import order, quantiles, report
from scribespark.operators.asof import asof_join

T0 = datetime(2024, 1, 1)


def brute_asof(rows, samples):
    out = {}
    for key, g, t in rows:
        own = [s for s in samples if s[0] == g and s[1] is not None and t is not None and s[1] <= t]
        out[key] = max(own, key=lambda s: (s[1], s[2]))[2] if own else None
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_asof(spark, partitions, monkeypatch):
    """One busy hour and a busy instant, ties, null times and groups, groups without samples."""
    rng = random.Random(partitions)
    time = lambda: None if rng.random() < 0.03 else T0 + timedelta(seconds=rng.choice([5, 7, rng.randint(0, 3000)]))
    rows = [(k, rng.choice(["a", "a", "a", "b", None, "c"]), time()) for k in range(600)]
    samples = [(rng.choice(["a", "a", "b", None]), time(), rng.randint(0, 9)) for _ in range(250)]
    r = spark.createDataFrame(rows, "k long, g string, t timestamp").repartition(partitions)
    s = spark.createDataFrame(samples, "g string, ts timestamp, v int").repartition(partitions)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = asof_join(r, s, "t", "ts", ["v"], by=("g",))
        assert got.columns == ["k", "g", "t", "sample"]
        assert {x.k: x.sample and x.sample.v for x in got.collect()} == brute_asof(rows, samples)
        alone = {x.k: x.sample and x.sample.v for x in asof_join(r, s, "t", "ts", ["v"]).collect()}
        assert alone == brute_asof([(k, 0, t) for k, _, t in rows], [(0, t, v) for _, t, v in samples])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_asof_of_empty_tables(spark):
    r, s = spark.createDataFrame([(1, T0)], "k long, t timestamp"), spark.createDataFrame([], "ts timestamp, v int")
    assert asof_join(r, s, "t", "ts", ["v"]).first().sample is None
    assert asof_join(r.limit(0), s, "t", "ts", ["v"]).count() == 0


def test_asof_deals_one_instant_to_many_tasks(spark):
    """All rows and samples in one second of one hour: no task has more than a few times the median."""
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(20_000).select("id", F.lit(T0).alias("t"))
        samples = spark.range(5).select(F.lit(T0).alias("ts"), F.col("id").alias("v"))
        got = asof_join(rows, samples, "t", "ts", ["v"])
        assert got.groupBy("sample.v").count().collect() == [(4, 20_000)]
        both = rows.select("id", "t").withColumns({"_tie": F.xxhash64("id"), "_id": F.monotonically_increasing_id()})
        sizes = both.repartitionByRange("t", "_tie", "_id").groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert len(sizes) == 8 and sizes.max() < 3 * sizes.median()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


SHARES = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}


def test_quantiles(spark):
    """Negative, tiny, huge and repeated values, infinities, null values and keys, one value, two groups of very different size."""
    rng = random.Random(2)
    odd = [0.0, -0.0, 5e-324, -5e-324, 1e300, -1e300, math.inf, -math.inf, 1.0, 1.0]
    rows = [("odd", x) for x in odd] + [("one", 3.5), (None, 1.0), (None, 2.0), ("none", None)]
    rows += [("big", rng.choice([0.0, 0.0, rng.gauss(0, 1), rng.gauss(0, 1e-9), float(rng.randint(-3, 3))])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in quantiles.quantiles(quantiles.kept(df, ["g"], "v"), ["g"], SHARES).collect()}
    assert set(got) == {"odd", "one", "big", None}
    for g, r in got.items():
        own = sorted(x for k, x in rows if k == g and x is not None)
        assert r.n == len(own)
        for name, q in SHARES.items():
            lo, hi = own[math.floor(q * (len(own) - 1))], own[math.ceil(q * (len(own) - 1))]
            want = lo if lo == hi else lo + (hi - lo) * (q * (len(own) - 1) % 1)
            assert r[name] == want or r[name] == pytest.approx(want, rel=1e-12, abs=1e-300)


def test_quantiles_by_two_keys_and_of_nothing(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("b"), F.col("id").cast("double").alias("v"))
    got = {(r.a, r.b): (r.n, r.q50) for r in quantiles.quantiles(quantiles.kept(df, ["a", "b"], "v"), ["a", "b"]).collect()}
    for (a, b), (n, q) in got.items():
        own = [i for i in range(100) if i % 2 == a and (i % 3 or None) == b]
        assert n == len(own) and q == statistics.median(own)
    assert len(got) == 6 and quantiles.quantiles(quantiles.kept(df.limit(0), ["a"], "v"), ["a"]).count() == 0


def test_quantiles_hand_on_counts_only(spark):
    """Of a million distinct values, no exchange gets more than the counts of a round."""
    df = spark.range(1_000_000).select(F.lit(1).alias("g"), (F.hash("id") / 1e5).alias("v"))
    values = quantiles.kept(df, ["g"], "v")
    row = quantiles.quantiles(values, ["g"], {"m": 0.5}).first()
    x = np.sort(values.select("x").toPandas()["x"].to_numpy())
    assert row.n == 1_000_000 and row.m == pytest.approx((x[499_999] + x[500_000]) / 2)
    assert values.select(F.shiftright("bits", 48)).distinct().count() < 65_536


def test_time_stats(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), (None, 5.0)], "g string, x double")
    got = {r.g: (r.n, r["mean"], r.median, r.lo, r.hi, r.total) for r in report.time_stats(df, "g", "x").collect()}
    assert got == {"a": (2, 1.5, 1.5, 1.0, 2.0, 3.0), "b": (0, None, None, None, None, None), None: (1, 5.0, 5.0, 5.0, 5.0, 5.0)}


def test_trimmed_statistics_of_ties(spark):
    """A value that most rows have counts as often as it stands among the untrimmed ones."""
    rng = random.Random(7)
    rows = [("a", 0.0)] * 700 + [("a", float(rng.randint(-2, 5))) for _ in range(301)] + [("b", 1.0)] * 3
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    got = {r.g: r for r in order.order_stats(df, ["g"], "x", 0.05, 20).collect()}
    for g in ("a", "b"):
        own = sorted(x for k, x in rows if k == g)
        cut = max(1, int(0.05 * len(own))) if len(own) > 20 else 0
        mid = own[cut : len(own) - cut]
        r = got[g]
        assert (r.n, r.median, r.lo, r.hi, r.p95) == (len(own), statistics.median(own), mid[0], mid[-1], own[int(0.95 * len(own))])
        assert r["mean"] == pytest.approx(statistics.fmean(mid))


def test_places_of_equal_rows(spark):
    """Repeated rows are dealt to many tasks and get every place once."""
    df = spark.range(3000).select(F.lit("same").alias("k"), F.lit(1).alias("g"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = order._dealt(df.repartition(3), ["k"])
        sizes = Counter(r[0] for r in dealt.select("_range").collect())
        assert len(sizes) > 1 and max(sizes.values()) < 3000 * 0.7
        assert sorted(r.at for r in order.numbered(df, ["k"], "at", ("g",)).collect()) == list(range(3000))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_tallied_values(spark):
    """Figures of equal values counted once are those of all rows, and what is written is a row a value."""
    rng = random.Random(15)
    rows = [(g, rng.choice([None, 0.0, -0.0, 5.0, 12.5, 100.0, 1e6 + 1 / 3])) for g in ("a", "b", None) for _ in range(500)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "model string, wer double").repartition(5)
    values = quantiles.tallied(df, ["model"], "wer")
    assert values.count() == 3 * 5 + 1
    got, cut = {r.model: r for r in report.describe(df).collect()}, {r.model: r for r in report.boxplot(df).collect()}
    bins = report.histogram(df).groupBy("model").agg(F.sum("in_bin")).collect()
    assert set(got) == {"a", "b", None, "one"}
    for g, r in got.items():
        own = sorted(x for k, x in rows if k == g and x is not None)
        assert (r.n, r.lo, r.hi, r.q50) == (len(own), own[0], own[-1], statistics.median(own))
        assert r["mean"] == pytest.approx(statistics.fmean(own)) and (r["std"] == pytest.approx(statistics.stdev(own)) if len(own) > 1 else r["std"] is None)
        q1, _, q3 = cut[g].q1, cut[g].q2, cut[g].q3
        assert cut[g].outliers == sum(not q1 - 1.5 * (q3 - q1) <= x <= q3 + 1.5 * (q3 - q1) for x in own)
        assert dict(bins)[g] == len(own)
