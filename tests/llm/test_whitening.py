"""Whitening against exact integers in plain Python and an eigenvalue solver of its own."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from scribespark.llm import queries, whitening

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label string, n string, component string"


def frame(spark, vectors):
    return spark.createDataFrame([(k, v, "x", "y", "z") for k, v in vectors], SCHEMA)


def exact(vectors):
    """n, sums and n^2 times the covariance of x-vectors, by plain loops over integers."""
    xs = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(xs), len(xs[0])
    sums = [sum(x[a] for x in xs) for a in range(d)]
    cov = [[sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for x in xs) for b in range(d)] for a in range(d)]
    return xs, n, sums, [[Fraction(c, n**3) for c in row] for row in cov]


def check(rows, ids, vectors, components):
    xs, n, sums, cov = exact(vectors)
    v = np.array([[float(c) for c in row] for row in cov])
    trace = float(sum(cov[a][a] for a in range(len(cov))))
    by_id = {}
    for r in rows:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(by_id) == sorted(ids) and len(rows) == len(ids) * components
    values = np.sort(np.linalg.eigvalsh(v))[::-1]
    w = np.array([[by_id[i][c].whitened for c in range(1, components + 1)] for i in ids])
    assert abs(w.T @ w / n - w.mean(0)[:, None] * w.mean(0) - np.eye(components)).max() == pytest.approx(rows[0].identity_error, abs=1e-9) and rows[0].identity_error < 1e-4
    centred = np.array([[float(Fraction(x[a]) - Fraction(sums[a], n)) for a in range(len(sums))] for x in xs])
    for c in range(components):
        # the direction that gives these values is a unit eigenvector: V u = e u
        u = centred.T @ w[:, c] / n / math.sqrt(values[c])
        assert np.linalg.norm(u) == pytest.approx(1, abs=1e-6) and abs(v @ u - values[c] * u).max() < 1e-6 * values[0]
        assert {by_id[i][c + 1].explained for i in ids} == {by_id[ids[0]][c + 1].explained}
        assert by_id[ids[0]][c + 1].explained == pytest.approx(values[c] / trace, rel=1e-4)
    for i, x in zip(ids, xs):
        assert {r.deviation for r in by_id[i].values()} == {sum((n * a - s) ** 2 for a, s in zip(x, sums))} and by_id[i][1].n == n


def test_query(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [r for r in rows if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    got = queries.QUERIES["op12_whitening"](spark, DATA).collect()
    check(got, [r.vec_id for r in rows], [r.embedding for r in rows], 32)


def test_bad_vectors_go_and_few_dimensions_stay(spark):
    rng = random.Random(3)
    good = [(k, [rng.gauss(0, 3), rng.gauss(5, 0.5), rng.uniform(-900, 900)]) for k in range(200)]
    bad = [(900, None), (901, []), (902, [1.0, None, 2.0]), (903, [1.0, float("nan"), 2.0]), (904, [float("inf"), 1.0, 1.0]), (905, [1.0, 2.0]), (906, [1e300, 1.0, 1.0])]
    got = whitening.whiten(frame(spark, good + bad)).collect()
    check(got, [k for k, _ in good], [v for _, v in good], 3)


def test_repeated_rows_null_ids_and_nothing_varies(spark):
    got = whitening.whiten(frame(spark, [(1, [0.5, 0.5]), (1, [0.5, 0.5]), (None, [0.5, 0.5])])).collect()
    assert len(got) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(3, 0, None, None, None)}
    got = whitening.whiten(frame(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0])])).orderBy("component", "vec_id").collect()
    assert [abs(r.whitened) for r in got[:2]] == [1.0, 1.0] and [r.whitened for r in got[2:]] == [None, None] and got[0].explained == 1.0
    assert whitening.whiten(frame(spark, [(1, [0.25])])).collect()[0].whitened is None
    assert whitening.whiten(frame(spark, [])).count() == whitening.whiten(frame(spark, [(1, None)])).count() == 0


@pytest.mark.parametrize("size", [1, 1 << 20, 1 << 40, 1 << 58])
def test_scatter_is_exact(size):
    """Small, large and negative integers, and numbers of rows about a word's 64."""
    rng = random.Random(size)
    for n in (1, 63, 64, 65, 300):
        x = np.array([[rng.randint(-size, size) for _ in range(5)] for _ in range(n)], np.int64)
        sums, products = whitening.scatter(x)
        rows = x.tolist()
        assert [int(s) for s in sums] == [sum(r[a] for r in rows) for a in range(5)]
        assert [[int(p) for p in row] for row in products] == [[sum(r[a] * r[b] for r in rows) for b in range(5)] for a in range(5)]


def test_large_entries(spark):
    vectors = [(k, [float(k) * 2**40, float(-k)]) for k in range(1, 9)]
    rows = whitening.whiten(frame(spark, vectors)).collect()
    _, n, sums, _ = exact([v for _, v in vectors])
    for r in rows:
        v = dict(vectors)[r.vec_id]
        assert r.deviation == sum((n * (math.floor(64 * c) + 1_000_000) - s) ** 2 for c, s in zip(v, sums))
