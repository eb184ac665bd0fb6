"""Operator 12: embeddings in fixed point, whitened by the principal components of their exact covariance.

Bit-sliced scatter: entries are shifted to start at zero, bit k of a dimension of many rows is packed into
64-bit words, and the cross-product of two dimensions is the sum over pairs of their bit planes of 2^(j+k)
times the number of ones that both have. So sums and cross-products are exact integers, in blocks of any
shift. They are added up as limbs of 40 bits, centred as integers, and only then handed to the eigenvalue
solver: its matrix has the size of the dimensions, not of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed point: floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 64.0, 1_000_000
#: Most components that are returned.
COMPONENTS = 32
#: Rows of a block, and 64-bit words of ANDed bit planes that are held at once.
BLOCK, WORDS = 1 << 16, 1 << 21

_LIMB = 40
_LIMBS = 4
#: Integers below this in size keep a block's products within 64 bits.
_PLAIN = 1 << 21


def fixed_point(entries: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * entries).astype(np.int64) + OFFSET


def planes(y: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of an array of rows by dimensions: plane, dimension, words of 64 rows."""
    padded = np.zeros((y.shape[1], -(-len(y) // 64) * 64), np.uint64)
    padded[:, : len(y)] = y.T
    return np.stack([np.packbits(((padded >> np.uint64(k)) & np.uint64(1)).astype(np.uint8), axis=1).view(np.uint64) for k in range(bits)])


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of the columns of an integer array, exact: Python integers where 64 bits may not do."""
    n, d = x.shape
    shift = x.min(axis=0)
    plain = int(abs(x).max()) < _PLAIN and n <= BLOCK
    y = x.astype(np.uint64) - shift.astype(np.uint64)  # wraps round to the right difference
    bits = max(1, int(y.max()).bit_length())
    sliced = planes(y, bits)
    step = max(1, WORDS // (d * sliced.shape[2]))
    by_weight = np.zeros((2 * bits - 1, d, d), np.int64)
    for j in range(bits):
        for k in range(j + 1):
            both = np.empty((d, d), np.int64)
            for lo in range(0, d, step):
                both[lo : lo + step] = np.bitwise_count(sliced[j][lo : lo + step, None] & sliced[k][None]).sum(axis=2, dtype=np.int64)
            by_weight[j + k] += both if j == k else both + both.T
    ones = np.bitwise_count(sliced).sum(axis=2, dtype=np.int64)
    if not plain:
        by_weight, ones, shift = by_weight.astype(object), ones.astype(object), shift.astype(object)
    products = sum(by_weight[s] * (1 << s) for s in range(2 * bits - 1))
    sums = sum(ones[k] * (1 << k) for k in range(bits))
    return sums + n * shift, products + np.outer(shift, sums) + np.outer(sums, shift) + n * np.outer(shift, shift)


def _limbs(values: np.ndarray) -> np.ndarray:
    """Limbs of 40 bits, the last one signed; limbs of several values may be added before they are put together."""
    out = np.zeros((_LIMBS, len(values)), np.int64)
    for k in range(_LIMBS - 1):
        out[k] = values & ((1 << _LIMB) - 1)
        values = values >> _LIMB
    out[-1] = values
    return out


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def usable(embedding: Column) -> Column:
    """Whether a vector has entries, all of them finite and, in fixed point, within 64 bits."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= F.lit(2.0**56))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & ~F.exists(embedding, bad), F.lit(False))


def _moments(vectors: DataFrame, d: int) -> tuple[list[int], list[list[int]]]:
    """Exact sums and cross-products over all vectors; as many rows reach the driver as there are pairs of dimensions."""
    i, j = np.triu_indices(d)
    first, second = np.concatenate([np.full(d, -1), i]), np.concatenate([np.arange(d), j])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((_LIMBS, len(first)), np.int64)
        waiting: list[np.ndarray] = []
        some = 0

        def add() -> None:
            nonlocal some
            sums, products = scatter(np.concatenate(waiting))
            total[:] += _limbs(np.concatenate([sums, products[i, j]]))
            waiting.clear()
            some = 0

        seen = False
        for batch in batches:
            x = fixed_point(_matrix(batch.column(0), d))
            for lo in range(0, len(x), BLOCK):
                part = x[lo : lo + BLOCK]
                if some + len(part) > BLOCK:
                    add()
                waiting.append(part)
                some += len(part)
                seen = True
        if some:
            add()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(second, pa.int32()), *map(pa.array, total)], names=["i", "j", *(f"l{k}" for k in range(_LIMBS))])

    limbs = [f"l{k}" for k in range(_LIMBS)]
    rows = vectors.select("embedding").mapInArrow(partial, "i int, j int, " + ", ".join(f"{c} long" for c in limbs))
    sums, products = [0] * d, [[0] * d for _ in range(d)]
    for r in rows.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in limbs)).collect():
        value = sum(r[c] << (_LIMB * k) for k, c in enumerate(limbs))
        if r.i < 0:
            sums[r.j] = value
        else:
            products[r.i][r.j] = products[r.j][r.i] = value
    return sums, products


class Whitening:
    """The fit: n, sums, components by falling eigenvalue, eigenvalues and their shares."""

    def __init__(self, n: int, sums: list[int], products: list[list[int]], components: int = COMPONENTS):
        d = len(sums)
        self.n, self.d = n, d
        # n^2 times the covariance, as integers; true division of integers is rounded once
        centred = [[(n * products[a][b] - sums[a] * sums[b]) / (n * n) for b in range(d)] for a in range(d)]
        values, vectors = np.linalg.eigh(np.array(centred, float).reshape(d, d))
        order = np.argsort(-values, kind="stable")[:components]
        self.values, self.vectors = values[order], vectors[:, order]
        self.vectors = self.vectors * np.where(self.vectors[abs(self.vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
        trace = float(sum(centred[a][a] for a in range(d)))
        self.shares = [float(v) / trace if trace else None for v in self.values]
        # a component without variance: what is left of it is rounding
        self.flat = self.values <= d * np.finfo(float).eps * max(float(values[-1]), 0.0)
        self.whole, self.rest = zip(*(divmod(s, n) for s in sums))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows by components; NaN where a component has no variance."""
        centred = (x - np.array(self.whole, np.int64)).astype(float) - np.array([r / self.n for r in self.rest])
        with np.errstate(divide="ignore", invalid="ignore"):
            return (centred @ self.vectors) * np.where(self.flat, np.nan, 1 / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int]:
        """For each row the sum over dimensions of (n x - S)^2."""
        y, rest = x - np.array(self.whole, np.int64), np.array(self.rest, np.int64)
        most = int(abs(y).max(initial=0))
        if self.d * most * max(most, self.n) >= 1 << 62:
            y, rest = y.astype(object), rest.astype(object)
        squares, mixed, last = (y * y).sum(axis=1).tolist(), (y * rest).sum(axis=1).tolist(), sum(r * r for r in self.rest)
        return [self.n * (self.n * a - 2 * b) + last for a, b in zip(squares, mixed)]


def _identity_error(vectors: DataFrame, fit: Whitening) -> float | None:
    """Largest absolute entry of the covariance of whitened rows minus the identity, over components with variance."""
    use = np.flatnonzero(~fit.flat)
    i, j = (use[k] for k in np.triu_indices(len(use)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(len(use)), np.zeros((len(use), len(use)))
        for batch in batches:
            w = fit.whitened(fixed_point(_matrix(batch.column(0), fit.d)))[:, use]
            sums += w.sum(axis=0)
            products += w.T @ w
        upper = products[np.triu_indices(len(use))]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(use), -1), i]), pa.int32()), pa.array(np.concatenate([use, j]), pa.int32()), pa.array(np.concatenate([sums, upper]))], names=["i", "j", "s"])

    if not len(use):
        return None
    found = {(r.i, r.j): r.s for r in vectors.select("embedding").mapInArrow(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    mean = {k: s / fit.n for (a, k), s in found.items() if a < 0}
    return max(abs(s / fit.n - mean[a] * mean[b] - (a == b)) for (a, b), s in found.items() if a >= 0)


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Vectors that are null or empty, or hold null or non-finite entries or such as do not fit into 64 bits in fixed point, are
    left out; so are those of another length than most have (of two lengths equally frequent, the longer stays). All
    others are the fit list: repeated rows count each, null ids stay null, extra columns are left out, an
    empty list gives no rows. ``deviation`` is a decimal of 38 digits, null beyond. A component without variance has a null ``whitened``,
    and does not count in ``identity_error``; ``explained`` is null where nothing varies.
    """
    vectors = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).where(usable(F.col("embedding")))
    most = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if most is None:
        return table.sparkSession.createDataFrame([], schema)
    vectors = vectors.where(F.size("embedding") == most.d)
    fit = Whitening(most["count"], *_moments(vectors, most.d), components)
    error = _identity_error(vectors, fit)
    k = len(fit.values)
    kind = pa.decimal128(38, 0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                x = fixed_point(_matrix(batch.column(1), fit.d))
                n = len(x)
                w = fit.whitened(x).ravel()
                deviation = pa.array([Decimal(v) if v < 10**38 else None for v in fit.deviations(x)], kind)
                each = pa.array(np.repeat(np.arange(n), k))
                cells = [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), pa.array(np.full(n * k, fit.n))]
                cells += [deviation.take(each), pa.array(w, mask=np.isnan(w)), pa.array(fit.shares * n, pa.float64()), pa.array([error] * (n * k), pa.float64())]
                yield pa.RecordBatch.from_arrays(cells, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(rows, schema)
