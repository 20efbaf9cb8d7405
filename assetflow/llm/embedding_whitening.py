"""Whitening of embeddings along their leading components, found by contour integration and counted by inertia."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import wider, written

#: Points of the quadrature on half of a contour, and rounds of subspace iteration at most.
NODES, ROUNDS = 8, 40


def inertia(matrix: np.ndarray, shift: float) -> int:
    """The number of eigenvalues of a symmetric matrix above shift: positive pivots of a symmetric elimination with 1 x 1 and 2 x 2 pivots, by Sylvester's law."""
    a = matrix - shift * np.eye(len(matrix))
    above = 0
    while len(a):
        n = len(a)
        on = np.abs(np.diag(a))
        off = np.abs(a - np.diag(np.diag(a)))
        i, (r, c) = int(on.argmax()), np.unravel_index(off.argmax(), off.shape)
        if n == 1 or on[i] >= 0.6404 * off[r, c]:  # (1 + sqrt(17)) / 8 bounds the growth of what is left
            pivot, column = a[i, i], np.delete(a[:, i], i)
            above += bool(pivot > 0)
            a = np.delete(np.delete(a, i, 0), i, 1)
            if pivot:
                a = a - np.outer(column, column / pivot)
        else:
            pair = [r, c]
            block, columns = a[np.ix_(pair, pair)], np.delete(a[:, pair], pair, 0)
            above += 1  # such a block has one eigenvalue of either sign
            a = np.delete(np.delete(a, pair, 0), pair, 1)
            a = a - columns @ np.linalg.solve(block, columns.T)
        a = (a + a.T) / 2
    return above


def brackets(matrix: np.ndarray) -> np.ndarray:
    """Each eigenvalue of a symmetric matrix, falling, to about 12 digits of the greatest: bisection by inertia counts of the tridiagonal form, all at once."""
    a, n = matrix.copy(), len(matrix)
    for i in range(n - 2):
        v = a[i + 1 :, i].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        if length := np.linalg.norm(v):
            v /= length
            a[i + 1 :] -= 2 * np.outer(v, v @ a[i + 1 :])
            a[:, i + 1 :] -= 2 * np.outer(a[:, i + 1 :] @ v, v)
    on, off = np.diag(a), np.append(0.0, np.diag(a, 1)) ** 2
    bound = np.abs(matrix).sum(axis=1).max()
    low, high, wanted = np.full(n, -bound * 1.01), np.full(n, bound * 1.01), np.arange(1, n + 1)
    for _ in range(44):
        shift, pivot, above = (low + high) / 2, np.ones(n), np.zeros(n, np.int64)
        for d, e in zip(on, off, strict=True):
            pivot = d - shift - e / np.where(np.abs(pivot) < 1e-290, 1e-290, pivot)
            above += pivot > 0
        low, high = np.where(above >= wanted, shift, low), np.where(above >= wanted, high, shift)
    return (low + high) / 2


def feast(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The count eigenvalues of a symmetric matrix between low and high, falling, and their vectors as columns.

    Each round solves the shifted systems at the points of a Gauss quadrature on the circle over the
    interval, which projects the trial vectors onto the wanted space; Rayleigh's quotient on a basis of
    it (Rayleigh-Ritz) extracts the pairs.  Raises where the pairs found in the interval are not count.
    """
    n = len(matrix)
    size = min(n, max(count + 2, -(-3 * count // 2)))
    random = np.random.default_rng(1)
    trial = random.standard_normal((n, size))
    points, weights = np.polynomial.legendre.leggauss(NODES)
    centre, radius, scale = (low + high) / 2, (high - low) / 2, max(np.abs(matrix).max(), np.finfo(float).tiny)
    least = np.inf
    values, vectors = np.zeros(0), np.zeros((n, 0))
    for _ in range(ROUNDS):
        projected = np.zeros((n, size))
        for x, w in zip(points, weights, strict=True):
            turn = np.exp(-np.pi / 2 * 1j * (x - 1))
            solved = np.linalg.solve((centre + radius * turn) * np.eye(n) - matrix, trial.astype(complex))
            projected += w / 2 * (radius * turn * solved).real
        basis, spread, _ = np.linalg.svd(projected, full_matrices=False)
        basis = basis[:, spread > spread[0] * 1e-14]
        small = basis.T @ matrix @ basis
        found, rotation = np.linalg.eigh((small + small.T) / 2)
        trial = basis @ rotation
        inside = (found > low) & (found <= high)
        off = np.linalg.norm(matrix @ trial[:, inside] - trial[:, inside] * found[inside], axis=0).max(initial=0)
        if inside.sum() == count and off < least:
            values, vectors, least = found[inside][::-1], trial[:, inside][:, ::-1], off
        elif inside.sum() == count:  # as exact as doubles allow
            break
        trial = np.concatenate([trial, random.standard_normal((n, size - trial.shape[1]))], axis=1)
    if len(values) != count or least > 1e-11 * n * scale:
        raise ArithmeticError(f"{count} eigenvalues lie between {low} and {high}; {len(values)} were found, to within {least}")
    return values, vectors


def components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues of a covariance, falling, and unit vectors as columns; fewer where the rest are zero.

    Inertia counts bracket the eigenvalues.  From the top, those that lie close together against the gap below
    them share an interval, whose ends lie halfway to their neighbours, so that feast()'s contour parts them
    well; inertia counts of the matrix itself at both ends say how many an interval must give.
    """
    n = len(matrix)
    trace = float(np.trace(matrix)) if n else 0.0
    if trace <= 0:
        return np.zeros(0), np.zeros((n, 0))
    near = brackets(matrix)
    least = max(n * 1e-13, 1e-12) * near[0]
    total, taken = int((near > least).sum()), 0
    values, vectors = np.zeros(0), np.zeros((n, 0))
    while taken < min(k, total):
        to = taken + 1
        gap = lambda i: near[i - 1] - (near[i] if i < n else near[i - 1] / 2)
        while to < total and gap(to) < max(0.1 * (near[taken] - near[to - 1]), 1e-4 * near[taken], 1e-9 * near[0]):
            to += 1
        below = min(gap(to), near[to - 1]) / 2
        low, high = near[to - 1] - below, near[taken] + min(below, (near[taken - 1] - near[taken]) / 2 if taken else np.inf)
        e, v = feast(matrix, low, high, inertia(matrix, low) - inertia(matrix, high))
        values, vectors, taken = np.append(values, e), np.concatenate([vectors, v], axis=1), to
    if inertia(matrix, low) != len(values):
        raise ArithmeticError(f"{inertia(matrix, low)} eigenvalues lie above {low}, {len(values)} were found")
    values, vectors = values[:k], vectors[:, :k] / np.linalg.norm(vectors[:, :k], axis=0)
    return values, vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))] < 0, -1.0, 1.0)


def scaled(vector: str, steps: int = 256) -> Column:
    """floor(steps * c) of each entry c as double, as array<bigint>; beyond 64 bits the nearest such number."""
    return F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * steps).cast("bigint"))


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector isn't null or empty, holds finite entries alone, and has the commonest length (of equally common ones the greatest)."""
    fine = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)
    lengths = rows.groupBy(F.size(vector).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.where(F.size(vector) == (lengths[0] if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array of lists of equal length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _sums(fit: DataFrame, rows_of, names: list[str]) -> pd.DataFrame:
    """Sums of what rows_of(x) gives of each batch of x, an array for each name: one row a task, added up by place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = rows_of(_matrix(batch.column("x")))
                total = made if total is None else [a + b for a, b in zip(total, made, strict=True)]
        if total is not None:
            arrays = [pa.array(np.arange(len(total[0]), dtype=np.int32)), *(pa.array(a) for a in total)]
            yield pa.RecordBatch.from_arrays(arrays, names=["place", *names])

    schema = "place int, " + ", ".join(f"{n} double" for n in names)
    return fit.mapInArrow(run, schema).groupBy("place").agg(*(F.sum(n).alias(n) for n in names)).orderBy("place").toPandas()


class Whitening:
    """What a fit gives: n distinct vectors, their sums, eigenvalues, unit vectors as columns, the trace, and the largest error of the identity."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float, error: float = 0.0):
        self.n, self.sums, self.values, self.vectors, self.trace, self.error = n, sums, values, vectors, trace, error

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values of integer vectors, a column for each component."""
        return (x - np.array([s / self.n for s in self.sums])) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums over the entries of (n x - sums) squared, exactly."""
        most = self.n * int(max(abs(int(x.min())), abs(int(x.max())))) + max(map(abs, self.sums)) if x.size else 0
        if most < 1 << 31 and most * most * max(1, x.shape[1]) < 1 << 62:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        return ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1).tolist()


def fit(rows: DataFrame, k: int, vector: str = "embedding", steps: int = 256) -> Whitening:
    """The leading k components of the distinct scaled vectors of rows, which usable() has passed.

    The distinct vectors are written to the shared folder.  Their number and sums come first, then products
    of the entries less the whole number nearest to the mean, which is centring up to a fraction that
    is taken off exactly.  Only those numbers, one for each pair of dimensions, come to the driver, where the
    contour's systems of that size are solved.  Components of no variance are left out.
    """
    x = written(rows.select(scaled(vector, steps).alias("x")).distinct(), "vectors")
    first = x.first()
    if first is None:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    d = len(first["x"])
    totals = x.select(F.posexplode("x")).groupBy("pos").agg(F.count("*").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).orderBy("pos").collect()
    n, sums = totals[0]["n"], [int(r["s"]) for r in totals]
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.float64)

    def products(batch: np.ndarray) -> list[np.ndarray]:
        y = batch - middle
        return [(y.T @ y).ravel()]

    squares = _sums(x, products, ["p"])["p"].to_numpy().reshape(d, d)
    rest = np.array([(s - n * int(m)) / n for s, m in zip(sums, middle, strict=True)])
    covariance = squares / n - np.outer(rest, rest)
    covariance = (covariance + covariance.T) / 2
    values, vectors = components(covariance, k)
    made = Whitening(n, sums, values, vectors, float(np.trace(covariance)))
    if len(values):
        size = len(values)
        mean = _sums(x, lambda b: [made.project(b).sum(axis=0)], ["w"])["w"].to_numpy() / n

        def centred(batch: np.ndarray) -> list[np.ndarray]:
            w = made.project(batch) - mean
            return [(w.T @ w).ravel()]

        got = _sums(x, centred, ["w"])["w"].to_numpy().reshape(size, size) / n
        made.error = float(np.abs(got - np.eye(size)).max())
    return made


def whiten(embeddings: DataFrame, k: int = 4, vector: str = "embedding", steps: int = 256) -> DataFrame:
    """A row for each usable row and component, from the greatest variance on: vec_id, component, n, deviation (decimal), whitened, explained, identity_error.

    Vectors count by their scaled entries, floor(steps * entry); the components are those of the
    distinct ones, so copies weigh nothing.  Rows whose vector is null or empty, holds null or
    non-finite entries, or has not the commonest length take no part; other rows, also repeated ones
    and those with a null vec_id, each have their rows.  Fewer components than k stand where the distinct
    vectors span fewer directions (none for one vector).  deviation is null beyond 38 digits.
    """
    rows = usable(embeddings.select("vec_id", vector), vector)
    model = fit(rows, k, vector, steps)
    own = rows.select("vec_id", scaled(vector, steps).alias("x"))
    schema = wider(own.select("vec_id"), component="integer", n="long", deviation="decimal(38,0)", whitened="double", explained="double", identity_error="double")
    size = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import decimal

        exact = decimal.Context(prec=60)
        for batch in batches:
            if not batch.num_rows or not size:
                continue
            x = _matrix(batch.column("x"))
            away = [exact.create_decimal(v) if v < 10**38 else None for v in model.deviations(x)]
            at = pa.array(np.repeat(np.arange(len(x)), size))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), model.n)), pa.array(away, pa.decimal128(38, 0)).take(at),
                pa.array(model.project(x).ravel()), pa.array(np.tile(model.values / model.trace, len(x))), pa.array(np.full(len(at), model.error))], names=schema.names)

    return own.mapInArrow(run, schema)
