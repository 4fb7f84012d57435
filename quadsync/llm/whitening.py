"""Operator 13: embedding whitening; eigenvalues by spectrum slicing.

Entries become whole numbers ``x = floor(256 * c)``.  The fit list holds each
distinct x vector once; its size n, sums S and centred second moments are summed
in whole numbers on Spark, so the covariance V is exact up to its last rounding.
Only these D x D sums reach the driver.

The k-th largest eigenvalue is isolated by bisection: the factors L D L^T of
``V - t I`` (symmetric pivoting, blocks of 1 and 2) have as many negative pivots as
V has eigenvalues below t.  Within the interval Rayleigh quotient iteration
converges cubically; the result is accepted when the counts just below and just
above it say that it is the k-th.  Eigenvalues closer to each other than
rounding can part are one cluster: its vectors are taken orthogonal to each other.

Each row's vector is then centred, projected and scaled in numpy batches.  The
identity error is measured on the whitened fit list itself, by sums that are
centred before they are multiplied and merged batch by batch.

Cases: rows whose vector is null or holds null, NaN or infinite entries, and empty
vectors, are dropped; rows are kept as they are, also those with equal or null
ids; vectors of each length are whitened among themselves; a component without
variance (eigenvalue below rounding) can't be scaled and is left out, so one
distinct vector alone gives no rows; an entry beyond a long's range counts as the
nearest long; a deviation beyond a long is null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadsync.llm.shared import store, table
from quadsync.session import ship_package

SCALE = 256
COMPONENTS = 4
ROWS_AT_ONCE = 2048
#: sums go to Spark as this times a high part plus a low part, so that decimals hold them
PART = 10**18
#: whole numbers up to this are exact in doubles
EXACT = 1 << 53
EPS = float(np.finfo(float).eps)


# -- eigenvalues of a symmetric matrix ---------------------------------------------------------------------

class Factors:
    """P (V - t I) P^T = L D L^T with D of blocks of 1 and 2 (complete pivoting)."""

    def __init__(self, v: np.ndarray, shift: float):
        n = len(v)
        a = v - shift * np.eye(n)
        self.order, self.low, self.blocks = np.arange(n), np.eye(n), []
        tiny = EPS * max(np.abs(v).max(initial=0.0), abs(shift), 1e-200) / 16
        k = 0
        while k < n:
            rest = np.abs(a[k:, k:])
            diag = rest.diagonal()
            r = int(diag.argmax())
            off = rest.copy()
            np.fill_diagonal(off, 0)
            p, q = np.unravel_index(int(off.argmax()), off.shape)
            if n - k == 1 or diag[r] >= 0.6403882032022076 * off[p, q]:
                self._swap(a, k, k + r)
                if abs(a[k, k]) < tiny:
                    a[k, k] = tiny
                size = 1
            else:
                p, q = sorted((int(p), int(q)))
                self._swap(a, k, k + p)
                self._swap(a, k + 1, k + q)
                size = 2
            d = a[k:k + size, k:k + size].copy()
            self.blocks.append((k, d))
            if k + size < n:
                col = a[k + size:, k:k + size].copy()
                low = np.linalg.solve(d, col.T).T
                self.low[k + size:, k:k + size] = low
                a[k + size:, k + size:] -= low @ col.T
                a[k + size:, k + size:] = (a[k + size:, k + size:] + a[k + size:, k + size:].T) / 2
            k += size

    def _swap(self, a: np.ndarray, i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]
            self.low[[i, j], :i] = self.low[[j, i], :i]
            self.order[[i, j]] = self.order[[j, i]]

    def negative(self) -> int:
        """Number of negative eigenvalues (of D, so of A)."""
        return sum(int(d[0, 0] < 0) if len(d) == 1 else 1 if np.linalg.det(d) < 0 else 2 * int(d[0, 0] + d[1, 1] < 0) for _, d in self.blocks)

    def solve(self, b: np.ndarray) -> np.ndarray:
        y = b[self.order].copy()
        for i in range(len(y)):
            y[i] -= self.low[i, :i] @ y[:i]
        for k, d in self.blocks:
            y[k:k + len(d)] = np.linalg.solve(d, y[k:k + len(d)])
        for i in range(len(y) - 1, -1, -1):
            y[i] -= self.low[i + 1:, i] @ y[i + 1:]
        out = np.empty_like(y)
        out[self.order] = y
        return out


def above(v: np.ndarray, t: float) -> int:
    """Number of eigenvalues of v that are at least t."""
    return len(v) - Factors(v, t).negative()


def leading_eigenpairs(v: np.ndarray, k: int) -> list[tuple[float, np.ndarray]]:
    """The k largest eigenvalues, falling, with orthonormal vectors; those that rounding can't tell from 0 are left out."""
    n = len(v)
    trace = float(np.trace(v))
    if n == 0 or trace <= 0:
        return []
    norm = float(np.abs(v).sum(1).max())
    near = 8 * n * EPS * norm
    found: list[tuple[float, np.ndarray]] = []
    rng = np.random.default_rng(13)
    while len(found) < min(k, n):
        i = len(found) + 1
        low, high = -near, norm + near  # above(low) = n >= i, above(high) = 0
        count_low, count_high = n, 0
        pair = None
        while pair is None:
            if high - low > 4 * near:
                mid = (low + high) / 2
                c = above(v, mid)
                low, count_low, high, count_high = (mid, c, high, count_high) if c >= i else (low, count_low, mid, c)
            narrow = high - low <= 4 * near
            alone = not narrow and count_low == i and count_high == i - 1
            if alone or narrow:
                pair = rayleigh(v, low, high, [w for _, w in found], rng, near, i, alone)
        if pair[0] <= near:
            break
        found.append(pair)
    return found


def rayleigh(v: np.ndarray, low: float, high: float, known: list[np.ndarray], rng: np.random.Generator, near: float, number: int, alone: bool) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from the middle of an interval.  None if it leaves the interval
    or the counts beside its value don't give it this number; then the interval must be halved further."""
    def without_known(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for w in known:
                x = x - (w @ x) * w
        return x / np.linalg.norm(x)

    x, shift = without_known(rng.standard_normal(len(v))), (low + high) / 2
    for _ in range(2):  # inverse iteration first, so that the quotient starts within the interval
        x = without_known(Factors(v, shift).solve(x))
    value = float(x @ (v @ x))
    for _ in range(30):
        if alone and not low <= value <= high:
            return None
        if np.linalg.norm(v @ x - value * x) <= near / 8:
            break
        x = without_known(Factors(v, value).solve(x))
        value = float(x @ (v @ x))
    if not low - near <= value <= high + near or np.linalg.norm(v @ x - value * x) > near:
        return None if alone else (value, x)
    if alone and not (above(v, value - near) >= number > above(v, value + near)):
        return None
    # one more inverse iteration settles the vector's last digits
    y = without_known(Factors(v, value).solve(x))
    if np.linalg.norm(v @ y - value * y) <= np.linalg.norm(v @ x - value * x):
        x, value = y, float(y @ (v @ y))
    return value, x


# -- sums over the fit list ---------------------------------------------------------------------------------

def matrix(batch: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(batch.flatten(), dtype=np.int64).reshape(-1, dim)


def whole_products(y: np.ndarray) -> np.ndarray:
    """y^T y in Python's whole numbers, in doubles where they are exact."""
    most = int(max(abs(int(y.max())), abs(int(y.min())))) if y.size else 0
    if most * most * len(y) < EXACT:
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T.dot(z)


def sums_of(dim: int, centre: list[int] | None) -> Callable:
    """One row per task: n and the sums or, around the centre, the sums and products, in two parts as text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        c = np.array(centre if centre is not None else [0] * dim, object)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                x = matrix(batch.column(0).slice(a, ROWS_AT_ONCE), dim)
                small = np.abs(x.astype(np.float64)).max(initial=0) < 1 << 40 and all(abs(v) < 1 << 40 for v in c)
                y = x - c.astype(np.int64) if small else x.astype(object) - c
                n += len(y)
                s = s + (y.sum(0).astype(object) if small else y.sum(0))
                if centre is not None:
                    q = q + whole_products(y)
        if n:
            parts = [divmod(int(v), PART) for v in [*s, *(q.reshape(-1) if centre is not None else [])]]
            yield pa.record_batch([pa.array([n]), pa.array([[str(v) for v, _ in parts]]), pa.array([[str(v) for _, v in parts]])], names=["n", "high", "low"])
    return run


def exact_sums(fit: DataFrame, dim: int, centre: list[int] | None) -> tuple[int, list[int], list[list[int]]]:
    """n, sums and products of the fit list; tasks' sums are added up on Spark, so only D * (D + 1) numbers come here."""
    parts = fit.mapInArrow(sums_of(dim, centre), "n long, high array<string>, low array<string>")
    values = parts.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("at", "v"))
    total = [F.sum(F.col(f"v.{c}").cast("decimal(38,0)")).cast("string").alias(c) for c in ("high", "low")]
    got = {r["at"]: r for r in values.groupBy("at").agg(F.sum("n").alias("n"), *total).collect()}
    n = got[0]["n"]
    v = [int(got[i]["high"]) * PART + int(got[i]["low"]) for i in range(len(got))]
    return n, v[:dim], [v[dim + i * dim: dim + (i + 1) * dim] for i in range(dim)] if centre is not None else []


def covariance(n: int, around: list[int], products: list[list[int]]) -> np.ndarray:
    """(n * products - sums sums^T) / n^2, each entry rounded once."""
    return np.array([[float(Fraction(n * q - a * b, n * n)) for b, q in zip(around, row, strict=True)] for a, row in zip(around, products, strict=True)])


class Whitener:
    """Mean and scaled components; x - S/n is taken from the nearest whole centre, so that nothing cancels."""

    def __init__(self, n: int, sums: list[int], pairs: list[tuple[float, np.ndarray]], trace: float):
        self.n, self.sums, self.trace = n, sums, trace
        self.centre = [round(Fraction(s, n)) for s in sums]
        self.offset = np.array([float(Fraction(s, n) - c) for s, c in zip(sums, self.centre, strict=True)])
        self.values = [e for e, _ in pairs]
        self.scaled = np.array([w / np.sqrt(e) for e, w in pairs]).reshape(len(pairs), len(sums))

    def whiten(self, x: np.ndarray) -> np.ndarray:
        big = np.abs(x.astype(np.float64)).max(initial=0) >= 1 << 52
        y = (x.astype(object) - np.array(self.centre, object)).astype(np.float64) if big else (x - np.array(self.centre, np.int64)).astype(np.float64)
        return (y - self.offset) @ self.scaled.T

    def deviation(self, x: np.ndarray) -> list[int | None]:
        most = self.n * int(np.abs(x.astype(np.float64)).max(initial=0) + 1) + max(abs(s) for s in self.sums)
        if most * most * x.shape[1] < 1 << 62:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(1).tolist()
        d = x.astype(object) * self.n - np.array(self.sums, object)
        return [int(v) if v < 1 << 63 else None for v in (d * d).sum(1)]


def merged_moments(w: Whitener, dim: int) -> Callable:
    """(n, mean, centred products) of the whitened rows of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                total = merge(total, moments(w.whiten(matrix(batch.column(0).slice(a, ROWS_AT_ONCE), dim))))
        if total:
            yield pa.record_batch([pa.array([total[0]]), pa.array([total[1].tolist()]), pa.array([total[2].reshape(-1).tolist()])], names=["n", "mean", "products"])
    return run


def moments(z: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = z.mean(0)
    return len(z), mean, (z - mean).T @ (z - mean)


def merge(a, b):
    """Sums around the common mean of two parts."""
    if a is None:
        return b
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def merge_parts(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for r in batch.to_pylist():
                total = merge(total, (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(k, k)))
        if total:
            yield pa.record_batch([pa.array([total[0]]), pa.array([total[1].tolist()]), pa.array([total[2].reshape(-1).tolist()])], names=["n", "mean", "products"])
    return run


def identity_error(fit: DataFrame, w: Whitener, dim: int) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity; the tasks' parts are merged by a few tasks first."""
    k = len(w.values)
    kind = "n long, mean array<double>, products array<double>"
    parts = fit.mapInArrow(merged_moments(w, dim), kind)
    total = None
    for r in parts.repartition(16).mapInArrow(merge_parts(k), kind).collect():  # 16 rows at most
        total = merge(total, (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(k, k)))
    return float(np.abs(total[2] / total[0] - np.eye(k)).max())


# -- the operator ---------------------------------------------------------------------------------------------

def whole_vector(v: Column) -> Column:
    return F.transform(v.cast("array<double>"), lambda c: F.floor(c * SCALE))


def usable(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def whitened_rows(w: Whitener, dim: int, error: float) -> Callable:
    explained = [e / w.trace for e in w.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(explained)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                ids, x = batch.column(0).slice(a, ROWS_AT_ONCE), matrix(batch.column(1).slice(a, ROWS_AT_ONCE), dim)
                m = len(x)
                yield pa.record_batch([
                    ids.take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n)),
                    pa.array([d for d in w.deviation(x) for _ in range(k)], pa.int64()), pa.array(w.whiten(x).reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), one row per vector and component."""
    ship_package(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where(usable(F.col("v")))
    rows = rows.select("vec_id", whole_vector(F.col("v")).alias("x"))
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit_all = store(rows.select("x").distinct(), "whitening-fit")
    lengths = sorted(r[0] for r in fit_all.select(F.size("x").alias("d")).distinct().collect())
    out = vectors.sparkSession.createDataFrame([], kind)
    for i, dim in enumerate(lengths):
        fit = fit_all.where(F.size("x") == dim)
        n, sums, _ = exact_sums(fit, dim, None)
        centre = [round(Fraction(s, n)) for s in sums]
        _, around, products = exact_sums(fit, dim, centre)
        v = covariance(n, around, products)
        pairs = leading_eigenpairs(v, components)
        if not pairs:
            continue
        w = Whitener(n, sums, pairs, float(np.trace(v)))
        some = rows.where(F.size("x") == dim).mapInArrow(whitened_rows(w, dim, identity_error(fit, w, dim)), kind)
        out = some if i == 0 else out.unionByName(some)
    return out


def op13_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
