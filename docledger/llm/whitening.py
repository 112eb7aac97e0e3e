"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Entries are integers, so n * n times the covariance is an integer matrix, summed exactly by
Spark. Its characteristic polynomial is taken modulo primes, one prime in a row of a Spark
job (reduction to Hessenberg form, then the recurrence of its leading minors), and put together by
Chinese remaindering. All its roots are real, so the sign changes of its coefficients, shifted to a
point, count the roots beyond that point exactly; bisection with integers isolates them to as
many bits as are asked for. A component spans the null space of the scatter less its root:
inverse iteration in fixed-point integers, far more precise than a double. Only moments, residues
and the components (a function of the dimension, not of the rows) reach the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, partitions
from .vectors import integers, usable

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Bits of a root's relative precision, and of one that shares its interval with others down to there
#: and so counts as a repeated one.
BITS, REPEATED = 64, 400
LIMB = 30
SCHEMA = "vec_id {key}, component int, n long, deviation long, whitened double, explained double, identity_error double"


# ---- exact moments
def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cell, limb, value: a task's number of vectors, sums and upper triangle of sums of products, as signed
    digits of base 2 ** LIMB, which Spark can sum in longs."""
    n, s, g = 0, 0, 0
    for b in batches:
        for k in range(0, b.num_rows, 4096):
            y = b.column(0).slice(k, 4096)
            y = y.flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            top = int(np.abs(y).max(initial=0))
            if top * top * len(y) < 1 << 53:
                products = (y.T.astype(np.float64) @ y.astype(np.float64)).astype(np.int64).astype(object)
            else:
                products = y.T.astype(object) @ y.astype(object)
            n, s, g = n + len(y), s + y.astype(object).sum(0), g + products
    if n:
        cells = [n, *s, *g[np.triu_indices(len(s))]]
        out = [(c, k, (abs(v) >> LIMB * k & (1 << LIMB) - 1) * (1 if v > 0 else -1)) for c, v in enumerate(map(int, cells)) for k in range(-(-abs(v).bit_length() // LIMB))]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cell", "limb", "value"])


def moments(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S and n * sum(y y') - S S' of the ``d``-dimensional rows of ``fit``, as Python integers."""
    found = [0] * (1 + d + d * (d + 1) // 2)
    for r in fit.mapInArrow(_cells, "cell int, limb int, value long").groupBy("cell", "limb").agg(F.sum("value").alias("value")).collect():
        found[r["cell"]] += r["value"] << LIMB * r["limb"]
    n, s, g = found[0], found[1 : d + 1], np.zeros((d, d), object)
    g[np.triu_indices(d)] = found[d + 1 :]
    g = np.triu(g) + np.triu(g, 1).T
    return n, s, n * g - np.outer(np.array(s, object), np.array(s, object))


# ---- the characteristic polynomial
def primes(bits: int) -> list[int]:
    """The largest primes below 2 ** 31, until their product has more than ``bits`` bits."""

    def prime(p: int) -> bool:
        r = (p - 1 & 1 - p).bit_length() - 1
        for a in (2, 3, 5, 7):  # enough below 3.2e9
            x = pow(a, p - 1 >> r, p)
            if x not in (1, p - 1) and all((x := x * x % p) != p - 1 for _ in range(r - 1)):
                return False
        return True

    out, p, product = [], (1 << 31) - 1, 1
    while product.bit_length() <= bits:
        if prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def hessenberg_mod(a: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``a`` modulo ``p`` with zeros below its subdiagonal."""
    h = (a % p).astype(np.int64)
    for k in range(len(h) - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        r = k + 1 + int(below[0])
        h[[k + 1, r]] = h[[r, k + 1]]
        h[:, [k + 1, r]] = h[:, [r, k + 1]]
        f = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - f[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * f % p).sum(1)) % p
    return h


def characteristic_mod(a: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - a) modulo ``p``, from that of x ** 0 on."""
    h, d = hessenberg_mod(a, p), len(a)
    minors = np.zeros((d + 1, d + 1), np.int64)  # of the leading k x k parts
    minors[0, 0] = 1
    for k in range(1, d + 1):
        weights, chain = np.zeros(k, np.int64), 1
        weights[k - 1] = h[k - 1, k - 1]
        for m in range(k - 1, 0, -1):
            chain = chain * int(h[m, m - 1]) % p
            weights[m - 1] = int(h[m - 1, k - 1]) * chain % p
        minors[k, 1:] = minors[k - 1, :-1]
        minors[k] = (minors[k] - (weights[:, None] * minors[:k] % p).sum(0)) % p
    return minors[d].tolist()


def characteristic(spark: SparkSession, a: np.ndarray) -> list[int]:
    """Coefficients of det(x - a) for a positive semidefinite integer matrix, from that of x ** 0 on."""
    d, trace = len(a), int(np.trace(a))
    most = max(comb(d, k) * (-(-trace // d)) ** k for k in range(d + 1))  # by Maclaurin's inequality
    moduli = primes(most.bit_length() + 2)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([characteristic_mod(a, moduli[i]) for i in at], pa.list_(pa.int64()))], ["id", "residues"])

    jobs = spark.range(0, len(moduli), 1, max(1, min(len(moduli), partitions(spark))))
    found = {r["id"]: r["residues"] for r in jobs.mapInArrow(residues, "id long, residues array<long>").collect()}
    whole = 1
    for p in moduli:
        whole *= p
    parts = [(whole // p) * pow(whole // p, -1, p) for p in moduli]
    out = []
    for k in range(d + 1):
        x = sum(part * found[i][k] for i, part in enumerate(parts)) % whole
        out.append(x - whole if 2 * x > whole else x)
    return out


# ---- roots
def roots_above(poly: list[int], m: int, s: int) -> int:
    """How many roots of a polynomial with real roots only, repeated ones included, exceed m / 2 ** s: the
    sign changes of the coefficients after a shift to there."""
    d = len(poly) - 1
    c = [x << s * (d - i) for i, x in enumerate(poly)]
    if m:
        for i in range(d):
            for j in range(d - 1, i - 1, -1):
                c[j] += m * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def largest_roots(poly: list[int], count: int, top: int) -> list[tuple[int, int, int]]:
    """(m, s, times): the root m / 2 ** s, or ``times`` ones too near to tell apart, by falling size: the
    ``count`` largest positive ones (all, if there are fewer) of a polynomial whose roots are real and at most ``top``."""
    out: list[tuple[int, int, int]] = []
    open_ = [(0, 1 << top.bit_length(), 0, roots_above(poly, 0, 0), 0)]
    while open_:
        low, high, s, above_low, above_high = open_.pop()
        times = above_low - above_high
        if not times or above_high >= count:
            continue
        if (high - low) << (BITS if times == 1 else REPEATED) <= low:
            out.append((low + high, s + 1, times))
            continue
        if high - low == 1:
            low, high, s = 2 * low, 2 * high, s + 1
        mid = (low + high) // 2
        above = roots_above(poly, mid, s)
        open_ += [(low, mid, s, above_low, above), (mid, high, s, above, above_high)]  # the upper half comes first
    return out


# ---- components
def null_space(a: np.ndarray, m: int, s: int, times: int) -> list[np.ndarray]:
    """``times`` orthonormal vectors, as doubles, that ``a`` - m / 2 ** s all but takes to zero."""
    d, p = len(a), 192 + 2 * (BITS if times == 1 else REPEATED)
    e = a * (1 << s) - m * np.eye(d, dtype=int).astype(object)
    e = (e << p) // max(1, int(np.abs(e).max()))
    order, factors = list(range(d)), []
    for k in range(d):  # elimination with row pivots
        r = k + max(range(d - k), key=lambda i: abs(e[k + i, k]))
        e[[k, r]] = e[[r, k]]
        order[k], order[r] = order[r], order[k]
        for f in factors:
            f[1][[k - f[0] - 1, r - f[0] - 1]] = f[1][[r - f[0] - 1, k - f[0] - 1]]
        e[k, k] = e[k, k] or 1
        f = (e[k + 1 :, k] << p) // e[k, k]
        e[k + 1 :, k:] -= (f[:, None] * e[k, k:]) >> p
        factors.append((k, f))
    unit = lambda v: (v << p) // max(1, isqrt(int((v * v).sum())))

    def solved(v: np.ndarray) -> np.ndarray:
        v = v[order].copy()
        for k, f in factors:
            v[k + 1 :] -= (f * v[k]) >> p
        for k in range(d - 1, -1, -1):
            v[k] = ((v[k] - (int((e[k, k + 1 :] * v[k + 1 :]).sum()) >> p)) << p) // e[k, k]
        return v

    found: list[np.ndarray] = []
    for t in range(times):
        v = unit(np.array([(i + 1) * (t + 3) * 2654435761 % (1 << 32) - (1 << 31) for i in range(d)], object))
        for _ in range(REPEATED):
            before, v = v, unit(solved(v))
            for _ in range(2):
                for w in found:
                    v = v - (w * (int((v * w).sum()) >> p) >> p)
                v = unit(v)
            if int(min(np.abs(v - before).max(), np.abs(v + before).max())) >> p - BITS == 0:
                break
        found.append(v if v[int(np.argmax(np.abs(v)))] > 0 else -v)
    return [np.array([int(x) / (1 << p) for x in v]) for v in found]


def principal(spark: SparkSession, a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, their shares in the trace, and unit eigenvectors as columns, of an integer scatter: the
    ``count`` largest positive ones."""
    trace = int(np.trace(a))
    roots = largest_roots(characteristic(spark, a), count, trace) if trace else []
    values = [(m / (1 << s), m / (trace << s)) for m, s, times in roots for _ in range(times)][:count]
    vectors = [v for m, s, times in roots for v in null_space(a, m, s, times)][:count]
    return np.array([x for x, _ in values]), np.array([x for _, x in values]), np.array(vectors).reshape(len(vectors), len(a)).T


# ---- rows
def _centred(y: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * y - s exactly: longs where they fit, else Python integers."""
    top = max(int(np.abs(y).max(initial=0)) * n, *map(abs, s), 0)
    return n * y - np.array(s, np.int64) if top < 1 << 61 else n * y.astype(object) - np.array(s, object)


def _deviations(t: np.ndarray) -> list[int | None]:
    top = int(np.abs(t).max(initial=0))
    if top * top * t.shape[1] < 1 << 63:
        return (t * t).sum(1).tolist()
    t = t.astype(object)
    return [x if x < 1 << 63 else None for x in (t * t).sum(1).tolist()]


def _summed(fit: DataFrame, values: Callable[[np.ndarray], np.ndarray]) -> dict[int, float]:
    """The sum over all rows of ``fit`` of each place of what ``values`` makes of a matrix of rows, already summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                y = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                total = values(y) if total is None else total + values(y)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["cell", "value"])

    return {r["cell"]: r["value"] for r in fit.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()}


def identity_error(fit: DataFrame, project: Callable[[np.ndarray], np.ndarray], n: int, k: int) -> float:
    """The largest absolute entry of the covariance (divisor n, centred first) of the projected rows of
    ``fit``, less the identity."""
    sums = _summed(fit, lambda y: project(y).sum(0))
    mean = np.array([sums[i] for i in range(k)]) / n

    def products(y: np.ndarray) -> np.ndarray:
        w = project(y) - mean
        return (w.T @ w).ravel()

    sums = _summed(fit, products)
    return float(np.abs(np.array([sums[i] for i in range(k * k)]).reshape(k, k) / n - np.eye(k)).max())


def whiten(df: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row for each usable row of
    ``df`` and each of the first ``components`` components.

    Fitted on each distinct vector of integers floor(64 * entry) + 1000000 once. Rows whose vector is
    null, empty, holds a null or non-finite entry or has another length than most go; repeated rows, null and
    repeated ids each keep their rows; equal vectors get equal values. Components of no variance do not exist: a table
    whose vectors are all equal, or an empty one, gives an empty result. Components of one eigenvalue are
    an orthonormal basis of its space. An integer that no long holds becomes the nearest multiple; a deviation that
    no long holds is null. Other columns are not read."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    rows = usable(df.select(F.col(key).alias("vec_id"), F.col(vector).alias("v")), "v")

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = integers(b.column(0), SCALE)
            yield pa.RecordBatch.from_arrays([pa.array(list(y), pa.list_(pa.int64()))], ["y"])

    # equal vectors meet map-side first, so that a common one is no hot key; the shift of all entries changes neither
    # scatter nor centred values
    fit = materialise(rows.select("v").mapInArrow(units, "y array<long>").distinct(), "fit")
    first = fit.select(F.size("y").alias("d")).first()
    if not first:
        return spark.createDataFrame([], SCHEMA.format(key=kind))
    n, s, scatter = moments(fit, first["d"])
    values, shares, vectors = principal(spark, scatter, components)
    k = len(values)
    if not k:
        return spark.createDataFrame([], SCHEMA.format(key=kind))
    basis = vectors / np.sqrt(values)  # of n * x - S
    project = lambda t: t.astype(np.float64) @ basis
    error = identity_error(fit, lambda y: project(_centred(y, n, s)), n, k)
    return rows.mapInArrow(partial(_rows, n, s, project, shares, error), SCHEMA.format(key=kind))


def _rows(n: int, s: list[int], project: Callable, shares: np.ndarray, error: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k = len(shares)
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            part = b.slice(at, 1024)
            t = _centred(integers(part.column(1), SCALE), n, s)
            each = np.repeat(np.arange(len(t)), k)
            deviations = pa.array(_deviations(t), pa.int64())
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(t))), pa.array(np.full(len(each), n)), deviations.take(pa.array(each)),
                pa.array(project(t).ravel()), pa.array(np.tile(shares, len(t))), pa.array(np.full(len(each), error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
