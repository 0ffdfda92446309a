"""Embedding whitening on principal components found by contour integration (FEAST).

Vectors become integers, and sums and second moments are integers too: tasks multiply deviations
from the whole-number part of the mean in limbs of LIMB_BITS bits, whose matrix products are exact in
doubles, and the cluster adds them up. The covariance is therefore the exact one, rounded once, whatever the
partitioning. It has one entry per pair of dimensions, so it, and all that is computed from it, fits the driver
(MAX_DIMS); rows stay on the executors.

Inertia counts (signs of the pivots of the shifted tridiagonal form) bracket the wanted
eigenvalues and cut their range into intervals at clear gaps. For every interval the
spectral projector is a contour integral around it: Gauss-Legendre quadrature of
solves with the complex shifted covariance, applied to a random block. Rayleigh-Ritz on the
projected block gives Ritz pairs; projection and Rayleigh-Ritz repeat until as many pairs
as the inertia counts say have residuals at rounding level.

Defined cases: rows whose vector is null or empty, holds a null, NaN or infinite entry or one
beyond 2^52 as an integer, or has another length than most take no part; null and repeated ids are rows of
their own; components with less than NO_VARIANCE of the largest variance are left out (their
whitened values would be noise), so one row, equal rows or no rows give no result; a deviation beyond a long is null; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelens.llm.common import drop_staged, map_arrow, staged

SCALE, OFFSET = 1024, 100_000
MAX_DIMS = 4096             # the covariance and a few matrices of its size are held by the driver
LIMB_BITS = 21              # ROWS products of two limbs add up below 2^53
ROWS = 2048
WORD_BITS = 40              # sums travel as words of so many bits, the last one signed
WORDS = 5
NODES = 12                  # quadrature nodes on the upper half of a contour
NO_VARIANCE = 1e-11
CLEAR_GAP = 1e-3            # of the larger eigenvalue, between two intervals


def whole_numbers(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): the usable vectors as integers floor(SCALE * c) + OFFSET."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fits = F.forall(v, lambda c: F.coalesce((F.abs(c) * SCALE < 2.0 ** 52) & ~F.isnan(c), F.lit(False)))
    good = rows.where(F.coalesce(fits, F.lit(False)) & (F.size(vector_col) > 0)).select(
        F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(c * SCALE) + OFFSET).alias("x"))
    length = good.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "d").first()
    if length and length["d"] > MAX_DIMS:
        raise ValueError(f"vectors of {length['d']} entries, at most {MAX_DIMS} are supported")
    return staged(good.where(F.size("x") == (length["d"] if length else -1)), "whole")


def _rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


SUMS = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()),
                     T.StructField("c", T.LongType()), *[T.StructField(f"w{k}", T.LongType()) for k in range(WORDS)]])


def _words(at: list[tuple[int, int]], count: int, values: list[int]) -> pa.RecordBatch:
    mask = (1 << WORD_BITS) - 1
    words = [[(v >> WORD_BITS * k) & mask if k < WORDS - 1 else v >> WORD_BITS * k for v in values] for k in range(WORDS)]
    cols = [pa.array([i for i, _ in at], pa.int32()), pa.array([j for _, j in at], pa.int32()),
            pa.array([count] * len(at), pa.int64()), *[pa.array(w, pa.int64()) for w in words]]
    return pa.RecordBatch.from_arrays(cols, names=SUMS.names)


def _added(partial: DataFrame) -> tuple[int, dict[tuple[int, int], int]]:
    """Row count and integer totals by (i, j); a row per pair of dimensions reaches the driver."""
    total = partial.groupBy("i", "j").agg(F.sum("c").alias("c"), *[F.sum(f"w{k}").alias(f"w{k}") for k in range(WORDS)])
    rows = total.collect()
    return (rows[0]["c"] if rows else 0,
            {(r["i"], r["j"]): sum(r[f"w{k}"] << WORD_BITS * k for k in range(WORDS)) for r in rows})


def sums(x: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the sum of every dimension."""
    def run(it):
        count, total = 0, None
        for batch in it:
            v = _rows_of(batch.column(0))
            for k in range(0, len(v), 512):         # 512 values of 2^53 fit a long
                s = v[k:k + 512].sum(axis=0).astype(object)
                total = s if total is None else total + s
            count += len(v)
        if count:
            yield _words([(i, -1) for i in range(len(total))], count, total.tolist())

    n, found = _added(map_arrow(x.select("x"), run, SUMS))
    return n, [found[i, -1] for i in range(len(found))]


def products(y: np.ndarray) -> np.ndarray:
    """The exact y^T y of a block of at most ROWS integer rows, as Python integers."""
    limbs, rest = [], y
    while np.abs(rest).max(initial=0) >= 1 << LIMB_BITS:
        limbs.append((rest & ((1 << LIMB_BITS) - 1)).astype(np.float64))
        rest = rest >> LIMB_BITS
    limbs.append(rest.astype(np.float64))
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for a, left in enumerate(limbs):
        for b, right in enumerate(limbs):
            total += (left.T @ right).astype(np.int64).astype(object) << LIMB_BITS * (a + b)
    return total


def covariance(x: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """The covariance (divisor n), every entry the exact value rounded once."""
    d = len(total)
    base = [s // n for s in total]
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    wide = np.triu_indices(d)

    def run(it):
        count, held = 0, None
        shift = np.array(base, np.int64)
        for batch in it:
            v = _rows_of(batch.column(0)) - shift
            for k in range(0, len(v), ROWS):
                p = products(v[k:k + ROWS])
                held = p if held is None else held + p
            count += len(v)
        if count:
            yield _words(upper, count, held[wide].tolist())

    _, found = _added(map_arrow(x.select("x"), run, SUMS))
    rest = [s - n * b for s, b in zip(total, base)]
    v = np.empty((d, d))
    for i, j in upper:
        v[i, j] = v[j, i] = (n * found[i, j] - rest[i] * rest[j]) / (n * n)    # integers: one rounding
    return v


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix (Householder)."""
    a = v.copy()
    for k in range(len(a) - 2):
        u = a[k + 1:, k].copy()
        u[0] += np.copysign(np.linalg.norm(u), u[0])
        size = u @ u
        if not size:
            continue
        a[k + 1:, k:] -= np.outer(u, (2 / size) * (u @ a[k + 1:, k:]))
        a[k:, k + 1:] -= np.outer((2 / size) * (a[k:, k + 1:] @ u), u)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def count_above(form: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """How many eigenvalues exceed ``shift``: the positive pivots of the shifted form (its inertia)."""
    diag, off = form
    tiny = np.finfo(float).tiny ** 0.5
    found, pivot = 0, 1.0
    for i, a in enumerate(diag.tolist()):
        pivot = a - shift - (off[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        found += pivot > 0
    return int(found)


def _bracket(form, k: int, low: float, high: float, width: float) -> float:
    """The k-th largest eigenvalue within ``width``, by bisection on inertia counts."""
    while high - low > width:
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if count_above(form, mid) >= k else (low, mid)
    return (low + high) / 2


def intervals(v: np.ndarray, most: int) -> list[tuple[float, float, int]]:
    """(low, high, count) of disjoint intervals that hold the ``most`` largest eigenvalues, from the top.

    An interval holds eigenvalues without a clear gap between them and reaches half
    the smaller gap beyond them; the counts are checked against the range as a whole.
    """
    form = tridiagonal(v)
    top = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-9)       # no eigenvalue is larger
    if not top:
        return []
    first = _bracket(form, 1, 0.0, top, top * 1e-13)
    rank = count_above(form, NO_VARIANCE * first)
    out: list[tuple[float, float, int]] = []
    run, above = [first], first                     # the run of close eigenvalues, the gap above it
    for k in range(2, rank + 2):
        value = _bracket(form, k, 0.0, run[-1], first * 1e-13) if k <= rank else 0.0
        gap = run[-1] - value
        if k <= rank and gap < CLEAR_GAP * run[-1]:
            run.append(value)
            continue
        reach = min(above, gap) / 2
        low, high = run[-1] - reach, run[0] + reach
        out.append((low, high, count_above(form, low) - count_above(form, high)))
        if sum(c for *_, c in out) != count_above(form, low):
            raise ArithmeticError(f"the intervals miss eigenvalues above {low}")
        if sum(c for *_, c in out) >= min(most, rank):
            break
        run, above = [value], gap
    return out


def contour_pairs(v: np.ndarray, low: float, high: float, count: int, rounds: int = 30,
                  seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs with values between ``low`` and ``high``."""
    d = len(v)
    node, weight = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(0.5j * np.pi * (node + 1))
    centre, radius = (low + high) / 2, (high - low) / 2
    exact = 64 * np.finfo(float).eps * np.abs(v).sum(axis=1).max()
    wide = min(d, count + max(4, count // 2))
    block = np.random.default_rng(seed).standard_normal((d, wide))
    for _ in range(rounds):
        image = np.zeros((d, wide))
        for t, w in zip(turn, weight):
            shifted = (centre + radius * t) * np.eye(d) - v
            image += (w / 2) * (radius * t * np.linalg.solve(shifted, block.astype(complex))).real
        basis = np.linalg.qr(image)[0]
        value, mix = np.linalg.eigh(basis.T @ v @ basis)
        block = basis @ mix
        settled = (np.linalg.norm(v @ block - block * value, axis=0) <= exact) & (value > low) & (value < high)
        if settled.sum() == count:
            return value[settled], block[:, settled]
    raise ArithmeticError(f"{int(settled.sum())} of {count} eigenvalues between {low} and {high} settled")


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as columns; the largest entry is positive."""
    blocks = [contour_pairs(v, *i)[1] for i in intervals(v, most)]
    if not blocks:
        return np.zeros(0), np.zeros((len(v), 0))
    basis = np.linalg.qr(np.hstack(blocks))[0]      # one more Rayleigh-Ritz over all intervals
    value, mix = np.linalg.eigh(basis.T @ v @ basis)
    order = np.argsort(-value, kind="stable")[:most]
    vectors = basis @ mix[:, order]
    peak = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0)
    return value[order], vectors * np.sign(peak)


@dataclass
class Whitening:
    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def fit(x: DataFrame, most: int = 8) -> Whitening:
    """Principal components of all integer vectors ``x``."""
    n, total = sums(x)
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    v = covariance(x, n, total)
    return Whitening(n, total, *components(v, most), float(np.trace(v)))


def project(x: DataFrame, w: Whitening) -> DataFrame:
    """(id, deviation, w): squared distance from the mean times n squared, and the whitened vector."""
    n = max(w.n, 1)
    base = [s // n for s in w.total]
    rest = [s - n * b for s, b in zip(w.total, base)]
    schema = T.StructType([T.StructField("id", x.schema["id"].dataType), T.StructField("deviation", T.LongType()),
                           T.StructField("w", T.ArrayType(T.DoubleType()))])

    def run(it):
        whiten = w.vectors / np.sqrt(w.values)
        for batch in it:
            y = _rows_of(batch.column(1)) - np.array(base, np.int64)
            far = n * (int(np.abs(y).max(initial=0)) + 1)
            exact = y if far * far * len(base) < 1 << 63 else y.astype(object)
            gap = exact * n - np.array(rest, exact.dtype)
            deviation = [s if s < 1 << 63 else None for s in (gap * gap).sum(axis=1).tolist()]
            out = (y - np.array([r / n for r in rest])) @ whiten
            k = out.shape[1]
            lists = pa.ListArray.from_arrays(np.arange(0, len(out) * k + 1, k, dtype=np.int32) if k
                                             else np.zeros(len(out) + 1, np.int32), out.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), lists], names=schema.names)

    return map_arrow(x.select("id", "x"), run, schema)


def identity_error(projected: DataFrame, k: int) -> float | None:
    """The largest absolute entry of the whitened covariance minus the identity."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    if not pairs:
        return None
    cov = projected.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(cov[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 8) -> DataFrame:
    """A row per usable row and component: id, component, n, deviation, whitened, explained, identity_error."""
    x = whole_numbers(rows, id_col, vector_col)
    model = fit(x, most)
    projected = staged(project(x, model), "whitened")
    drop_staged(x)
    k = len(model.values)
    error = identity_error(projected, k)
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values]).cast("array<double>")
    flat = projected.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return flat.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
                       "deviation", "whitened", share[F.col("at")].alias("explained"),
                       F.lit(error).cast("double").alias("identity_error"))
