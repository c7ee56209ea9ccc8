"""Whitening of embeddings: a compensated covariance and a divide-and-conquer eigen-solve.

Entries become integers, so counts and sums are exact. Rows are centred on the
exact mean, and their outer products are summed in double-double arithmetic:
each value is a high part and a low one, and error-free transformations carry
what a double would round off. Tasks hand on both parts, row by row of the
matrix, and these are merged in a shuffle whose keys are the matrix's rows. The
driver gets one matrix, whose size is the dimension's square whatever the
number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, StructField, StructType

from prismfeed.llm._tables import map_rows

SCALE, OFFSET = 64, 1_000_000
#: Integers keep within this, so that they are exact as doubles.
LARGEST = 1 << 53
#: Doubles that a task sums at once, in products.
_TOGETHER = 1 << 15
_SPLIT = 134217729.0
_EPS = np.finfo(float).eps


# Error-free transformations: sums and products with what rounding loses.


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = _SPLIT * a
    high = t - (t - a)
    return high, a - high


def two_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = a * b
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def dd_add(ah: np.ndarray, al: np.ndarray, bh: np.ndarray, bl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e = two_sum(ah, bh)
    t, f = two_sum(al, bl)
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def _dd(value: Fraction) -> tuple[float, float]:
    high = float(value)
    return high, float(value - Fraction(high))


class Centre:
    """The exact mean of integer vectors, and rows less it."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        pairs = [_dd(Fraction(s, n)) for s in sums]
        self.high, self.low = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])

    def less(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x - mean in double-double."""
        s, e = two_sum(x.astype(np.float64), -self.high[None, :])
        return two_sum(s, e - self.low[None, :])

    def deviations(self, x: np.ndarray) -> pa.Array:
        """The exact sum over dimensions of (n * x - sum) ** 2 of each row; null beyond 38 digits."""
        most = max((abs(self.n * int(b) - s) for lo, hi, s in zip(x.min(axis=0), x.max(axis=0), self.sums, strict=True) for b in (lo, hi)), default=0) if len(x) else 0
        reach = max(most, self.n * int(np.abs(x).max(initial=0)), *map(abs, self.sums), 1)
        if reach < 1 << 62 and most * most * x.shape[1] < 1 << 63:
            d = x * self.n - np.array(self.sums, np.int64)
            return pa.array((d * d).sum(axis=1)).cast(pa.decimal128(38, 0))
        out = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return pa.array([v if v < 10**38 else None for v in out], pa.decimal128(38, 0))


def outer_sums(high: np.ndarray, low: np.ndarray, total: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """total (lanes, pairs) plus the products of each pair of columns i <= j of the rows, lane by lane."""
    i, j = np.triu_indices(high.shape[1])
    lanes = len(total[0])
    for at in range(0, len(high), lanes):
        h, l = high[at : at + lanes], low[at : at + lanes]
        p, e = two_product(h[:, i], h[:, j])
        e = e + (h[:, i] * l[:, j] + l[:, i] * h[:, j])
        k = len(h)
        total[0][:k], total[1][:k] = dd_add(total[0][:k], total[1][:k], p, e)
    return total


def _folded(total: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    high, low = total[0][0], total[1][0]
    for h, l in zip(total[0][1:], total[1][1:], strict=True):
        high, low = dd_add(high, low, h, l)
    return high, low


def moments(rows: DataFrame, values, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of outer products (width, width), high and low parts, of what `values` makes of a batch: rows in double-double."""
    pairs = width * (width + 1) // 2
    lanes = max(1, _TOGETHER // max(1, pairs))
    starts = np.concatenate([[0], np.cumsum(np.arange(width, 0, -1))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = (np.zeros((lanes, pairs)), np.zeros((lanes, pairs))), False
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                total, seen = outer_sums(*values(b.slice(at, 4096)), total), True
        if seen:
            high, low = _folded(total)
            part = [pa.array([x[starts[r] : starts[r + 1]] for r in range(width)], pa.list_(pa.float64())) for x in (high, low)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), *part], names=["row", "high", "low"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # rows of one matrix at most
        for b in batches:
            for r, h, l in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                h, l = np.array(h.values, np.float64), np.array(l.values, np.float64)
                held[r] = dd_add(*held[r], h, l) if r in held else (h, l)
        yield pa.RecordBatch.from_pydict({"row": pa.array([*held], pa.int32()), **{n: pa.array([v[k] for v in held.values()], pa.list_(pa.float64())) for k, n in enumerate(("high", "low"))}})

    kind = "row int, high array<double>, low array<double>"
    out = np.zeros((2, width, width))
    for r in rows.mapInArrow(run, kind).repartition("row").mapInArrow(merged, kind).collect():  # the matrix, once
        for k in (0, 1):
            out[k, r.row, r.row :] = out[k, r.row :, r.row] = r[k + 1]
    return out[0], out[1]


# Symmetric eigen-solve: Householder reflections to a tridiagonal, which is torn in halves; the secular equation joins them.


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal d, off-diagonal e and orthogonal q with a = q @ tri(d, e) @ q.T."""
    a, n = a.astype(np.float64).copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        scale = np.abs(x).max()
        if scale == 0 or not np.abs(x[1:]).any():
            continue
        v = x / scale
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def _secular(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """For the k-th root of 1 + rho * sum(z2 / (d - x)) = 0, d rising and rho > 0: the nearest pole and the distance from it, by bisection.

    Distances are bisected on the doubles' own scale first, so that roots close to a pole keep all their digits.
    """
    n = len(d)
    ends = np.append(d[1:], d[-1] + rho * z2.sum())
    pole, off = np.arange(n), np.zeros(n)
    gap = ends - d
    at_middle = 1 + rho * (z2[None, :] / ((d[None, :] - d[:, None]) - gap[:, None] / 2)).sum(axis=1)
    right = (at_middle < 0) & (np.arange(n) < n - 1)
    pole[right] += 1
    sign = np.where(right, -1.0, 1.0)
    shifted = d[None, :] - d[pole][:, None]
    tiny = np.finfo(float).tiny ** 0.5
    low, high = np.full(n, tiny), np.where(np.arange(n) < n - 1, gap / 2, gap)
    high = np.maximum(high * (1 + 4 * _EPS), 2 * tiny)
    for step in range(140):
        mid = np.sqrt(low * high) if step < 60 else (low + high) / 2
        value = 1 + rho * (z2[None, :] / (shifted - (sign * mid)[:, None])).sum(axis=1)
        up = (value < 0) == (sign > 0)  # from the left pole f rises from minus infinity; from the right one it falls away
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    off[:] = sign * (low + high) / 2
    return pole, off


def _joined(d: np.ndarray, z: np.ndarray, rho: float, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of diag(d) + rho * z @ z.T, rho >= 0, up to rounding of the whole matrix's scale."""
    n = len(d)
    order = np.argsort(d, kind="stable")
    d, z, turn = d[order].copy(), z[order].copy(), np.eye(n)[:, order]
    tol = 8 * _EPS * scale
    live: list[int] = []
    for k in range(n):  # deflation: weightless entries stay, and of two equal ones a rotation takes the weight
        if rho * abs(z[k]) * np.linalg.norm(z) <= tol:
            z[k] = 0
            continue
        if live:
            p = live[-1]
            r = np.hypot(z[p], z[k])
            c, s = z[k] / r, z[p] / r
            if abs((d[k] - d[p]) * c * s) <= tol:
                z[p], z[k] = 0.0, r
                turn[:, [p, k]] = np.stack([c * turn[:, p] - s * turn[:, k], s * turn[:, p] + c * turn[:, k]], axis=1)
                d[p], d[k] = c * c * d[p] + s * s * d[k], s * s * d[p] + c * c * d[k]
                live.pop()
        live.append(k)
    w, u = d.copy(), np.eye(n)
    if live and rho > 0:
        at = np.array(live)
        at = at[np.argsort(d[at], kind="stable")]
        dl, zl = d[at], z[at]
        pole, off = _secular(dl, zl * zl, rho)
        m = len(at)
        apart = (dl[pole][:, None] - dl[None, :]) + off[:, None]  # root k less pole j, without cancellation
        # weights for which the computed roots are exact (Gu and Eisenstat), so that the vectors are orthogonal
        weight = np.empty(m)
        for j in range(m):
            others = np.arange(m) != j
            weight[j] = np.abs(apart[j, j] / rho * np.prod(apart[others, j] / (dl[others] - dl[j])))
        fresh = np.copysign(np.sqrt(weight), zl)
        v = fresh[None, :] / -apart
        v /= np.linalg.norm(v, axis=1)[:, None]
        w[at] = dl[pole] + off
        u[np.ix_(at, at)] = v.T
    return w, turn @ u


def _conquer(d: np.ndarray, e: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    n = len(d)
    if n <= 1:
        return d.copy(), np.eye(n)
    k = n // 2
    rho = e[k - 1]
    left, right = d[:k].copy(), d[k:].copy()
    left[-1] -= abs(rho)
    right[0] -= abs(rho)
    (wl, ul), (wr, ur) = _conquer(left, e[: k - 1], scale), _conquer(right, e[k:], scale)
    u = np.zeros((n, n))
    u[:k, :k], u[k:, k:] = ul, ur
    z = np.concatenate([ul[-1], np.copysign(1.0, rho) * ur[0]])
    w, v = _joined(np.concatenate([wl, wr]), z, abs(rho), scale)
    return w, u @ v


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    scale = np.abs(a).max(initial=0)
    if not len(a) or scale == 0:
        return np.zeros(len(a)), np.eye(len(a))
    d, e, q = tridiagonal(a / scale)
    w, u = _conquer(d, e, max(np.abs(d).max(), np.abs(e).max(initial=0)))
    order = np.argsort(-w, kind="stable")
    v = q @ u[:, order]
    return w[order] * scale, v / np.linalg.norm(v, axis=0)


def _integers(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        grid = np.floor(SCALE * flat)
    return (np.clip(grid, -LARGEST + OFFSET, LARGEST - OFFSET).astype(np.int64) + OFFSET).reshape(len(column), width)


def whiten(vectors: DataFrame, components: int = 32, vec_col: str = "embedding") -> DataFrame:
    """vectors with n, deviation, whitened, explained and identity_error, from all of them.

    An entry c becomes floor(64 * c) + 1,000,000, held within 2 ** 53. n: the
    rows fitted; deviation: the exact sum of (n * x - sum) ** 2 over dimensions
    (decimal; null beyond 38 digits); whitened: x less the mean on each of the
    first components, over the root of its eigenvalue, null where that is zero
    but for rounding (equal rows, dependent dimensions); explained: eigenvalues
    over the trace; identity_error: the largest entry of whitened's covariance
    less the identity, over all rows.

    Rows whose vector is null, empty, or holds null or non-finite entries are
    dropped, as are those not of the commonest dimension (ties to the smaller).
    Repeated rows and repeated or null ids count and return each; an empty table
    gives an empty result. Other columns stay; those of the new names go. Three
    passes read the table and one writes; nothing is shuffled but a matrix for
    each task. Memory is in proportion to the dimension's square.
    """
    valid = F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(vec_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    made = {"n", "deviation", "whitened", "explained", "identity_error"}
    good = vectors.filter(valid)
    good = good.select(*[_named(c) for c in good.columns if c.casefold() not in made])
    dims = good.groupBy(F.size(vec_col).alias("d")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "d").limit(1).collect()
    width, n = (dims[0].d, dims[0].rows) if dims else (0, 0)
    at = good.columns.index(next(c for c in good.columns if c.casefold() == vec_col.casefold()))
    fit = good.filter(F.size(vec_col) == width)
    lean = fit.select(F.col(vec_col).cast("array<double>").alias("v"))
    sums = _sums(lean, width) if n else []
    centre = Centre(max(n, 1), sums)
    high, low = moments(lean, lambda b: centre.less(_integers(b.column(0), width)), width) if n else (np.zeros((0, 0)), np.zeros((0, 0)))
    values, axes = eigen((high + low) / max(n, 1))
    k = min(components, width)
    trace = float(np.trace(high) + np.trace(low)) / max(n, 1)
    real = values[:k] > 64 * width * _EPS * max(values.max(initial=0), np.finfo(float).tiny)
    project = axes[:, :k] / np.sqrt(np.where(real, values[:k], 1.0))
    explained = [float(v) for v in (np.where(real, values[:k], 0.0) / trace if trace > 0 else np.zeros(k))]

    def projected(x: np.ndarray) -> np.ndarray:
        h, l = centre.less(x)
        return h @ project + l @ project

    error = 0.0
    if real.any():
        kept = int(real.sum())

        def white(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            z = projected(_integers(b.column(0), width))[:, :kept]
            return z, np.zeros_like(z)

        wh, wl = moments(lean, white, kept)  # rows are centred already
        error = float(np.abs((wh + wl) / n - np.eye(kept)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                b = whole.slice(lo, 4096)
                x = _integers(b.column(at), width)
                z = projected(x)
                flat = pa.array(z.ravel(), mask=np.broadcast_to(~real, z.shape).ravel().copy())
                white = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * k), flat)
                yield pa.RecordBatch.from_arrays([*b.columns, centre.deviations(x), white], names=[f"c{i}" for i in range(b.num_columns + 2)])

    schema = StructType([*fit.schema.fields, StructField("deviation", DecimalType(38, 0)), StructField("whitened", ArrayType(DoubleType()))])
    return map_rows(fit, run, schema).select(
        *[_named(c) for c in fit.columns], F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.lit(explained).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"),
    )


def _sums(lean: DataFrame, width: int) -> list[int]:
    """Exact sums of each dimension: tasks' in whole numbers of two limbs, merged as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, seen = np.zeros(width, np.int64), np.zeros(width, np.int64), False
        for b in batches:
            x = _integers(b.column(0), width)
            high, low, seen = high + (x >> 27).sum(axis=0), low + (x & (1 << 27) - 1).sum(axis=0), True
        if seen:
            yield pa.RecordBatch.from_pydict({"d": pa.array(np.arange(width, dtype=np.int32)), "high": pa.array(high), "low": pa.array(low)})

    parts = lean.mapInArrow(run, "d int, high long, low long").groupBy("d").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    found = {r.d: (int(r.high) << 27) + int(r.low) for r in parts.collect()}  # one row a dimension
    return [found[d] for d in range(width)]


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
