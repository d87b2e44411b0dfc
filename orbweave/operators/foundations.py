"""Spatial signs, medians, ranks, and the scatter matrices made of them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions.partial import block_pairs, held, moments, over_pairs, pairs_total, sides, total
from orbweave.sources.samples import bound, dimensions, largest, norm, rows_of, vector


@dataclass
class Fit:
    """A fixed point: what it is, how far its equation is from holding, and how it ended."""

    value: np.ndarray
    residual: float
    iterations: int
    converged: bool
    stable: bool = False
    shape: np.ndarray | None = None


def signs(d: np.ndarray, zero_tol: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Directions of rows, zero for norms up to ``zero_tol``, and the norms."""
    top = np.abs(d).max(1, initial=0.0)
    safe = np.where(top > 0, top, 1.0)
    r = top * np.sqrt(((d / safe[:, None]) ** 2).sum(1))
    on = r > zero_tol
    u = np.where(on[:, None], d / safe[:, None], 0.0)
    return u / np.where(on, r / safe, 1.0)[:, None], r


def spatial_sign(df: DataFrame, center=None, zero_tol: float = 0.0) -> DataFrame:
    """Rows (id, sign, norm); columns only, no shuffle."""
    d = F.col("x") if center is None else F.zip_with("x", vector(center), lambda a, b: a - b)
    out = df.select("id", d.alias("d")).withColumn("norm", norm(F.col("d")))

    def scaled(s):
        return F.transform("d", lambda v: (v / s["top"]) / s["length"])

    # what all elements are divided by is computed once a row
    top = largest(F.col("d"))
    parts = F.struct(top.alias("top"), (F.col("norm") / top).alias("length"))
    sign = F.when(F.col("norm") > zero_tol, bound(parts, scaled)).otherwise(F.transform("d", lambda v: F.lit(0.0)))
    return out.select("id", sign.alias("sign"), "norm")


def _mean(df: DataFrame) -> np.ndarray:
    t = total(df.select("x"), lambda x: np.r_[len(x), rows_of(x).sum(0)])
    return t[1:] / t[0]


@held
def spatial_median(df: DataFrame, initial=None, tol: float = 1e-8, max_iter: int = 500, zero_tol: float = 0.0) -> Fit:
    """The point of least summed distance, by Weiszfeld steps that allow for
    coinciding rows, from the mean; one pass a step.  ``residual`` is what is left of the mean
    direction beyond the weight of rows at the point; it must be at most ``tol``.
    """
    _, p = dimensions(df)
    y = _mean(df) if initial is None else np.asarray(initial, float)
    best, step = (np.inf, y), np.inf
    data = df.select("x")

    def sums(at):
        def f(x):
            u, r = signs(rows_of(x) - at, zero_tol)
            on = r > zero_tol
            return np.r_[u.sum(0), (1 / r[on]).sum(), len(r) - on.sum(), len(r)]

        return total(data, f)

    for k in range(max_iter):
        s = sums(y)
        direction, inverse, same, n = s[:p], s[p], s[p + 1], s[p + 2]
        size = float(np.linalg.norm(direction))
        residual = max(0.0, size - same) / n
        if residual < best[0]:
            best = residual, y
        if residual <= tol or inverse == 0:
            return Fit(y, residual, k, residual <= tol, step <= tol * (1 + np.linalg.norm(y)))
        # near a row that may be the solution, that row is tried itself
        if k % 10 == 9:
            near = _nearest(df, y)
            t = sums(near)
            left = max(0.0, float(np.linalg.norm(t[:p])) - t[p + 1]) / n
            if left <= tol:
                return Fit(near, left, k + 1, True, True)
        move = (1 - min(1.0, same / size)) * direction / inverse
        step, y = float(np.linalg.norm(move)), y + move
    return Fit(best[1], best[0], max_iter, False)


def _nearest(df: DataFrame, y: np.ndarray) -> np.ndarray:
    d = F.aggregate(F.zip_with("x", vector(y), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return np.array(df.agg(F.min_by("x", F.struct(d.alias("d"), F.col("id")))).first()[0], float)


def center_of(df: DataFrame, center, p: int, **settings) -> np.ndarray:
    """A centre by name (spatial, mean, none) or as given."""
    if center is None or isinstance(center, str) and center == "none":
        return np.zeros(p)
    if not isinstance(center, str):
        return np.asarray(center, float)
    if center == "mean":
        return _mean(df)
    if center != "spatial":
        raise ValueError(f"no centre {center}")
    fit = spatial_median(df, **settings)
    if not fit.converged:
        raise ArithmeticError("the spatial median did not converge")
    return fit.value


def sscm(df: DataFrame, center="spatial", zero_tol: float = 0.0, **settings) -> np.ndarray:
    """Mean of sign times sign transposed; zero signs stay in the divisor."""
    n, p = dimensions(df)
    c = center_of(df, center, p, **settings)

    def gram(x):
        u, _ = signs(rows_of(x) - c, zero_tol)
        return (u.T @ u).ravel()

    return total(df.select("x"), gram).reshape(p, p) / n


#: Rows of one side at a time, so that a table of their pairs stays in the cache.
_SLICE = 128


def _pair_weights(x: np.ndarray, y: np.ndarray, power: int, zero_tol: float):
    """For some rows of ``x`` at a time: the slice, they and ``y`` about a common point and in a common unit, distances to minus ``power`` in
    that unit, and (row of the slice, rows of ``y``) to be looked at one by one.

    Squared distances come from a product of matrices; where this would cancel, or lies near ``zero_tol``
    or the ends of the floating range, the weight is 0 and the pair is named.
    """
    unit = 2.0 ** np.frexp(max(np.abs(x).max(), np.abs(y).max()))[1]
    shift = (y / unit).mean(0)
    b = y / unit - shift
    twice, size_b = -2 * b.T, (b * b).sum(1)
    least = max(1e-200, 4 * (zero_tol / unit) ** 2)
    for begin in range(0, len(x), _SLICE):
        part = slice(begin, begin + _SLICE)
        a = x[part] / unit - shift
        size_a = (a * a).sum(1)
        w = a @ twice
        w += size_a[:, None]
        w += size_b
        near = []
        for i in np.flatnonzero(w.min(1) <= np.maximum(1e-4 * (size_a + size_b.max()), least)):
            at = np.flatnonzero(w[i] <= np.maximum(1e-4 * (size_a[i] + size_b), least))
            w[i, at] = np.inf
            near.append((i, at))
        if power == 1:
            np.sqrt(w, out=w)
        yield part, a, b, np.divide(1, w, out=w), near


def _rank_sums(x: np.ndarray, y: np.ndarray, zero_tol: float = 0.0) -> np.ndarray:
    """For each row of ``x`` the sum of the directions from all rows of ``y``."""
    out = []
    for part, a, b, w, near in _pair_weights(x, y, 1, zero_tol):
        sums = a * w.sum(1)[:, None] - w @ b
        for i, at in near:
            if len(at):
                sums[i] += signs(x[part][i] - y[at], zero_tol)[0].sum(0)
        out.append(sums)
    return np.concatenate(out)


def _direction_gram(x: np.ndarray, y: np.ndarray, zero_tol: float = 0.0) -> np.ndarray:
    """Over all pairs of rows the sum of their direction times itself transposed."""
    out, of_y, all_b = 0.0, 0.0, None
    for part, a, b, w, near in _pair_weights(x, y, 2, zero_tol):
        mixed = a.T @ (w @ b)
        out = out + (a.T * w.sum(1)) @ a - mixed - mixed.T
        of_y, all_b = of_y + w.sum(0), b
        for i, at in near:
            if len(at):
                u, _ = signs(x[part][i] - y[at], zero_tol)
                out += u.T @ u
    return out + (all_b.T * of_y) @ all_b


def spatial_rank(df: DataFrame, reference: DataFrame | None = None, zero_tol: float = 0.0) -> DataFrame:
    """Rows (id, rank): the mean direction from all reference rows.

    Blocks of rows meet blocks of reference rows in products of matrices; sums a row meet by id.
    """
    reference = df if reference is None else reference
    n, p = dimensions(df)
    m, q = dimensions(reference)
    if p != q:
        raise ValueError("samples of different dimension")

    def part(batches):
        def done():
            return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(now, "<i8")), pa.array(list(sums), pa.list_(pa.float64()))], names=["id", "s"])

        now, sums = None, None
        for b in batches:
            for a, xs, ys in zip(*(b.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if a != now:
                    if now is not None:
                        yield done()
                    now, sums = a, 0.0
                sums = sums + _rank_sums(np.frombuffer(xs).reshape(-1, p), np.frombuffer(ys).reshape(-1, p), zero_tol)
        if now is not None:
            yield done()

    parts = block_pairs(df, reference, sides(df.sparkSession, n, m, p)).mapInArrow(part, "id long, s array<double>")
    out = parts.groupBy("id").agg(*(F.sum(F.get("s", F.lit(k))).alias(f"s{k}") for k in range(p)))
    return out.select("id", F.array(*(F.col(f"s{k}") / m for k in range(p))).alias("rank"))


def spatial_kendall(df: DataFrame, zero_tol: float = 0.0) -> np.ndarray:
    """Mean over pairs of rows of their difference's sign times itself transposed."""
    n, p = dimensions(df)

    def f(ids, x, others, y):
        # a pair of different blocks comes once for both orders
        return _direction_gram(x, y, zero_tol).ravel() * (1 if np.array_equal(ids, others) else 2)

    into = sides(df.sparkSession, n, n, p)
    return pairs_total(block_pairs(df, into=into), over_pairs(f, p), into).reshape(p, p) / (n * (n - 1))


def spatial_rank_covariance(df: DataFrame, zero_tol: float = 0.0) -> np.ndarray:
    n, p = dimensions(df)
    ranks = spatial_rank(df, zero_tol=zero_tol).select("rank")
    return total(ranks, lambda r: (rows_of(r).T @ rows_of(r)).ravel()).reshape(p, p) / n


def symmetric_root(v: np.ndarray, power: float) -> np.ndarray:
    values, vectors = np.linalg.eigh(v)
    if values.min() <= 0:
        raise ArithmeticError("not positive definite")
    return (vectors * values**power) @ vectors.T


def normalize_shape(shape, method: str = "trace") -> np.ndarray:
    """A positive definite matrix with trace p, or with determinant 1."""
    v = np.asarray(shape, float)
    v = (v + v.T) / 2
    values = np.linalg.eigvalsh(v)
    if values.min() <= 0:
        raise ValueError("not positive definite")
    p = len(v)
    return v * (p / values.sum() if method == "trace" else np.exp(-np.log(values).mean()))


@held
def tyler_shape(df: DataFrame, center="mean", initial=None, tol: float = 1e-8, max_iter: int = 500) -> Fit:
    """V = p/n sum z z' / (z' V^-1 z) with trace p; a pass a step."""
    n, p = dimensions(df)
    if n <= p:
        raise ValueError("more rows than columns are needed")
    c = center_of(df, center, p)
    v = np.eye(p) if initial is None else normalize_shape(initial)
    best = (np.inf, v)
    for k in range(max_iter):
        inverse = np.linalg.inv(v)

        def f(x, inverse=inverse):
            z = rows_of(x) - c
            q = np.einsum("ij,jk,ik->i", z, inverse, z)
            if (q <= 0).any():
                raise ValueError("a row lies at the centre")
            return ((z / q[:, None]).T @ z).ravel()

        w = total(df.select("x"), f).reshape(p, p) * p / n
        residual = float(np.abs(w - v).max() / np.abs(v).max())
        if residual < best[0]:
            best = residual, v
        if residual <= tol:
            return Fit(v, residual, k, True)
        v = normalize_shape(w)
    return Fit(best[1], best[0], max_iter, False)


@held
def hr_estimator(df: DataFrame, initial_location=None, initial_shape=None, tol: float = 1e-8, max_iter: int = 500) -> Fit:
    """Location and shape together, so that standardised signs have mean zero and
    identity covariance; the iterate of least residual is given back."""
    n, p = dimensions(df)
    mu = _mean(df) if initial_location is None else np.asarray(initial_location, float)
    v = normalize_shape(moments(df, p)[2]) if initial_shape is None else normalize_shape(initial_shape)
    best: Fit | None = None
    for k in range(max_iter):
        root, back = symmetric_root(v, 0.5), symmetric_root(v, -0.5)

        def f(x, mu=mu, back=back):
            u, r = signs((rows_of(x) - mu) @ back)
            return np.r_[u.sum(0), (1 / r[r > 0]).sum(), (u.T @ u).ravel()]

        t = total(df.select("x"), f)
        mean, gram = t[:p] / n, t[p + 1 :].reshape(p, p) / n
        residual = float(max(np.linalg.norm(mean), np.abs(p * gram - np.eye(p)).max()))
        if best is None or residual < best.residual:
            best = Fit(mu, residual, k, residual <= tol, shape=v)
        if residual <= tol:
            return best
        mu = mu + root @ t[:p] / t[p]
        v = normalize_shape(p * root @ gram @ root)
    best.iterations = max_iter
    return best


def acg_loglik(df: DataFrame, shape, include_constant: bool = False) -> float:
    """Log likelihood of directions under the angular central Gaussian law."""
    import math

    n, p = dimensions(df)
    values, vectors = np.linalg.eigh(np.asarray(shape, float))
    if values.min() <= 0:
        raise ValueError("not positive definite")
    scale = vectors / np.sqrt(values)
    s = total(df.select("x"), lambda x: [np.log(((signs(rows_of(x))[0] @ scale) ** 2).sum(1)).sum()])[0]
    out = -n / 2 * np.log(values).sum() - p / 2 * s
    return float(out + n * (math.lgamma(p / 2) - math.log(2) - p / 2 * math.log(math.pi)) if include_constant else out)
