"""Sparse covariance and precision matrices by convex programs.

The scatter comes from distributed moments.  Programs over the whole p x p matrix
run on the driver; those of single columns are dealt to the executors.  A result is
returned only with its certificate: optimality conditions or a duality gap within
``tol``; otherwise ArithmeticError is raised.  Nothing is clipped or ridged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from orbweave.functions.partial import moments
from orbweave.operators.foundations import sscm
from orbweave.sources.samples import dimensions

#: Columns of a column program that one task solves together.
COLUMNS = 64


@dataclass
class Sparse:
    """An estimate, how far it is from optimal, and the steps it took."""

    value: np.ndarray
    residual: float
    iterations: int
    source: np.ndarray

    def threshold(self, tau: float) -> np.ndarray:
        """Entries, the diagonal's too, of at least ``tau`` in absolute value; others are 0."""
        if not 0 <= tau < np.inf:
            raise ValueError("a threshold must be finite and not negative")
        return np.where(np.abs(self.value) >= tau, self.value, 0.0)


def _scatter(df: DataFrame, center: bool, divisor: str) -> np.ndarray:
    n, p = dimensions(df)
    if divisor not in ("n", "n-1"):
        raise ValueError(f"no divisor {divisor!r}")
    if n < 2:
        raise ValueError("at least two rows are needed")
    _, _, g = moments(df, p, None if center else np.zeros(p))
    return g / (n if divisor == "n" else n - 1)


def _soft(v: np.ndarray, by) -> np.ndarray:
    return np.sign(v) * np.maximum(np.abs(v) - by, 0.0)


def _penalty(p: int, lam: float, diagonal: bool) -> np.ndarray:
    if not 0 <= lam < np.inf:
        raise ValueError("lambda must be finite and not negative")
    w = np.full((p, p), float(lam))
    if not diagonal:
        np.fill_diagonal(w, 0.0)
    return w


def _balanced(rho: float, primal: float, dual: float) -> float:
    """A penalty's factor that keeps the two residuals alike."""
    return 2.0 if primal > 10 * dual and rho < 1e6 else 0.5 if dual > 10 * primal and rho > 1e-6 else 1.0


def graphical_lasso(s: np.ndarray, lam: float, diagonal: bool = False, tol: float = 1e-7, max_iter: int = 100_000) -> Sparse:
    """The positive definite T of least tr(S T) - log det T + lam * sum |T_ij|.

    The sum leaves the diagonal out unless ``diagonal``.  By alternating
    directions; the sparse iterate is returned once it is positive definite and
    the optimality conditions hold within ``tol`` of the mean variance in every entry.
    """
    s = np.asarray(s, float)
    p = len(s)
    # a scatter of mean variance 1 has the same problem, with an estimate as many times as large
    scale = float(np.diag(s).mean())
    if not scale > 0:
        raise ArithmeticError("variances must be positive")
    s, w = s / scale, _penalty(p, lam / scale, diagonal)
    if (np.diag(s) + np.diag(w)).min() <= 0:
        raise ArithmeticError("without a penalty on the diagonal its variances must be positive")
    z, u, rho = np.diag(1 / (np.diag(s) + np.diag(w))), np.zeros((p, p)), 1.0
    residual = np.inf
    for k in range(1, max_iter + 1):
        e, q = np.linalg.eigh(rho * (z - u) - s)
        t = (q * ((e + np.sqrt(e * e + 4 * rho)) / (2 * rho))) @ q.T
        old, z = z, _soft(t + u, w / rho)
        z = (z + z.T) / 2
        u = u + t - z
        primal, dual = np.abs(t - z).max(), rho * np.abs(z - old).max()
        if max(primal, dual) < 10 * tol and np.linalg.eigvalsh(z)[0] > 0:
            g = s - np.linalg.inv(z)
            residual = float(np.where(z == 0, np.maximum(np.abs(g) - w, 0.0), np.abs(g + w * np.sign(z))).max())
            if residual <= tol:
                return Sparse(z / scale, residual, k, s * scale)
        factor = _balanced(rho, primal, dual) if k % 10 == 0 else 1.0
        rho, u = rho * factor, u / factor
    raise ArithmeticError(f"the graphical lasso did not converge (residual {residual})")


def gaussian_graphical_lasso(df: DataFrame, lam: float, center: bool = True, divisor: str = "n", **solver) -> Sparse:
    return graphical_lasso(_scatter(df, center, divisor), lam, **solver)


def _prepared(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """A matrix scaled to norm 1, the inverse of 1 + its square, and the scale."""
    scale = np.linalg.norm(s, 2) or 1.0
    return s / scale, np.linalg.inv(np.eye(len(s)) + s @ s / scale**2), scale


def _clime_columns(s: np.ndarray, columns: np.ndarray, lam: float, tol: float, max_iter: int, prepared: tuple[np.ndarray, np.ndarray, float] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Columns b of least |b|_1 with |scale S b - e|_inf <= lam, and their gaps.

    ``s`` of norm 1 has the same program, with columns ``scale`` times as long;
    ``prepared`` has that, the inverse of 1 + S^2, and the scale.
    Alternating directions with two copies, one thresholded, one in the box.  The
    scaled multiplier of the box, made feasible, bounds the optimum from below.
    """
    s, solve, scale = prepared or _prepared(s)
    p = len(s)
    e = np.zeros((p, len(columns)))
    e[columns, np.arange(len(columns))] = 1.0
    w, z, u, v, rho = np.zeros_like(e), np.zeros_like(e), np.zeros_like(e), np.zeros_like(e), 1.0
    gap = np.full(len(columns), np.inf)
    for k in range(1, max_iter + 1):
        b = solve @ (w - u + s @ (z - v))
        sb = s @ b
        w0, z0 = w, z
        w, z = _soft(b + u, 1 / rho), np.clip(sb + v, e - lam, e + lam)
        u, v = u + b - w, v + sb - z
        if k % 25:
            continue
        outside = np.maximum(np.abs(s @ w - e) - lam, 0.0).max(0)
        y = -rho * v
        y = y / np.maximum(1.0, np.abs(s @ y).max(0))
        value = np.abs(w).sum(0)
        gap = np.maximum(outside, np.abs(value - ((y * e).sum(0) - lam * np.abs(y).sum(0))) / (1 + value))
        if gap.max() <= tol:
            return w / scale, gap, k
        if k <= 2000:
            primal = max(np.abs(b - w).max(), np.abs(sb - z).max())
            factor = _balanced(rho, primal, rho * max(np.abs(w - w0).max(), np.abs(z - z0).max()))
            rho, u, v = rho * factor, u / factor, v / factor
    raise ArithmeticError(f"a column did not converge (gap {gap.max()})")


def clime(spark: SparkSession, s: np.ndarray, lam: float, tol: float = 1e-7, max_iter: int = 100_000) -> Sparse:
    """Column by column the least 1-norm within ``lam`` of an inverse, on the executors.

    Of an entry and its mirror image the smaller in absolute value stays (the upper
    one of equal ones).  The symmetric matrix may be outside the bound;
    ``residual`` is the largest gap of a column.
    """
    s = np.asarray(s, float)
    p = len(s)
    _penalty(p, lam, True)

    shared = spark.sparkContext.broadcast(_prepared(s))

    def run(batches):
        for batch in batches:
            columns = batch.column(0).to_numpy()
            for at in range(0, len(columns), COLUMNS):
                part = columns[at : at + COLUMNS]
                b, gap, k = _clime_columns(s, part, lam, tol, max_iter, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(list(b.T), pa.list_(pa.float64())), pa.array(gap), pa.array([k] * len(part), pa.int64())], names=["j", "b", "gap", "k"])

    rows = spark.range(0, p, 1, -(-p // COLUMNS)).mapInArrow(run, "j long, b array<double>, gap double, k long").collect()
    b = np.empty((p, p))
    for r in rows:
        b[:, r["j"]] = r["b"]
    upper = np.triu(np.where(np.abs(b) <= np.abs(b.T), b, b.T))
    return Sparse(upper + np.triu(upper, 1).T, max(r["gap"] for r in rows), max(r["k"] for r in rows), s)


def clime_precision(df: DataFrame, lam: float, center: bool = True, divisor: str = "n", **solver) -> Sparse:
    return clime(df.sparkSession, _scatter(df, center, divisor), lam, **solver)


def spatial_sign_precision(df: DataFrame, lam: float, method: str = "sclime", zero_tol: float = 0.0, **solver) -> Sparse:
    """CLIME, or the graphical lasso with its diagonal penalised, of p times the SSCM
    about the spatial median: a precision matrix up to scale."""
    a = dimensions(df)[1] * sscm(df, "spatial", zero_tol)
    if not a.any():
        raise ArithmeticError("all signs are zero")
    if method == "sclime":
        return clime(df.sparkSession, a, lam, **solver)
    if method != "sglasso":
        raise ValueError(f"no method {method!r}")
    return graphical_lasso(a, lam, diagonal=True, **solver)


def ec2_covariance(df: DataFrame, lam: float, tau: float, center: bool = True, divisor: str = "n", tol: float = 1e-7, max_iter: int = 50_000) -> Sparse:
    """The correlation matrix C of least |R - C|^2 / 2 + lam * sum |C_ij|, i <> j, with
    diagonal 1 and eigenvalues of at least ``tau``, put back on the variables' scales.

    By alternating directions between the sparse matrix, which is returned, and one
    of bounded eigenvalues, until they and their last steps differ by ``tol`` at most.
    """
    cov = _scatter(df, center, divisor)
    scale = np.sqrt(np.diag(cov))
    if scale.min() <= 0:
        raise ArithmeticError("a variance is zero")
    if not 0 < tau <= 1:
        raise ValueError("tau must be above 0 and at most 1")
    r = cov / np.outer(scale, scale)
    p = len(r)
    _penalty(p, lam, False)
    z, u = np.eye(p), np.zeros((p, p))
    residual = np.inf
    for k in range(1, max_iter + 1):
        c = _soft((r + z - u) / 2, lam / 2)
        np.fill_diagonal(c, 1.0)
        e, q = np.linalg.eigh(c + u)
        old, z = z, (q * np.maximum(e, tau)) @ q.T
        u = u + c - z
        residual = float(max(np.abs(c - z).max(), np.abs(z - old).max()))
        if residual <= tol and np.linalg.eigvalsh(c)[0] >= tau - tol:
            return Sparse(c * np.outer(scale, scale), residual, k, cov)
    raise ArithmeticError(f"the covariance did not converge (residual {residual})")
