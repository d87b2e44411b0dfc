"""Sparse linear discriminants and principal subspaces: one pass for moments, then p x p.

Each estimate comes with a bound from below (or above) by a dual point, and is only
returned once the two are close.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from orbweave.functions.partial import held, moments
from orbweave.operators.covariance import leading
from orbweave.operators.learning import Classifier, _by_class, two_classes
from orbweave.sources.samples import dimensions


def lasso(c: np.ndarray, b: np.ndarray, yy: float, lam: float, tol: float = 1e-7, max_iter: int = 100_000) -> tuple[np.ndarray, float, int]:
    """The x of least yy - 2 b'x + x'C x + lam |x|_1, by coordinates; with its duality gap and the sweeps.

    A multiple of the residual that meets |2 (b - C x)| <= lam bounds the least value from
    below; the gap is relative to the value, or to 1.
    """
    if not lam > 0:
        raise ValueError("a positive penalty is needed")
    x, d = np.zeros(len(b)), np.diag(c)
    slope = b.astype(float).copy()  # b - C x
    for k in range(1, max_iter + 1):
        for j in np.flatnonzero(d > 0):
            raw = slope[j] + d[j] * x[j]
            new = np.sign(raw) * max(abs(raw) - lam / 2, 0.0) / d[j]
            if new != x[j]:
                slope -= c[:, j] * (new - x[j])
                x[j] = new
        slope = b - c @ x
        left = yy - b @ x  # the response's product with the residual; the residual's square is that less x'slope
        square = left - x @ slope
        primal = square + lam * np.abs(x).sum()
        s = min(1.0, lam / max(2 * np.abs(slope).max(), 1e-300))
        gap = float(primal - (2 * s * left - s * s * square)) / max(1.0, abs(primal))
        over = float(np.where(x == 0, np.maximum(2 * np.abs(slope) - lam, 0.0), np.abs(2 * slope - lam * np.sign(x)))[d > 0].max(initial=0.0))
        if gap <= tol and over <= tol * max(1.0, lam):
            return x, max(gap, over), k
    raise ArithmeticError(f"the lasso did not converge (gap {gap})")


@held
def dsda_classifier(df: DataFrame, lam: float, levels=None, tol: float = 1e-7, max_iter: int = 100_000, tie: str = "class1", empty: str = "invalid") -> Classifier:
    """Lasso of the classes, coded -n / n1 and n / n2, on the columns; equal priors, the boundary at the means' middle.

    From rows (id, x, y).  The objective is the mean squared error plus ``lam`` times the coefficients'
    absolute sum.  A fit without any coefficient is not valid, or with ``empty`` "tie" (as in the reference) it
    scores every row 0, so that the class of ties has them all.
    """
    if empty not in ("invalid", "tie"):
        raise ValueError("an empty fit is invalid or a tie")
    levels = two_classes(df, levels)
    (n1, m1, g1), (n2, m2, g2) = _by_class(df, levels)
    n, d = n1 + n2, m2 - m1
    c = (g1 + g2) / n + n1 * n2 / n**2 * np.outer(d, d)
    beta, gap, sweeps = lasso(c, d, n / n1 + n / n2, lam, tol, max_iter)
    middle = (m1 + m2) / 2
    detail = {"direction": -beta, "coefficients": beta, "gap": gap, "iterations": sweeps, "active": np.flatnonzero(beta)}
    return Classifier(levels, lambda z: -(z - middle) @ beta, tie, empty == "tie" or bool(beta.any()), detail)


@dataclass
class Subspace:
    """A matrix of the Fantope, its leading vectors, its sparse twin, the objective, and how far that may be from the best."""

    value: np.ndarray
    vectors: np.ndarray
    sparse: np.ndarray
    objective: float
    gap: float
    iterations: int


def onto_fantope(m: np.ndarray, k: int) -> np.ndarray:
    """The nearest symmetric matrix with eigenvalues between 0 and 1 and trace ``k``.

    Eigenvalues less a number, cut at 0 and 1; their sum falls linearly between the
    places where one reaches a cut.
    """
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    cuts = np.unique(np.r_[values, values - 1])
    sums = np.array([np.clip(values - t, 0, 1).sum() for t in cuts])
    at = int(np.searchsorted(-sums, -k))  # the first with a sum of at most k
    if at == 0 or sums[at] == k:
        theta = cuts[at]
    else:
        theta = cuts[at - 1] + (sums[at - 1] - k) / (sums[at - 1] - sums[at]) * (cuts[at] - cuts[at - 1])
    return (vectors * np.clip(values - theta, 0, 1)) @ vectors.T


def fantope(s: np.ndarray, k: int, tau: float, tol: float = 1e-7, max_iter: int = 50_000) -> Subspace:
    """The H of largest tr(S H) - tau sum |H_ij| with eigenvalues between 0 and 1 and trace ``k``.

    By alternating directions.  For any Y within tau, the ``k`` largest eigenvalues of S - Y
    sum to a bound from above; the scaled multiplier, cut to tau, is such a Y.
    """
    s = np.asarray(s, float)
    p = len(s)
    if not 1 <= k <= p or tau < 0:
        raise ValueError("a rank from 1 to the number of columns and a penalty of 0 or more are needed")
    scale = float(np.abs(np.linalg.eigvalsh(s)).max()) or 1.0
    a, t = s / scale, tau / scale
    z, u, rho = np.zeros((p, p)), np.zeros((p, p)), 1.0
    for it in range(1, max_iter + 1):
        h = onto_fantope(z - u + a / rho, k)
        old, z = z, np.sign(h + u) * np.maximum(np.abs(h + u) - t / rho, 0.0)
        u = u + h - z
        primal, dual = np.abs(h - z).max(), rho * np.abs(z - old).max()
        if it % 10:
            continue
        y = np.clip(rho * u, -t, t)
        value = float((a * h).sum() - t * np.abs(h).sum())
        bound = float(np.sort(np.linalg.eigvalsh(a - (y + y.T) / 2))[::-1][:k].sum())
        if bound - value <= tol * max(1.0, abs(value)) and primal <= np.sqrt(tol):
            return Subspace(h, leading(h, k)[1], z, value * scale, (bound - value) * scale, it)
        factor = 2.0 if primal > 10 * dual else 0.5 if dual > 10 * primal else 1.0
        rho, u = rho * factor, u / factor
    raise ArithmeticError(f"the projection did not converge (gap {bound - value})")


def fantope_pca(df: DataFrame, k: int, tau: float, center: str = "mean", scale: bool = False, divisor: str = "n", **solver) -> Subspace:
    """`fantope` of the sample's second moments about "mean" or "none"; with ``scale``, of correlations."""
    if center not in ("mean", "none") or divisor not in ("n", "n-1"):
        raise ValueError("no such centre or divisor")
    n, p = dimensions(df)
    _, _, g = moments(df, p, None if center == "mean" else np.zeros(p))
    s = g / (n if divisor == "n" else n - 1)
    if scale:
        if not (np.diag(s) > 0).all():
            raise ArithmeticError("a column does not vary")
        root = np.sqrt(np.diag(s))
        s = s / np.outer(root, root)
    return fantope(s, k, tau, **solver)
