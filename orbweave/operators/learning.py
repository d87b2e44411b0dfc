"""Classifiers, dimension reduction and clustering.

Fits are small: centres, directions, matrices. Scores are columns over rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions import tails
from orbweave.functions.partial import held, moments, total
from orbweave.operators.covariance import leading
from orbweave.operators.foundations import center_of, spatial_kendall, spatial_median, sscm
from orbweave.sources.samples import dimensions, rows_of


@dataclass
class Classifier:
    """A score on rows; from 0 up it means the first class."""

    levels: tuple[str, str]
    score: Callable[[np.ndarray], np.ndarray]
    tie: str = "class1"
    valid: bool = True
    detail: dict = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        """Rows (id, score, label)."""
        if not self.valid:
            raise ValueError("an invalid fit")
        levels, score, tie = self.levels, self.score, self.tie

        def run(batches):
            for b in batches:
                s = np.asarray(score(rows_of(b.column(1))), float) if b.num_rows else np.empty(0)
                first = s > 0 if tie == "class2" else s >= 0
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(np.where(first, *levels).tolist(), pa.string())], names=["id", "score", "label"])

        return df.select("id", "x").mapInArrow(run, "id long, score double, label string")


def two_classes(df: DataFrame, levels: tuple[str, str] | None = None) -> tuple[str, str]:
    """The two labels, in order of first appearance by id."""
    if levels is None:
        rows = df.groupBy(F.col("y").cast("string").alias("y")).agg(F.min("id").alias("id")).orderBy("id").limit(3).collect()
        levels = tuple(r["y"] for r in rows)
    if len(levels) != 2 or None in levels:
        raise ValueError("exactly two classes are needed")
    return levels


def _by_class(df: DataFrame, levels) -> list[tuple[int, np.ndarray, np.ndarray]]:
    p = dimensions(df)[1]
    return [moments(df.where(F.col("y").cast("string") == v), p) for v in levels]


def _log_prior(n1: int, n2: int, prior) -> float:
    """Of the classes' odds: "equal" (also None), "empirical", or two positive numbers."""
    if prior is None or isinstance(prior, str):
        if prior not in (None, "equal", "empirical"):
            raise ValueError(f"no prior {prior!r}")
        prior = (n1, n2) if prior == "empirical" else (1, 1)
    a, b = prior
    if not (0 < a < math.inf and 0 < b < math.inf):
        raise ValueError("a prior must be two positive numbers")
    return math.log(a / b)


def _linear(levels, mean1, mean2, precision, log_prior: float, **detail) -> Classifier:
    direction = precision @ (mean1 - mean2)
    middle = (mean1 + mean2) / 2
    return Classifier(levels, lambda z: (z - middle) @ direction + log_prior, detail={"direction": direction, **detail})


def gaussian_lda_oracle(levels, mean1, mean2, covariance=None, precision=None, prior=(0.5, 0.5)) -> Classifier:
    if (covariance is None) == (precision is None):
        raise ValueError("give either the covariance or the precision")
    m = np.linalg.inv(covariance) if precision is None else np.asarray(precision, float)
    return _linear(levels, np.asarray(mean1, float), np.asarray(mean2, float), m, _log_prior(0, 0, prior))


def _quadratic(levels, m1, s1, m2, s2, log_prior: float) -> Classifier:
    r1, r2 = (np.linalg.inv(np.linalg.cholesky(s)) for s in (s1, s2))
    half = -np.log(np.diag(r2)).sum() + np.log(np.diag(r1)).sum()

    def score(z):
        d1, d2 = ((z - m1) @ r1.T), ((z - m2) @ r2.T)
        return 0.5 * ((d2**2).sum(1) - (d1**2).sum(1)) + half + log_prior

    return Classifier(levels, score)


def gaussian_qda_oracle(levels, mean1, covariance1, mean2, covariance2, prior=(0.5, 0.5)) -> Classifier:
    return _quadratic(levels, *(np.asarray(v, float) for v in (mean1, covariance1, mean2, covariance2)), _log_prior(0, 0, prior))


def classical_lda(df: DataFrame, levels=None, prior=None) -> Classifier:
    """From rows (id, x, y); pooled covariance with divisor n - 2."""
    levels = two_classes(df, levels)
    (n1, m1, g1), (n2, m2, g2) = _by_class(df, levels)
    s = (g1 + g2) / (n1 + n2 - 2)
    np.linalg.cholesky(s)
    return _linear(levels, m1, m2, np.linalg.inv(s), _log_prior(n1, n2, prior))


def classical_qda(df: DataFrame, levels=None, prior=None) -> Classifier:
    levels = two_classes(df, levels)
    (n1, m1, g1), (n2, m2, g2) = _by_class(df, levels)
    return _quadratic(levels, m1, g1 / (n1 - 1), m2, g2 / (n2 - 1), _log_prior(n1, n2, prior))


def sparse_plugin_lda(df: DataFrame, precision=None, covariance=None, locations=None, levels=None, prior="empirical") -> Classifier:
    """The linear rule from a given precision, or covariance, matrix and the classes' means."""
    if (precision is None) == (covariance is None):
        raise ValueError("give either the covariance or the precision")
    levels = two_classes(df, levels)
    (n1, m1, _), (n2, m2, _) = _by_class(df, levels)
    if locations is not None:
        m1, m2 = (np.asarray(v, float) for v in locations)
    given = np.asarray(covariance if precision is None else precision, float)
    np.linalg.cholesky(given)
    return _linear(levels, m1, m2, np.linalg.inv(given) if precision is None else given, _log_prior(n1, n2, prior))


def shao_threshold_lda(df: DataFrame, m_cov: float, m_mean: float, alpha: float, levels=None, prior=None) -> Classifier:
    """LDA of a pooled covariance (divisor n) whose off-diagonal entries, and a mean difference
    whose entries, of at most m_cov sqrt(log p / n) and m_mean (log p / n)^alpha are 0.

    A covariance that is not positive definite then raises.
    """
    if not (0 < alpha < 0.5 and m_cov >= 0 and m_mean >= 0):
        raise ValueError("alpha must be between 0 and 1/2, the multipliers not negative")
    levels = two_classes(df, levels)
    (n1, m1, g1), (n2, m2, g2) = _by_class(df, levels)
    n, p = n1 + n2, len(m1)
    s, d = (g1 + g2) / n, m1 - m2
    keep = np.abs(s) > m_cov * math.sqrt(math.log(p) / n)
    np.fill_diagonal(keep, True)
    s = np.where(keep, s, 0.0)
    np.linalg.cholesky(s)
    d = np.where(np.abs(d) > m_mean * (math.log(p) / n) ** alpha, d, 0.0)
    direction, middle, shift = np.linalg.solve(s, d), (m1 + m2) / 2, _log_prior(n1, n2, prior)
    return Classifier(levels, lambda z: (z - middle) @ direction + shift, detail={"direction": direction, "covariance": s, "difference": d})


def spatial_sign_precision_lda(df: DataFrame, fit, locations=None, levels=None) -> Classifier:
    """The linear rule of equal priors from a fit of `spatial_sign_precision` and the
    classes' spatial medians; the score is known up to a positive factor."""
    levels = two_classes(df, levels)
    if locations is None:
        p = dimensions(df)[1]
        locations = [center_of(df.where(F.col("y").cast("string") == v), "spatial", p) for v in levels]
    return _linear(levels, *(np.asarray(v, float) for v in locations), fit.value, 0.0)


def elliptical_oracle(levels, location1, shape1, location2, shape2, log_generator1: Callable, log_generator2: Callable | None = None, prior=(0.5, 0.5)) -> Classifier:
    """The exact rule of two known elliptical laws.

    A generator's logarithm is a function of an array of squared distances; the
    second is the first where it is not given.
    """
    c1, c2 = np.asarray(location1, float), np.asarray(location2, float)
    r1, r2 = (np.linalg.inv(np.linalg.cholesky(np.asarray(s, float))) for s in (shape1, shape2))
    g1, g2 = log_generator1, log_generator2 or log_generator1
    shift = np.log(np.diag(r1)).sum() - np.log(np.diag(r2)).sum() + _log_prior(0, 0, prior)

    def score(z):
        d1, d2 = (((z - c1) @ r1.T) ** 2).sum(1), (((z - c2) @ r2.T) ** 2).sum(1)
        return np.asarray(g1(d1), float) - np.asarray(g2(d2), float) + shift

    return Classifier(levels, score)


def independence_classifier(df: DataFrame, levels=None, prior=None, divisor: str = "n-2") -> Classifier:
    levels = two_classes(df, levels)
    (n1, m1, g1), (n2, m2, g2) = _by_class(df, levels)
    v = (np.diag(g1) + np.diag(g2)) / (n1 + n2 - (2 if divisor == "n-2" else 0))
    if v.min() <= 0:
        raise ArithmeticError("a variance is zero")
    return _linear(levels, m1, m2, np.diag(1 / v), _log_prior(n1, n2, prior))


def fair_classifier(df: DataFrame, levels=None, features: int | None = None) -> Classifier:
    """Independence rule, by the mean of both classes' variances, on the features of largest Welch statistic."""
    levels = two_classes(df, levels)
    (n1, m1, g1), (n2, m2, g2) = _by_class(df, levels)
    n, p = n1 + n2, len(m1)
    v1, v2 = np.diag(g1) / (n1 - 1), np.diag(g2) / (n2 - 1)
    t = (m1 - m2) / np.sqrt(v1 / n1 + v2 / n2)
    order = np.lexsort((np.arange(p), -np.abs(t)))
    if features is None:
        s = (g1 + g2) / (n - 2)
        r = s / np.sqrt(np.outer(np.diag(s), np.diag(s)))
        best = -math.inf
        for m in range(1, p + 1):
            at = order[:m]
            t2 = float((t[at] ** 2).sum())
            value = n * (t2 + m * (n1 - n2) / n) ** 2 / (np.linalg.eigvalsh(r[np.ix_(at, at)])[-1] * (m * n1 * n2 + n1 * n2 * t2))
            if value > best:
                best, features = value, m
    keep = order[:features]
    w = np.zeros(p)
    w[keep] = 2 / (v1 + v2)[keep]
    return _linear(levels, m1, m2, np.diag(w), 0.0, features=keep, t=t)


def classical_pca(df: DataFrame, k: int | None = None, divisor: str = "n-1") -> dict:
    n, p = dimensions(df)
    _, mean, g = moments(df, p)
    values, vectors = leading(g / (n - 1 if divisor == "n-1" else n), k or p)
    return {"values": values, "vectors": vectors, "center": mean}


def scores(df: DataFrame, fit: dict) -> DataFrame:
    """Rows (id, scores) on the directions of a fit."""
    center, vectors = fit["center"], fit["vectors"]

    def run(batches):
        for b in batches:
            s = (rows_of(b.column(1)) - center) @ vectors if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(s), pa.list_(pa.float64()))], names=["id", "scores"])

    return df.select("id", "x").mapInArrow(run, "id long, scores array<double>")


def classical_cca(df: DataFrame, p: int, k: int | None = None) -> dict:
    """Canonical correlations of the first ``p`` columns with the rest."""
    n, both = dimensions(df)
    _, _, g = moments(df, both)
    s = g / (n - 1)
    a, b = np.linalg.cholesky(s[:p, :p]), np.linalg.cholesky(s[p:, p:])
    u, d, v = np.linalg.svd(np.linalg.solve(a, np.linalg.solve(b, s[:p, p:].T).T))
    k = k or min(p, both - p)
    return {"correlations": np.minimum(d[:k], 1.0), "x": np.linalg.solve(a.T, u[:, :k]), "y": np.linalg.solve(b.T, v[:k].T), "n": n, "p": p, "q": both - p}


def cca_bartlett(fit: dict, k: int = 0) -> dict:
    """Whether the correlations after the first ``k`` are zero."""
    n, p, q = fit["n"], fit["p"], fit["q"]
    x = -(n - 1 - (p + q + 1) / 2) * float(np.log1p(-fit["correlations"][k:] ** 2).sum())
    return {"statistic": x, "p_value": tails.chi2_sf(x, (p - k) * (q - k))}


def spatial_sign_pca(df: DataFrame, k: int, center="spatial") -> dict:
    p = dimensions(df)[1]
    values, vectors = leading(sscm(df, center), k)
    return {"values": values, "vectors": vectors, "center": center_of(df, center, p)}


def kendall_pca(df: DataFrame, k: int) -> dict:
    values, vectors = leading(spatial_kendall(df), k)
    return {"values": values, "vectors": vectors, "center": center_of(df, "mean", dimensions(df)[1])}


def kendall_factor_number(df: DataFrame, kmax: int, c: float, method: str = "mker", zero_pair_action: str = "error") -> dict:
    """The number of factors by ratios of eigenvalues of spatial Kendall's scatter, each raised by
    c / sqrt(min(n, p)): "mker" of neighbours, "mktcr" of their logarithmic shares in the tail.

    The first of equal ratios counts.  Equal rows raise unless ``zero_pair_action`` is "zero".
    """
    n, p = dimensions(df)
    m = min(n, p)
    if not 1 <= kmax < m or not 0 < c < math.inf or method not in ("mker", "mktcr"):
        raise ValueError("kmax must be from 1 to min(n, p) - 1, c positive, the method mker or mktcr")
    scatter = spatial_kendall(df)
    # a pair of equal rows adds nothing to a trace that is 1 without any
    if zero_pair_action == "error" and np.trace(scatter) < 1 - 1 / (n * (n - 1)):
        raise ArithmeticError("two rows are equal")
    values, _ = leading(scatter, m)
    v = values + c / math.sqrt(m)
    if v.min() <= 0:
        raise ArithmeticError("an eigenvalue is not positive")
    tails_ = np.cumsum(v[::-1])[::-1]
    share = v if method == "mker" else np.log1p(v / tails_)
    ratios = share[:kmax] / share[1 : kmax + 1]
    return {"k": int(ratios.argmax()) + 1, "ratios": ratios, "values": values}


def robust_factor_subspace(df: DataFrame, k: int, scatter: str = "sscm", min_gap: float = 1e-12) -> np.ndarray:
    m = sscm(df) if scatter == "sscm" else spatial_kendall(df)
    values, vectors = leading(m, len(m))
    if k < len(m) and values[k - 1] - values[k] <= min_gap:
        raise ArithmeticError("no gap between the eigenvalues")
    return vectors[:, :k]


def rts_factor(df: DataFrame, k: int, center="mean") -> dict:
    """Loadings sqrt(p) times Kendall directions; scores of rows about ``center`` times L / p."""
    p = dimensions(df)[1]
    loadings = math.sqrt(p) * leading(spatial_kendall(df), k)[1]
    return {"vectors": loadings / p, "loadings": loadings, "center": center_of(df, center, p)}


def truncated_power(operator, s: int, k: int = 1, tol: float = 1e-10, max_iter: int = 1000) -> list[dict]:
    """Sparse directions: power steps keeping ``s`` coordinates, then deflation."""
    a, out = np.asarray(operator, float).copy(), []
    for _ in range(k):
        v = np.zeros(len(a))
        v[int(np.argmax(np.diag(a)))] = 1.0
        for it in range(max_iter):
            w = a @ v
            keep = np.lexsort((np.arange(len(w)), -np.abs(w)))[:s]
            new = np.zeros(len(w))
            new[keep] = w[keep]
            new /= np.linalg.norm(new)
            moved = min(np.abs(new - v).max(), np.abs(new + v).max())
            v = new
            if moved <= tol:
                break
        v = v * np.sign(v[int(np.argmax(np.abs(v)))])
        out.append({"vector": v, "value": float(v @ a @ v), "iterations": it + 1, "converged": moved <= tol})
        q = np.eye(len(a)) - np.outer(v, v)
        a = q @ a @ q
    return out


def sparse_spatial_sign_pca(df: DataFrame, s: int, k: int = 1) -> list[dict]:
    return truncated_power(sscm(df), s, k)


def _squares(r: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of rows from centres, a column a centre."""
    return np.stack([((r - c) ** 2).sum(1) for c in centers], 1)


def _maxmin_start(df: DataFrame, k: int, p: int, first_index: int = 1) -> np.ndarray:
    """The row ``first_index`` by id, then always the row farthest from all chosen, the least id where several are.

    One pass a centre; of each partition one row reaches the driver.
    """
    ids = [df.orderBy("id").select("id").limit(first_index).agg(F.max("id")).first()[0]]
    centers = [np.array(df.where(F.col("id") == ids[0]).first()["x"], float)]
    while len(centers) < k:
        at = np.array(centers)

        def farthest(batches, at=at):
            best = None
            for b in batches:
                if b.num_rows:
                    d = _squares(rows_of(b.column(1)), at).min(1)
                    own = b.column(0).to_numpy()
                    i = int(np.lexsort((own, -d))[0])
                    if best is None or (d[i], -own[i]) > (best[0], -best[1]):
                        best = float(d[i]), int(own[i]), b.column(1)[i].as_py()
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]]), pa.array([best[2]], pa.list_(pa.float64()))], names=["d", "id", "x"])

        row = df.select("id", "x").mapInArrow(farthest, "d double, id long, x array<double>").orderBy(F.desc("d"), "id").first()
        if not row["d"] > 0:
            raise ValueError("fewer different rows than centres")
        centers.append(np.array(row["x"]))
    return np.array(centers)


def _distance(c):
    return F.aggregate(F.zip_with("x", F.array(*(F.lit(float(v)) for v in c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


@held
def lloyd_kmeans(df: DataFrame, k: int, initial=None, max_iter: int = 100, first_index: int = 1) -> dict:
    """Nearest mean, ties to the first; an empty cluster is an error.

    ``converged`` tells whether the objective stopped falling before ``max_iter``.
    """
    n, p = dimensions(df)
    centers = _maxmin_start(df, k, p, first_index) if initial is None else np.asarray(initial, float)
    objective, done = math.inf, False
    for it in range(max_iter):

        def f(x, centers=centers):
            r = rows_of(x)
            d = _squares(r, centers)
            g = d.argmin(1)
            one = np.eye(k)[g]
            return np.r_[d.min(1).sum(), one.sum(0), (one.T @ r).ravel()]

        t = total(df.select("x"), f)
        size = t[1 : 1 + k]
        if (size == 0).any():
            raise ArithmeticError("an empty cluster")
        done, objective = t[0] >= objective, float(t[0])
        if done:
            break
        centers = t[1 + k :].reshape(k, p) / size[:, None]
    return {"centers": centers, "objective": objective, "sizes": size.astype(int), "iterations": it + 1, "converged": bool(done)}


def assign(df: DataFrame, centers: np.ndarray) -> DataFrame:
    """Rows (id, cluster, distance): the nearest centre, ties to the first."""
    d = F.array(*(_distance(c) for c in centers))
    return df.select("id", d.alias("d")).select("id", (F.array_position("d", F.array_min("d")) - 1).cast("int").alias("cluster"), F.sqrt(F.array_min("d")).alias("distance"))


@held
def k_spatial_median(df: DataFrame, k: int, initial=None, max_iter: int = 50, first_index: int = 1) -> dict:
    """Centres are spatial medians; the objective is the sum of distances.

    A median that does not converge is an error.
    """
    p = dimensions(df)[1]
    centers = _maxmin_start(df, k, p, first_index) if initial is None else np.asarray(initial, float)
    before: list[float] = []
    for _ in range(max_iter):
        placed = df.join(assign(df, centers), "id").cache()
        objective = placed.agg(F.sum("distance")).first()[0]
        fits = [spatial_median(placed.where(F.col("cluster") == c).select("id", "x"), initial=centers[c]) for c in range(k)]
        placed.unpersist()
        if not all(fit.converged for fit in fits):
            raise ArithmeticError("a cluster's median did not converge")
        new = np.array([fit.value for fit in fits])
        if before and objective >= before[-1] - 1e-12:
            break
        before.append(objective)
        centers = new
    return {"centers": centers, "objective": before[-1], "history": before}


@held
def gaussian_mixture(df: DataFrame, weights, means, covariances, tol: float = 1e-8, max_iter: int = 200) -> dict:
    """Full-covariance EM from a given start; the likelihood must not fall."""
    n, p = dimensions(df)
    w, m, s = np.asarray(weights, float), np.asarray(means, float), np.asarray(covariances, float)
    k, last, history = len(w), -math.inf, []
    for _ in range(max_iter):
        roots = [np.linalg.inv(np.linalg.cholesky(c)) for c in s]

        def f(x, w=w, m=m, roots=roots):
            r = rows_of(x)
            logs = np.column_stack([math.log(w[j]) - 0.5 * (((r - m[j]) @ roots[j].T) ** 2).sum(1) + np.log(np.diag(roots[j])).sum() - p / 2 * math.log(2 * math.pi) for j in range(k)])
            top = logs.max(1)
            lik = top + np.log(np.exp(logs - top[:, None]).sum(1))
            post = np.exp(logs - lik[:, None])
            return np.r_[lik.sum(), post.sum(0), (post.T @ r).ravel(), np.concatenate([(r.T * post[:, j] @ r).ravel() for j in range(k)])]

        t = total(df.select("x"), f)
        if t[0] < last - 1e-8 * abs(last):
            raise ArithmeticError("the likelihood fell")
        history.append(float(t[0]))
        if t[0] - last <= tol * abs(t[0]):
            break
        last = float(t[0])
        size = t[1 : 1 + k]
        w, m = size / n, t[1 + k : 1 + k + k * p].reshape(k, p) / size[:, None]
        s = t[1 + k + k * p :].reshape(k, p, p) / size[:, None, None] - np.einsum("ki,kj->kij", m, m)
    return {"weights": w, "means": m, "covariances": s, "loglik": history[-1], "history": history}

