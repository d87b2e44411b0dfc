"""Tests and estimators of covariance and shape."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions import tails
from orbweave.functions.partial import moments, total
from orbweave.operators.foundations import center_of, signs, sscm
from orbweave.operators.series import prefix_sums
from orbweave.sources.samples import dimensions, rows_of


def _second(df: DataFrame, center: bool = True, divisor: str = "n") -> tuple[int, int, int, np.ndarray]:
    """Rows, columns, degrees of freedom, second moment."""
    n, p = dimensions(df)
    m = n - 1 if center else n
    _, _, gram = moments(df, p, None if center else np.zeros(p))
    return n, p, m, gram / (n if divisor == "n" else n - 1)


def _logdet(s: np.ndarray) -> float:
    sign, value = np.linalg.slogdet(s)
    if sign <= 0 or not math.isfinite(value):
        raise ArithmeticError("not positive definite")
    return float(value)


def _chi2(x: float, df: float, **more) -> dict:
    return {"statistic": x, "p_value": tails.chi2_sf(x, df), "df": df, **more}


def gaussian_covariance_lrt(df: DataFrame, sigma0, center: bool = True) -> dict:
    n, p, _, s = _second(df, center)
    r = np.linalg.solve(np.asarray(sigma0, float), s)
    return _chi2(n * (float(np.trace(r)) - _logdet(r) - p), p * (p + 1) / 2)


def mauchly_sphericity(df: DataFrame, center: bool = True) -> dict:
    n, p, m, s = _second(df, center)
    log_v = _logdet(s) - p * math.log(np.trace(s) / p)
    return _chi2(-(m - (2 * p * p + p + 2) / (6 * p)) * log_v, (p - 1) * (p + 2) / 2, log_v=log_v)


def john_sphericity(df: DataFrame, center: bool = True) -> dict:
    n, p, m, s = _second(df, center)
    u = p * float((s**2).sum()) / float(np.trace(s)) ** 2 - 1
    return _chi2(m * p * u / 2, (p - 1) * (p + 2) / 2, u=u)


def nagao_identity(df: DataFrame, center: bool = True) -> dict:
    n, p, m, s = _second(df, center)
    s = s * n / m
    return _chi2(m / 2 * float(((s - np.eye(p)) ** 2).sum()), p * (p + 1) / 2)


def spatial_sign_sphericity(df: DataFrame, center="spatial") -> dict:
    """n (p + 2) / 2 times what the SSCM's trace of squares exceeds 1 / p by, times p."""
    n, p = dimensions(df)
    b = sscm(df, center)
    q = p * float((b**2).sum()) - 1
    return _chi2(n * (p + 2) * q / 2, (p - 1) * (p + 2) / 2, q=q)


def fisher_sun_gallagher_sphericity(df: DataFrame) -> dict:
    """Unbiased means of the second and fourth powers of the covariance's eigenvalues, compared."""
    rows, p, n, s = _second(df, divisor="n-1")
    if p < 2 or rows < 5:
        raise ValueError("at least two variables and five rows are needed")
    s = s / np.abs(s).max() if s.any() else s
    values = np.linalg.eigvalsh(s)
    t1, t2, t3, t4 = (float((values**k).sum()) for k in (1, 2, 3, 4))
    common = n * (n * n + n + 2)
    a2 = n * n / ((n - 1) * (n + 2) * p) * (t2 - t1 * t1 / n)
    inner = t4 - 4 / n * t3 * t1 - (2 * n * n + 3 * n - 6) / common * t2 * t2 + 2 * (5 * n + 6) / common * t2 * t1 * t1 - (5 * n + 6) / (n * common) * t1**4
    a4 = n**4 * common / ((n + 1) * (n + 2) * (n + 4) * (n + 6) * (n - 1) * (n - 2) * (n - 3)) / p * inner
    if not a2 > 0 or not math.isfinite(a4):
        raise ArithmeticError("a trace estimate is not positive")
    c, psi = p / n, a4 / a2**2
    z = math.sqrt(n * p / (8 * (8 + 12 * c + c * c))) * (psi - 1)
    return {"statistic": z, "p_value": tails.normal_sf(z), "psi": psi}


def _sign_moments(df: DataFrame, center) -> tuple[int, int, np.ndarray, np.ndarray, int]:
    """Rows, columns, SSCM, means of the radii's powers -1, -2, -3 (of a common scale), rows at the center.

    Those rows have a zero direction and no part in the radii's powers.
    """
    n, p = dimensions(df)
    if n < 2 or p < 2:
        raise ValueError("at least two rows and two variables are needed")
    c = center_of(df, center, p)

    def size(x):
        return np.r_[np.linalg.norm(rows_of(x) - c, axis=1).sum()]

    scale = float(total(df.select("x"), size)[0]) / n

    def f(x):
        u, r = signs(rows_of(x) - c)
        inverse = scale / r[r > 0]
        return np.r_[inverse.sum(), (inverse**2).sum(), (inverse**3).sum(), len(r) - len(inverse), (u.T @ u).ravel()]

    t = total(df.select("x"), f)
    return n, p, t[4:].reshape(p, p) / n, t[:3] / n, int(t[3])


def _center_bias(inverse, n: int) -> float:
    """What fitting the center adds to the squared cosines, from means of 1 / r, 1 / r^2 and 1 / r^3."""
    r2, r3 = inverse[1] / inverse[0] ** 2, inverse[2] / inverse[0] ** 3
    return (2 - 2 * r2 + r2 * r2) / n**2 + (8 * r2 - 6 * r2 * r2 + 2 * r2 * r3 - 2 * r3) / n**3


def sign_sum_sphericity(df: DataFrame, center="spatial", bias: str = "residual") -> dict:
    """Sum of squared cosines over pairs of directions, less the fitted center's bias.

    ``bias`` is "residual", from inverse moments of the radii, or "normal_limit".
    A row at the center has a zero direction; with "residual", it raises.
    """
    if bias not in ("residual", "normal_limit"):
        raise ValueError(f"unknown bias {bias!r}")
    n, p, b, inverse, zeros = _sign_moments(df, center)
    if zeros and bias == "residual":
        raise ArithmeticError("a row at the center has no inverse radius")
    delta = _center_bias(inverse, n) if bias == "residual" else n**-2.0 + 2 * n**-3.0
    q = p / (n * (n - 1)) * (n * n * float((b**2).sum()) - (n - zeros)) - 1
    z = (q - p * delta) / math.sqrt(4 * (p - 1) / (n * (n - 1) * (p + 2)))
    return {"statistic": z, "p_value": tails.normal_sf(z), "raw": q, "delta": delta}


def cheng_sscm_equality(x: DataFrame, y: DataFrame, center="spatial") -> dict:
    """Whether two samples have one SSCM: squared cosines over pairs of rows within
    each sample, less twice those across, less the fitted centers' bias.

    A row at its center raises.
    """
    (n1, p, b1, inverse1, zeros1), (n2, p2, b2, inverse2, zeros2) = _sign_moments(x, center), _sign_moments(y, center)
    if p != p2:
        raise ValueError("samples of different dimension")
    if zeros1 or zeros2:
        raise ArithmeticError("a row at the center has no inverse radius")
    within = [(n * float((b**2).sum()) - 1) / (n - 1) for n, b in ((n1, b1), (n2, b2))]
    bias = [_center_bias(inverse, n) for n, inverse in ((n1, inverse1), (n2, inverse2))]
    trace = p * p / (n1 + n2) * (n1 * (within[0] - bias[0]) + n2 * (within[1] - bias[1]))
    if not trace > 0:
        raise ArithmeticError("the trace estimate is not positive")
    raw = p * (sum(within) - 2 * float((b1 * b2).sum()))
    z = (raw - p * sum(bias)) / (2 * (1 / n1 + 1 / n2) / (p + 2) * trace)
    return {"statistic": z, "p_value": tails.normal_sf(z), "raw": raw, "trace": trace}


def sign_max_sphericity(df: DataFrame, center="spatial") -> dict:
    """Largest entry of the SSCM less I / p, each by its own variance; Gumbel tail."""
    n, p, b, _, _ = _sign_moments(df, center)
    score = n * p * (p + 2) * (b - np.eye(p) / p) ** 2
    score[np.diag_indices(p)] /= 2 * (1 - 1 / p)
    count = p * (p + 1) / 2
    g = float(score.max()) - 2 * math.log(count) + math.log(math.log(count))
    return {"statistic": g, "p_value": tails.gumbel_sf(g), "raw": float(score.max())}


def adaptive_sphericity(df: DataFrame, center="spatial") -> dict:
    """The sum's and the maximum's p-values by the truncated Cauchy combination."""
    p_sum, p_max = sign_sum_sphericity(df, center)["p_value"], sign_max_sphericity(df, center)["p_value"]
    p = tails.truncated_cauchy(p_sum, p_max)
    return {"statistic": p, "p_value": p, "p_sum": p_sum, "p_max": p_max}


def regularized_sign_covariance(df: DataFrame, center="spatial") -> dict:
    """p times the SSCM, drawn to the identity by an estimated weight in [0, 1].  A row at the center raises."""
    n, p, b, _, zeros = _sign_moments(df, center)
    if zeros:
        raise ArithmeticError("a row at the center has no direction")
    a = p * float((b**2).sum())
    if a == 1:
        weight = 0.0
    else:
        weight = min(1.0, max(0.0, (n / (n - 1) * (a - p / n) - 1) / (a - 1)))
    return {"value": weight * p * b + (1 - weight) * np.eye(p), "weight": weight, "a": a}


def wang_yao_corrected_john(df: DataFrame, center: bool = False, beta: float = 0.0) -> dict:
    n, p, m, s = _second(df, center)
    u = p * float((s**2).sum()) / float(np.trace(s)) ** 2 - 1
    raw = n * u - (n * p / (n - 1) if center else p)
    z = (raw - 1 - beta) / 2
    return {"statistic": z, "p_value": tails.normal_sf(z), "raw": raw}


def wang_yao_corrected_lrt(df: DataFrame, center: bool = False, beta: float | None = 0.0) -> dict:
    """The likelihood ratio of sphericity, recentred for as many dimensions as a share of the rows.

    ``beta`` is the entries' fourth cumulant, taken from the data where None.
    Dimensions must be fewer than degrees of freedom.
    """
    n, p, m, s = _second(df, center)
    s = s * n / m
    if n < 3 or p >= m:
        raise ValueError("at least three rows, and more degrees of freedom than dimensions, are needed")
    if beta is None:
        c = center_of(df, "mean" if center else "none", p)
        t = total(df.select("x"), lambda x: np.r_[((rows_of(x) - c) ** 2).sum(), ((rows_of(x) - c) ** 4).sum()]) / (n * p)
        beta = float(t[1] / t[0] ** 2) - 3
    y = p / m
    ratio = p * math.log(np.trace(s) / p) - _logdet(s)
    raw = ratio + (p - m) * math.log1p(-y) - p
    mean, variance = (beta * y - math.log1p(-y)) / 2, -2 * math.log1p(-y) - 2 * y
    z = (raw - mean) / math.sqrt(variance)
    return {"statistic": z, "p_value": tails.normal_sf(z), "raw": raw, "ratio": ratio, "beta": beta, "mean": mean, "variance": variance}


#: Second moments of the scores at uniform ranks (fixed values).
SCORE_MOMENTS = {"sign": lambda p: 1.0, "wilcoxon": lambda p: 1 / 3, "spearman": lambda p: 1 / 5, "vdw": lambda p: float(p * (p + 2))}


def hallin_paindaveine_shape(df: DataFrame, shape0=None, center="spatial", score: str = "sign") -> dict:
    """Signs about the centre, sphericised by ``shape0``, weighted by scores of their radii's ranks.

    Scores: "sign" (none), "wilcoxon" (the rank over n + 1), "spearman" (its square)
    and "vdw" (the chi-square quantile there).  A row at the centre raises, and so do
    equal radii where ranks count.  Ranks are of ranges of radii, without one task for all.
    """
    n, p = dimensions(df)
    if score not in SCORE_MOMENTS:
        raise ValueError(f"no score {score}")
    if p < 2 or n < 3:
        raise ValueError("at least two variables and three rows are needed")
    c, low = center_of(df, center, p), np.linalg.cholesky(np.eye(p) if shape0 is None else np.asarray(shape0, float))

    def directions(x) -> tuple[np.ndarray, np.ndarray]:
        u, r = signs(np.linalg.solve(low, (rows_of(x) - c).T).T)
        if not r.all():
            raise ArithmeticError("a row at the centre has no direction")
        return u, r

    if score == "sign":
        found = total(df.select("x"), lambda x: (directions(x)[0].T @ directions(x)[0]).ravel())
    else:

        def radii(batches):
            for b in batches:
                if b.num_rows:
                    u, r = directions(b.column(0))
                    yield pa.RecordBatch.from_arrays([pa.array(np.ravel(r)), pa.array(list(u), pa.list_(pa.float64()))], names=["id", "u"])

        def weight(k: np.ndarray) -> np.ndarray:
            q = k / (n + 1)
            return {"wilcoxon": lambda: q, "spearman": lambda: q**2, "vdw": lambda: np.array([tails.chi2_quantile(v, p) for v in q])}[score]()

        def scatter(u, k):
            u = rows_of(u)
            return (u.T @ (u * weight(k.to_numpy())[:, None])).ravel()

        rows = df.select("x").mapInArrow(radii, "id double, u array<double>").persist()
        try:
            if rows.select("id").distinct().count() < n:
                raise ValueError("equal radii")
            with prefix_sums(rows.select("id", F.lit(0.0).alias("value")), "value") as ranked:
                found = total(rows.join(ranked.select("id", "k"), "id").select("u", "k"), scatter)
        finally:
            rows.unpersist()
    s = found.reshape(p, p) / n
    contrast = float(((s - np.eye(p) * np.trace(s) / p) ** 2).sum())
    return _chi2(n * p * (p + 2) * contrast / (2 * SCORE_MOMENTS[score](p)), p * (p + 1) / 2 - 1, scatter=s, contrast=contrast)


def trace_u_statistics(df: DataFrame) -> dict:
    """Unbiased estimates over distinct rows, from sums over rows alone."""
    n, p = dimensions(df)
    t = total(df.select("x"), lambda x: rows_of(x).sum(0))

    def f(x):
        r = rows_of(x)
        own = (r**2).sum(1)
        off = r @ t - own
        return np.r_[own.sum(), (own**2).sum(), off.sum(), (off**2).sum(), (r.T @ r).ravel()]

    s = total(df.select("x"), f)
    squared = float((s[4:] ** 2).sum() - s[1])
    triple, quadruple = s[3] - squared, s[2] ** 2 - 4 * s[3] + 2 * squared
    p2 = n * (n - 1)
    y = [s[0] / n, squared / p2, s[2] / p2, triple / (p2 * (n - 2)), quadruple / (p2 * (n - 2) * (n - 3))]
    return {**{f"y{k + 1}": float(v) for k, v in enumerate(y)}, "t1": float(y[0] - y[2]), "t2": float(y[1] - 2 * y[3] + y[4]), "n": n, "p": p}


def chen_zhang_zhong(df: DataFrame, null: str = "sphericity") -> dict:
    u = trace_u_statistics(df)
    n, p = u["n"], u["p"]
    raw = p * u["t2"] / u["t1"] ** 2 - 1 if null == "sphericity" else u["t2"] / p - 2 * u["t1"] / p + 1
    z = n * raw / 2
    return {"statistic": z, "p_value": tails.normal_sf(z), "raw": raw, **u}


def cross_trace(x: DataFrame, y: DataFrame) -> float:
    """Trace of the product of both covariance matrices."""
    return float((_second(x, True, "n-1")[3] * _second(y, True, "n-1")[3]).sum())


def li_chen(x: DataFrame, y: DataFrame) -> dict:
    a, b = trace_u_statistics(x), trace_u_statistics(y)
    t = a["t2"] + b["t2"] - 2 * cross_trace(x, y)
    se = 2 * a["t2"] / b["n"] + 2 * b["t2"] / a["n"]
    if se <= 0:
        raise ArithmeticError("the standard error is not positive")
    return {"statistic": t / se, "p_value": tails.normal_sf(t / se), "raw": t}


def threshold(v: np.ndarray, level, rule: str = "hard", scad_a: float = 3.7, eta: float = 1.0) -> np.ndarray:
    """Entrywise: hard keeps what exceeds the level strictly."""
    a = np.abs(v)
    level = np.broadcast_to(level, v.shape)
    soft = np.sign(v) * np.maximum(a - level, 0)
    if rule == "hard":
        return np.where(a > level, v, 0.0)
    if rule == "soft":
        return soft
    if rule == "scad":
        middle = ((scad_a - 1) * v - np.sign(v) * scad_a * level) / (scad_a - 2)
        return np.where(a <= 2 * level, soft, np.where(a <= scad_a * level, middle, v))
    if rule == "adaptive_lasso":
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, np.sign(v) * np.maximum(a - level ** (eta + 1) * a**-eta, 0), 0.0)
    raise ValueError(f"no rule {rule}")


def covariance_threshold(df: DataFrame, level: float | None = None, constant: float = 1.0, rule: str = "hard", center: bool = True, divisor: str = "n", threshold_diagonal: bool = True, **shape) -> np.ndarray:
    n, p, _, s = _second(df, center, divisor)
    out = threshold(s, constant * math.sqrt(math.log(p) / n) if level is None else level, rule, **shape)
    if not threshold_diagonal:
        np.fill_diagonal(out, np.diag(s))
    return out


def adaptive_covariance_threshold(df: DataFrame, delta: float = 2.0, rule: str = "hard", threshold_diagonal: bool = True, **shape) -> np.ndarray:
    """Levels by entry, from the variance of the products of centred columns."""
    n, p, _, s = _second(df)
    mean = moments(df, p)[1]

    def squares(x):
        """Of each entry, the products' squared distance from their mean."""
        d = rows_of(x) - mean
        return ((d**2).T @ d**2 - 2 * s * (d.T @ d) + len(d) * s**2).ravel()

    variance = total(df.select("x"), squares).reshape(p, p) / n
    out = threshold(s, delta * np.sqrt(variance * math.log(p) / n), rule, **shape)
    if not threshold_diagonal:
        np.fill_diagonal(out, np.diag(s))
    return out


def leading(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues and their vectors, the largest coordinate positive."""
    values, vectors = np.linalg.eigh(s)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    at = np.abs(vectors).argmax(0)
    return values, vectors * np.sign(vectors[at, np.arange(vectors.shape[1])])


def poet(s: np.ndarray, factors: int, level: float, rule: str = "hard", kind: str = "correlation") -> np.ndarray:
    """Leading eigen part plus the rest with its off-diagonal thresholded."""
    values, vectors = leading(s, factors)
    low = (vectors * values) @ vectors.T
    rest = s - low
    left = np.diag(rest)
    if kind == "correlation" and (left < -1e-10 * np.abs(np.diag(s)).max()).any():
        raise ArithmeticError("a residual variance is negative")
    # with as many factors as columns nothing is left but rounding
    root = np.sqrt(np.maximum(left, 0.0))
    scale = np.outer(root, root) if kind == "correlation" else 1.0
    kept = threshold(rest, level * scale, rule)
    np.fill_diagonal(kept, np.diag(rest))
    return low + kept


def poet_covariance(df: DataFrame, factors: int, level: float, rule: str = "hard", kind: str = "correlation") -> np.ndarray:
    return poet(_second(df)[3], factors, level, rule, kind)


def spatial_sign_poet(df: DataFrame, factors: int, constant: float = 1.0, rule: str = "hard") -> np.ndarray:
    n, p = dimensions(df)
    return poet(p * sscm(df), factors, constant * (math.sqrt(math.log(p) / n) + math.sqrt(math.log(n) / n)), rule, "variance")


def elliptical_factor_number(df: DataFrame, max_factors: int, method: str = "er") -> int:
    """The largest ratio of neighbouring eigenvalues of p SSCM ("er"), or of their growth ("gr").

    Growth is log(1 + value / tail); the tail of place j adds the values from j
    to the last but one of min(n, p).  Places without a positive tail do not count.
    """
    n, p = dimensions(df)
    r = min(n, p)
    most = r - 1 if method == "er" else r - 2
    if method not in ("er", "gr") or not 1 <= max_factors <= most:
        raise ValueError(f"method er or gr, and 1 to {most} factors")
    v = leading(p * sscm(df), p)[0]
    ratio = np.full(max_factors, -math.inf)
    for j in range(max_factors):
        if method == "er":
            ratio[j] = v[j] / v[j + 1] if v[j + 1] > 0 else math.inf
            continue
        tail, after = float(v[j : r - 1].sum()), float(v[j + 1 : r - 1].sum())
        if tail > 0 and after > 0 and v[j + 1] > 0:
            ratio[j] = math.log1p(v[j] / tail) / math.log1p(v[j + 1] / after)
    if np.isneginf(ratio).all():
        raise ArithmeticError("no tail is positive")
    return int(np.argmax(ratio)) + 1
