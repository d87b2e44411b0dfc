"""One- and two-sample tests of location, from distributed moments.

Each returns a dict with ``statistic``, ``p_value`` and what they are made of.
A variance estimate that is not positive raises; nothing is repaired.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions import tails
from orbweave.functions.partial import block_pairs, moments, over_pairs, pairs_total, total
from orbweave.operators.foundations import Fit, signs, spatial_rank
from orbweave.sources.samples import dimensions, rows_of, vector


def _summary(df: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    n, p = dimensions(df)
    if n < 2:
        raise ValueError("at least two rows are needed")
    _, mean, gram = moments(df, p)
    return n, p, mean, gram / (n - 1)


def _two(x: DataFrame, y: DataFrame):
    a, b = _summary(x), _summary(y)
    if a[1] != b[1]:
        raise ValueError("samples of different dimension")
    return a, b


def _positive(v: float, what: str) -> float:
    if not v > 0 or not math.isfinite(v):
        raise ArithmeticError(f"{what} is not positive")
    return v


def _null(mu, p: int) -> np.ndarray:
    return np.zeros(p) if mu is None else np.asarray(mu, float)


def _solve(s: np.ndarray, d: np.ndarray, tol: float) -> float:
    if np.linalg.matrix_rank(s) < len(s) or 1 / np.linalg.cond(s) < tol:
        raise ArithmeticError("a singular covariance matrix")
    low = np.linalg.cholesky(s)
    return float((np.linalg.solve(low, d) ** 2).sum())


def hotelling_one_sample(df: DataFrame, mu=None, tol: float = 1.5e-8) -> dict:
    n, p, mean, s = _summary(df)
    t2 = n * _solve(s, mean - _null(mu, p), tol)
    f = (n - p) * t2 / (p * (n - 1))
    return {"statistic": f, "p_value": tails.f_sf(f, p, n - p), "t2": t2}


def hotelling_two_sample(x: DataFrame, y: DataFrame, tol: float = 1.5e-8) -> dict:
    (n1, p, m1, s1), (n2, _, m2, s2) = _two(x, y)
    nu = n1 + n2 - 2
    t2 = n1 * n2 / (n1 + n2) * _solve(((n1 - 1) * s1 + (n2 - 1) * s2) / nu, m1 - m2, tol)
    f = (nu - p + 1) * t2 / (p * nu)
    return {"statistic": f, "p_value": tails.f_sf(f, p, nu - p + 1), "t2": t2}


def _normal(z: float, **more) -> dict:
    return {"statistic": z, "p_value": tails.normal_sf(z), **more}


def srivastava_du(df: DataFrame, mu=None) -> dict:
    n, p, mean, s = _summary(df)
    nu, v = n - 1, np.diag(s)
    _positive(v.min(), "a variance")
    r = s / np.sqrt(np.outer(v, v))
    r2 = float((r**2).sum())
    c = 1 + r2 / p**1.5
    a = n * float(((mean - _null(mu, p)) ** 2 / v).sum())
    variance = _positive(2 * (r2 - p * p / nu) * c, "the variance")
    return _normal((a - nu * p / (nu - 2)) / math.sqrt(variance), raw=a, trace_r2=r2)


def bai_saranadasa(x: DataFrame, y: DataFrame) -> dict:
    (n1, _, m1, s1), (n2, _, m2, s2) = _two(x, y)
    n, nu = n1 + n2, n1 + n2 - 2
    s, a = ((n1 - 1) * s1 + (n2 - 1) * s2) / nu, n / (n1 * n2)
    sigma2 = nu * nu / (n * (n - 3)) * _positive(float((s**2).sum() - np.trace(s) ** 2 / nu), "the trace term")
    xi = float(((m1 - m2) ** 2).sum() - a * np.trace(s))
    return _normal(xi / math.sqrt(2 * a * a * (n - 1) / nu * sigma2), raw=xi, trace_sigma2=sigma2)


def srivastava_katayama_kano(x: DataFrame, y: DataFrame) -> dict:
    (n1, p, m1, s1), (n2, _, m2, s2) = _two(x, y)
    d = np.diag(s1) / n1 + np.diag(s2) / n2
    _positive(d.min(), "a combined variance")
    scale = np.sqrt(np.outer(d, d))
    a1, a2 = s1 / n1 / scale, s2 / n2 / scale
    q = float(((m1 - m2) ** 2 / d).sum())
    f1 = (a1**2).sum() - np.trace(a1) ** 2 / (n1 - 1)
    f2 = (a2**2).sum() - np.trace(a2) ** 2 / (n2 - 1)
    variance = _positive(2 * (f1 + f2 + 2 * (a1 * a2).sum()) / p, "the variance")
    c = 1 + float(((a1 + a2) ** 2).sum()) / p**1.5
    return _normal((q - p) / math.sqrt(p) / math.sqrt(variance * c), raw=q)


def zhang_zhu_zhang(x: DataFrame, y: DataFrame, adjust: bool = True) -> dict:
    """The standardised mean difference against a chi-square over its degrees of freedom.

    Each sample's covariance is weighted by the other's share of the rows.  With
    ``adjust`` the degrees of freedom are divided by the finite-sample factor where
    that is 1.2 at most.
    """
    (n1, p, m1, s1), (n2, _, m2, s2) = _two(x, y)
    if min(n1, n2) < 3:
        raise ValueError("at least three rows a sample are needed")
    n = n1 + n2
    w1, w2 = n2 / n, n1 / n
    d = w1 * np.diag(s1) + w2 * np.diag(s2)
    _positive(d.min(), "a combined variance")
    scale = np.sqrt(np.outer(d, d))
    r1, r2 = s1 / scale, s2 / scale
    cross = 2 * w1 * w2 * float((r1 * r2).sum())
    raw = w1 * w1 * float((r1**2).sum()) + w2 * w2 * float((r2**2).sum()) + cross
    own = [(k - 1) ** 2 / ((k - 2) * (k + 1)) * float((r**2).sum() - np.trace(r) ** 2 / (k - 1)) for k, r in ((n1, r1), (n2, r2))]
    trace = _positive(w1 * w1 * own[0] + w2 * w2 * own[1] + cross, "the trace estimate")
    plain, factor = p * p / trace, 1 + raw / p**1.5
    used = plain / factor if adjust and factor <= 1.2 else plain
    t = n1 * n2 / (n * p) * float(((m1 - m2) ** 2 / d).sum())
    return {"statistic": t, "p_value": tails.chi2_sf(used * t, used), "df": used, "df_plain": plain, "factor": factor, "trace": trace}


def _within_trace(df: DataFrame, n: int, p: int, prepare=lambda x: x) -> float:
    """Mean over ordered pairs of x_i'(x_j - m) x_j'(x_i - m), m without both.

    Expanded into sums over rows, so that no pair of rows has to meet.
    """
    t = total(df.select("x"), lambda x: prepare(rows_of(x)).sum(0))

    def f(x):
        r = prepare(rows_of(x))
        own, cross = (r**2).sum(1), r @ t
        rest = cross - own
        return np.r_[(own**2).sum(), rest.sum(), (rest**2).sum(), (r.T @ r).ravel()]

    s = total(df.select("x"), f)
    off = float((s[3:] ** 2).sum() - s[0])
    c = (n - 1) / (n - 2)
    mean_of, square = s[1] / (n - 2), s[2] / (n - 2) ** 2
    return (c * c * off - 2 * c * s[2] / (n - 2) + mean_of**2 - square) / (n * (n - 1))


def chen_qin(x: DataFrame, y: DataFrame) -> dict:
    (n1, p, m1, s1), (n2, _, m2, s2) = _two(x, y)
    t = float(((m1 - m2) ** 2).sum() - np.trace(s1) / n1 - np.trace(s2) / n2)
    a1, a2, a12 = _within_trace(x, n1, p), _within_trace(y, n2, p), float((s1 * s2).sum())
    variance = _positive(2 * a1 / (n1 * (n1 - 1)) + 2 * a2 / (n2 * (n2 - 1)) + 4 * a12 / (n1 * n2), "the variance")
    return _normal(t / math.sqrt(variance), raw=t, a1=a1, a2=a2, a12=a12)


def zhang_zhou_guo(df: DataFrame, mu=None) -> dict:
    """Chi-square match of three cumulants of n |mean|^2 - tr S."""
    n, p, mean, s = _summary(df)
    v = n - 1
    s2 = s @ s
    t1, t2, t3 = float(np.trace(s)), float(np.trace(s2)), float((s2 * s).sum())
    a2 = _positive(v * v / ((v - 1) * (v + 2)) * (t2 - t1 * t1 / v), "the second trace")
    a3 = _positive(v**4 / ((v - 1) * (v - 2) * (v + 2) * (v + 4)) * (t3 - 3 * t2 * t1 / v + 2 * t1**3 / v**2), "the third trace")
    t = n * float(((mean - _null(mu, p)) ** 2).sum()) - t1
    beta0, beta1 = -n / (n - 2) * a2 * a2 / a3, (n - 2) / (n - 1) * a3 / a2
    df_ = n * (n - 1) / (n - 2) ** 2 * a2**3 / a3**2
    z = (t - beta0) / beta1
    return {"statistic": z, "p_value": tails.chi2_sf(z, df_), "raw": t, "df": df_}


def zhang_zhou_guo_paired(x: DataFrame, y: DataFrame, delta=None) -> dict:
    """The same on differences of rows with equal ids."""
    both = x.select("id", "x").join(y.select("id", F.col("x").alias("y")), "id")
    return zhang_zhou_guo(both.select("id", F.zip_with("x", "y", lambda a, b: a - b).alias("x")), delta)


def zhang_zhou_guo_linear(df: DataFrame, matrix, rhs=None) -> dict:
    """The same on ``matrix`` times each row, against ``rhs``."""
    rows = np.asarray(matrix, float)
    products = [F.aggregate(F.zip_with("x", F.array(*(F.lit(float(v)) for v in r)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for r in rows]
    return zhang_zhou_guo(df.select("id", F.array(*products).alias("x")), rhs)


def wang_peng_li(df: DataFrame, mu=None) -> dict:
    """Sum over pairs of products of signs about the null centre."""
    n, p = dimensions(df)
    c = _null(mu, p)
    direction = lambda x: signs(x - c)[0]
    s = total(df.select("x"), lambda x: np.r_[direction(rows_of(x)).sum(0), (direction(rows_of(x)) ** 2).sum()])
    t = (float((s[:p] ** 2).sum()) - s[p]) / 2
    trace = _positive(_within_trace(df, n, p, direction), "the trace estimate")
    return _normal(t / math.sqrt(n * (n - 1) / 2 * trace), raw=t, trace_b2=trace)


def _quadratic(total_: np.ndarray, b: np.ndarray, factor: float, p: int) -> dict:
    q = factor * float(total_ @ np.linalg.solve(b, total_))
    return {"statistic": q, "p_value": tails.chi2_sf(q, p)}


def spatial_sign_test(df: DataFrame, mu=None) -> dict:
    n, p = dimensions(df)
    c = _null(mu, p)

    def f(x):
        u = signs(rows_of(x) - c)[0]
        return np.r_[u.sum(0), (u.T @ u).ravel()]

    s = total(df.select("x"), f) / n
    return _quadratic(s[:p], s[p:].reshape(p, p), n, p)


def spatial_signed_rank_test(df: DataFrame, mu=None) -> dict:
    n, p = dimensions(df)
    c = _null(mu, p)
    z = df.select("id", F.zip_with("x", F.array(*(F.lit(float(v)) for v in c)), lambda a, b: a - b).alias("x"))
    minus = z.select("id", F.transform("x", lambda v: -v).alias("x"))
    ranks = spatial_rank(z, minus).select("rank")
    s = total(ranks, lambda r: np.r_[rows_of(r).sum(0), (rows_of(r).T @ rows_of(r)).ravel()]) / n
    return _quadratic(s[:p], s[p:].reshape(p, p), n / 4, p)


def spatial_rank_test(x: DataFrame, y: DataFrame) -> dict:
    n1, p = dimensions(x)
    n2, _ = dimensions(y)
    shift = x.agg(F.max("id")).first()[0] + 1 - y.agg(F.min("id")).first()[0]
    pooled = x.select("id", "x").union(y.select(F.col("id") + shift, "x"))
    ranks = spatial_rank(pooled).join(x.select("id", F.lit(1.0).alias("first")), "id", "left").select("rank", F.coalesce("first", F.lit(0.0)).alias("first"))

    def f(r, first):
        m, g = rows_of(r), first.to_numpy()
        return np.r_[g @ m, (1 - g) @ m, (m.T @ m).ravel()]

    s, n = total(ranks, f), n1 + n2
    return _quadratic(s[:p] / n1 - s[p : 2 * p] / n2, s[2 * p :].reshape(p, p) / (n - 1), n1 * n2 / n, p)


def scaled_spatial_median(df: DataFrame, tol: float = 1e-7, max_iter: int = 500) -> Fit:
    """Location and diagonal scale whose standardised signs have mean zero and
    equal second moments; ``shape`` is the diagonal with largest entry 1."""
    n, p, theta, s = _summary(df)
    d = np.diag(s) / np.exp(np.log(np.diag(s)).mean())
    best: Fit | None = None
    for k in range(max_iter):

        def f(x, theta=theta, d=d):
            u, r = signs((rows_of(x) - theta) / np.sqrt(d))
            return np.r_[u.sum(0), (u**2).sum(0), (1 / r[r > 0]).sum()]

        t = total(df.select("x"), f)
        square = t[p : 2 * p] / n
        residual = float(max(np.linalg.norm(t[:p]) / n, np.abs(p * square - 1).max()))
        if best is None or residual < best.residual:
            best = Fit(theta, residual, k, residual <= tol, shape=d / d.max())
        if residual <= tol:
            return best
        theta = theta + np.sqrt(d) * t[:p] / t[2 * p]
        d = d * p * square
        d = d / np.exp(np.log(d).mean())
    best.iterations = max_iter
    return best


def spatial_sign_max_test(df: DataFrame, mu=None, tol: float = 1e-7, max_iter: int = 500) -> dict:
    """Largest standardised coordinate of the scaled median less ``mu``; Gumbel tail.

    A fit that did not settle, or a row at its center, raises.
    """
    fit = scaled_spatial_median(df, tol, max_iter)
    if not fit.converged:
        raise ArithmeticError("the scaled median did not settle")
    n, p = dimensions(df)
    root = np.sqrt(fit.shape)

    def f(x):
        r = np.linalg.norm((rows_of(x) - fit.value) / root, axis=1)
        if not r.all():
            raise ArithmeticError("a row at the center has no direction")
        return np.r_[(1 / r).sum()]

    inverse = float(total(df.select("x"), f)[0]) / n
    largest = float((((fit.value - _null(mu, p)) / root) ** 2).max())
    raw = n * largest * p * (1 - n**-0.5) * inverse**2
    g = float(raw - 2 * math.log(p) + math.log(math.log(p)))
    return {"statistic": g, "p_value": tails.gumbel_sf(g), "raw": float(raw), "zeta": float(inverse)}


def _pair_series(df: DataFrame, c: np.ndarray, n: int, sums: np.ndarray, squares: np.ndarray) -> float | None:
    """The sum over ordered pairs of ab / v, by columns, for `park_ayyala_numerator`; None where the series is too slow.

    (n - 3) v = whole - own(a) - own(b) - 2 g ab with g = 1 / (n - 2), so that ab / v is (n - 3) / whole times the sum
    over i, j, l of (i + j + l)! / (i! j! l!) own(a)^i own(b)^j (2 g ab)^l ab, each divided by ``whole``^(i + j + l).
    """
    p, g = len(c), 1 / (n - 2)
    whole = squares - sums**2 * g
    if not (np.isfinite(whole) & (whole > 0)).all():
        return None
    root = np.sqrt(whole)
    far = F.array_max(F.zip_with(F.zip_with("x", vector(c), lambda a, b: a - b), vector(root), lambda d, r: F.abs(d) / r))
    most = df.agg(F.max(far)).first()[0]
    own = most**2 * (1 + g) + 2 * g * most * float((np.abs(sums) / root).max())
    mixed = 2 * g * most**2
    if not 2 * own + mixed <= 0.5:
        return None
    # powers left out add less than 1e-17 of |ab| / whole a pair
    top = next(k for k in range(1, 64) if (2 * own + mixed) ** k <= 5e-18)
    deep = next(k for k in range(1, 64) if 4 * (mixed / (1 - 2 * own)) ** (k + 1) <= 1e-17)

    def powers(x):
        a = rows_of(x) - c
        alone = (a * a * (1 + g) - 2 * g * sums * a) / whole
        joint = a * math.sqrt(2 * g) / root
        out = np.zeros((deep + 1, top, p))
        first = a.copy()
        for l in range(deep + 1):
            term = first.copy()
            for i in range(top - l):
                out[l, i] = term.sum(0)
                term *= alone
            first *= joint
        itself = a * a / (whole * (1 - 2 * alone - joint * joint))
        return np.r_[itself.sum(), out.ravel()]

    t = total(df.select("x"), powers)
    m, out = t[1:].reshape(deep + 1, top, p), 0.0
    for l in range(deep + 1):
        for i in range(top - l):
            for j in range(top - l - i):
                out += math.comb(i + j + l, l) * math.comb(i + j, i) * float((m[l, i] * m[l, j] / whole).sum())
    return (n - 3) * (out - float(t[0]))


def park_ayyala_numerator(df: DataFrame, mu=None) -> float:
    """Mean over ordered pairs of z_i' D^-1 z_j, D the variances without both.

    Where no two rows make up half of a column's variation, the inverse variances are a series in what the
    two take away, to the last digit, and sums of powers over rows give the sum over all pairs; else
    blocks of rows meet blocks of rows.
    """
    n, p = dimensions(df)
    if n < 6:
        raise ValueError("at least six rows are needed")
    c = _null(mu, p)
    t = total(df.select("x"), lambda x: np.r_[(rows_of(x) - c).sum(0), ((rows_of(x) - c) ** 2).sum(0)])
    if (series := _pair_series(df, c, n, t[:p], t[p:])) is not None:
        return series / (n * (n - 1))

    def f(ids, x, others, y):
        out = 0.0
        for i, a in zip(ids, x - c, strict=True):
            b = (y - c)[others != i]
            m = (t[:p] - a - b) / (n - 2)
            v = (t[p:] - a * a - b * b - (n - 2) * m * m) / (n - 3)
            out += (a * b / v).sum()
        return [out]

    return float(pairs_total(block_pairs(df, df), over_pairs(f, p))[0]) / (n * (n - 1))


def _long(df: DataFrame) -> DataFrame:
    return df.select("id", F.posexplode("x").alias("dim", "v"))


def zhang_feng_one_sample_scores(df: DataFrame, mu=None) -> DataFrame:
    """Rows (dim, u): standardised Wilcoxon signed-rank scores of each dimension.

    Ties or zeros raise.
    """
    n, p = dimensions(df)
    c = F.array(*(F.lit(float(v)) for v in _null(mu, p)))
    z = _long(df).withColumn("v", F.col("v") - F.get(c, F.col("dim")))
    ranked = z.withColumn("r", F.rank().over(Window.partitionBy("dim").orderBy(F.abs("v"))))
    out = ranked.groupBy("dim").agg(F.sum(F.signum("v") * F.col("r")).alias("w"), F.countDistinct("r").alias("different"), F.count_if(F.col("v") == 0).alias("zeros"))
    if not out.where((F.col("different") < n) | (F.col("zeros") > 0)).isEmpty():
        raise ValueError("ties or zeros")
    return out.select("dim", (F.col("w") / math.sqrt(n * (n + 1) * (2 * n + 1) / 6)).alias("u"))


def zhang_feng_two_sample_scores(x: DataFrame, y: DataFrame) -> DataFrame:
    """Rows (dim, u): standardised Mann-Whitney scores of each dimension."""
    n1, _ = dimensions(x)
    n2, _ = dimensions(y)
    n = n1 + n2
    z = _long(x).withColumn("g", F.lit(1)).union(_long(y).withColumn("g", F.lit(0)))
    ranked = z.withColumn("r", F.rank().over(Window.partitionBy("dim").orderBy("v")))
    out = ranked.groupBy("dim").agg(F.sum(F.when(F.col("g") == 1, F.col("r"))).alias("w"), F.countDistinct("r").alias("different"))
    if not out.where(F.col("different") < n).isEmpty():
        raise ValueError("ties")
    return out.select("dim", ((F.col("w") - n1 * (n + 1) / 2) / math.sqrt(n1 * n2 * (n + 1) / 12)).alias("u"))


def zhang_feng_max(scores: DataFrame) -> dict:
    r = scores.agg(F.max(F.col("u") * F.col("u")).alias("m"), F.count("*").alias("p")).first()
    g = r["m"] - 2 * math.log(r["p"]) + math.log(math.log(r["p"]))
    return {"statistic": g, "p_value": tails.gumbel_sf(g), "raw": r["m"]}


def zhang_feng_sum(scores: DataFrame, tau_sq: float) -> dict:
    """The sum of squared scores, centred, over the root of p times ``tau_sq``."""
    r = scores.agg(F.sum(F.col("u") * F.col("u")).alias("s"), F.count("*").alias("p")).first()
    return _normal((r["s"] - r["p"]) / math.sqrt(r["p"] * _positive(tau_sq, "tau_sq")), raw=r["s"])


def oracle_weighted_sign_sum(df: DataFrame, theta, diagonal, weight="constant", power: float = 0.0, null_sd: float | None = None, nu2: float | None = None, trace_r2: float | None = None, zero_tol: float = 0.0) -> dict:
    """Mean inner product of two rows' signs, weighted by radius, about a known location and diagonal.

    ``weight`` is "constant", "inverse_norm", "power" (of ``power``) or a function of
    an array of radii.  With ``null_sd``, or with ``nu2`` and ``trace_r2``, the
    statistic is standardised; otherwise there is no p-value.  A radius of at most
    ``zero_tol`` raises.
    """
    if (nu2 is None) != (trace_r2 is None) or (null_sd is not None and nu2 is not None):
        raise ValueError("give either null_sd, or nu2 and trace_r2 together")
    n, p = dimensions(df)
    c, d = np.asarray(theta, float), np.asarray(diagonal, float)
    if n < 2 or c.shape != (p,) or d.shape != (p,) or d.min() <= 0:
        raise ValueError("two rows, a location and a positive diagonal of their dimension are needed")
    k = weight if callable(weight) else {"constant": np.ones_like, "inverse_norm": lambda r: 1 / r, "power": lambda r: r**power}[weight]

    def f(x):
        u, r = signs((rows_of(x) - c) / np.sqrt(d), zero_tol)
        if r.min() <= zero_tol:
            raise ArithmeticError("a radius is zero")
        w = np.asarray(k(r), float)
        return np.r_[(w**2).sum(), (w[:, None] * u).sum(0)]

    t = total(df.select("x"), f)
    score = float((t[1:] ** 2).sum() - t[0]) / (n * (n - 1))
    if nu2 is not None:
        null_sd = nu2 / p * math.sqrt(2 * trace_r2 / (n * (n - 1)))
    if null_sd is None:
        return {"statistic": score, "raw": score, "nu2": float(t[0]) / n}
    return _normal(score / _positive(null_sd, "the standard deviation"), raw=score, nu2=float(t[0]) / n)
