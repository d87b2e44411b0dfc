"""Ordered samples and panels: change points, white noise, independence, alphas."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions import tails
from orbweave.functions.partial import moments, total
from orbweave.operators.foundations import signs
from orbweave.sources.samples import dimensions, rows_of


@contextmanager
def prefix_sums(df: DataFrame, column: str) -> Iterator[DataFrame]:
    """Rows (id, value, k, s, was): rank of the id, sum of values up to it, and the value before.

    Rows are dealt to ranges of ids, whatever the ids; each range has one window,
    and what the ranges before hold, one row a range, is added.  The executors keep
    the rows while the block runs, as several passes follow.
    """
    rows = df.select("id", F.col(column).cast("double").alias("value"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "id").withColumn("part", F.spark_partition_id()).persist()
    within = Window.partitionBy("part").orderBy("id")
    ends = rows.groupBy("part").agg(F.sum("value").alias("s"), F.count("*").alias("n"), F.max_by("value", "id").alias("last")).orderBy("part").collect()
    shifts, s0, n0, last = [], 0.0, 0, None
    for r in ends:
        shifts.append((r["part"], s0, n0, last))
        s0, n0, last = s0 + r["s"], n0 + r["n"], r["last"]
    shifts = F.broadcast(df.sparkSession.createDataFrame(shifts, "part int, s0 double, n0 long, w0 double"))
    out = rows.select("*", F.sum("value").over(within.rowsBetween(Window.unboundedPreceding, 0)).alias("s1"), F.row_number().over(within).alias("n1"), F.lag("value").over(within).alias("w1"))
    out = out.join(shifts, "part").select("id", "value", (F.col("n0") + F.col("n1")).cast("long").alias("k"), (F.col("s0") + F.col("s1")).alias("s"), F.coalesce("w1", "w0").alias("was"))
    try:
        yield out
    finally:
        rows.unpersist()


def kolmogorov_sf(x: float) -> float:
    if x <= 0.2:
        return 1.0
    return min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 200)))


def classical_cusum(df: DataFrame, column: str = "value", gamma: float = 0.0, trim: int = 1, variance: str = "difference") -> dict:
    """The largest weighted bridge of partial sums, over the standard deviation.

    The first of equal places is the change point.
    """
    with prefix_sums(df, column) as sums:
        return _cusum(sums, gamma, trim, variance)


def _cusum(sums: DataFrame, gamma: float, trim: int, variance: str) -> dict:
    last = sums.agg(F.max("k").alias("n"), F.max_by("s", "k").alias("s"), F.avg("value").alias("m")).first()
    n, s = last["n"], last["s"]
    if variance == "difference":
        sigma2 = sums.agg(F.sum((F.col("value") - F.col("was")) ** 2)).first()[0] / (2 * (n - 1))
    else:
        sigma2 = sums.agg(F.sum((F.col("value") - last["m"]) ** 2)).first()[0] / (n - 1)
    if not sigma2 > 0:
        raise ArithmeticError("the variance is not positive")
    u = F.col("k") / n
    c = F.abs(F.col("s") - u * s) / math.sqrt(n) / math.sqrt(sigma2) * F.pow(u * (1 - u), F.lit(-gamma))
    best = sums.where((F.col("k") >= trim) & (F.col("k") <= n - trim)).select("k", c.alias("c")).agg(F.max("c").alias("c"), F.min_by("k", F.struct(-F.col("c"), F.col("k"))).alias("k")).first()
    return {"statistic": best["c"], "k": best["k"], "sigma2": sigma2, "n": n, "p_value": kolmogorov_sf(best["c"]) if gamma == 0 else None}


def portmanteau(df: DataFrame, lags: int, column: str = "value", kind: str = "ljung-box") -> dict:
    """Box-Pierce or Ljung-Box over the first lags of a series."""
    x = df.select("id", F.array(F.col(column).cast("double")).alias("x"))
    m = _centred(x, "mean")
    n, _, g, _ = _lagged(x, lags, lambda r: r - m)
    rho = [float(g[h, 0, 0] / g[0, 0, 0]) for h in range(1, lags + 1)]
    q = n * sum(x * x for x in rho) if kind == "box-pierce" else n * (n + 2) * sum(x * x / (n - h) for h, x in enumerate(rho, 1))
    return {"statistic": q, "p_value": tails.chi2_sf(q, lags), "rho": rho}


#: Times in one block of lagged products; a block also holds as many more as there are lags.
LAG_BLOCK = 1024


def _lagged(df: DataFrame, lags: int, prepare) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Sums over times t, for lags h from 0, of x_t x_{t+h}' and of |x_t|^2 |x_{t+h}|^2.

    Times are ranks of the ids.  A block of times takes the first times of the next
    one along, so that each row moves once, or twice near a block's start.
    """
    n, p = dimensions(df)
    if not 1 <= lags <= n - 2:
        raise ValueError("lags must be between 1 and the rows less two")
    size = max(LAG_BLOCK, lags)
    with prefix_sums(df.select("id", F.lit(0.0).alias("value")), "value") as ranked:
        times = df.select("id", "x").join(ranked.select("id", (F.col("k") - 1).alias("k")), "id")
        block, at = F.floor(F.col("k") / size), F.col("k") % size
        copies = F.when((at < lags) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
        held = times.select(F.explode(copies).alias("block"), "k", "x").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("rows"))

        def f(blocks, rows):
            out = np.zeros((lags + 1) * (p * p + 1))
            for b, held_rows in zip(blocks.to_pylist(), rows, strict=True):
                k, x = (held_rows.values.field(c) for c in ("k", "x"))
                x = prepare(rows_of(x))
                own, square = int((k.to_numpy() < (b + 1) * size).sum()), (x**2).sum(1)
                parts = []
                for h in range(lags + 1):
                    m = min(own, len(x) - h)
                    parts += [(x[:m].T @ x[h : h + m]).ravel(), [square[:m] @ square[h : h + m]]] if m > 0 else [np.zeros(p * p + 1)]
                out += np.concatenate(parts)
            return out

        t = total(held, f).reshape(lags + 1, -1)
    return n, p, t[:, :-1].reshape(-1, p, p), t[:, -1]


def _centred(df: DataFrame, center: str) -> np.ndarray | float:
    if center not in ("none", "mean"):
        raise ValueError(f"no centre {center!r}")
    if center == "none":
        return 0.0
    t = total(df.select("x"), lambda x: np.r_[len(x), rows_of(x).sum(0)])
    return t[1:] / t[0]


def feng_liu_ma_white_noise(df: DataFrame, lags: int = 1, component: str = "fisher", center: str = "none") -> dict:
    """Whether vectors are uncorrelated over time: the largest lagged correlation, the
    sum of products of inner products a lag apart over all pairs of times, or both.

    The sum over pairs of times is the square of the lagged products' sum less its
    equal times, so that no pair of rows meets.  Autocovariances have divisor n.
    """
    c = _centred(df, center)
    n, p, m, same = _lagged(df, lags, lambda x: x - c)
    if lags * p * p <= 1:
        raise ValueError("one lag of one column has no extreme-value law; use the portmanteau")
    v = np.diag(m[0]) / n
    if v.min() <= 0:
        raise ArithmeticError("a variance is zero")
    largest = math.sqrt(n) * float(np.abs(m[1:] / n / np.sqrt(np.outer(v, v))).max())
    gumbel = largest**2 - 2 * math.log(lags * p * p) + math.log(math.log(lags * p * p))
    pairs = ((m**2).sum((1, 2)) - same) / (n * (n - 1))
    if not pairs[0] > 0:
        raise ArithmeticError("the trace estimate is not positive")
    z = float(pairs[1:].sum()) / (math.sqrt(2 * lags / (n * (n - 1))) * pairs[0])
    p_max, p_sum = tails.gumbel_sf(gumbel), tails.normal_sf(z)
    found = {"max": gumbel, "sum": z, "p_max": p_max, "p_sum": p_sum, "trace": float(pairs[0]), "largest": largest}
    if component == "fisher":
        both = -2 * (math.log(p_max) + math.log(p_sum)) if p_max > 0 and p_sum > 0 else math.inf
        return {"statistic": both, "p_value": tails.fisher_two(p_max, p_sum), **found}
    return {"statistic": found[component], "p_value": found[f"p_{component}"], **found}


def spatial_sign_white_noise(df: DataFrame, lags: int = 1, center: str = "none", zero_action: str = "error") -> dict:
    """The sum test on the rows' spatial signs; zero rows raise, or stay as zeros ("keep")."""
    c = _centred(df, center)

    def prepare(x):
        u, r = signs(x - c)
        if zero_action == "error" and r.min() <= 0:
            raise ArithmeticError("a row has no direction")
        return u

    n, _, m, same = _lagged(df, lags, prepare)
    pairs = (m**2).sum((1, 2)) - same
    trace = float(pairs[0]) / (n * (n - 1))
    if not trace > 0:
        raise ArithmeticError("the trace estimate is not positive")
    raw = float((pairs[1:] / 2 / (n - np.arange(1, lags + 1))).sum())
    z = raw / (math.sqrt(lags / 2) * trace)
    return {"statistic": z, "p_value": tails.normal_sf(z), "raw": raw, "trace": trace}


def pesaran_cd(df: DataFrame) -> dict:
    """Rows are times, columns units: scaled sum of uncentred correlations."""
    t, n = dimensions(df)
    _, _, g = moments(df, n, np.zeros(n))
    r = g / np.sqrt(np.outer(np.diag(g), np.diag(g)))
    z = math.sqrt(2 * t / (n * (n - 1))) * float(r[np.triu_indices(n, 1)].sum())
    return {"statistic": z, "p_value": 2 * tails.normal_sf(abs(z))}


def gaussian_wilks_independence(df: DataFrame, p: int) -> dict:
    """The first ``p`` columns against the rest; Bartlett's statistic."""
    n, both = dimensions(df)
    q = both - p
    _, _, g = moments(df, both)
    log_lambda = np.linalg.slogdet(g)[1] - np.linalg.slogdet(g[:p, :p])[1] - np.linalg.slogdet(g[p:, p:])[1]
    x = -(n - 1 - (p + q + 1) / 2) * float(log_lambda)
    return {"statistic": x, "p_value": tails.chi2_sf(x, p * q), "lambda": math.exp(log_lambda)}


def alpha_fit(returns: DataFrame, factors: DataFrame | None = None) -> dict:
    """Least squares of every asset on an intercept and the factors, by id."""
    t, n = dimensions(returns)
    if factors is None:
        joined, k = returns.select("x", F.array().cast("array<double>").alias("f")), 0
    else:
        k = dimensions(factors)[1]
        joined = returns.select("id", "x").join(factors.select("id", F.col("x").alias("f")), "id").select("x", "f")

    def f(x, z):
        y = rows_of(x)
        d = np.column_stack([np.ones(len(y)), rows_of(z) if k else np.empty((len(y), 0))])
        return np.r_[len(y), (d.T @ d).ravel(), (d.T @ y).ravel(), (y.T @ y).ravel()]

    s = total(joined, f)
    m = k + 1
    dd, dy, yy = s[1 : 1 + m * m].reshape(m, m), s[1 + m * m : 1 + m * m + m * n].reshape(m, n), s[1 + m * m + m * n :].reshape(n, n)
    if int(s[0]) != t:
        raise ValueError("returns and factors are of different times")
    b = np.linalg.solve(dd, dy)
    scatter = yy - dy.T @ b
    return {"t": t, "n": n, "k": k, "alpha": b[0], "scatter": scatter, "h": 1 / float(np.linalg.inv(dd)[0, 0])}


def grs_alpha(returns: DataFrame, factors: DataFrame | None = None) -> dict:
    a = alpha_fit(returns, factors)
    t, n, k = a["t"], a["n"], a["k"]
    f = (t - n - k) / n * a["h"] / t * float(a["alpha"] @ np.linalg.solve(a["scatter"] / t, a["alpha"]))
    return {"statistic": f, "p_value": tails.f_sf(f, n, t - n - k)}


def _squared_t(a: dict) -> np.ndarray:
    return a["alpha"] ** 2 * a["h"] / (np.diag(a["scatter"]) / (a["t"] - a["k"] - 1))


def alpha_max(returns: DataFrame, factors: DataFrame | None = None) -> dict:
    a = alpha_fit(returns, factors)
    g = float(_squared_t(a).max()) - 2 * math.log(a["n"]) + math.log(math.log(a["n"]))
    return {"statistic": g, "p_value": tails.gumbel_sf(g)}


def _normal_quantile(p: float) -> float:
    low, high = -40.0, 40.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if tails.normal_sf(middle) > 1 - p else (low, middle)
    return (low + high) / 2


def pesaran_yamagata_alpha(returns: DataFrame, factors: DataFrame | None = None, p0: float = 0.1, delta: float = 1.0) -> dict:
    a = alpha_fit(returns, factors)
    n, v = a["n"], a["t"] - a["k"] - 1
    r = a["scatter"] / np.sqrt(np.outer(np.diag(a["scatter"]), np.diag(a["scatter"])))
    rho = r[np.triu_indices(n, 1)]
    keep = np.abs(math.sqrt(v) * rho) > _normal_quantile(1 - p0 / (2 * n**delta))
    tilde = 2 * float((rho[keep] ** 2).sum()) / (n * (n - 1))
    scale = v / (v - 2) * math.sqrt(2 * (v - 1) * (1 + (n - 1) * tilde) / (v - 4))
    z = float((_squared_t(a) - v / (v - 2)).sum()) / math.sqrt(n) / scale
    return {"statistic": z, "p_value": tails.normal_sf(z), "rho2": tilde}


def gaussian_alpha_combination(returns: DataFrame, factors: DataFrame | None = None) -> dict:
    p = min(1.0, 2 * min(pesaran_yamagata_alpha(returns, factors)["p_value"], alpha_max(returns, factors)["p_value"]))
    return {"statistic": p, "p_value": p}


def gaussian_alpha_cauchy(returns: DataFrame, trace_r2: float, factors: DataFrame | None = None) -> dict:
    """The sum of squared alphas over variances, standardised by a known trace of the squared
    correlation, and the largest squared t, by Cauchy's combination."""
    if not 0 < trace_r2 < math.inf:
        raise ValueError("the trace must be positive")
    a = alpha_fit(returns, factors)
    variance = np.diag(a["scatter"]) / (a["t"] - a["k"] - 1)
    if variance.min() <= 0:
        raise ArithmeticError("a residual variance is not positive")
    z = (a["t"] * float((a["alpha"] ** 2 / variance).sum()) - a["n"]) / math.sqrt(2 * trace_r2)
    g = float(_squared_t(a).max()) - 2 * math.log(a["n"]) + math.log(math.log(a["n"]))
    p = tails.cauchy_combination(tails.normal_sf(z), tails.gumbel_sf(g))
    return {"statistic": p, "p_value": p, "sum": z, "max": g}


def weighted_sign_alpha_oracle(scores: DataFrame, trace_r2: float, weight) -> dict:
    """From rows (x direction, radius, h): the weighted quadratic form of all pairs of
    times, with all nuisances known.  ``weight`` is a function of an array of radii."""
    t, n = dimensions(scores)
    if t < 2 or n < 2 or not trace_r2 > 0:
        raise ValueError("two times, two assets and a positive trace are needed")

    def f(x, radius, h):
        u, h = rows_of(x), h.to_numpy()
        if np.abs((u**2).sum(1) - 1).max() > 1e-8:
            raise ValueError("a direction is not of length 1")
        w = np.asarray(weight(radius.to_numpy()), float)
        return np.r_[h @ h, w @ w, ((h * w) ** 2) @ (u**2).sum(1), (h * w) @ u]

    s = total(scores.select("x", F.col("radius").cast("double"), F.col("h").cast("double")), f)
    if not (s[0] > 0 and s[1] > 0):
        raise ArithmeticError("the weights or the residualised intercept are zero")
    q, psi2 = n * float((s[3:] ** 2).sum() - s[2]) / s[0], s[1] / t
    z = float(q / (psi2 * math.sqrt(2 * trace_r2)))
    return {"statistic": z, "p_value": tails.normal_sf(z), "raw": float(q), "psi2": float(psi2)}


def benjamini_hochberg(p_values: DataFrame, q: float = 0.05) -> DataFrame:
    """Rows (id, p, rejected) by the step-up rule; equal p-values go together."""
    m = p_values.count()
    # equal p-values, however many, are one row that has the rank of their last
    different = p_values.groupBy(F.col("p").alias("id")).agg(F.count("*").cast("double").alias("value"))
    with prefix_sums(different, "value") as ranked:
        cut = ranked.where(F.col("id") <= q * F.col("s") / m).agg(F.max("id")).first()[0]
    return p_values.select("id", "p", (F.col("p") <= cut if cut is not None else F.lit(False)).alias("rejected"))
