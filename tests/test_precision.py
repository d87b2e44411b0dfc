"""Convex programs against closed forms, vertices and optimality; lagged tests against literal sums."""

import itertools
import math

import numpy as np
import pytest

from orbweave.functions import tails
from orbweave.operators import covariance, foundations, learning, location, precision, series
from tests.test_operators import frame, unit


@pytest.fixture(scope="module")
def rows():
    g = np.random.default_rng(8)
    return g.normal(size=(20, 4)) @ np.array([[1, 0.6, 0, 0], [0, 1, 0, 0.3], [0, 0, 1, 0], [0, 0, 0, 2]]) + 0.2


def test_graphical_lasso(spark, rows):
    s = np.array([[2.0, 0.7], [0.7, 1.0]])
    # of two columns: the covariance has the off-diagonal entry shrunk
    assert precision.graphical_lasso(s, 0.2).value == pytest.approx(np.linalg.inv([[2, 0.5], [0.5, 1]]), abs=1e-6)
    assert precision.graphical_lasso(s, 0.2, diagonal=True).value == pytest.approx(np.linalg.inv([[2.2, 0.5], [0.5, 1.2]]), abs=1e-6)
    assert precision.graphical_lasso(s, 0.9).value == pytest.approx(np.diag([0.5, 1]))
    fit = precision.gaussian_graphical_lasso(frame(spark, rows), 0.1, divisor="n-1")
    assert fit.source == pytest.approx(np.cov(rows.T))

    def loss(t):
        return np.trace(fit.source @ t) - np.linalg.slogdet(t)[1] + 0.1 * (np.abs(t).sum() - np.abs(np.diag(t)).sum())

    g = np.random.default_rng(1)
    for _ in range(200):
        d = g.normal(size=(4, 4)) * 1e-3
        assert loss(fit.value + d + d.T) >= loss(fit.value) - 1e-9
    with pytest.raises(ArithmeticError):
        precision.graphical_lasso(np.zeros((2, 2)), 0.1)
    with pytest.raises(ValueError):
        precision.graphical_lasso(s, -1)


def _least_norm(s, j, lam):
    """The best vertex of the program's arrangement of planes."""
    p = len(s)
    e = np.eye(p)[j]
    planes = [(s[i], e[i] + sign * lam) for i in range(p) for sign in (-1, 1)] + [(np.eye(p)[i], 0.0) for i in range(p)]
    best = math.inf
    for chosen in itertools.combinations(planes, p):
        a = np.array([c[0] for c in chosen])
        if abs(np.linalg.det(a)) > 1e-12:
            b = np.linalg.solve(a, [c[1] for c in chosen])
            if np.abs(s @ b - e).max() <= lam + 1e-9:
                best = min(best, np.abs(b).sum())
    return best


def test_clime(spark, rows):
    s = np.cov(rows.T[:3], bias=True)
    for lam in (0.05, 0.3):
        b, gap, _ = precision._clime_columns(s, np.arange(3), lam, 1e-7, 100_000)
        assert gap.max() <= 1e-7
        assert np.abs(b).sum(0) == pytest.approx([_least_norm(s, j, lam) for j in range(3)], abs=1e-5)
    b, _, _ = precision._clime_columns(s, np.arange(3), 0.3, 1e-7, 100_000)
    fit = precision.clime_precision(frame(spark, rows[:, :3]), 0.3)
    assert fit.value == pytest.approx(np.where(np.abs(b) <= np.abs(b.T), b, b.T), abs=1e-5)
    assert (fit.value == fit.value.T).all()
    assert fit.threshold(0.2) == pytest.approx(np.where(np.abs(fit.value) >= 0.2, fit.value, 0))
    assert not precision.clime(spark, s, 1.0).value.any()


def test_sign_precision(spark, rows):
    df = frame(spark, rows)
    a = 4 * foundations.sscm(df)
    assert precision.spatial_sign_precision(df, 0.1, "sglasso").value == pytest.approx(precision.graphical_lasso(a, 0.1, diagonal=True).value, abs=1e-6)
    assert precision.spatial_sign_precision(df, 0.2).source == pytest.approx(a)
    with pytest.raises(ValueError):
        precision.spatial_sign_precision(df, 0.1, "other")


def test_ec2(spark, rows):
    df = frame(spark, rows[:, :2])
    cov = np.cov(rows.T[:2], bias=True)
    r = cov[0, 1] / math.sqrt(cov[0, 0] * cov[1, 1])
    for lam, tau in ((0.1, 0.01), (0.0, 0.9)):
        want = math.copysign(min(max(abs(r) - lam, 0), 1 - tau), r)
        got = precision.ec2_covariance(df, lam, tau).value
        assert got[0, 1] / math.sqrt(got[0, 0] * got[1, 1]) == pytest.approx(want, abs=1e-6) and np.diag(got) == pytest.approx(np.diag(cov))


@pytest.mark.parametrize("block", [3, 1024])
def test_white_noise(spark, rows, block, monkeypatch):
    monkeypatch.setattr(series, "LAG_BLOCK", block)
    n, p = rows.shape
    df = spark.createDataFrame([(7 * i, r.tolist()) for i, r in enumerate(rows)], "id long, x array<double>").repartition(4)
    x, u = rows - rows.mean(0), unit(rows)

    def pairs(z, h):
        return sum((z[t] @ z[s]) * (z[t + h] @ z[s + h]) for t in range(n - h) for s in range(n - h) if t != s)

    got = series.feng_liu_ma_white_noise(df, 3, center="mean")
    trace, v = pairs(x, 0) / (n * (n - 1)), (x**2).mean(0)
    z = sum(pairs(x, h) for h in (1, 2, 3)) / (n * (n - 1)) / math.sqrt(6 / (n * (n - 1))) / trace
    top = math.sqrt(n) * max(np.abs(x[:-h].T @ x[h:] / n / np.sqrt(np.outer(v, v))).max() for h in (1, 2, 3))
    g = top**2 - 2 * math.log(3 * p * p) + math.log(math.log(3 * p * p))
    assert (got["trace"], got["sum"], got["largest"], got["max"]) == pytest.approx((trace, z, top, g))
    assert got["p_value"] == pytest.approx(tails.chi2_sf(-2 * math.log(tails.normal_sf(z) * tails.gumbel_sf(g)), 4))
    assert series.feng_liu_ma_white_noise(df, 3, "sum", "mean")["statistic"] == pytest.approx(z)
    got = series.spatial_sign_white_noise(df, 2)
    raw, trace = sum(pairs(u, h) / 2 / (n - h) for h in (1, 2)), pairs(u, 0) / (n * (n - 1))
    assert (got["raw"], got["trace"], got["statistic"]) == pytest.approx((raw, trace, raw / trace))
    with pytest.raises(ValueError):
        series.spatial_sign_white_noise(df, n - 1)


def test_supplied_scores(spark, rows):
    n, p = rows.shape
    theta, d = np.arange(4.0), np.arange(1.0, 5.0)
    y = (rows - theta) / np.sqrt(d)
    r = np.linalg.norm(y, axis=1)
    for weight, k in (("constant", r**0), ("inverse_norm", 1 / r), (np.log1p, np.log1p(r))):
        v = unit(y) * k[:, None]
        raw = 2 / (n * (n - 1)) * sum(v[i] @ v[j] for i in range(n) for j in range(i))
        got = location.oracle_weighted_sign_sum(frame(spark, rows), theta, d, weight, nu2=2.0, trace_r2=5.0)
        assert (got["raw"], got["nu2"], got["statistic"]) == pytest.approx((raw, (k**2).mean(), raw / (2 / p * math.sqrt(10 / (n * (n - 1))))))
    assert "p_value" not in location.oracle_weighted_sign_sum(frame(spark, rows), theta, d)
    h = np.linspace(0.5, 1.5, n)
    df = spark.createDataFrame([(i, u.tolist(), float(a), float(b)) for i, (u, a, b) in enumerate(zip(unit(y), r, h, strict=True))], "id long, x array<double>, radius double, h double")
    u = unit(y)
    q = p / (h @ h) * sum(h[s] * h[t] / r[s] / r[t] * (u[s] @ u[t]) for s in range(n) for t in range(n) if s != t)
    got = series.weighted_sign_alpha_oracle(df, 3.0, lambda x: 1 / x)
    assert (got["raw"], got["statistic"]) == pytest.approx((q, q / math.sqrt(6) / (r**-2.0).mean()))


def test_gaussian_alpha_cauchy(spark, rows):
    n, p = rows.shape
    t2 = n * rows.mean(0) ** 2 / rows.var(0, ddof=1)
    got = series.gaussian_alpha_cauchy(frame(spark, rows), 6.0)
    z, g = (t2.sum() - p) / math.sqrt(12), t2.max() - 2 * math.log(p) + math.log(math.log(p))
    assert (got["sum"], got["max"]) == pytest.approx((z, g)) and got["p_value"] == pytest.approx(tails.cauchy_combination(tails.normal_sf(z), tails.gumbel_sf(g)))


def test_plugin_classifiers(spark, rows):
    y = ["a" if i % 3 else "b" for i in range(20)]
    df = spark.createDataFrame([(i, r.tolist(), c) for i, (r, c) in enumerate(zip(rows, y, strict=True))], "id long, x array<double>, y string")
    first = np.array([c == "a" for c in y])
    m1, m2, w = rows[first].mean(0), rows[~first].mean(0), np.diag([1.0, 2, 3, 4])
    want = (rows - (m1 + m2) / 2) @ w @ (m1 - m2) + math.log(first.sum() / (~first).sum())
    for given in ({"precision": w}, {"covariance": np.linalg.inv(w)}):
        got = learning.sparse_plugin_lda(df, levels=("a", "b"), **given).predict(df).orderBy("id").collect()
        assert [r["score"] for r in got] == pytest.approx(want) and [r["label"] for r in got] == ["a" if s >= 0 else "b" for s in want]
    fit = precision.spatial_sign_precision(df, 0.1, "sglasso")
    c1, c2 = (foundations.spatial_median(df.where(f"y = '{c}'")).value for c in "ab")
    got = learning.spatial_sign_precision_lda(df, fit, levels=("a", "b")).predict(df).orderBy("id").collect()
    assert [r["score"] for r in got] == pytest.approx((rows - (c1 + c2) / 2) @ fit.value @ (c1 - c2), abs=1e-6)
    # a normal generator is the quadratic rule
    s1, s2 = np.cov(rows.T), np.eye(4)
    a = learning.elliptical_oracle(("a", "b"), m1, s1, m2, s2, lambda q: -q / 2, prior=(0.3, 0.7)).score(rows)
    assert a == pytest.approx(learning.gaussian_qda_oracle(("a", "b"), m1, s1, m2, s2, (0.3, 0.7)).score(rows))


def test_kendall_factor_number(spark, rows):
    d = [unit(rows[i] - rows[j]) for i in range(20) for j in range(i)]
    v = np.sort(np.linalg.eigvalsh(sum(np.outer(u, u) for u in d) / len(d)))[::-1] + 0.5 / 2
    got = learning.kendall_factor_number(frame(spark, rows), 3, 0.5)
    assert got["ratios"] == pytest.approx(v[:3] / v[1:]) and got["k"] == (v[:3] / v[1:]).argmax() + 1
    share = [math.log1p(v[j] / v[j:].sum()) for j in range(4)]
    assert learning.kendall_factor_number(frame(spark, rows), 3, 0.5, "mktcr")["ratios"] == pytest.approx([share[j] / share[j + 1] for j in range(3)])
    twice = np.vstack([rows, rows[:1]])
    with pytest.raises(ArithmeticError):
        learning.kendall_factor_number(frame(spark, twice), 2, 0.5)
    assert learning.kendall_factor_number(frame(spark, twice), 2, 0.5, zero_pair_action="zero")["k"] >= 1


def test_cheng_sscm_equality(spark, rows):
    other = rows[:13] * [1, 2, 1, 0.5] + 1
    a, b = frame(spark, rows), frame(spark, other)
    parts = []
    for df, x in ((a, rows), (b, other)):
        d = x - foundations.spatial_median(df).value
        u, r, n = unit(d), np.linalg.norm(d, axis=1), len(x)
        m1, m2, m3 = ((1 / r**k).mean() for k in (1, 2, 3))
        bias = (2 - 2 * m2 / m1**2 + m2**2 / m1**4) / n**2 + (-6 * m2**2 / m1**4 + 2 * m2 * m3 / m1**5 + 8 * m2 / m1**2 - 2 * m3 / m1**3) / n**3
        parts.append((u, n, sum((u[i] @ u[j]) ** 2 for i in range(n) for j in range(n) if i != j) / (n * (n - 1)), bias))
    (u, n1, s1, d1), (v, n2, s2, d2) = parts
    raw = 4 * (s1 + s2 - 2 * ((u @ v.T) ** 2).mean())
    q = 4 / (n1 + n2) * (n1 * (s1 - d1) + n2 * (s2 - d2))
    got = covariance.cheng_sscm_equality(a, b)
    assert got["raw"] == pytest.approx(raw, abs=1e-6)
    assert got["statistic"] == pytest.approx((raw - 4 * (d1 + d2)) / (2 * (1 / n1 + 1 / n2) / 6 * 4 * q), abs=1e-5)


def test_shao_threshold_lda(spark, rows):
    first = np.arange(20) % 3 > 0
    df = spark.createDataFrame([(i, r.tolist(), "a" if f else "b") for i, (r, f) in enumerate(zip(rows, first, strict=True))], "id long, x array<double>, y string")
    m1, m2 = rows[first].mean(0), rows[~first].mean(0)
    c = np.vstack([rows[first] - m1, rows[~first] - m2])
    s, d = c.T @ c / 20, m1 - m2
    t1, t2 = 0.8 * math.sqrt(math.log(4) / 20), 0.3 * (math.log(4) / 20) ** 0.25
    cut = np.where((np.abs(s) > t1) | np.eye(4, dtype=bool), s, 0)
    assert 0 < (cut == 0).sum() < 12
    want = (rows - (m1 + m2) / 2) @ np.linalg.solve(cut, np.where(np.abs(d) > t2, d, 0))
    got = learning.shao_threshold_lda(df, 0.8, 0.3, 0.25, levels=("a", "b")).predict(df).orderBy("id").collect()
    assert [r["score"] for r in got] == pytest.approx(want.tolist())


@pytest.mark.parametrize("scale", [1e-12, 1e-8, 1e-4, 1e3, 1e12])
def test_graphical_lasso_of_any_scale(scale):
    g = np.random.default_rng(8)
    x = g.normal(size=(40, 6)) @ g.normal(size=(6, 6))
    s = np.cov(x.T, bias=True)
    one = precision.graphical_lasso(s, 0.1)
    other = precision.graphical_lasso(scale * s, scale * 0.1)
    assert scale * other.value == pytest.approx(one.value, rel=1e-5, abs=1e-7 * np.abs(one.value).max())
