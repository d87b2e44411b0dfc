"""Operators against literal numpy versions on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.functions import tails
from orbweave.operators import covariance, foundations, learning, location, series, shrinkage
from orbweave.sources.samples import relliptical, rspherical


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(3)


@pytest.fixture(scope="module")
def data():
    g = np.random.default_rng(5)
    return g.normal(size=(15, 4)) @ np.diag([1, 2, 0.5, 1.5]) + 0.3, g.normal(size=(12, 4))


def unit(d):
    r = np.linalg.norm(d, axis=-1, keepdims=True)
    return np.divide(d, r, out=np.zeros_like(d), where=r > 0)


def test_tails():
    assert tails.normal_sf(1.96) == pytest.approx(0.0249978951, rel=1e-8)
    assert tails.chi2_sf(3.84, 1) == pytest.approx(0.05004352, rel=1e-6)
    assert tails.chi2_sf(3.0, 2) == pytest.approx(math.exp(-1.5), rel=1e-12)
    assert tails.f_sf(2.0, 2, 10) == pytest.approx((1 + 2 * 2 / 10) ** -5, rel=1e-12)
    assert tails.cauchy_combination(0.2, 0.2) == pytest.approx(0.2)
    assert tails.fisher_two(1.0, 1.0) == 1.0


def test_signs(spark):
    out = foundations.spatial_sign(frame(spark, [(0, 0), (3, 4), (-6, -8)])).orderBy("id").collect()
    assert [list(np.round(r["sign"], 12)) for r in out] == [[0, 0], [0.6, 0.8], [-0.6, -0.8]]
    big = foundations.spatial_sign(frame(spark, [(1e308, 1e308)])).first()
    assert big["sign"] == pytest.approx([math.sqrt(0.5)] * 2)


def test_medians_and_shapes(spark, data):
    assert foundations.spatial_median(frame(spark, [(-1, 0), (1, 0), (0, -1), (0, 1)])).value == pytest.approx([0, 0], abs=1e-8)
    x = data[0]
    df = frame(spark, x)
    fit = foundations.spatial_median(df)
    assert fit.converged and np.linalg.norm(unit(x - fit.value).mean(0)) <= 1e-7
    v = foundations.tyler_shape(df)
    z = x - x.mean(0)
    q = np.einsum("ij,jk,ik->i", z, np.linalg.inv(v.value), z)
    assert v.converged and (4 / 15 * (z / q[:, None]).T @ z) == pytest.approx(v.value, abs=1e-6)
    hr = foundations.hr_estimator(df, max_iter=300)
    assert hr.residual < 1e-6
    s = location.scaled_spatial_median(df)
    u = unit((x - s.value) / np.sqrt(s.shape))
    assert s.converged and np.abs(u.mean(0)).max() < 1e-6 and (u**2).mean(0) == pytest.approx([0.25] * 4, abs=1e-6)


def test_ranks(spark, data):
    x, y = data
    df = frame(spark, x)
    got = {r["id"]: r["rank"] for r in foundations.spatial_rank(df).collect()}
    want = unit(x[:, None] - x).mean(1)
    assert all(got[i] == pytest.approx(list(want[i])) for i in range(15))
    assert foundations.spatial_rank_covariance(df) == pytest.approx(want.T @ want / 15)
    pairs = np.array([unit(x[i] - x[j]) for i in range(15) for j in range(i)])
    assert foundations.spatial_kendall(df) == pytest.approx(pairs.T @ pairs / len(pairs))
    u = unit(x - x.mean(0))
    assert foundations.sscm(df, "mean") == pytest.approx(u.T @ u / 15)
    r = np.array([unit(a + x).mean(0) for a in x])
    q = 15 / 4 * r.mean(0) @ np.linalg.solve(r.T @ r / 15, r.mean(0))
    assert location.spatial_signed_rank_test(df)["statistic"] == pytest.approx(q)
    z = np.r_[x, y]
    r = unit(z[:, None] - z).mean(1)
    d = r[:15].mean(0) - r[15:].mean(0)
    q = 15 * 12 / 27 * d @ np.linalg.solve(r.T @ r / 26, d)
    assert location.spatial_rank_test(df, frame(spark, y))["statistic"] == pytest.approx(q)


def leave_two(x):
    n, out = len(x), 0.0
    for i in range(n):
        for j in range(n):
            if i != j:
                m = (x.sum(0) - x[i] - x[j]) / (n - 2)
                out += x[i] @ (x[j] - m) * (x[j] @ (x[i] - m))
    return out / (n * (n - 1))


def test_location(spark, data):
    x, y = data
    dx, dy = frame(spark, x), frame(spark, y)
    cq = location.chen_qin(dx, dy)
    assert (cq["a1"], cq["a2"]) == pytest.approx((leave_two(x), leave_two(y)))
    cross = sum(((a - x.mean(0)) @ (b - y.mean(0))) ** 2 for a in x for b in y) / (14 * 11)
    assert cq["a12"] == pytest.approx(cross)
    wpl = location.wang_peng_li(dx)
    u = unit(x)
    assert wpl["raw"] == pytest.approx(sum(u[i] @ u[j] for i in range(15) for j in range(i)))
    assert wpl["trace_b2"] == pytest.approx(leave_two(u))
    s = np.cov(x.T)
    assert location.hotelling_one_sample(dx)["t2"] == pytest.approx(15 * x.mean(0) @ np.linalg.solve(s, x.mean(0)))
    pa = 0.0
    for i in range(15):
        for j in range(15):
            if i != j:
                v = np.delete(x, [i, j], 0).var(0, ddof=1)
                pa += (x[i] * x[j] / v).sum()
    assert location.park_ayyala_numerator(dx) == pytest.approx(pa / 210)
    u = {r["dim"]: r["u"] for r in location.zhang_feng_two_sample_scores(dx, dy).collect()}
    greater = sum(a > b for a in x[:, 0] for b in y[:, 0])
    assert u[0] == pytest.approx((greater - 90) / math.sqrt(15 * 12 * 28 / 12))
    with pytest.raises(ValueError):
        location.zhang_feng_one_sample_scores(frame(spark, [(1.0,), (1.0,), (2.0,)]))
    with pytest.raises(ValueError):
        location.hotelling_one_sample(frame(spark, [(1.0,), (float("nan"),)]))
    paired = location.zhang_zhou_guo_paired(dx, dx.select("id", F.transform("x", lambda v: v * 0.5).alias("x")))
    assert paired["raw"] == pytest.approx(location.zhang_zhou_guo_linear(dx, np.eye(4) / 2)["raw"])


def test_covariance(spark, data):
    x, y = data
    dx, dy = frame(spark, x), frame(spark, y)
    g = x @ x.T
    n = 15
    u = covariance.trace_u_statistics(dx)
    off = [(i, j) for i in range(n) for j in range(n) if i != j]
    assert u["y2"] == pytest.approx(np.mean([g[i, j] ** 2 for i, j in off]))
    assert u["y4"] == pytest.approx(np.mean([g[i, j] * g[j, k] for i, j in off for k in range(n) if k not in (i, j)]))
    assert covariance.li_chen(dx, dy)["raw"] == pytest.approx(u["t2"] + covariance.trace_u_statistics(dy)["t2"] - 2 * (np.cov(x.T) * np.cov(y.T)).sum())
    s = np.cov(x.T, bias=True)
    assert covariance.john_sphericity(dx)["u"] == pytest.approx(4 * (s**2).sum() / np.trace(s) ** 2 - 1)
    assert covariance.gaussian_covariance_lrt(dx, s)["statistic"] == pytest.approx(0, abs=1e-9)
    assert covariance.threshold(np.array([1.0, -0.5, 0.2]), 0.5).tolist() == [1.0, 0.0, 0.0]
    assert covariance.poet_covariance(dx, 4, 0.5) == pytest.approx(s)
    assert covariance.elliptical_factor_number(frame(spark, np.outer(np.arange(-7.0, 8), [1, 1, 1, 1]) + x * 0.01), 2) == 1


def test_series(spark):
    v = np.sin(np.arange(50.0) * 1.3) + (np.arange(50) > 30) * 2
    df = spark.createDataFrame([(10 * i, float(a)) for i, a in enumerate(v)], "id long, value double")
    series.BLOCK = 64
    s = np.cumsum(v)
    c = np.abs(s - np.arange(1, 51) / 50 * s[-1]) / math.sqrt(50) / math.sqrt((np.diff(v) ** 2).sum() / 98)
    got = series.classical_cusum(df)
    assert got["statistic"] == pytest.approx(c[:-1].max()) and got["k"] == c[:-1].argmax() + 1
    z = v - v.mean()
    rho = [(z[h:] * z[:-h]).sum() / (z**2).sum() for h in (1, 2, 3)]
    assert series.portmanteau(df, 3)["rho"] == pytest.approx(rho)
    g = np.random.default_rng(1)
    r, f = g.normal(size=(20, 3)), g.normal(size=(20, 1))
    a = series.alpha_fit(frame(spark, r), frame(spark, f))
    d = np.c_[np.ones(20), f]
    b = np.linalg.lstsq(d, r, rcond=None)[0]
    assert a["alpha"] == pytest.approx(b[0]) and a["scatter"] == pytest.approx((r - d @ b).T @ (r - d @ b))
    p = spark.createDataFrame([(0, 0.01), (1, 0.02), (2, 0.5), (3, 0.03)], "id long, p double")
    assert {x["id"] for x in series.benjamini_hochberg(p, 0.05).where("rejected").collect()} == {0, 1, 3}


def test_learning(spark, data):
    x, y = data
    rows = [(i, list(map(float, r)), "A" if i < 15 else "B") for i, r in enumerate(np.r_[x, y + 1])]
    df = spark.createDataFrame(rows, "id long, x array<double>, y string")
    s = (14 * np.cov(x.T) + 11 * np.cov(y.T)) / 25
    w = np.linalg.solve(s, x.mean(0) - y.mean(0) - 1)
    z = np.r_[x, y + 1]
    want = (z - (x.mean(0) + y.mean(0) + 1) / 2) @ w + math.log(15 / 12)
    got = {r["id"]: r for r in learning.classical_lda(df, prior="empirical").predict(df).collect()}
    equal = {r["id"]: r["score"] for r in learning.classical_lda(df).predict(df).collect()}
    assert all(equal[i] == pytest.approx(want[i] - math.log(15 / 12)) for i in range(27))
    assert all(got[i]["score"] == pytest.approx(want[i]) and got[i]["label"] == ("A" if want[i] >= 0 else "B") for i in range(27))
    q = learning.classical_qda(df, prior="empirical")
    oracle = learning.gaussian_qda_oracle(("A", "B"), x.mean(0), np.cov(x.T), y.mean(0) + 1, np.cov(y.T), (15, 12))
    assert q.score(z) == pytest.approx(oracle.score(z))
    assert len(learning.fair_classifier(df, features=2).detail["features"]) == 2
    dx = df.select("id", "x")
    pca = learning.classical_pca(dx, 2)
    assert pca["values"] == pytest.approx(np.linalg.eigvalsh(np.cov(z.T))[::-1][:2])
    assert np.array(learning.scores(dx, pca).first()["scores"]).shape == (2,)
    cca = learning.classical_cca(dx, 2)
    m = np.cov(z.T)
    k = np.linalg.solve(m[:2, :2], m[:2, 2:]) @ np.linalg.solve(m[2:, 2:], m[2:, :2])
    assert sorted(cca["correlations"] ** 2) == pytest.approx(sorted(np.linalg.eigvals(k).real))
    t = learning.truncated_power(np.diag([3.0, 2.0, 1.0]), 1, 2)
    assert [list(np.round(v["vector"], 9)) for v in t] == [[1, 0, 0], [0, 1, 0]]


def test_clusters(spark):
    df = frame(spark, [[0.0], [1.0], [2.0], [8.0], [9.0], [10.0]])
    fit = learning.lloyd_kmeans(df, 2)
    assert sorted(fit["centers"].ravel()) == [1, 9] and fit["objective"] == 4
    m = learning.k_spatial_median(df, 2, initial=[[0.5], [8.5]])
    assert sorted(np.round(m["centers"].ravel(), 6)) == [1, 9] and m["objective"] == 4
    em = learning.gaussian_mixture(df, [0.5, 0.5], [[0.0], [10.0]], [[[1.0]], [[1.0]]])
    assert sorted(em["means"].ravel()) == pytest.approx([1, 9], abs=1e-3)


def test_generators(spark):
    a = rspherical(spark, 3000, 3, seed=4)
    assert a.count() == 3000 and a.orderBy("id").first() == rspherical(spark, 3000, 3, seed=4).orderBy("id").first()
    b = relliptical(spark, 2000, [1.0, 2.0], np.array([[4.0, 0], [0, 1.0]]), seed=1)
    x = np.array([r["x"] for r in b.collect()])
    assert x.mean(0) == pytest.approx([1, 2], abs=0.2) and x.var(0) == pytest.approx([4, 1], rel=0.2)


def test_registry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_sphericity_of_signs(spark, data):
    x, _ = data
    df = frame(spark, x)
    n, p = x.shape
    for center, c in (("mean", x.mean(0)), ("none", np.zeros(p))):
        u = unit(x - c)
        r = np.linalg.norm(x - c, axis=1)
        b = u.T @ u / n
        q = p / (n * (n - 1)) * sum((u[i] @ u[j]) ** 2 for i in range(n) for j in range(n) if i != j) - 1
        got = covariance.sign_sum_sphericity(df, center)
        r2, r3 = (r**-2.0).mean() / (1 / r).mean() ** 2, (r**-3.0).mean() / (1 / r).mean() ** 3
        delta = (2 - 2 * r2 + r2**2) / n**2 + (8 * r2 - 6 * r2**2 + 2 * r2 * r3 - 2 * r3) / n**3
        assert (got["raw"], got["delta"]) == pytest.approx((q, delta))
        plain = covariance.sign_sum_sphericity(df, center, "normal_limit")
        assert plain["statistic"] == pytest.approx((q - p * (n**-2 + 2 * n**-3)) / math.sqrt(4 * (p - 1) / (n * (n - 1) * (p + 2))))
        scores = [n * p * (p + 2) * (b[i, i] - 1 / p) ** 2 / (2 * (1 - 1 / p)) for i in range(p)]
        scores += [n * p * (p + 2) * b[i, j] ** 2 for i in range(p) for j in range(i)]
        assert covariance.sign_max_sphericity(df, center)["raw"] == pytest.approx(max(scores))
        a = p * (b**2).sum()
        w = min(1, max(0, (n / (n - 1) * (a - p / n) - 1) / (a - 1)))
        assert covariance.regularized_sign_covariance(df, center)["value"] == pytest.approx(w * p * b + (1 - w) * np.eye(p))
    both = covariance.adaptive_sphericity(df)
    assert 0 <= both["p_value"] <= 1
    at_center = frame(spark, np.r_[x, -x, np.zeros((1, p))])
    u = unit(np.r_[x, -x])
    m = 2 * n + 1
    want = p / (m * (m - 1)) * ((u @ u.T) ** 2).sum() - p / (m * (m - 1)) * 2 * n - 1
    assert covariance.sign_sum_sphericity(at_center, "none", "normal_limit")["raw"] == pytest.approx(want)
    with pytest.raises(ArithmeticError):
        covariance.sign_sum_sphericity(at_center, "none")
    with pytest.raises(ArithmeticError):
        covariance.regularized_sign_covariance(at_center, "none")


def test_fisher_sun_gallagher(spark, data):
    x, _ = data
    rows, p = x.shape
    n = rows - 1
    s = np.cov(x.T)
    got = covariance.fisher_sun_gallagher_sphericity(frame(spark, x))
    t = [np.trace(np.linalg.matrix_power(s, k)) for k in range(5)]
    a2 = n**2 / ((n - 1) * (n + 2) * p) * (t[2] - t[1] ** 2 / n)
    tau = n**5 * (n**2 + n + 2) / ((n + 1) * (n + 2) * (n + 4) * (n + 6) * (n - 1) * (n - 2) * (n - 3))
    k = n * (n**2 + n + 2)
    a4 = tau / p * (t[4] - 4 / n * t[3] * t[1] - (2 * n**2 + 3 * n - 6) / k * t[2] ** 2 + 2 * (5 * n + 6) / k * t[2] * t[1] ** 2 - (5 * n + 6) / (n * k) * t[1] ** 4)
    assert got["psi"] == pytest.approx(a4 / a2**2)


def test_sign_max_of_scaled_median(spark, data):
    x, _ = data
    n, p = x.shape
    df = frame(spark, x)
    fit = location.scaled_spatial_median(df)
    assert fit.converged
    z = (x - fit.value) / np.sqrt(fit.shape)
    r = np.linalg.norm(z, axis=1)
    assert unit(z).sum(0) == pytest.approx(np.zeros(p), abs=1e-4)
    assert p * (unit(z) ** 2).mean(0) == pytest.approx(np.ones(p), abs=1e-5)
    got = location.spatial_sign_max_test(df)
    raw = n * (fit.value**2 / fit.shape).max() * p * (1 - n**-0.5) * (1 / r).mean() ** 2
    assert got["raw"] == pytest.approx(raw)


def test_queries_of_all_coordinates(spark, tmp_path):
    """Every coordinate of every sign and rank, as numpy and the queries' SQL have them."""
    from orbweave.plans import registry

    x = np.random.default_rng(4).normal(size=(12, 64)).astype(np.float32)
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame([(k, k % 3, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, label int, embedding array<float>").write.parquet(path)
    x = x.astype(float)
    pairs = x[:, None] - x[None]
    norm = np.linalg.norm(pairs, axis=2, keepdims=True)
    want = {"sign": unit(x), "rank": (pairs / np.where(norm > 0, norm, 1)).mean(1)}
    for name, m in want.items():
        query = f"q_spatial_{name}_coordinates"
        got = {(r["id"], r["d"]): r["v"] for r in registry.queries()[query](spark, str(tmp_path)).collect()}
        assert got == pytest.approx({(i, k + 1): v for (i, k), v in np.ndenumerate(m)}, abs=1e-6)
        duckdb = pytest.importorskip("duckdb")
        with duckdb.connect() as c:
            c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/*.parquet')")
            assert {(i, d): v for i, d, v in c.execute(registry.oracle_sql()[query]).fetchall()} == pytest.approx(got, abs=2e-6)


def test_shrinkage(spark, data):
    x, _ = data
    df = frame(spark, x)
    s, n, p = np.cov(x.T), 15, 4
    found = {k: shrinkage.ollila_raninen_shrinkage(df, k) for k in ("ell1", "ell2", "ell3")}
    d = x - x.mean(0)
    g2 = (d**4).mean(0) / (d**2).mean(0) ** 2 - 3
    kappa = max(-2 / 6, np.mean(14 / (13 * 12) * (16 * g2 + 6)) / 3)
    u = unit(x - foundations.spatial_median(df).value)
    ell1 = min(p, max(1, n / (n - 1) * (p * ((u.T @ u / n) ** 2).sum() - p / n)))
    assert found["ell1"]["kappa"] == pytest.approx(kappa) and found["ell1"]["gamma"] == pytest.approx(ell1, rel=1e-6)
    assert found["ell3"]["gamma"] == min(found["ell1"]["gamma"], found["ell2"]["gamma"])
    for f in found.values():
        y = f["gamma"]
        w = (y - 1) / (y - 1 + kappa * (2 * y + p) / n + (y + p) / (n - 1))
        assert f["value"] == pytest.approx(w * s + (1 - w) * np.trace(s) / p * np.eye(p))
    # in two dimensions the map has a closed form; the identity stays itself
    v = np.array([0.01, 0.5, 3.0, 40.0])
    assert shrinkage.sign_map(v, 2) == pytest.approx(v * np.log(v) / (v - 1) / 2, abs=1e-8)
    assert shrinkage.inverse_sign_map(np.full(5, 0.2), 5) == pytest.approx(np.ones(5))
    shape = np.array([0.4, 0.8, 1.2, 1.6])
    assert shrinkage.inverse_sign_map(shrinkage.sign_map(shape, 4), 4) == pytest.approx(shape)
    for f in (shrinkage.basic_shape(df), shrinkage.basics_shape(df)):
        assert np.trace(f["value"]) == pytest.approx(4) and np.linalg.eigvalsh(f["value"]) == pytest.approx(np.sort(f["eigenvalues"]))
    values, vectors = np.linalg.eigh(u.T @ u / n)
    assert shrinkage.basic_shape(df)["value"] == pytest.approx((vectors * shrinkage.inverse_sign_map(values, 4)) @ vectors.T, abs=1e-5)


def test_growth_ratio_of_factors(spark, data):
    x, _ = data
    df = frame(spark, x)
    v = np.sort(np.linalg.eigvalsh(4 * foundations.sscm(df)))[::-1]
    grow = [math.log1p(v[0] / (v[0] + v[1] + v[2])) / math.log1p(v[1] / (v[1] + v[2])), math.log1p(v[1] / (v[1] + v[2])) / math.log1p(v[2] / v[2])]
    assert covariance.elliptical_factor_number(df, 2, "gr") == 1 + int(np.argmax(grow))
    assert covariance.elliptical_factor_number(df, 3, "er") == 1 + int(np.argmax(v[:3] / v[1:]))
    with pytest.raises(ValueError):
        covariance.elliptical_factor_number(df, 3, "gr")


def test_classical_statistics(spark, data):
    """Against formulas written out: shape, independence, alphas, signs."""
    x, _ = data
    df = frame(spark, x)
    s = np.cov(x.T)
    w = 4**4 * np.linalg.det(s) / np.trace(s) ** 4
    assert covariance.mauchly_sphericity(df)["statistic"] == pytest.approx(-(14 - (2 * 16 + 4 + 2) / 24) * math.log(w))
    assert covariance.nagao_identity(df)["statistic"] == pytest.approx(7 * ((s - np.eye(4)) ** 2).sum())
    u = unit(x - x.mean(0))
    assert covariance.spatial_sign_sphericity(df, "mean")["q"] == pytest.approx(4 * ((u.T @ u / 15) ** 2).sum() - 1)
    lam = np.linalg.det(s) / np.linalg.det(s[:2, :2]) / np.linalg.det(s[2:, 2:])
    assert series.gaussian_wilks_independence(df, 2)["lambda"] == pytest.approx(lam)
    market = np.sin(np.arange(15.0))[:, None]
    z = np.column_stack([np.ones(15), market])
    beta, *_ = np.linalg.lstsq(z, x, rcond=None)
    e = x - z @ beta
    sigma = e.T @ e / 15
    grs = (15 - 4 - 1) / 4 / (1 + market.mean() ** 2 / market.var()) * beta[0] @ np.linalg.solve(sigma, beta[0])
    factors = frame(spark, market)
    assert series.grs_alpha(df, factors)["statistic"] == pytest.approx(grs)
    t2 = beta[0] ** 2 / (np.diag(e.T @ e) / 13 * np.linalg.inv(z.T @ z)[0, 0])
    assert series.alpha_max(df, factors)["statistic"] == pytest.approx(t2.max() - 2 * math.log(4) + math.log(math.log(4)))
    both = series.pesaran_yamagata_alpha(df, factors)["p_value"], series.alpha_max(df, factors)["p_value"]
    assert series.gaussian_alpha_combination(df, factors)["p_value"] == pytest.approx(min(1, 2 * min(both)))
    sign = learning.spatial_sign_pca(df, 2, "mean")
    assert sign["values"] == pytest.approx(np.linalg.eigvalsh(u.T @ u / 15)[::-1][:2])
    pairs = unit(np.array([a - b for i, a in enumerate(x) for b in x[:i]]))
    kendall = np.linalg.eigh(pairs.T @ pairs / len(pairs))
    assert learning.kendall_pca(df, 2)["values"] == pytest.approx(kendall[0][::-1][:2])
    rts = learning.rts_factor(df, 1)
    assert np.abs(rts["loadings"][:, 0]) == pytest.approx(2 * np.abs(kendall[1][:, -1])) and rts["center"] == pytest.approx(x.mean(0))
    assert learning.robust_factor_subspace(df, 1, "kendall").shape == (4, 1)


def test_kmeans_start(spark):
    rows = [(0.0,), (1.0,), (2.0,), (8.0,), (9.0,), (10.0,)]
    df = frame(spark, rows)
    assert learning._maxmin_start(df, 2, 1).ravel().tolist() == [0.0, 10.0]
    assert learning._maxmin_start(df, 2, 1, first_index=6).ravel().tolist() == [10.0, 0.0]
    fit = learning.lloyd_kmeans(df, 2)
    assert sorted(fit["centers"].ravel().tolist()) == [1.0, 9.0] and fit["objective"] == pytest.approx(4) and fit["converged"]
    with pytest.raises(ValueError):
        learning.lloyd_kmeans(frame(spark, [(1.0,), (1.0,)]), 2)


def test_sums_in_a_tree(spark, data, monkeypatch):
    from orbweave.functions import partial

    df = frame(spark, data[0]).repartition(9)
    f = lambda x: np.r_[len(x), np.concatenate(x.to_pylist()).sum()]
    plain = partial.total(df.select("x"), f)
    monkeypatch.setattr(partial, "FAN_IN", 2)
    assert partial.total(df.select("x"), f) == pytest.approx(plain) and plain == pytest.approx([15, data[0].sum()])


def test_series_over_ranges(spark):
    values = [math.sin(k * k) for k in range(40)]
    df = spark.createDataFrame([(1000 * k * k, v) for k, v in enumerate(values)], "id long, value double").repartition(5)
    with series.prefix_sums(df, "value") as sums:
        rows = sums.orderBy("id").collect()
    assert [r["k"] for r in rows] == list(range(1, 41)) and [r["s"] for r in rows] == pytest.approx(np.cumsum(values).tolist())
    assert [r["was"] for r in rows] == [None, *values[:-1]]


def test_chi2_quantile():
    for df in (1, 2, 5, 64):
        for q in (1e-6, 0.05, 0.5, 0.99):
            assert 1 - tails.chi2_sf(tails.chi2_quantile(q, df), df) == pytest.approx(q, rel=1e-8)
    with pytest.raises(ValueError):
        tails.chi2_quantile(1.0, 3)


@pytest.mark.parametrize("center", [False, True])
def test_wang_yao_corrected_lrt(spark, data, center):
    x = data[0]
    n, p = x.shape
    m = n - center
    d = x - x.mean(0) * center
    values = np.linalg.eigvalsh(d.T @ d / m)
    y, beta = p / m, (d**4).mean() / (d**2).mean() ** 2 - 3
    raw = -np.log(values).sum() + p * math.log(values.mean()) + (p - m) * math.log(1 - y) - p
    want = (raw + math.log(1 - y) / 2 - beta * y / 2) / math.sqrt(-2 * math.log(1 - y) - 2 * y)
    found = covariance.wang_yao_corrected_lrt(frame(spark, x), center, None)
    assert found["statistic"] == pytest.approx(want) and found["beta"] == pytest.approx(beta)
    with pytest.raises(ValueError):
        covariance.wang_yao_corrected_lrt(frame(spark, x[:4]), center)


@pytest.mark.parametrize("score", ["sign", "wilcoxon", "spearman", "vdw"])
def test_hallin_paindaveine_shape(spark, data, score):
    x, shape = data[0], np.diag([1.0, 2.0, 1.5, 1.0]) + 0.2
    n, p = x.shape
    z = np.linalg.solve(np.linalg.cholesky(shape), (x - 0.3).T).T
    r, u = np.linalg.norm(z, axis=1), unit(z)
    q = (np.argsort(np.argsort(r)) + 1) / (n + 1)
    k, second = {"sign": (np.ones(n), 1), "wilcoxon": (q, 1 / 3), "spearman": (q**2, 1 / 5), "vdw": (np.array([tails.chi2_quantile(v, p) for v in q]), p * (p + 2))}[score]
    want = p * (p + 2) / (2 * n * second) * sum(k[i] * k[j] * ((u[i] @ u[j]) ** 2 - 1 / p) for i in range(n) for j in range(n))
    found = covariance.hallin_paindaveine_shape(frame(spark, x), shape, np.full(p, 0.3), score)
    assert found["statistic"] == pytest.approx(want) and found["df"] == 9
    if score == "wilcoxon":
        with pytest.raises(ValueError):
            covariance.hallin_paindaveine_shape(frame(spark, np.r_[x, x[:1]]), None, "mean", score)


def test_zhang_zhu_zhang(spark, data):
    x, y = data
    (n1, p), n2 = x.shape, len(y)
    n = n1 + n2
    s1, s2 = np.cov(x.T), np.cov(y.T)
    half = np.diag(1 / np.sqrt((n2 * np.diag(s1) + n1 * np.diag(s2)) / n))
    r1, r2 = half @ s1 @ half, half @ s2 @ half
    fair = [(k - 1) ** 2 / ((k - 2) * (k + 1)) * (np.trace(r @ r) - np.trace(r) ** 2 / (k - 1)) for k, r in ((n1, r1), (n2, r2))]
    trace = (n2**2 * fair[0] + n1**2 * fair[1] + 2 * n1 * n2 * np.trace(r1 @ r2)) / n**2
    pooled = (n2 * r1 + n1 * r2) / n
    factor = 1 + np.trace(pooled @ pooled) / p**1.5
    d = half @ (x.mean(0) - y.mean(0))
    found = location.zhang_zhu_zhang(frame(spark, x), frame(spark, y))
    assert found["statistic"] == pytest.approx(n1 * n2 / (n * p) * d @ d)
    assert found["factor"] == pytest.approx(factor) and found["df"] == pytest.approx(p * p / trace / (factor if factor <= 1.2 else 1))
    assert found["p_value"] == pytest.approx(tails.chi2_sf(found["df"] * found["statistic"], found["df"]))


def test_a_kept_sample_stays_kept_and_no_other_is(spark, data):
    df = frame(spark, data[0]).cache()
    df.count()
    foundations.spatial_median(df)
    shrinkage.basics_shape(df)
    assert df.storageLevel.useMemory
    df.unpersist()
    loose = frame(spark, data[0])
    shrinkage.ollila_raninen_shrinkage(loose, "ell3")
    foundations.spatial_kendall(loose)
    foundations.spatial_rank_covariance(loose)
    location.park_ayyala_numerator(loose)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_pairs_of_blocks_come_once(spark, data, monkeypatch):
    monkeypatch.setattr("orbweave.functions.partial.BLOCK_ROWS", 2)
    x = data[0]
    u = unit(x[:, None] - x[None]).reshape(-1, 4)
    assert foundations.spatial_kendall(frame(spark, x)) == pytest.approx(u.T @ u / (15 * 14))


@pytest.mark.parametrize("p", [2, 3, 8, 101, 5000, 10_000])
def test_sign_map_against_integrals(p):
    def integral(v):  # half of l e^(-p s / 2) / (e^-s + (1 - e^-s) l) over s from 0
        x, w = np.polynomial.legendre.leggauss(200)
        edges = np.r_[0, 10 ** np.linspace(-12, math.log10(160 / p), 70)]
        return sum((b - a) / 4 * (w * np.exp(-p / 2 * s) * v / (np.exp(-s) - np.expm1(-s) * v)).sum() for a, b in zip(edges[:-1], edges[1:], strict=True) for s in [(a + b) / 2 + (b - a) / 2 * x])

    v = np.array([1e-9, 1e-4, 0.3, 0.499, 0.501, 0.999999, 1, 1.000001, 2.5, 60, 3e4])
    assert shrinkage.sign_map(v, p) == pytest.approx([integral(x) for x in v], rel=1e-9)
    g = np.random.default_rng(p)
    shape = g.exponential(size=min(p, 2000)) ** 3
    if len(shape) == p:
        shape *= p / shape.sum()
        assert shrinkage.inverse_sign_map(shrinkage.sign_map(shape, p), p) == pytest.approx(shape, rel=1e-7)
    assert shrinkage.inverse_sign_map(np.full(p, 1 / p), p) == pytest.approx(np.ones(p))
    assert shrinkage.inverse_sign_map(np.r_[1.0, np.zeros(p - 1)], p)[0] == pytest.approx(p)


def test_fair_weights_are_means_of_both_variances(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(30, 5)) * np.r_[1, 2, 3, 4, 5]
    y = np.array(["a"] * 22 + ["b"] * 8)
    x[:22, :2] += 3
    x[22:] *= 3
    df = spark.createDataFrame([(i, [float(v) for v in r], k) for i, (r, k) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y string")
    fit = learning.fair_classifier(df, ("a", "b"), features=3)
    a, b = x[y == "a"], x[y == "b"]
    t = (a.mean(0) - b.mean(0)) / np.sqrt(a.var(0, ddof=1) / 22 + b.var(0, ddof=1) / 8)
    keep = np.argsort(-np.abs(t), kind="stable")[:3]
    w = np.zeros(5)
    w[keep] = 2 / (a.var(0, ddof=1) + b.var(0, ddof=1))[keep]
    assert fit.detail["direction"] == pytest.approx(w * (a.mean(0) - b.mean(0)))


def test_equal_p_values_are_one_row(spark):
    p = [0.001, 0.01, 0.01, 0.01, 0.04, 0.2, 1.0, 1.0, 1.0, 1.0]
    df = spark.createDataFrame(list(enumerate(p)), "id long, p double").repartition(4)
    got = {r["id"]: r["rejected"] for r in series.benjamini_hochberg(df, 0.1).collect()}
    ordered = np.sort(p)
    cut = max((v for k, v in enumerate(ordered, 1) if v <= 0.1 * k / 10), default=-1)
    assert got == {i: v <= cut for i, v in enumerate(p)}


def test_a_residual_variance_of_zero_raises():
    with pytest.raises(ArithmeticError):
        covariance.poet(np.diag([2.0, 1.0, -0.5]), 1, 0.1)


@pytest.mark.parametrize("scale, offset, zero_tol", [(1.0, 0.0, 0.0), (1e-180, 0.0, 0.0), (1e180, 0.0, 0.0), (1.0, 1e6, 0.0), (1.0, 0.0, 0.9)])
def test_directions_of_pairs_by_products_of_matrices(scale, offset, zero_tol):
    g = np.random.default_rng(3)
    x, y = g.normal(size=(30, 5)), g.normal(size=(40, 5))
    y[:10], y[10:20] = x[:10], x[:10] + 1e-7 * g.normal(size=(10, 5))
    x, y = scale * x + offset, scale * y + offset
    u = np.array([foundations.signs(row - y, zero_tol * scale)[0] for row in x])
    assert foundations._rank_sums(x, y, zero_tol * scale) == pytest.approx(u.sum(1), abs=1e-8 if offset else 1e-11)
    assert foundations._direction_gram(x, y, zero_tol * scale) == pytest.approx(np.einsum("ijk,ijl->kl", u, u), abs=1e-7 if offset else 1e-10)


def test_park_ayyala_pairs_by_sums_of_powers(spark, monkeypatch):
    g = np.random.default_rng(12)
    x = g.normal(size=(70, 3)) * [1, 2, 3] + [0.1, 0, 1]
    monkeypatch.setattr(location, "pairs_total", lambda *_: pytest.fail("pairs of rows met"))
    want = 0.0
    for i in range(70):
        for j in set(range(70)) - {i}:
            want += (x[i] * x[j] / np.delete(x, [i, j], 0).var(0, ddof=1)).sum()
    assert location.park_ayyala_numerator(frame(spark, x)) == pytest.approx(want / (70 * 69), rel=1e-12)


def test_sign_divides_by_what_is_computed_once(spark):
    df = spark.range(3).select("id", F.array(*(F.lit(float(k)) for k in range(-2, 3))).alias("x"))
    plan = foundations.spatial_sign(df)._jdf.queryExecution().optimizedPlan().toString()
    # the largest value is found for the norm and for the sign, not within functions of elements
    assert plan.count("array_max") <= 4
    u = foundations.spatial_sign(df).first()["sign"]
    assert u == pytest.approx(np.arange(-2, 3) / np.sqrt(10))
