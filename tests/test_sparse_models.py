"""Sparse discriminants and subspaces against plain long iterations and closed forms."""

import numpy as np
import pytest

from orbweave.operators import sparse_models


def labelled(spark, x, y):
    return spark.createDataFrame([(i, [float(v) for v in r], k) for i, (r, k) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y string").repartition(3)


@pytest.mark.parametrize("lam", [0.05, 0.6])
def test_dsda_equals_proximal_steps(spark, lam):
    g = np.random.default_rng(3)
    x = g.normal(size=(40, 6)) @ (np.eye(6) + 0.3)
    y = np.array(["a"] * 25 + ["b"] * 15)
    x[:25, 0] += 1.5
    x[25:, 2] += 1
    fit = sparse_models.dsda_classifier(labelled(spark, x, y), lam, ("a", "b"), tol=1e-9)
    code = np.where(y == "a", -40 / 25, 40 / 15)
    z, beta = x - x.mean(0), np.zeros(6)
    step = 1 / (2 * np.linalg.eigvalsh(z.T @ z / 40)[-1])
    for _ in range(60_000):
        v = beta + step * 2 * z.T @ (code - z @ beta) / 40
        beta = np.sign(v) * np.maximum(np.abs(v) - step * lam, 0)
    assert fit.detail["coefficients"] == pytest.approx(beta, abs=1e-6)
    middle = (x[:25].mean(0) + x[25:].mean(0)) / 2
    out = fit.predict(labelled(spark, x, y)).toPandas().sort_values("id")
    assert out["score"].to_numpy() == pytest.approx(-(x - middle) @ beta, abs=1e-5)
    empty = sparse_models.dsda_classifier(labelled(spark, x, y), 1e6, ("a", "b"))
    assert not empty.valid
    with pytest.raises(ValueError):
        empty.predict(labelled(spark, x, y))


def test_fantope_projection_and_optimum():
    g = np.random.default_rng(4)
    for p, k in ((3, 1), (6, 2), (6, 6), (9, 4)):
        m = g.normal(size=(p, p)) * 3
        h = sparse_models.onto_fantope(m, k)
        e = np.linalg.eigvalsh(h)
        assert e.min() > -1e-9 and e.max() < 1 + 1e-9 and np.trace(h) == pytest.approx(k)
        for _ in range(30):  # no other point of the set is nearer
            q = np.linalg.qr(g.normal(size=(p, p)))[0][:, :k]
            assert ((m + m.T) / 2 - h).ravel() @ (q @ q.T - h).ravel() < 1e-8
    s = np.cov(g.normal(size=(30, 7)).T @ np.eye(30), bias=True)
    s = s @ s
    values, vectors = np.linalg.eigh(s)
    plain = sparse_models.fantope(s, 2, 0.0, tol=1e-10)
    assert plain.value == pytest.approx(vectors[:, -2:] @ vectors[:, -2:].T, abs=1e-3) and plain.objective == pytest.approx(values[-2:].sum(), rel=1e-8)
    for tau in (0.05 * values[-1], 0.5 * values[-1]):
        fit = sparse_models.fantope(s, 2, tau, tol=1e-8)
        assert fit.gap <= 1e-7 * max(values[-1], abs(fit.objective))
        assert np.isclose(fit.objective, (s * fit.value).sum() - tau * np.abs(fit.value).sum())
    assert (np.abs(fit.sparse[~np.eye(7, dtype=bool)]) < 1e-6).all()  # a large penalty leaves the diagonal


def test_fantope_pca_of_any_scale(spark):
    g = np.random.default_rng(6)
    x = g.normal(size=(50, 5)) * np.r_[5, 1, 1, 3, 1]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    one = sparse_models.fantope_pca(df, 2, 0.4)
    assert one.objective == pytest.approx(sparse_models.fantope(np.cov(x.T, bias=True), 2, 0.4).objective)
    assert sorted(np.abs(one.vectors[[0, 3]]).max(0).round(1)) == [1.0, 1.0]
    other = sparse_models.fantope(1e6 * np.cov(x.T, bias=True), 2, 4e5)
    assert other.objective == pytest.approx(1e6 * one.objective, rel=1e-6)


def test_dsda_without_coefficients_scores_ties(spark):
    x = np.random.default_rng(7).normal(size=(12, 3))
    df = labelled(spark, x, ["a", "b"] * 6)
    for tie, label in (("class1", "a"), ("class2", "b")):
        fit = sparse_models.dsda_classifier(df, 1e6, ("a", "b"), tie=tie, empty="tie")
        out = fit.predict(df).collect()
        assert len(out) == 12 and {(r["score"], r["label"]) for r in out} == {(0.0, label)}
