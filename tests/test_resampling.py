"""Drawn and enumerated reference distributions against literal loops."""

import itertools
import math

import numpy as np
import pytest

from orbweave.operators import resampling, sparse_clustering
from orbweave.operators.foundations import spatial_median


def frame(spark, x, parts=3):
    return spark.createDataFrame([(3 * i + 1, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(parts)


def cq(x, y):
    def within(z):
        return ((z.sum(0) ** 2).sum() - (z**2).sum()) / (len(z) * (len(z) - 1))

    return within(x) + within(y) - 2 * x.mean(0) @ y.mean(0)


@pytest.mark.parametrize("n", [(9, 8), (10, 5)])
def test_every_pattern_of_signs(spark, monkeypatch, n):
    monkeypatch.setattr(sparse_clustering, "BLOCK_ROWS", 3)  # pairs lie in two blocks
    g = np.random.default_rng(sum(n))
    x, y = g.normal(size=(n[0], 5)) + 0.4, g.normal(size=(n[1], 5))
    got = resampling.approximate_randomization_test(frame(spark, x), frame(spark, y))
    u, v = ((z[1 : len(z) // 2 * 2 : 2] - z[: len(z) // 2 * 2 : 2]) / 2 for z in (x, y))
    t = [cq(u * np.array(e[: len(u)])[:, None], v * np.array(e[len(u) :])[:, None]) for e in itertools.product((1, -1), repeat=len(u) + len(v))]
    assert got["statistic"] == pytest.approx(cq(x, y))
    assert got["p_value"] == pytest.approx(np.mean(np.array(t) >= cq(x, y) - 1e-12))
    assert got["variance"] == pytest.approx(np.var(t)) and got["evaluations"] == len(t) // 2 and got["calibration"] == "exact"
    drawn = resampling.approximate_randomization_test(frame(spark, x), frame(spark, y), "monte_carlo", B=4000, seed=3)
    assert drawn["p_value"] == pytest.approx(got["p_value"], abs=0.04) and drawn["variance"] == pytest.approx(got["variance"], rel=0.15)
    assert drawn["p_value"] == (1 + (drawn["replicates"] >= drawn["raw"]).sum()) / 4001
    with pytest.raises(ValueError):
        resampling.approximate_randomization_test(frame(spark, x), frame(spark, y), "exact", max_exact=4)


@pytest.mark.parametrize("kind", ["rademacher", "gaussian"])
def test_strong_correlation_signs(spark, monkeypatch, kind):
    monkeypatch.setattr(sparse_clustering, "BLOCK_ROWS", 8)
    monkeypatch.setattr(resampling, "SLICE", 700)  # several slices
    g = np.random.default_rng(2)
    x = g.normal(size=(21, 4)) + 0.3
    x[4] = 0.0
    got = resampling.strong_correlation_sign_test(frame(spark, x), multiplier=kind, B=300, seed=5, alpha=0.1)

    def unit(z):
        r = np.linalg.norm(z, axis=1)[:, None]
        return np.divide(z, r, out=np.zeros_like(z), where=r > 0)

    u = unit(x)
    raw = sum(u[i] @ u[j] for i in range(21) for j in range(i))
    assert got["raw"] == pytest.approx(raw) and got["statistic"] == pytest.approx(raw / math.sqrt(210))
    fitted = unit(x - spatial_median(frame(spark, x)).value)
    assert len(got["replicates"]) == 300 and len(set(np.round(got["replicates"], 9))) > 250
    spread = 2 * sum((fitted[i] @ fitted[j]) ** 2 for i in range(21) for j in range(21) if i != j) / 4
    assert got["replicates"].var() == pytest.approx(spread, rel=0.4) and abs(got["replicates"].mean()) < 0.3 * math.sqrt(spread)
    assert got["p_value"] == (1 + (got["replicates"] >= raw).sum()) / 301
    assert got["critical"] == np.sort(got["replicates"])[269] and got["rejected"] == (raw > got["critical"])
    again = resampling.strong_correlation_sign_test(frame(spark, x), multiplier=kind, B=300, seed=5, alpha=0.1)
    assert np.allclose(again["replicates"], got["replicates"])
