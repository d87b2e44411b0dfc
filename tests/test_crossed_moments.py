"""Two-sample tests from sums over rows against those pair by pair."""

import math

import numpy as np
import pytest

from orbweave.operators import crossed_moments, leave_out


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(3).cache()


def skew(seed, n, p, shift=0.0):
    g = np.random.default_rng(seed)
    return (g.standard_normal((n, p)) + 0.3 * g.exponential(size=(n, p))) * np.arange(1, p + 1) + shift


def off(got, want):
    return abs(got["raw"] - want["raw"]) / math.sqrt(want["variance"]), abs(got["variance"] / want["variance"] - 1)


@pytest.mark.parametrize("m", [0.0, -1.0])
def test_two_samples_from_sums_over_rows(spark, monkeypatch, m):
    """No row is fitted by itself and no pair is gone through; twice the rows, less than half the error."""
    errors = []
    for n in (80, 160):
        x, y = frame(spark, skew(3, n, 6)), frame(spark, skew(4, n + 10, 6, 0.3))
        want = leave_out._crossed(x, y, m, 1e-11, 900)
        with monkeypatch.context() as c:
            c.setattr(leave_out, "REMAINDER", 0.0)
            for name in ("_settled", "_crossed_block"):
                c.setattr(leave_out, name, lambda *a: pytest.fail("by rows or pairs"))
            errors.append(off(leave_out._crossed(x, y, m, 1e-11, 900), want))
    assert all(b < a / 2 for a, b in zip(*errors, strict=True)) and max(errors[1]) < 60 / 160**2


def test_rows_without_much_effect_are_not_fitted_one_by_one(spark, monkeypatch):
    """With parameters as they are but for the tolerance, by which 1500 rows are enough for that."""
    x, y = frame(spark, skew(5, 1500, 5)), frame(spark, skew(6, 1400, 5))
    fitted = []
    monkeypatch.setattr(leave_out, "_settled", lambda *a, f=leave_out._settled: fitted.append(a[1].count()) or f(*a))
    got = leave_out.feng_zou_wang_two_sample(x, y, tol=3e-5)
    assert sum(fitted) < 400
    monkeypatch.setattr(leave_out, "_crossed_sums", lambda *a: None)
    want = leave_out.feng_zou_wang_two_sample(x, y, tol=1e-9)
    assert max(off(got, want)) < 1e-3


@pytest.mark.parametrize("m", [0.0, -1.0])
def test_heavy_rows_are_paired_one_by_one(spark, monkeypatch, m):
    """Far rows, and rows near the other sample's location: none is lost and none is twice there."""
    x, y = skew(7, 150, 6), skew(8, 170, 6, 3.0)
    x[:3] *= 30
    y[:2] *= 20
    y[5] = x[3:].mean(0) + 1e-3
    first, second = frame(spark, x), frame(spark, y)
    want = leave_out._crossed(first, second, m, 1e-9, 900)
    bound, seen = 0.08, []
    monkeypatch.setattr(leave_out, "REMAINDER", 1e-9 / bound**3)
    monkeypatch.setattr(crossed_moments, "side_sums", lambda *a, f=crossed_moments.side_sums: seen.append(f(*a)) or seen[-1])
    got = leave_out._crossed(first, second, m, 1e-9, 900)
    assert [0 < v["heavy"] < 38 for v in seen] == [True, True]
    assert max(off(got, want)) < 2e-3
