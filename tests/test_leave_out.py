"""Leave-out tests of location against fits made one by one."""

import math

import numpy as np
import pytest

from orbweave.operators import leave_out, location


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(range(len(x)) if ids is None else ids, x, strict=True)], "id long, x array<double>").repartition(3)


def directions(e):
    r = np.linalg.norm(e, axis=-1)
    return e / r[..., None], r


def one_fit(x, m=0.0, tol=1e-10):
    """Location by r^m U, scale by unweighted signs, a row at a time from mean and variances."""
    c, d = x.mean(0), x.var(0, ddof=1)
    for _ in range(3000):
        u, r = directions((x - c) / np.sqrt(d))
        first, second = (r[:, None] ** m * u).sum(0), x.shape[1] * (u * u).mean(0)
        if max(abs(first).max() / (r**m).sum(), abs(second - 1).max()) <= tol:
            return c, d
        c, d = c + np.sqrt(d) * first / (r ** (m - 1)).sum(), d * second
    raise AssertionError


def location_fit(x, d, m, tol=1e-10):
    c = x.mean(0)
    for _ in range(3000):
        u, r = directions((x - c) / np.sqrt(d))
        first = (r[:, None] ** m * u).sum(0)
        if abs(first).max() / (r**m).sum() <= tol:
            return c
        c = c + np.sqrt(d) * first / (r ** (m - 1)).sum()
    raise AssertionError


def sample(seed, n, p, shift=0.0):
    return np.random.default_rng(seed).standard_t(5, (n, p)) * np.arange(1, p + 1) + shift


def normals(seed, n, p, shift=0.0):
    return np.random.default_rng(seed).standard_normal((n, p)) * np.arange(1, p + 1) + shift


def literal_pairs(x, mu, m):
    n, p = x.shape
    cross = square = product = 0.0
    for i in range(n):
        for j in range(i + 1, n):
            kept = np.delete(x, [i, j], 0)
            c, d = one_fit(kept)
            (u, v), (r, s) = directions((x[[i, j]] - mu) / np.sqrt(d))
            cross += (r * s) ** m * (u @ v)
            (a, b), _ = directions((x[[i, j]] - c) / np.sqrt(d))
            square += (a @ b) ** 2
            mean = directions((kept - mu) / np.sqrt(d))[0].mean(0)
            product += 2 * (r * s) ** (2 * m) * ((u - mean) @ v) * ((v - mean) @ u)
    pairs = n * (n - 1) / 2
    return cross / pairs, square / pairs**2, 2 * product / n**4


def test_feng_sun_against_single_fits(spark):
    x, mu = sample(1, 12, 6), np.linspace(-0.5, 0.5, 6)
    raw, variance, _ = literal_pairs(x, mu, 0.0)
    got = leave_out.feng_sun_one_sample(frame(spark, x), mu, tol=1e-9)
    assert got["raw"] == pytest.approx(raw, rel=1e-6)
    assert got["variance"] == pytest.approx(variance, rel=1e-6)
    assert got["statistic"] == pytest.approx(raw / math.sqrt(variance), rel=1e-6)


@pytest.mark.parametrize("m", [-1.0, 0.5])
def test_weighted_sign_sum_against_single_fits(spark, m):
    x, mu = sample(2, 11, 5), np.zeros(5)
    raw, _, variance = literal_pairs(x, mu, m)
    got = leave_out.weighted_sign_sum(frame(spark, x), mu, m, tol=1e-10)
    assert got["raw"] == pytest.approx(raw, rel=1e-6)
    assert got["variance"] == pytest.approx(variance, rel=1e-6)
    if m == -1:
        assert leave_out.inst_one_sample(frame(spark, x), mu, tol=1e-10)["statistic"] == pytest.approx(got["statistic"], rel=1e-9)


@pytest.mark.parametrize("remainder", [0.0, 2e-6, math.inf])
def test_pairs_from_fits_without_one_row_are_those_fitted(spark, monkeypatch, remainder):
    """All pairs, some, and none by the fits without one row: the same to third order of a row's effect."""
    x = normals(7, 70, 3)
    s, = leave_out._samples(frame(spark, x))
    mu = (np.full(3, 0.1) - s.shift) / s.unit
    monkeypatch.setattr(leave_out, "REMAINDER", remainder)
    for m, direct in ((0.0, False), (-1.0, True), (0.5, True)):
        sums, left = leave_out._nested(s, m, 1e-9, 500, mu, direct)
        n = 0 if left is None else left.count()
        assert n == 0 if remainder == 0 else n == 70 * 69 // 2 if math.isinf(remainder) else 0 < n < 70 * 69 // 2
        if left is not None:
            sums = sums + leave_out._fitted_sums(s, left, m, 1e-9, 500, mu, direct)
        assert sums == pytest.approx(leave_out._fitted_sums(s, leave_out._pairs(s), m, 1e-9, 500, mu, direct), rel=2e-3)


def test_third_order_of_what_pairs_leave_out(monkeypatch):
    """Twice the rows, an eighth of the error: a pair's fit from the one without its first row against its own."""
    off = []
    for n in (100, 200, 400, 800):
        x = np.random.default_rng(8).standard_normal((n, 4))
        total, squares, worst = x.sum(0), (x * x).sum(0), 0.0
        c, d, by_c, by_d = leave_out._followed(x, None, 0, total, squares, 1e-12, 500)
        for i in range(5):
            ci, di, _, first = leave_out._followed(x, i, i + 1, total, squares, 1e-12, 500)
            for j in range(i + 1, 6):
                cj, dj = one_fit(np.delete(x, j, 0), tol=1e-12)
                exact_c, exact_d = one_fit(np.delete(x, [i, j], 0), tol=1e-12)
                worst = max(worst, np.abs(np.log(di / exact_d) + first[j - i - 1] + np.log(dj / d) - by_d[j]).max())
        off.append(worst)
    assert off[3] < off[1] / 16 and off[2] < off[0] / 16 and off[3] < 1e-6


def test_second_order_of_pairs_follows_from_derivatives_of_all_rows(spark):
    """Location, log scale and its common factor beyond both rows' own fits: four times the rows, far less than a sixteenth of the error."""
    off = []
    for n in (100, 400):
        x = np.random.default_rng(8).standard_normal((n, 4)) * np.arange(1, 5)
        s, = leave_out._samples(frame(spark, x))
        x = (x - s.shift) / s.unit
        bends = leave_out._Bends(s, x, 1e-12, 500, True)
        bends.ready(x)
        factors = bends.factors(s, x, np.arange(5), 1e-12, 500)
        single, worst = [one_fit(np.delete(x, k, 0), tol=1e-12) for k in range(6)], np.zeros(3)
        for i in range(5):
            for j, got in enumerate(bends.of(i)(slice(i + 1, 6)), i + 1):
                c, d = one_fit(np.delete(x, [i, j], 0), tol=1e-12)
                moved = (c - single[i][0] - single[j][0] + bends.location) / np.sqrt(bends.scale)
                log = np.log(d * bends.scale / single[i][1] / single[j][1])
                worst = np.maximum(worst, [np.abs(moved - got[:4]).max(), np.abs(log - log.mean() - got[4:]).max(), abs(log.mean() - factors[i, j])])
        off.append(worst)
    assert (off[1] < off[0] / 30).all() and (off[1] < 2e-6).all()


def test_pairs_are_the_same_with_derivatives_of_each_row(spark, monkeypatch):
    x = normals(7, 70, 3)
    s, = leave_out._samples(frame(spark, x))
    mu = (np.full(3, 0.1) - s.shift) / s.unit
    monkeypatch.setattr(leave_out, "REMAINDER", 0.0)
    for m, direct in ((0.0, False), (-1.0, True), (0.5, True)):
        monkeypatch.setattr(leave_out, "SHARED_BYTES", 32 << 20)
        want, _ = leave_out._nested(s, m, 1e-9, 500, mu, direct)
        monkeypatch.setattr(leave_out, "SHARED_BYTES", 1700)  # the sample's 1680 bytes, but not the second derivatives' 1728
        assert leave_out._nested(s, m, 1e-9, 500, mu, direct)[0] == pytest.approx(want, rel=2e-3)


@pytest.mark.parametrize("m", [-1.0, 0.0, 0.5])
def test_crossed_block_by_products_is_that_of_single_pairs(m):
    """Also where a row lies on, or next to, the other sample's location."""
    g = np.random.default_rng(9)
    z, w, c1, c2, i1, i2 = (g.standard_normal((k, 4)) + 3 for k in (5, 6, 5, 6, 5, 6))
    i1, i2 = abs(i1), abs(i2)
    z[0], z[1], w[2] = c2[3], c2[4] + 1e-9, c1[0] - 1e-7
    literal = 0.0
    for k in range(5):
        for j in range(6):
            a, b = (z[k] - c2[j]) * i1[k], (w[j] - c1[k]) * i2[j]
            r = np.linalg.norm(a) * np.linalg.norm(b)
            literal += a @ b * r ** (m - 1) if r > 0 else 0.0
    assert leave_out._crossed_block(z, w, c1, c2, i1, i2, m) == pytest.approx(literal, rel=1e-6)


def literal_two(x, y, m):
    """The crossed statistic and its variance, pair by pair."""
    groups, p = (x, y), x.shape[1]
    full = [one_fit(g)[1] for g in groups]
    fits = []
    for g in groups:
        f = [one_fit(np.delete(g, i, 0)) for i in range(len(g))]
        fits.append([(location_fit(np.delete(g, i, 0), d, m) if m else c, d) for i, (c, d) in enumerate(f)])
    total, (n1, n2) = 0.0, (len(x), len(y))
    for i in range(n1):
        for j in range(n2):
            u, r = directions((x[i] - fits[1][j][0]) / np.sqrt(fits[0][i][1]))
            v, s = directions((y[j] - fits[0][i][0]) / np.sqrt(fits[1][j][1]))
            total -= (r * s) ** m * (u @ v)
    own = [[directions((g[i] - f[i][0]) / np.sqrt(f[i][1])) for i in range(len(g))] for g, f in zip(groups, fits, strict=True)]
    nu, c = ([np.mean([r**k for _, r in o]) for o in own] for k in (2 * m, m - 1))
    within = []
    for a, b, o in ((0, 1, own[0]), (1, 0, own[1])):
        bridge, n = np.sqrt(full[a] / full[b]), len(o)
        q = sum((o[k][0] @ (bridge * o[j][0])) ** 2 for k in range(n) for j in range(n) if j != k)
        within.append(2 * (nu[a] * c[b] / c[a]) ** 2 * p * p * q / (n * (n - 1)) / (n * (n - 1) * p * p))
    mixed = sum((u @ v) ** 2 for u, _ in own[0] for v, _ in own[1])
    return total / (n1 * n2), sum(within) + 4 * nu[0] * nu[1] * mixed / (n1 * n2) ** 2


@pytest.mark.parametrize("m", [0.0, -1.0])
def test_two_samples_against_single_fits(spark, m):
    x, y = normals(3, 9, 20), normals(4, 11, 20, 0.3)
    raw, variance = literal_two(x, y, m)
    test = leave_out.tinst_two_sample if m else leave_out.feng_zou_wang_two_sample
    got = test(frame(spark, x), frame(spark, y), tol=1e-10)
    assert got["raw"] == pytest.approx(raw, rel=1e-6)
    assert got["variance"] == pytest.approx(variance, rel=1e-6)
    # neither units nor the order of the samples matter
    other = test(frame(spark, y * 1e3 + 5), frame(spark, x * 1e3 + 5), tol=1e-10)
    assert other["statistic"] == pytest.approx(got["statistic"], rel=1e-6)


def test_blocks_that_meet_blocks_give_the_same(spark, monkeypatch):
    x, y = normals(3, 9, 20), normals(4, 11, 20, 0.3)
    first, second = frame(spark, x), frame(spark, y)
    tests = (lambda: leave_out.tinst_two_sample(first, second, tol=1e-3), lambda: leave_out.weighted_sign_sum(second, m=-1.0, tol=1e-3))
    shared = [t() for t in tests]
    monkeypatch.setattr(leave_out, "SHARED_BYTES", 0)
    monkeypatch.setattr(leave_out, "FITS", 20)
    for t, want in zip(tests, shared, strict=True):
        got = t()
        assert got["raw"] == pytest.approx(want["raw"], rel=1e-9) and got["variance"] == pytest.approx(want["variance"], rel=1e-9)


@pytest.mark.parametrize("m", [1.0, 0.0, -1.0])
def test_weighted_median_and_max(spark, m):
    x, mu = sample(5, 40, 8), np.full(8, 0.1)
    c, d = one_fit(x, m)
    fit = leave_out.weighted_scaled_spatial_median(frame(spark, x), m, tol=1e-10)
    assert np.allclose(fit.value, c, rtol=0, atol=1e-7) and np.allclose(fit.shape, d / d.max(), rtol=1e-7)
    r = np.linalg.norm((x - c) / np.sqrt(d), axis=1)
    raw = 40 * max((c - mu) ** 2 / d) * 8 * (1 - 40**-0.5) * np.mean(r ** (m - 1)) ** 2 / np.mean(r ** (2 * m))
    got = leave_out.weighted_max_test(frame(spark, x), mu, m, tol=1e-10)
    assert got["raw"] == pytest.approx(raw, rel=1e-6)
    if m == 0:
        assert got["raw"] == pytest.approx(location.spatial_sign_max_test(frame(spark, x), mu, 1e-10)["raw"], rel=1e-6)


def test_combinations(spark):
    df = frame(spark, normals(6, 24, 8))
    for got, largest, summed in (
        (leave_out.spatial_sign_maxsum(df), location.spatial_sign_max_test(df), leave_out.feng_sun_one_sample(df)),
        (leave_out.weighted_maxsum(df, m=0.0), leave_out.weighted_max_test(df, m=0.0), leave_out.weighted_sign_sum(df, m=0.0)),
    ):
        t = (math.tan((0.5 - largest["p_value"]) * math.pi) + math.tan((0.5 - summed["p_value"]) * math.pi)) / 2
        assert got["statistic"] == pytest.approx(t, rel=1e-6) and got["p_value"] == pytest.approx(0.5 - math.atan(t) / math.pi, rel=1e-6)


def test_rows_near_a_location_are_exact():
    g = np.random.default_rng(7)
    x, ids = g.standard_normal((30, 4)), np.arange(30)
    location_ = np.stack([x[3] + 1e-7, x[5]])
    scale, left = np.array([[1.0, 2, 3, 4], [2, 1, 1, 1]]), np.array([[1], [2]])
    got = leave_out._sums(ids, x, left, location_, scale, 0.0)
    for k in range(2):
        kept = [i for i in range(30) if i != left[k, 0]]
        e = (x[kept] - location_[k]) / np.sqrt(scale[k])
        r = np.linalg.norm(e, axis=1)
        on = r > 0
        u = e[on] / r[on, None]
        assert np.allclose(got[k], np.r_[u.sum(0), (u * u).sum(0), (1 / r[on]).sum(), on.sum(), (~on).sum()], rtol=1e-8, atol=1e-9)


def test_what_cannot_be_fitted_raises(spark):
    x = sample(8, 9, 3)
    with pytest.raises(ValueError, match="ids"):
        leave_out.feng_sun_one_sample(frame(spark, x, [0] * 9))
    with pytest.raises(ValueError, match="ids"):
        leave_out.feng_sun_one_sample(spark.createDataFrame([(None, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [0.0, 3.0]), (3, [4.0, 1.0])], "id long, x array<double>"))
    with pytest.raises(ValueError, match="four rows"):
        leave_out.feng_sun_one_sample(frame(spark, x[:3]))
    with pytest.raises(ArithmeticError, match="variation"):
        leave_out.feng_sun_one_sample(frame(spark, np.c_[x, np.ones(9)]))
    with pytest.raises(ArithmeticError, match="did not settle"):
        leave_out.feng_sun_one_sample(frame(spark, x), max_iter=2)
    with pytest.raises(ArithmeticError, match="inverse radius"):
        leave_out.weighted_sign_sum(frame(spark, sample(9, 12, 5)), sample(9, 12, 5)[0], -1.0)
    with pytest.raises(ValueError, match="at most 1"):
        leave_out.weighted_max_test(frame(spark, x), m=2.0)


def moments(spark, x, mu, m, direct, tol=1e-12, bound=math.inf):
    s, = leave_out._samples(frame(spark, x))
    mu = (mu - s.shift) / s.unit
    e = leave_out.pair_moments.Expansion(s, tol, 900, leave_out._curvature, leave_out._slopes, bool(m), bound)
    return s, mu, leave_out.pair_moments.pair_sums(s, e, mu, m, direct, bound)


@pytest.mark.parametrize("m,direct", [(0.0, False), (0.5, True)])
def test_sums_over_rows_give_those_over_pairs(spark, m, direct):
    """Twice the rows, a quarter of the relative error and less."""
    off = []
    for n in (60, 120):
        s, mu, got = moments(spark, normals(7, n, 4), np.full(4, 0.3), m, direct)
        want = leave_out._fitted_sums(s, leave_out._pairs(s), m, 1e-12, 900, mu, direct)
        off.append(abs(got[2:] / want[2:] - 1))
    assert (off[0] < 30 / 60**2).all() and (off[1] < 30 / 120**2).all() and off[1][0] < 2 / 120**2


def test_rows_that_change_the_fit_much_are_paired_one_by_one(spark, monkeypatch):
    """Some rows are not in the sums over rows; none is lost and none is twice there."""
    x, mu = normals(7, 90, 3), np.full(3, 0.1)
    x[:2] *= 30
    monkeypatch.setattr(leave_out, "REMAINDER", 1e-4)
    s, = leave_out._samples(frame(spark, x))
    at = (mu - s.shift) / s.unit
    called = []
    monkeypatch.setattr(leave_out, "_of_heavy", lambda *a, f=leave_out._of_heavy: called.append(len(a[2])) or f(*a))
    monkeypatch.setattr(leave_out, "_nested", lambda *a: pytest.fail("all pairs"))
    for m, direct in ((0.5, True),):
        bound = 0.2
        sums, left = leave_out._by_moments(s, m, 1e-4 * bound**3, 900, at, direct)
        if left is not None:
            sums = sums + leave_out._fitted_sums(s, left, m, 1e-9, 900, at, direct)
        want = leave_out._fitted_sums(s, leave_out._pairs(s), m, 1e-9, 900, at, direct)
        assert sums == pytest.approx(want, rel=2e-2)
    assert called and all(0 < h < 23 for h in called)
