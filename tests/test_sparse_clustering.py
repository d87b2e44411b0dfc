"""Feature-weighted, screened and metric clustering against literal loops over all rows."""

import math

import numpy as np
import pytest

from orbweave.operators import sparse_clustering as sc


def frame(spark, x, parts=3):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(parts)


def rows(seed=0, n=60, p=6, k=3):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, p))
    x[:, :2] += 4 * np.eye(max(k, 2))[np.arange(n) % k][:, :2]
    return x


def bisected(a, bound):
    if bound == 1:
        return np.eye(len(a))[a.argmax()]
    low, high = 0.0, a.max()
    if a.sum() / np.linalg.norm(a) <= bound:
        return a / np.linalg.norm(a)
    for _ in range(300):
        t = (low + high) / 2
        w = np.maximum(a - t, 0)
        low, high = (t, high) if w.sum() > bound * np.linalg.norm(w) else (low, t)
    return w / np.linalg.norm(w)


def test_weights_meet_both_bounds():
    g = np.random.default_rng(1)
    for _ in range(200):
        a = g.exponential(size=g.integers(2, 30)) ** 2 * 10.0 ** g.integers(-8, 8)
        bound = g.uniform(1, math.sqrt(len(a)))
        np.testing.assert_allclose(sc.feature_weights(a, bound), bisected(a, bound), atol=1e-9)
    assert sc.feature_weights(np.array([1.0, 3.0, 3.0]), 1).tolist() == [0, 1, 0]
    with pytest.raises(ArithmeticError):
        sc.feature_weights(np.zeros(3), 1.2)


def farthest(x, k, first):
    at = [first - 1]
    while len(at) < k:
        at.append(int(((x[:, None] - x[at]) ** 2).sum(2).min(1).argmax()))
    return x[at]


def literal_weighted(x, k, s, start, medians):
    middle = (lambda z: np.median(z, 0)) if medians else (lambda z: z.mean(0))
    power = 1 if medians else 2
    label = (np.abs(x[:, None] - start) ** power).sum(2).argmin(1)
    for _ in range(100):
        c = np.array([middle(x[label == j]) for j in range(k)])
        gain = (np.abs(x - middle(x)) ** power).sum(0) - (np.abs(x - c[label]) ** power).sum(0)
        gain = np.maximum(gain, 0) * (1 if medians else 2)
        w = bisected(gain, s)
        new = (np.abs(x[:, None] - c) ** power @ w).argmin(1)
        if (new == label).all():
            return c, w, float(w @ gain), np.bincount(label, minlength=k)
        label = new
    raise AssertionError("no end")


@pytest.mark.parametrize("medians", [False, True])
def test_weighted_clusters_equal_literal_ones(spark, monkeypatch, medians):
    monkeypatch.setattr(sc, "BLOCK_ROWS", 16)
    f = sc.sparse_kmedian if medians else sc.sparse_kmeans
    for seed, s in ((0, 1.2), (2, 2.3)):
        x = rows(seed)
        if seed == 2:
            x = np.round(x)  # ties
        fit = f(frame(spark, x), 3, s)
        c, w, objective, sizes = literal_weighted(x, 3, s, farthest(x, 3, 1), medians)
        np.testing.assert_allclose(fit["centers"], c, atol=1e-12)
        np.testing.assert_allclose(fit["weights"], w, atol=1e-8)
        assert math.isclose(fit["objective"], objective, rel_tol=1e-9) and fit["sizes"].tolist() == sizes.tolist() and fit["certified"]
        out = sc.weighted_assign(frame(spark, x), fit["centers"], fit["weights"], medians).toPandas().sort_values("id")
        assert out["cluster"].tolist() == (np.abs(x[:, None] - c) ** (1 if medians else 2) @ fit["weights"]).argmin(1).tolist()


@pytest.mark.parametrize("fetched", [1 << 19, 10])
def test_medians_take_two_passes_or_bits(spark, monkeypatch, fetched):
    monkeypatch.setattr(sc, "BLOCK_ROWS", 16)
    monkeypatch.setattr(sc, "FETCHED", fetched)
    x = np.random.default_rng(3).standard_normal((90, 4))
    x[:, 1], x[::3, 2], x[:, 3] = np.round(x[:, 1]), -0.5, 2.0
    with sc.Sample(frame(spark, x)) as data:
        state = sc.State(0, np.array([x[0], x[1], np.full(4, 1e9)]))
        label = np.abs(x[:, None] - state.centers).sum(2).argmin(1)
        passes, plain = [], data.total
        monkeypatch.setattr(data, "total", lambda *a: passes.append(1) or plain(*a))
        got, = sc.column_medians(data, [state], [np.bincount(label, minlength=3)])
    assert (got[:2] == [np.median(x[label == k], 0) for k in range(2)]).all() and (got[2] == 1e9).all()
    assert len(passes) == (1 if fetched > 10 else 9)


def test_empty_clusters_are_errors_or_get_the_farthest_row(spark):
    x = np.array([[0.0, 0], [1, 0], [2, 0], [10, 1], [11, 0], [12, 1]])
    start = np.array([[1.0, 0], [11, 0], [500, 500]])
    with pytest.raises(ArithmeticError):
        sc.sparse_kmeans(frame(spark, x), 3, 1.2, initial=start)
    fit = sc.sparse_kmeans(frame(spark, x), 3, 1.2, initial=start, empty_action="farthest")
    assert fit["sizes"].min() >= 1 and fit["sizes"].sum() == 6
    with pytest.raises(ValueError):
        sc.sparse_kmeans(frame(spark, x), 3, 9.0)
    with pytest.raises(ValueError):
        sc.sparse_kmeans(frame(spark, np.zeros((4, 2))), 2, 1.0)


def test_bijections_permute_and_given_ones_are_followed(spark, monkeypatch):
    monkeypatch.setattr(sc, "BLOCK_ROWS", 8)
    for n in (1, 2, 3, 17, 256, 1000):
        where = sc.keyed_bijection(5, n)
        seen = {tuple(where(b, j, np.arange(n)).tolist()) for b in (1, 2) for j in (0, 1, 2)}
        assert all(sorted(s) == list(range(n)) for s in seen) and (n < 17 or len(seen) == 6)
    x = rows(4, 30, 3)
    g = np.random.default_rng(2)
    plan = np.array([[g.permutation(30) for _ in range(3)] for _ in range(2)])
    with sc.Sample(frame(spark, x)) as data:
        data.permute(2, sc._given(plan))
        got = data.rows_at(list(range(30)))
    assert (got[0] == x).all()
    for b in range(2):
        assert all((got[b + 1][:, j] == x[plan[b, j], j]).all() for j in range(3))


def test_gap_over_bounds_equals_single_fits(spark, monkeypatch):
    monkeypatch.setattr(sc, "BLOCK_ROWS", 16)
    x = rows(5, 45, 5)
    g = np.random.default_rng(3)
    plan = np.array([[g.permutation(45) for _ in range(5)] for _ in range(3)])
    grid = [2.0, 1.1, 1.5]
    for selection in ("max", "one_se"):
        got = sc.sparse_kmeans_select_s(frame(spark, x), 3, grid, permutations=plan, selection=selection)
        samples = [x] + [np.stack([x[q[j], j] for j in range(5)], 1) for q in plan]
        o = np.log([[literal_weighted(z, 3, s, farthest(z, 3, 1), False)[2] for s in sorted(grid)] for z in samples])
        gap = o[0] - o[1:].mean(0)
        se = math.sqrt(1 + 1 / 3) * o[1:].std(0, ddof=1)
        np.testing.assert_allclose([r["gap"] for r in got["table"]], gap, atol=1e-8)
        np.testing.assert_allclose([r["se"] for r in got["table"]], se, atol=1e-8)
        at = gap.argmax() if selection == "max" else np.flatnonzero(gap >= gap.max() - se[gap.argmax()])[0]
        assert got["selected"] == sorted(grid)[at]
    drawn = sc.sparse_kmeans_select_s(frame(spark, x), 3, [1.5], B=2, seed=7)
    assert drawn["objectives"].shape == (3, 1) and (drawn["objectives"][1:] < drawn["objectives"][0]).all()


def median(z):
    y = z.mean(0)
    for _ in range(20000):
        d = z - y
        r = np.linalg.norm(d, axis=1)
        on = r > 1e-13
        u = (d[on] / r[on, None]).sum(0)
        if np.linalg.norm(u) <= (~on).sum() + 1e-11 * len(z):
            return y
        for i in np.flatnonzero(r < 1e-3 * np.linalg.norm(z - z.mean(0), axis=1).max()):  # a row itself
            v = z - z[i]
            q = np.linalg.norm(v, axis=1)
            if np.linalg.norm((v[q > 0] / q[q > 0, None]).sum(0)) <= (q == 0).sum():
                return z[i]
        y = y + (1 - min(1, (~on).sum() / np.linalg.norm(u))) * u / (1 / r[on]).sum()
    return y


def test_spatial_medians_settle_in_few_passes(spark, monkeypatch):
    x = np.random.default_rng(12).standard_normal((200, 3)) * [1.0, 2, 5]
    with sc.Sample(frame(spark, x)) as data:
        passes, plain, squares = [], data.total, []
        monkeypatch.setattr(data, "total", lambda *a: passes.append(1) or plain(*a))
        group = sc.State(0, np.zeros((1, 3))), None, None
        got, = sc.spatial_medians(data, [group], [x.mean(0)], tol=1e-10, squares=squares)
    assert len(passes) <= 6
    np.testing.assert_allclose(got, median(x), atol=1e-8)
    u = (x - got) / np.linalg.norm(x - got, axis=1)[:, None]
    np.testing.assert_allclose(squares[0], u.T @ u, atol=1e-8)
    line = np.c_[np.arange(9.0) ** 2, np.zeros(9)]  # no curvature along a line
    with sc.Sample(frame(spark, line)) as data:
        assert sc.spatial_medians(data, [(sc.State(0, np.zeros((1, 2))), None, None)], [line.mean(0)])[0] == pytest.approx([16, 0], abs=1e-6)


def literal_screened(x, k, tau, start):
    label = ((x[:, None] - start) ** 2).sum(2).argmin(1)
    for _ in range(50):
        c = np.array([median(x[label == j]) for j in range(k)])
        on = np.abs(c - c.mean(0)).sum(0) >= tau
        new = ((x[:, None] - c)[..., on] ** 2).sum(2).argmin(1)
        if (new == label).all():
            return c, on, label
        label = new
    raise AssertionError("no end")


def test_screened_spatial_medians_equal_literal_ones(spark, monkeypatch):
    monkeypatch.setattr(sc, "BLOCK_ROWS", 16)
    for seed, tau in ((1, 2.5),):
        x = rows(seed)
        fit = sc.sparse_k_spatial_median(frame(spark, x), 3, tau, tol=1e-5, spatial_max_iter=3000, reset_excluded="overall_spatial_median")
        c, on, label = literal_screened(x, 3, tau, farthest(x, 3, 1))
        assert fit["active"].tolist() == on.tolist() and fit["sizes"].tolist() == np.bincount(label, minlength=3).tolist()
        np.testing.assert_allclose(fit["algorithm_centers"], c, atol=1e-3)
        np.testing.assert_allclose(fit["centers"], np.where(on, c, median(x)), atol=1e-3)
        assert math.isclose(fit["objective"], np.sqrt((((x - c[label]) * on) ** 2).sum(1)).sum(), rel_tol=1e-3)
    with pytest.raises(ArithmeticError):
        sc.sparse_k_spatial_median(frame(spark, rows(1)), 3, 1e6, tol=1e-3)
    assert sc._active(np.array([1.0, 3, 2]), 9.0, "largest").tolist() == [False, True, False] and sc._active(np.ones(3), 9.0, "all").all()


def test_common_sign_metric_equals_a_literal_loop(spark):
    x = rows(6)
    fit = sc.sm_sscm(frame(spark, x), 3, 0.2, tol=1e-5, spatial_max_iter=3000)
    label = ((x[:, None] - farthest(x, 3, 1)) ** 2).sum(2).argmin(1)
    for _ in range(50):
        c = np.array([median(x[label == j]) for j in range(3)])
        d = x - c[label]
        u = d / np.linalg.norm(d, axis=1)[:, None]
        m = np.linalg.inv(u.T @ u / len(x) + 0.2 * np.eye(6))
        q = np.einsum("nkp,pq,nkq->nk", x[:, None] - c, m, x[:, None] - c)
        new = q.argmin(1)
        if (new == label).all():
            break
        label = new
    np.testing.assert_allclose(fit["centers"], c, atol=1e-3)
    assert fit["sizes"].tolist() == np.bincount(label, minlength=3).tolist()
    assert math.isclose(fit["objective"], np.sqrt(q.min(1)).sum(), rel_tol=1e-3)


def test_thresholds_and_numbers_of_clusters_by_gap_and_ratio(spark, monkeypatch):
    monkeypatch.setattr(sc, "BLOCK_ROWS", 16)
    x = rows(8, 36, 4)
    g = np.random.default_rng(4)
    plan = np.array([[g.permutation(36) for _ in range(4)] for _ in range(2)])
    samples = [x] + [np.stack([x[q[j], j] for j in range(4)], 1) for q in plan]

    def dispersion(z, k, tau):
        c, on, label = literal_screened(z, k, tau, farthest(z, k, 1))
        return (np.bincount(label, minlength=k) * ((c[:, on] - median(z[:, on])) ** 2).sum(1)).sum(), on, label

    table = {}
    for k in (2, 3):
        o = np.log([[dispersion(z, k, t)[0] for t in (0.0, 0.5)] for z in samples])
        gap = o[0] - o[1:].mean(0)
        tau = (0.0, 0.5)[gap.argmax()]
        _, on, label = dispersion(x, k, tau)
        c = np.array([median(x[label == j][:, on]) for j in range(k)])
        apart = np.mean([np.linalg.norm(c[i] - c[j]) for i in range(k) for j in range(i)])
        within = np.linalg.norm(x[:, on] - c[label], axis=1).mean()
        table[k] = gap, tau, apart / (k - 1) / (within / (36 - k))
    settings = {"permutations": plan, "tol": 1e-5, "spatial_max_iter": 3000}
    one = sc.sparse_sm_select_tau(frame(spark, x), 3, [0.5, 0.0], **settings)
    np.testing.assert_allclose([r["gap"] for r in one["table"]], table[3][0], atol=2e-3)
    assert one["selected"] == table[3][1]
    both = sc.sparse_sm_select_k(frame(spark, x), [3, 2], [0.0, 0.5], **settings)
    np.testing.assert_allclose([r["ratio"] for r in both["table"]], [table[2][2], table[3][2]], rtol=2e-3)
    assert both["selected"] == max(table, key=lambda k: table[k][2])


def test_no_block_stays_kept(spark):
    sc.sparse_kmeans_select_s(frame(spark, rows(9)), 2, [1.5], B=1, seed=1)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_clusters_settle_after_more_than_a_hundred_steps(spark):
    x = np.random.default_rng(5).random((4000, 1))
    fit = sc.sparse_kmeans(frame(spark, x), 8, 1.0)
    assert fit["iterations"] > 100 and fit["sizes"].sum() == 4000
    label = np.abs(x - fit["centers"].T).argmin(1)
    assert fit["centers"][:, 0] == pytest.approx([x[label == k].mean() for k in range(8)])
    with pytest.raises(ArithmeticError):
        sc.sparse_kmeans(frame(spark, x), 8, 1.0, max_iter=3)


def test_passes_go_over_one_kept_table_of_all_copies(spark):
    x = np.random.default_rng(5).standard_normal((3000, 3))
    with sc.Sample(frame(spark, x)) as data:
        data.permute(2, sc.keyed_bijection(1, data.n))
        assert data.blocks.storageLevel.useMemory and data.blocks.rdd.getNumPartitions() == data.partitions
        assert data.blocks.groupBy("copy").count().count() == 3
        t = data.total(lambda copy, own, rows, out: out.__iadd__(np.eye(3)[copy] * rows.sum()), 3)
        assert np.allclose(t, x.sum())
    assert not data.blocks.storageLevel.useMemory
