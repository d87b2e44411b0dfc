"""Tests whose reference distribution is drawn: random signs or multipliers of stored scores.

Rows are numbered blocks (`sparse_clustering.Sample`).  The multipliers of a block are
keyed by seed, block and slice of replicates, so that a pass adds up, for a whole slice,
each replicate's weighted sum of rows, and a lost task draws the same again.  A
replicate is a vector of the sample's dimension, whatever the rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions.partial import total
from orbweave.operators.foundations import signs, spatial_median
from orbweave.operators.location import _positive
from orbweave.operators.sparse_clustering import Sample
from orbweave.sources.samples import rows_of

#: Numbers that a task adds up in one pass, at most about.
SLICE = 1 << 20
#: Replicates with every pattern of signs are counted up to so many; each task takes PATTERNS.
MOST_EXACT, PATTERNS = 1 << 20, 1 << 12


def _multipliers(kind: str, seed: int, begin: int, first: int, rows: int, replicates: int) -> np.ndarray:
    g = np.random.Generator(np.random.Philox(key=[seed, begin], counter=[0, 0, first, 0]))
    return g.standard_normal((rows, replicates)) if kind == "gaussian" else g.integers(0, 2, (rows, replicates)) * 2.0 - 1


def _slices(B: int, p: int) -> list[tuple[int, int]]:
    step = max(1, SLICE // (p + 1))
    return [(a, min(B, a + step)) for a in range(0, B, step)]


def _checked(B: int, seed: int | None, alpha: float) -> None:
    if B < 1 or seed is None or seed < 0 or not 0 < alpha < 1:
        raise ValueError("replicates, a seed and a level between 0 and 1 are needed")


def strong_correlation_sign_test(df: DataFrame, mu=None, multiplier: str = "rademacher", B: int = 9999, seed: int | None = None, alpha: float = 0.05, tol: float = 1e-8, max_iter: int = 1000) -> dict:
    """Inner products of all pairs of rows' signs about ``mu``, against multipliers of the signs about the spatial median.

    The sum over pairs is half of the squared norm of the summed signs less their squared norms; a row at its centre has
    a zero sign.  ``p_value`` counts replicates as large, with the sample itself; ``critical`` is
    their order statistic of number ceil((1 - alpha) B), and only a larger sum is ``rejected``.
    """
    _checked(B, seed, alpha)
    if multiplier not in ("rademacher", "gaussian"):
        raise ValueError(f"no multiplier {multiplier!r}")
    fit = spatial_median(df, tol=tol, max_iter=max_iter)
    if not fit.converged:
        raise ArithmeticError("the spatial median did not converge")
    with Sample(df) as data:
        n, p = data.n, data.p
        if n < 2:
            raise ValueError("at least two rows are needed")
        c = np.zeros(p) if mu is None else np.asarray(mu, float)

        def own(copy, number, x, out):
            u, _ = signs(x - c)
            out += np.r_[u.sum(0), (u**2).sum()]

        t = data.total(own, p + 1)
        raw = float((t[:p] ** 2).sum() - t[p]) / 2
        drawn = []
        for first, last in _slices(B, p):
            m = last - first

            def sums(copy, number, x, out, first=first, m=m):
                u, _ = signs(x - fit.value)
                e = _multipliers(multiplier, seed, int(number[0]), first, len(x), m)
                out += np.c_[e.T @ u, (e**2).T @ (u**2).sum(1)].ravel()

            t = data.total(sums, m * (p + 1)).reshape(m, p + 1)
            drawn.append(((t[:, :p] ** 2).sum(1) - t[:, p]) / 2)
    drawn = np.concatenate(drawn)
    critical = float(np.sort(drawn)[math.ceil((1 - alpha) * B) - 1])
    pairs = math.sqrt(n * (n - 1) / 2)
    return {"statistic": raw / pairs, "raw": raw, "p_value": float((1 + (drawn >= raw).sum()) / (B + 1)), "critical": critical, "rejected": raw > critical, "location": fit.value, "replicates": drawn}


def half_differences(data: Sample) -> DataFrame:
    """Rows (copy, begin, rows) of half of each second row less the one before, in blocks; an odd last row goes.

    Pairs that two blocks share meet by their number.
    """
    p = data.p
    kinds = "copy int, begin long, rows binary"

    def whole(batches):
        for b in batches:
            for begin, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = np.frombuffer(data).reshape(-1, p)[begin % 2 :]
                x = x[: len(x) // 2 * 2]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([-(-begin // 2)], pa.int64()), pa.array([((x[1::2] - x[::2]) / 2).tobytes()], pa.binary())], names=["copy", "begin", "rows"])

    def ends(batches):
        for b in batches:
            for begin, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = np.frombuffer(data).reshape(-1, p)
                at = ([0] if begin % 2 else []) + ([len(x) - 1] if (begin + len(x)) % 2 else [])
                numbers = [begin + i for i in at]
                yield pa.RecordBatch.from_arrays([pa.array([k // 2 for k in numbers], pa.int64()), pa.array([k % 2 for k in numbers], pa.int64()), pa.array([x[i].tobytes() for i in at], pa.binary())], names=["pair", "odd", "row"])

    def joined(batches):
        for b in batches:
            rows = [((np.frombuffer(o) - np.frombuffer(e)) / 2).tobytes() for e, o in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b.num_rows, np.int32)), b.column(0), pa.array(rows, pa.binary())], names=["copy", "begin", "rows"])

    shared = data.blocks.mapInArrow(ends, "pair long, odd long, row binary").groupBy("pair").agg(F.min_by("row", "odd").alias("e"), F.max_by("row", "odd").alias("o"), F.count("*").alias("n"))
    return data.blocks.mapInArrow(whole, kinds).union(shared.where("n = 2").select("pair", "e", "o").mapInArrow(joined, kinds))


def approximate_randomization_test(x: DataFrame, y: DataFrame, calibration: str = "auto", B: int = 9999, seed: int | None = None, alpha: float = 0.05, max_exact: int = MOST_EXACT) -> dict:
    """Squared distance of two means, without each row's own square, against random signs of half differences.

    Half of each second row less the row before, by id, has no mean; the same statistic of
    these, each with a random sign, is the reference.  "exact" takes every pattern of signs (one of
    each two that differ in all), which "auto" does up to ``max_exact`` of them; then
    ``p_value`` is the share of patterns as large.  Else ``B`` are drawn by ``seed``, and the sample counts
    as one of them.
    """
    if calibration not in ("auto", "exact", "monte_carlo"):
        raise ValueError(f"no calibration {calibration!r}")
    with Sample(x) as a, Sample(y) as b:
        if a.p != b.p or min(a.n, b.n) < 4:
            raise ValueError("samples of one dimension and four rows or more are needed")
        p, sizes = a.p, (a.n // 2, b.n // 2)
        moments = []
        for s in (a, b):
            first = s.total(lambda copy, number, r, out: out.__iadd__(r.sum(0)), p) / s.n
            moments.append((first, float(s.total(lambda copy, number, r, out, first=first: out.__iadd__([((r - first) ** 2).sum()]), 1)[0]) / (s.n - 1)))
        raw = float(((moments[0][0] - moments[1][0]) ** 2).sum() - moments[0][1] / a.n - moments[1][1] / b.n)
        halves = [half_differences(s).persist() for s in (a, b)]
        try:
            exact = sum(sizes) <= 62 and 1 << sum(sizes) - 1 <= max_exact
            if calibration == "exact" and not exact:
                raise ValueError("too many patterns of signs")
            if calibration != "monte_carlo" and exact:
                found = _every_pattern(x, a, b, halves, sizes, raw)
            else:
                _checked(B, seed, alpha)
                found = _drawn_patterns(a, b, halves, sizes, raw, B, seed)
        finally:
            for h in halves:
                h.unpersist()
    return {"statistic": raw, "raw": raw, "rejected": found["p_value"] <= alpha, **found}


def _cross(tx: np.ndarray, qx: np.ndarray, ty: np.ndarray, qy: np.ndarray, sizes: tuple[int, int]) -> np.ndarray:
    """The statistic from each replicate's signed sums and the sums of squares."""
    m1, m2 = sizes
    return ((tx**2).sum(1) - qx) / (m1 * (m1 - 1)) + ((ty**2).sum(1) - qy) / (m2 * (m2 - 1)) - 2 * (tx * ty).sum(1) / (m1 * m2)


def _drawn_patterns(a: Sample, b: Sample, halves: list[DataFrame], sizes: tuple[int, int], raw: float, B: int, seed: int) -> dict:
    p, drawn = a.p, []
    for first, last in _slices(B, p):
        m, sums = last - first, []
        for which, (s, h) in enumerate(zip((a, b), halves, strict=True)):

            def f(copy, number, d, out, first=first, m=m, which=which):
                e = _multipliers("rademacher", seed * 2 + which, int(number[0]), first, len(d), m)
                out += np.r_[(e.T @ d).ravel(), (d**2).sum()]

            t = s.total(f, m * p + 1, h)
            sums += [t[:-1].reshape(m, p), t[-1]]
        drawn.append(_cross(*sums, sizes))
    drawn = np.concatenate(drawn)
    return {"p_value": float((1 + (drawn >= raw).sum()) / (B + 1)), "calibration": "monte_carlo", "evaluations": B, "variance": float(drawn.var(ddof=1)) if B > 1 else math.nan, "replicates": drawn}


def _every_pattern(x: DataFrame, a: Sample, b: Sample, halves: list[DataFrame], sizes: tuple[int, int], raw: float) -> dict:
    """All patterns in ranges of their numbers; a small matrix of inner products goes to every task."""
    d = []
    for h in halves:  # at most 63 rows together
        blocks = sorted((r["begin"], bytes(r["rows"])) for r in h.select("begin", "rows").collect())
        d.append(np.concatenate([np.frombuffer(v).reshape(-1, a.p) for _, v in blocks]))
    (m1, m2), (u, v) = sizes, d
    kernel = np.block([[u @ u.T / (m1 * (m1 - 1)), -u @ v.T / (m1 * m2)], [-v @ u.T / (m1 * m2), v @ v.T / (m2 * (m2 - 1))]])
    np.fill_diagonal(kernel, 0.0)
    patterns = 1 << m1 + m2 - 1

    def f(numbers):
        k = numbers.to_numpy()
        out = np.zeros(4)
        for at in range(0, len(k), PATTERNS):
            some = k[at : at + PATTERNS]
            e = 1.0 - 2 * ((some[:, None] >> np.arange(m1 + m2 - 1)) & 1)
            e = np.c_[np.ones(len(some)), e]  # the first sign stays
            t = np.einsum("ni,ij,nj->n", e, kernel, e)
            # a pattern equal to the sample but for rounding is as large
            out += [(t >= raw - 1e-12 * max(1.0, abs(raw))).sum(), t.sum(), (t**2).sum(), len(t)]
        return out

    spark = x.sparkSession
    t = total(spark.range(0, patterns, 1, max(1, min(-(-patterns // PATTERNS), 4096))).select("id"), f)
    return {"p_value": float(t[0] / t[3]), "calibration": "exact", "evaluations": patterns, "variance": float(_positive(t[2] / t[3] - (t[1] / t[3]) ** 2, "the variance of the patterns"))}
