"""Tests of location whose scale is fitted anew without the rows it is applied to.

A fit is a location and a diagonal scale of one sample without one or two of its rows, by
the diagonal Hettmansperger-Randles recursion: with e = (x - location) / root of scale, r = |e|
and U = e / r, the location moves until the mean of U is zero and the scale until p times the
mean of U squared is one in each column.  It starts at the mean and the variances of the rows
kept, as only these give the scale its common factor.

All fits step together: a block of fits meets a block of rows in four matrix products.  A
sample of up to ``SHARED_BYTES`` goes to the executors once, and each block of fits ends in
its task.  A larger one stays in blocks: blocks of fits meet blocks of rows, sums of a fit's
block are added after a shuffle, and what a step leaves is written to the shared folder.

Fits without a pair of rows are as many as pairs, and each is a pass over all rows.  Where both rows
move the fit little, ``_nested`` takes it from those without one row: to what both change alone comes a term of second order,
by derivatives at the fit of all rows (`_Bends`), with very many columns by derivatives along the steps of the fit without the first.
What is left out is of third order; pairs for which
``REMAINDER`` times it is not within the tolerance, and all pairs of a sample too large to share, are fitted themselves.

Ids must be there and differ.  A fit that does not settle, or comes to lie on a row it is fitted to, raises,
as does a column without variation among the rows kept, or a variance estimate that is not
positive.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions import tails
from orbweave.functions.partial import blocks, held, total
from orbweave.functions.states import States
from orbweave.operators import crossed_moments, pair_moments
from orbweave.operators.foundations import Fit
from orbweave.operators.location import spatial_sign_max_test
from orbweave.sources.samples import dimensions, rows_of

#: Rows of a sample are sent to the executors whole up to so many bytes.
SHARED_BYTES = 32 << 20
#: Fits in a block.
FITS = 256
#: A pair's fit may be off by so many times q of one row and the square of the other's, if that is larger; q is the row's own effect (`_effects`).
REMAINDER = 16.0
#: Rows that `_nested` goes through at once.
_CHUNK = 512
_BLOCK = "block long, ids binary, own binary, location binary, scale binary, residual binary, origin binary"
_NAMES = ("ids", "own", "location", "scale", "residual", "origin")


class _Sample:
    """A sample's rows, shifted and scaled by column, and their sums."""

    def __init__(self, df: DataFrame, shift: np.ndarray, unit: np.ndarray, rows: int) -> None:
        self.df, self.shift, self.unit, self.n, self.p = df, shift, unit, rows, len(shift)
        t = total(df.select("x"), lambda x: np.r_[self.scaled(x).sum(0), (self.scaled(x) ** 2).sum(0)])
        self.sum, self.squares = t[: self.p], t[self.p :]

    def __getstate__(self) -> dict:
        """What tasks get: all but the rows."""
        return {k: v for k, v in self.__dict__.items() if k != "df"}

    def scaled(self, x: pa.Array) -> np.ndarray:
        return (rows_of(x) - self.shift) / self.unit


def _samples(*dfs: DataFrame) -> list[_Sample]:
    """Samples in common units: about the mean of all rows, by their deviations."""
    sizes = [dimensions(df) for df in dfs]
    if len({p for _, p in sizes}) > 1:
        raise ValueError("samples of different dimension")
    if any(df.agg(F.count_distinct("id")).first()[0] != n for df, (n, _) in zip(dfs, sizes, strict=True)):
        raise ValueError("ids must be there and differ")
    n = sum(n for n, _ in sizes)
    mean = sum(total(df.select("x"), lambda x: rows_of(x).sum(0)) for df in dfs) / n
    square = sum(total(df.select("x"), lambda x: ((rows_of(x) - mean) ** 2).sum(0)) for df in dfs)
    if not square.min() > 0:
        raise ArithmeticError("a column without variation")
    return [_Sample(df, mean, np.sqrt(square / (n - 1)), k) for df, (k, _) in zip(dfs, sizes, strict=True)]


def _sums(ids: np.ndarray, x: np.ndarray, left: np.ndarray, location: np.ndarray, scale: np.ndarray, m: float) -> np.ndarray:
    """For each fit, over the rows but those of its ``left`` ids: the sums of r^m U, of U squared, of r^(m - 1) and
    of r^m, and the number of rows at the location (which take no other part).

    Squared radii come from products of matrices; rows so near the location that these
    would cancel are computed one by one.
    """
    a = 1 / scale
    squares = x * x
    size = squares @ a.T + (location * location * a).sum(1)
    r2 = size - 2 * (x @ (location * a).T)
    near_row, near_fit = np.nonzero(r2 < 1e-4 * size)
    exact = ((x[near_row] - location[near_fit]) ** 2 * a[near_fit]).sum(1)
    r2[near_row, near_fit] = exact
    on = np.ones(r2.shape, bool)
    order = np.argsort(ids)
    for k in range(left.shape[1]):
        at = np.minimum(np.searchsorted(ids, left[:, k], sorter=order), len(ids) - 1)
        there = ids[order[at]] == left[:, k]
        on[order[at[there]], np.nonzero(there)[0]] = False
    at_zero = (on & (r2 <= 0)).sum(0)
    on &= r2 > 0
    safe = np.where(on, r2, 1.0)
    inverse = np.where(on, 1 / safe, 0.0)
    if m == 0:
        weight, radial = np.sqrt(inverse), on.sum(0)
    else:
        weight = inverse if m == -1 else np.where(on, safe ** ((m - 1) / 2), 0.0)
        radial = (weight * np.sqrt(safe)).sum(0)
    weight = weight.copy()
    steps = weight.sum(0)
    near_weight, near_inverse = weight[near_row, near_fit], inverse[near_row, near_fit]
    weight[near_row, near_fit] = inverse[near_row, near_fit] = 0.0
    first = weight.T @ x - weight.sum(0)[:, None] * location
    second = inverse.T @ squares - 2 * location * (inverse.T @ x) + inverse.sum(0)[:, None] * location**2
    if len(near_row):
        d = x[near_row] - location[near_fit]
        np.add.at(first, near_fit, near_weight[:, None] * d)
        np.add.at(second, near_fit, near_inverse[:, None] * d * d)
    return np.column_stack([first * np.sqrt(a), second * a, steps, radial, at_zero])


def _moved(sums: np.ndarray, location: np.ndarray, scale: np.ndarray, residual: np.ndarray, n: int, m: float, tol: float, with_scale: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the sums make of fits that have not settled: location, scale and residual; settled ones stay."""
    p = location.shape[1]
    first, second, steps, radial, zeros = sums[:, :p], sums[:, p : 2 * p] * (p / n), sums[:, 2 * p], sums[:, 2 * p + 1], sums[:, 2 * p + 2]
    with np.errstate(all="ignore"):
        off = np.abs(first / radial[:, None]).max(1)
        if with_scale:
            off = np.maximum(off, np.abs(second - 1).max(1))
        lost = (zeros > 0) | ~np.isfinite(off)
        active = residual > tol
        go = (active & ~lost & (off > tol))[:, None]
        location = np.where(go, location + np.sqrt(scale) * first / steps[:, None], location)
        if with_scale:
            scale = np.where(go, scale * second, scale)
    return location, scale, np.where(active, np.where(lost, -np.inf, off), residual)


def _pending(residual: np.ndarray, tol: float) -> bool:
    """Whether a fit of a block is to move on; those lost have a residual of minus infinity."""
    return bool((residual > tol).any())


def _unpacked(columns: dict[str, bytes], p: int) -> list[np.ndarray]:
    ids = np.frombuffer(columns["ids"], "<i8")
    f = len(columns["location"]) // 8 // p
    return [ids.reshape(f, -1), np.frombuffer(columns["own"]).reshape(f, -1, p)] + [np.frombuffer(columns[c]).reshape(f, -1) for c in _NAMES[2:]]


def _packed(block: int, values: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block])] + [pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in values], names=["block", *_NAMES])


def _started(s: _Sample, left: DataFrame) -> DataFrame:
    """Blocks of fits from rows (ids, x...), ids those to leave out, x their vectors; each at its mean and variances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, FITS):
                b = batch.slice(start, FITS)
                ids = np.array(b.column(0).to_pylist(), "<i8")
                own = np.stack([s.scaled(c) for c in b.columns[1:]], axis=1)
                n = s.n - own.shape[1]
                mean = (s.sum - own.sum(1)) / n
                scale = (s.squares - (own**2).sum(1) - n * mean**2) / (n - 1)
                if scale.min() < 1e-13:
                    raise ArithmeticError("a column without variation among the rows kept")
                yield _packed(block, [ids, own, mean, scale, np.full((len(ids), 1), np.inf), np.zeros_like(mean)])
                block += 1

    return left.mapInArrow(run, _BLOCK)


def _settled(s: _Sample, left: DataFrame, power: float, tol: float, max_iter: int, origin: np.ndarray | None = None) -> DataFrame:
    """Blocks of fits, settled.  With a ``power`` other than 0 the location is fitted once more, from the
    mean, with r^power U in place of U and the scale as it is; ``origin`` asks for the sum of U about it,
    of all rows kept, by the fitted scale.
    """
    fits = _started(s, left)
    if s.n * s.p * 8 <= SHARED_BYTES:
        rows = [(np.frombuffer(r["ids"], "<i8"), (np.frombuffer(r["rows"]).reshape(-1, s.p) - s.shift) / s.unit) for r in blocks(s.df).select("ids", "rows").toLocalIterator()]
        shared = s.df.sparkSession.sparkContext.broadcast(rows)

        def run(batches):
            def sums(ids, location, scale, m):
                return sum(_sums(i, x, ids, location, scale, m) for i, x in shared.value)

            for batch in batches:
                for r in batch.to_pylist():
                    ids, own, start, scale, residual, at = _unpacked(r, s.p)
                    n, location, residual = s.n - ids.shape[1], start, residual[:, 0]

                    def settle(location, scale, residual, m, with_scale, ids=ids, n=n):
                        for _ in range(max_iter):
                            on = residual > tol
                            if not on.any():
                                break
                            location, scale = location.copy(), scale.copy()
                            location[on], scale[on], residual[on] = _moved(sums(ids[on], location[on], scale[on], m), location[on], scale[on], residual[on], n, m, tol, with_scale)
                        return location, scale, residual

                    location, scale, residual = settle(location, scale, residual.copy(), 0.0, True)
                    if power:
                        location, scale, residual = settle(start, scale, np.where(abs(residual) <= tol, np.inf, -np.inf), power, False)
                    if origin is not None:
                        at = sums(ids, np.broadcast_to(origin, location.shape), scale, 0.0)[:, : s.p]
                    yield _packed(r["block"], [ids, own, location, scale, residual, at])

        return fits.mapInArrow(run, _BLOCK)
    states = States(s.df.sparkSession)
    state = states.written(fits)
    rows = blocks(s.df).select("ids", "rows").withColumnsRenamed({"ids": "row_ids"})
    for m, with_scale in ((0.0, True),) + (((power, False),) if power else ()):
        if not with_scale:
            state = states.written(_mapped(state, s, lambda v, s=s: _again(v, s, tol)))
        for _ in range(max_iter):
            if not state.where(F.udf(lambda r: _pending(np.frombuffer(r), tol), "boolean")("residual")).limit(1).count():
                break

            def move(v, sums, m=m, with_scale=with_scale):
                v[2], v[3], r = _moved(sums, v[2], v[3], v[4][:, 0], s.n - v[0].shape[1], m, tol, with_scale)
                v[4] = r[:, None]
                return v

            state = states.written(_stepped(state, rows, s, m, None, move))
    if origin is not None:
        state = states.written(_stepped(state, rows, s, 0.0, origin, lambda v, sums: [*v[:5], sums[:, : s.p]]))
    return state


def _again(v: list[np.ndarray], s: _Sample, tol: float) -> list[np.ndarray]:
    """Settled fits at the mean of their rows again."""
    return [v[0], v[1], (s.sum - v[1].sum(1)) / (s.n - v[0].shape[1]), v[3], np.where(abs(v[4]) <= tol, np.inf, -np.inf), v[5]]


def _mapped(state: DataFrame, s: _Sample, f: Callable) -> DataFrame:
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                yield _packed(r["block"], f(_unpacked(r, s.p)))

    return state.mapInArrow(run, _BLOCK)


def _stepped(state: DataFrame, rows: DataFrame, s: _Sample, m: float, origin: np.ndarray | None, f: Callable) -> DataFrame:
    """``f`` of each block of fits and its sums over all rows, about ``origin`` where given."""

    def one(r):
        ids, _, location, scale, _, _ = _unpacked(r, s.p)
        x = (np.frombuffer(r["rows"]).reshape(-1, s.p) - s.shift) / s.unit
        return _sums(np.frombuffer(r["row_ids"], "<i8"), x, ids, location if origin is None else np.broadcast_to(origin, location.shape), scale, m)

    def added(value: Callable):
        def run(batches):
            at, sums = None, None
            for b in batches:
                for r in b.to_pylist():
                    if r["block"] != at:
                        if at is not None:
                            yield out(at, sums)
                        at, sums = r["block"], 0.0
                    sums = sums + value(r)
            if at is not None:
                yield out(at, sums)

        def out(at, sums):
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([np.asarray(sums).tobytes()], pa.binary())], names=["block", "sums"])

        return run

    parts = state.crossJoin(rows).mapInArrow(added(one), "block long, sums binary")
    sums = parts.repartition("block").sortWithinPartitions("block").mapInArrow(added(lambda r: np.frombuffer(r["sums"])), "block long, sums binary")

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                v = _unpacked(r, s.p)
                yield _packed(r["block"], f(v, np.frombuffer(r["sums"]).reshape(len(v[0]), -1)))

    return state.join(sums, "block").mapInArrow(run, _BLOCK)


def _pairs(s: _Sample, ids: np.ndarray | None = None, q: np.ndarray | None = None, tol: float = 0.0) -> DataFrame:
    """Every pair of rows once: (ids, x, y); with rows' effects ``q`` only those that `_nested` leaves."""
    spark = s.df.sparkSession
    first, second = s.df.select("id", "x"), s.df.select(F.col("id").alias("other"), F.col("x").alias("y"))
    n, keep = s.n, F.col("id") < F.col("other")
    if q is not None:
        on = ~(_off(q, q.max()) <= tol)
        n = int(on.sum())
        first, second = (df.join(F.broadcast(spark.createDataFrame(pa.table({name: ids[on], f"q_{name}": q[on]}))), name) for df, name in ((first, "id"), (second, "other")))
        keep &= ~(F.col("q_id") * F.col("q_other") * F.greatest("q_id", "q_other") <= tol)
    tasks = max(4 * spark.sparkContext.defaultParallelism, n * n // (128 * FITS))
    return first.repartition(min(s.n, tasks), "id").crossJoin(second).where(keep).select(F.array("id", "other").alias("ids"), "x", "y")


def _off(q: np.ndarray, other) -> np.ndarray:
    """By how much the fits of pairs of rows with these effects, times the root of ``REMAINDER``, may be off."""
    return q * other * np.maximum(q, other)


def _inner(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r = np.sqrt((e * e).sum(-1))
    return e / np.where(r > 0, r, 1.0)[..., None], r


def _started_without(x: np.ndarray, total: np.ndarray, squares: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variances of so many rows by their sums, less each row of ``x``."""
    mean = (total - x) / (rows - 1)
    return mean, (squares - x * x - (rows - 1) * mean**2) / (rows - 2)


def _followed(x: np.ndarray, skip: int | None, first: int, total: np.ndarray, squares: np.ndarray, tol: float, max_iter: int, look: Callable | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The fit of all rows but ``skip``, and by how much location and log scale change, to first order, without
    each of the rows from ``first`` on.

    ``look`` gets, before each step and at last with None for the step's own: U and U squared, 1 / r, the changes so far, what a
    change makes of both sums and of the sum of 1 / r, what it makes of the next, and the roots of the scale's factors.
    """
    n, p = x.shape
    if skip is not None:
        total, squares, n = total - x[skip], squares - x[skip] ** 2, n - 1
    location = total / n
    scale = (squares - n * location**2) / (n - 1)
    root = np.sqrt(scale)
    mean, variances = _started_without(x[first:], total, squares, n)
    change = np.hstack([(mean - location) / root, variances / scale - 1])
    own, inverses = np.empty((len(x), 2 * p)), np.empty((len(x), 1))  # U, U squared and 1 / r
    for _ in range(max_iter):
        m, both, radial = np.zeros((2 * p, 2 * p)), np.zeros((3, 2 * p)), 0
        a, b = 1 / root, location / root
        for at in range(0, len(x), _CHUNK):
            u = own[at : at + _CHUNK]
            e = x[at : at + _CHUNK] * a
            e -= b
            r = np.sqrt(np.einsum("ij,ij->i", e, e))
            if skip is not None and at <= skip < at + len(e):
                e[skip - at], r[skip - at] = 0.0, np.inf
            if not r.min() > 0:
                raise ArithmeticError("a fit lies on a row")
            inverse = 1 / r
            inverses[at : at + _CHUNK, 0] = inverse
            e *= inverse[:, None]
            u[:, :p] = e
            np.multiply(e, e, out=u[:, p:])
            e *= inverse[:, None]
            m[:, :p] += u.T @ e
            m[:, p:] += u.T @ u[:, p:]
            both += np.stack([np.ones(len(r)), inverse, inverse * inverse]) @ u
            radial += len(r) - np.isinf(r).sum()
        sums, second_sums, over, over2, squares_over, steps = both[0, :p], both[0, p:], both[1, :p], both[2, :p], both[1, p:], inverses.sum()
        second = second_sums * (p / n)
        settled = max(np.abs(sums / radial).max(), np.abs(second - 1).max()) <= tol
        if settled and look is None:
            return location, scale, change[:, :p] * root, change[:, p:]
        f = sums / steps
        if len(change) or look is not None:
            by = np.empty((2 * p, 2 * p))  # what a change (of location over root of scale, of log scale) makes of both sums
            by[:p, :p], by[:p, p:], by[p:, :p], by[p:, p:] = m[:p, :p].T, 2 * m[p:, :p].T, m[:p, p:].T / 2, m[p:, p:].T
            k = np.arange(p)
            by[k, k] -= steps
            by[k, k + p] -= 2 * over
            by[k + p, k] -= sums / 2
            by[k + p, k + p] -= second_sums
            if look is not None:
                of_sums, of_steps = by.copy(), np.r_[over2, squares_over / 2]
            if settled:
                look(own, inverses, change, of_sums, of_steps, None, None)
                return location, scale, change[:, :p] * root, change[:, p:]
            # and of the step: first sums over the sum of 1 / r, in roots of the next scale; logs of second sums over their rows
            by[:, :p] -= np.outer(np.r_[over2, squares_over / 2], f)
            unit = np.r_[1 / (steps * np.sqrt(second)), n / ((n - 1) * second_sums)]
            by *= unit
            by[k, k] += 1 / np.sqrt(second)
            by[k + p, k] += f / (2 * np.sqrt(second))
            by[k + p, k + p] += 1
            if look is not None:
                look(own, inverses, change, of_sums, of_steps, by, np.sqrt(second))
            shift = f * unit[:p]
            for at in range(0, len(change), _CHUNK):
                d = change[at : at + _CHUNK] @ by
                u = own[first + at : first + at + _CHUNK] * unit
                d -= u
                d[:, :p] += inverses[first + at : first + at + _CHUNK] * shift
                d[:, p:] += 1 / (n - 1)
                change[at : at + _CHUNK] = d
        location = location + root * f
        scale = scale * second
        root = np.sqrt(scale)
    raise ArithmeticError("a fit did not settle")


def _about(x: np.ndarray, origin: np.ndarray, scale: np.ndarray, skip: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The sum of U about ``origin`` of all rows but ``skip``, and its derivative by the log scale (transposed)."""
    p = x.shape[1]
    at, by = np.zeros(p), np.zeros((p, p))
    for a in range(0, len(x), _CHUNK):
        u, _ = _inner((x[a : a + _CHUNK] - origin) / np.sqrt(scale))
        if skip is not None and a <= skip < a + len(u):
            u[skip - a] = 0.0
        at += u.sum(0)
        by += (u * u).T @ u
    return at, (by - np.diag(at)) / 2


def _slopes(u: np.ndarray, inverse: np.ndarray, f: np.ndarray, g: float, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, what f . U + g / r + h . U squared changes by with e, and that times e."""
    v = f + 2 * h * u - u * ((u @ f) + 2 * ((u * u) @ h))[:, None] - g * inverse * u
    return v * inverse, u * v


def _curvature(u: np.ndarray, inverse: np.ndarray, f: np.ndarray, g: float, h: np.ndarray) -> np.ndarray:
    """Second derivatives of the sum of f . U + g / r + h . U squared over rows by (location over root of scale, log scale)."""
    p = u.shape[1]
    out, k = np.zeros((2 * p, 2 * p)), np.arange(p)
    for at in range(0, len(u), _CHUNK):
        w, i = u[at : at + _CHUNK], inverse[at : at + _CHUNK]
        a, b = w @ f, (w * w) @ h
        outer, plain = (3 * a + 8 * b)[:, None] + 3 * g * i, -(a + 2 * b)[:, None] - g * i
        cross = -(f + 4 * h * w)
        by_e, times_e = (v.sum(0) for v in _slopes(w, i, f, g, h))
        for rows, columns, weight, left, right, share, diagonal in ((0, 0, i * i, 1.0, 1.0, 1.0, 0.0), (0, p, i, 1.0, w, 0.5, by_e / 2), (p, p, np.ones_like(i), w, w, 0.25, times_e / 4)):
            x, y = weight * left, right * w
            out[rows : rows + p, columns : columns + p] += share * ((x * (outer * w + cross)).T @ y + (x * w).T @ (right * cross))
            out[rows + k, columns + k] += share * (x * right * (plain + 2 * h)).sum(0) + diagonal
    out[p:, :p] = out[:p, p:].T
    return out


def _curvatures(s: _Sample, shared, p: int, outputs: int) -> np.ndarray:
    """`_curvature` of each sum of U, then of U squared, by [change, change, sum]; ``shared`` has U and 1 / r of all rows."""
    spark = s.df.sparkSession

    def run(batches):
        u, inverse = shared.value
        for b in batches:
            for k in b.column(0).to_pylist():
                one = np.eye(p)[k % p]
                found = _curvature(u, inverse, one * (k < p), 0.0, one * (k >= p))
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([found.tobytes()], pa.binary())], names=["k", "found"])

    out = np.empty((2 * p, 2 * p, outputs))
    for r in spark.range(0, outputs, 1, min(outputs, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "k long, found binary").collect():
        out[:, :, r["k"]] = np.frombuffer(r["found"]).reshape(2 * p, 2 * p)
    return out


class _Bends:
    """How much the fit without two rows differs from what the fits without one of them say, to second order.

    At the fit of all rows both sums are zero (U, and U squared less 1 / p), which gives all but the scale's common factor; that follows from the steps
    taken, of which only its own derivatives, carried backwards, are needed.
    """

    def __init__(self, s: _Sample, x: np.ndarray, tol: float, max_iter: int, with_location: bool) -> None:
        p = s.p
        self.steps, last = [], []

        def look(own, inverses, change, of_sums, of_steps, by, roots):
            if by is None:
                last.extend((own.copy(), inverses.copy(), of_sums))
            else:
                self.steps.append((by.copy(), roots))

        self.location, self.scale, _, _ = _followed(x, None, len(x), s.sum, s.squares, tol, max_iter, look)
        own, inverses, of_sums = last
        shared = s.df.sparkSession.sparkContext.broadcast((own[:, :p].copy(), inverses))
        bent = _curvatures(s, shared, p, 2 * p)
        common = np.r_[np.zeros(p), np.ones(p)]
        inverse = np.linalg.inv(of_sums - len(x) / p**2 * np.outer(common, common))
        self.inverse, self.out = inverse, inverse if with_location else inverse[:, p:]
        self.bent = np.ascontiguousarray(bent @ self.out)
        # derivatives of the mean log scale at last by what each step starts from
        back = common / p
        for k in range(len(self.steps) - 1, -1, -1):
            by, roots = self.steps[k]
            self.steps[k] = np.r_[back[:p] / roots, back[p:]]
            back = by @ back
        self.start = back

    def ready(self, x: np.ndarray) -> None:
        """Once a task, what all rows have."""
        p = x.shape[1]
        u, r = _inner((x - self.location) / np.sqrt(self.scale))
        inverse = 1 / r[:, None]
        rows = np.hstack([u, u * u, u * inverse, inverse, np.ones_like(inverse)])
        self.effects = np.hstack([u, u * u - 1 / p]) @ self.inverse
        self.products = (np.hstack([u, 2 * u * u]) @ self.out).astype(np.float32)
        self.exact, self.rows = rows, rows.astype(np.float32)

    def of(self, i: int) -> Callable[[slice], np.ndarray]:
        """For row i with each of a slice of rows: changes of location over root of scale (where asked for) and of log scale, whose
        mean is 0.  Single precision is enough for what is of second order."""
        p = len(self.scale)
        a, row = self.effects[i], self.exact[i]
        u, inverse = row[:p], row[3 * p]
        own = np.empty((2 * p, p))  # derivatives of row i's U
        own[:p], own[p:] = (np.outer(u, u) - np.eye(p)) * inverse, (np.outer(u * u, u) - np.diag(u)) / 2
        m = self.inverse @ (np.hstack([own, 2 * own * u]) @ self.out - np.tensordot(a, self.bent, 1))
        weights = np.vstack([m, -2 * a[:p, None] * self.out[p:], -a[:p] @ self.out[:p], -m[p:].sum(0) / p])
        weights[:p] -= a[p:, None] / 2 * self.out[:p]
        weights[p : 2 * p] -= a[p:, None] * self.out[p:]
        share = np.r_[np.zeros(p), a[p:] / 2, a[:p], 0.0, 0.0]
        weights, share = weights.astype(np.float32), share.astype(np.float32)

        def at(others: slice) -> np.ndarray:
            rows = self.rows[others]
            out = (rows @ share)[:, None] * self.products[others]
            out += rows @ weights
            return out

        return at

    def factors(self, s: _Sample, x: np.ndarray, some: np.ndarray, tol: float, max_iter: int) -> np.ndarray:
        """For some rows with every row, the change of the mean log scale."""
        n, p = x.shape
        y = x - s.sum / n
        q, (a, b) = (y * y).sum(0), (self.start[:p], self.start[p:])
        along = y @ (a / np.sqrt(q / (n - 1))) / n**2
        out = b.sum() / (n - 1) ** 2 - along[some, None] - along
        out -= (y[some] * (2 * b / (n * q))) @ y.T
        out -= (y[some] ** 2 * (b / q**2)) @ (y * y).T
        at = iter(self.steps)

        def look(own, inverses, change, of_sums, of_steps, by, roots):
            back = next(at, None)
            if by is None or back is None:
                return
            u, a, b = own[:, :p], back[:p], back[p:]
            first, second, steps = u.sum(0), own[:, p:].sum(0), inverses.sum()
            f, g, h = a / steps, -(a @ first) / steps**2, b / second
            bent = _curvature(u, inverses, f, g, h)
            moved, slower = change @ of_sums - own, change @ of_steps - inverses[:, 0]
            by_e, times_e = _slopes(u, inverses, f, g, h)
            slopes = np.hstack([-by_e, times_e / -2])
            d, e, c = moved[some], slower[some, None], change[some]
            log = c[:, p:]
            left = c @ bent - slopes[some]
            left[:, p:] += f / 2 * d[:, :p] - f * first / (2 * steps) * e + f * first / 4 * log
            last = d[:, :p] @ (-f / steps) - 2 * g / steps * e[:, 0] - log @ (f * first) / (2 * steps)
            nonlocal out
            out += np.hstack([f / 2 * log - f / steps * e, -h / second * d[:, p:], left, -c, last[:, None], np.full((len(c), 1), b.sum() / n**2)]) @ np.hstack([moved, change, slopes, slower[:, None], np.ones((n, 1))]).T

        _followed(x, None, 0, s.sum, s.squares, tol, max_iter, look)
        return out


def _effects(x: np.ndarray, total: np.ndarray, squares: np.ndarray, whole: tuple[np.ndarray, np.ndarray], location: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """How much each row changes the fit: half the largest change of a log scale plus that of the location over
    the rows' radii (cubic mean), at the start or the end, whichever is larger."""
    n = len(x)
    mean = total / n
    begun = mean, (squares - n * mean**2) / (n - 1)
    out = []
    for (c, d), (a, b) in ((begun, _started_without(x, total, squares, n)), (whole, (location, scale))):
        r = np.concatenate([_inner((x[k : k + _CHUNK] - c) / np.sqrt(d))[1] for k in range(0, n, _CHUNK)])
        with np.errstate(all="ignore"):
            near = np.mean(r**-3.0) ** (1 / 3)
            out.append(np.abs(np.log(b / d)).max(1) / 2 + np.linalg.norm((a - c) / np.sqrt(d), axis=1) * near)
    q = np.maximum(*out)
    return np.where(np.isfinite(q), q, np.inf)


def _nested(s: _Sample, m: float, tol: float, max_iter: int, origin: np.ndarray, direct: bool) -> tuple[np.ndarray, DataFrame | None]:
    """The sums of `_pair_sums` over the pairs that fits without one row lead to, and the other pairs (None: there are no others)."""
    spark, p = s.df.sparkSession, s.p
    tasks = min(s.n, max(spark.sparkContext.defaultParallelism, s.n // FITS))
    # written, as what is fetched part by part is computed part by part
    state = States(spark)
    singles = state.written(_settled(s, s.df.select(F.array("id").alias("ids"), "x").repartition(tasks, "ids"), 0.0, tol, max_iter, origin if direct else None))
    parts = [_unpacked(r.asDict(), p) for r in singles.select(*_NAMES).toLocalIterator()]
    ids = np.concatenate([v[0][:, 0] for v in parts])
    order = np.argsort(ids)
    ids, x, location, scale, residual, at = (np.concatenate(v)[order] for v in ([v[0][:, 0] for v in parts], [v[1][:, 0] for v in parts], *([v[k] for v in parts] for k in range(2, 6))))
    try:
        c, d, _, _ = _followed(x, None, s.n, s.sum, s.squares, tol, max_iter)
    except ArithmeticError:  # all pairs are fitted themselves
        return np.zeros(4), _pairs(s)
    q = np.where(abs(residual[:, 0]) <= tol, _effects(x, s.sum, s.squares, (c, d), location, scale), np.inf) * np.cbrt(REMAINDER)
    if not _off(q.min(), q.min()) <= tol:
        return np.zeros(4), _pairs(s)
    return _by_fits(s, ids, x, location, scale, at, q, s.n, m, tol, max_iter, origin, direct)


def _by_fits(s: _Sample, ids: np.ndarray, x: np.ndarray, location: np.ndarray, scale: np.ndarray, at: np.ndarray, q: np.ndarray, first: int, m: float, tol: float, max_iter: int, origin: np.ndarray, direct: bool) -> tuple[np.ndarray, DataFrame | None]:
    """The sums of the ``first`` rows with all after them, and the pairs that these leave."""
    spark, p = s.df.sparkSession, s.p
    # with so many columns that second derivatives are not to be sent, derivatives are taken anew for each row
    bends, about = (_Bends(s, x, tol, max_iter, not direct), None) if 64 * p**3 <= SHARED_BYTES else (None, None)
    if bends and direct:
        u, r = _inner((x - origin) / np.sqrt(bends.scale))
        about = np.ascontiguousarray(_curvatures(s, spark.sparkContext.broadcast((u, 1 / np.where(r > 0, r, 1.0)[:, None])), p, p)[p:, p:])
    shared = spark.sparkContext.broadcast((x, location, scale, at, q, bends, about))

    def run(rows):
        x, location, scale, at, q, bends, about = shared.value
        rows = rows.to_numpy()
        if bends:
            return _bent_sums(s, rows, x, location, scale, at, q, bends, about, m, tol, max_iter, origin, direct)
        return _followed_sums(s, rows, x, location, scale, at, q, m, tol, max_iter, origin, direct)

    # a task holds some numbers for each of its rows with every row
    tasks = min(first, max(4 * spark.sparkContext.defaultParallelism, -(-first * s.n * 8 // SHARED_BYTES)))
    sums = total(spark.range(first).repartition(tasks, "id"), run, tasks)
    if _off(q.max(), q.max()) <= tol:
        return sums, None
    return sums, _pairs(s, ids, q, tol)


def _by_moments(s: _Sample, m: float, tol: float, max_iter: int, origin: np.ndarray, direct: bool) -> tuple[np.ndarray, DataFrame | None]:
    """As `_nested`: pairs of rows that change the fit little by sums over rows, the others each."""
    shared, bound = s.n * s.p * 8 <= SHARED_BYTES, float(np.cbrt(tol / REMAINDER)) if REMAINDER else math.inf
    each = _nested if shared else lambda s, *_: (np.zeros(4), _pairs(s))
    if 64 * s.p**3 > SHARED_BYTES:
        return each(s, m, tol, max_iter, origin, direct)
    try:
        e = pair_moments.Expansion(s, tol, max_iter, _curvature, _slopes, bool(m), bound)
    except (ArithmeticError, np.linalg.LinAlgError):  # a row at a location, or a fit that does not settle
        return each(s, m, tol, max_iter, origin, direct)
    if 4 * e.heavy > s.n:
        return each(s, m, tol, max_iter, origin, direct)
    sums = pair_moments.pair_sums(s, e, origin, m, direct, bound)
    if not e.heavy:
        return sums, None
    heavy = pair_moments.heavy_rows(s, e, bound)
    if not shared:
        return sums, _pairs_of(s, heavy)
    more, pairs = _of_heavy(s, e, heavy, m, tol, max_iter, origin, direct)
    return sums + more, pairs


def _pairs_of(s: _Sample, heavy: np.ndarray) -> DataFrame:
    """Every pair of rows of which one is among some."""
    spark = s.df.sparkSession
    some = F.broadcast(spark.createDataFrame(pa.table({"id": heavy})))
    second = s.df.select("id", "x").join(some.withColumn("heavy", F.lit(True)), "id", "left").select(F.col("id").alias("other"), F.col("x").alias("y"), F.col("heavy").isNotNull().alias("heavy"))
    first = s.df.select("id", "x").join(some, "id").repartition(max(1, min(len(heavy), 4 * spark.sparkContext.defaultParallelism)), "id")
    return first.crossJoin(second).where(~F.col("heavy") | (F.col("id") < F.col("other"))).select(F.array("id", "other").alias("ids"), "x", "y")


def _of_heavy(s: _Sample, e: pair_moments.Expansion, heavy: np.ndarray, m: float, tol: float, max_iter: int, origin: np.ndarray, direct: bool) -> tuple[np.ndarray, DataFrame | None]:
    """As `_nested`, the pairs of which one is among some rows; the others' own fits follow from derivatives."""
    spark, p = s.df.sparkSession, s.p
    some = F.broadcast(spark.createDataFrame(pa.table({"id": heavy})))
    fits = States(spark).written(_settled(s, s.df.join(some, "id").select(F.array("id").alias("ids"), "x").repartition(min(len(heavy), spark.sparkContext.defaultParallelism), "ids"), 0.0, tol, max_iter, origin if direct else None))
    parts = [_unpacked(r.asDict(), p) for r in fits.select(*_NAMES).toLocalIterator()]
    own = [np.concatenate([v[k][:, 0] if k < 2 else v[k] for v in parts]) for k in range(6)]
    ids, rest = pair_moments.light_fits(s, e, heavy, origin)
    x, location, scale, at = (np.concatenate([a, b]) for a, b in zip((own[1], own[2], own[3], own[5]), rest, strict=True))
    q = np.where(abs(np.r_[own[4][:, 0], np.zeros(len(ids))]) <= tol, _effects(x, s.sum, s.squares, (e.location, e.scale), location, scale), np.inf) * np.cbrt(REMAINDER)
    # pairs of other rows are in the sums
    q[len(heavy) :] = np.minimum(q[len(heavy) :], np.cbrt(tol) * (1 - 1e-9))
    return _by_fits(s, np.r_[own[0], ids], x, location, scale, at, q, len(heavy), m, tol, max_iter, origin, direct)


def _bent_sums(s: _Sample, rows: np.ndarray, x: np.ndarray, location: np.ndarray, scale: np.ndarray, at: np.ndarray, q: np.ndarray, bends: _Bends, about: np.ndarray | None, m: float, tol: float, max_iter: int, origin: np.ndarray, direct: bool) -> np.ndarray:
    """The sums over some rows with those after them, by both rows' own fits and `_Bends`."""
    n, p = s.n, s.p
    bends.ready(x)
    c, d = bends.location, bends.scale
    factors = bends.factors(s, x, rows, tol, max_iter) if m else None
    log, y = np.log(scale / d), x - origin
    inverse, own = 1 / scale, (location - c) / np.sqrt(d)
    if direct:
        sums, by = _about(x, origin, d, None)
        signs, alone = (_inner(y / np.sqrt(v))[0] for v in (d, scale))
        # what each row alone changes, beyond its derivative
        more_at = at - (sums - alone) - log @ by
    out = np.zeros(4)
    for number, i in enumerate(rows.tolist()):
        if i + 1 == n:
            continue
        bent = bends.of(i)
        grown = d * inverse[i]
        if direct:
            u = signs[i]
            by_i = by + np.tensordot(log[i], about, 1) - (np.outer(u * u, u) - np.diag(u)) / 2
        for k in range(i + 1, n, _CHUNK):
            j = slice(k, min(k + _CHUNK, n))
            on = _off(q[i], q[j]) <= tol
            if not on.any():
                continue
            change = bent(j).astype(float)
            h = change[:, -p:]
            if m:
                h += factors[number, j, None]
            a = 1 - h  # with half its square, e to the -h but for terms of sixth order
            a += h * h / 2
            a *= inverse[j]
            a *= grown
            z = y[j] * a
            r2, t2, inner = a @ (y[i] * y[i]), np.einsum("ij,ij->i", z, y[j]), z @ y[i]
            lies = (r2 <= 0) + (t2 <= 0).astype(int)
            out[1] += lies[on].sum()
            r2[r2 <= 0] = t2[t2 <= 0] = 1.0
            weight = np.where(on, (r2 * t2) ** (m / 2), 0.0)
            inner /= np.sqrt(r2 * t2)
            out[2] += weight @ inner
            if direct:
                h += log[j]
                mean = h @ by_i
                mean += more_at[j]
                mean += at[i]
                mean *= np.sqrt(a)
                of_j = np.einsum("ij,ij->i", mean, y[j]) / np.sqrt(t2) - 1
                of_i = mean @ y[i] / np.sqrt(r2) - inner
                out[3] += (weight * weight * (inner - of_j / (n - 2)) * (inner - of_i / (n - 2))).sum()
            else:
                middle = change[:, :p] + own[j]
                middle *= np.sqrt(d)
                middle += location[i]
                e, f = x[i] - middle, x[j] - middle
                z = e * a
                inner = np.einsum("ij,ij->i", z, f) ** 2 / (np.einsum("ij,ij->i", z, e) * np.einsum("ij,ij,ij->i", f, f, a))
                out[3] += inner[on].sum()
    return out


def _followed_sums(s: _Sample, rows: np.ndarray, x: np.ndarray, location: np.ndarray, scale: np.ndarray, at: np.ndarray, q: np.ndarray, m: float, tol: float, max_iter: int, origin: np.ndarray, direct: bool) -> np.ndarray:
    """`_bent_sums` with derivatives taken anew along the steps of each row's fit."""
    n = s.n
    c, d, own_c, own_d = _followed(x, None, 0, s.sum, s.squares, tol, max_iter)
    more_c, more_d = location - c - own_c, np.log(scale / d) - own_d
    if direct:
        sums, by = _about(x, origin, d, None)
        alone = _inner((x - origin) / np.sqrt(scale))[0]
        more_at = at - (sums - alone) - np.log(scale / d) @ by
    out = np.zeros(4)
    for i in rows.tolist():
        some = np.flatnonzero(_off(q[i], q[i + 1 :]) <= tol) + i + 1
        if not len(some):
            continue
        c, d, by_c, by_d = _followed(x, i, i + 1, s.sum, s.squares, tol, max_iter)
        if direct:
            sums, by = _about(x, origin, d, i)
        for k in range(0, len(some), _CHUNK):
            j = some[k : k + _CHUNK]
            log = by_d[j - i - 1] + more_d[j]
            a = np.exp(log / -2) / np.sqrt(d)
            u, r = _inner((x[i] - origin) * a)
            v, t = _inner((x[j] - origin) * a)
            out[1] += (r == 0).sum() + (t == 0).sum()
            weight = (np.where(r > 0, r, 1.0) * np.where(t > 0, t, 1.0)) ** m
            inner = np.einsum("ij,ij->i", u, v)
            out[2] += weight @ inner
            if direct:
                mean = (sums - v + log @ by + more_at[j]) / (n - 2)
                out[3] += (weight**2 * (inner - np.einsum("ij,ij->i", mean, v)) * (inner - np.einsum("ij,ij->i", mean, u))).sum()
            else:
                at_pair = c + by_c[j - i - 1] + more_c[j]
                u, _ = _inner((x[i] - at_pair) * a)
                v, _ = _inner((x[j] - at_pair) * a)
                out[3] += (np.einsum("ij,ij->i", u, v) ** 2).sum()
    return out


def _pair_sums(df: DataFrame, mu, m: float, tol: float, max_iter: int, direct: bool) -> tuple[int, int, np.ndarray]:
    """Over all pairs of rows: r^m U' r^m U about ``mu``, and its square about the fitted location or the direct variance's terms."""
    (s,) = _samples(df)
    if s.n < 4:
        raise ValueError("at least four rows are needed")
    origin = ((np.zeros(s.p) if mu is None else np.asarray(mu, float)) - s.shift) / s.unit
    t, pairs = _by_moments(s, m, tol, max_iter, origin, direct)
    if pairs is not None:
        t = t + _fitted_sums(s, pairs, m, tol, max_iter, origin, direct)
    if t[0]:
        raise ArithmeticError(f"{int(t[0])} fits did not settle")
    if t[1] and m < 0:
        raise ArithmeticError("a row at the null location has no inverse radius")
    return s.n, s.p, t[2:]


def _fitted_sums(s: _Sample, pairs: DataFrame, m: float, tol: float, max_iter: int, origin: np.ndarray, direct: bool) -> np.ndarray:
    """The sums over some pairs, each with a fit of its own; before them the fits that did not settle and rows at ``origin``."""
    fits = _settled(s, pairs, 0.0, tol, max_iter, origin if direct else None)

    def f(*columns):
        out = np.zeros(4)
        for row in zip(*(c.to_pylist() for c in columns), strict=True):
            _, own, location, scale, residual, at = _unpacked(dict(zip(_NAMES, row, strict=True)), s.p)
            root = np.sqrt(scale)[:, None]
            u, r = _inner((own - origin) / root)
            out[0] += (abs(residual) > tol).sum()
            out[1] += (r == 0).sum()
            weight = np.where(r > 0, r, 1.0).prod(1) ** m
            out[2] += (weight * (u[:, 0] * u[:, 1]).sum(1)).sum()
            if direct:
                mean = at / (s.n - 2)
                out[3] += (weight**2 * ((u[:, 0] - mean) * u[:, 1]).sum(1) * ((u[:, 1] - mean) * u[:, 0]).sum(1)).sum()
            else:
                v, _ = _inner((own - location[:, None]) / root)
                out[3] += ((v[:, 0] * v[:, 1]).sum(1) ** 2).sum()
        return out

    return total(fits.select(*_NAMES), f)


def _standardised(raw: float, variance: float, **more) -> dict:
    if not variance > 0 or not math.isfinite(variance):
        raise ArithmeticError("the variance is not positive")
    z = raw / math.sqrt(variance)
    return {"statistic": z, "p_value": tails.normal_sf(z), "raw": raw, "variance": variance, **more}


@held
def feng_sun_one_sample(df: DataFrame, mu=None, tol: float = 1e-7, max_iter: int = 500) -> dict:
    """Mean inner product of two rows' signs about ``mu``, by the scale of the rows but these two.

    The fits are as many as pairs of rows, each over all rows.
    """
    n, p, (cross, square) = _pair_sums(df, mu, 0.0, tol, max_iter, False)
    pairs = n * (n - 1) / 2
    return _standardised(cross / pairs, square / pairs**2, trace_r2=p * p * square / pairs)


@held
def weighted_sign_sum(df: DataFrame, mu=None, m: float = -1.0, tol: float = 1e-8, max_iter: int = 500) -> dict:
    """The same with signs weighted by r^m, and a variance from signs less their mean over the rows kept."""
    _power(m)
    n, _, (cross, product) = _pair_sums(df, mu, m, tol, max_iter, True)
    return _standardised(cross / (n * (n - 1) / 2), 4 * product / n**4)


def inst_one_sample(df: DataFrame, mu=None, tol: float = 1e-8, max_iter: int = 500) -> dict:
    """The inverse norm sign test: `weighted_sign_sum` at m = -1."""
    return weighted_sign_sum(df, mu, -1.0, tol, max_iter)


def _power(m: float) -> None:
    if not math.isfinite(m) or m > 1:
        raise ValueError("a finite power of at most 1 is needed")


def _whole(s: _Sample, m: float, tol: float, max_iter: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Location and scale of all rows, a pass a step."""
    none = np.empty((1, 0), "<i8")
    location, scale = (s.sum / s.n)[None], ((s.squares - s.sum**2 / s.n) / (s.n - 1))[None]
    residual = np.array([np.inf])
    for k in range(max_iter):
        t = total(s.df.select("id", "x"), lambda ids, x, a=location, b=scale: _sums(ids.to_numpy(), s.scaled(x), none, a, b, m).ravel())
        location, scale, residual = _moved(t[None], location, scale, residual, s.n, m, tol, True)
        if not residual[0] > tol:
            break
    if not 0 <= residual[0] <= tol:
        raise ArithmeticError("the fit of all rows did not settle")
    return location[0], scale[0], float(residual[0]), k


@held
def weighted_scaled_spatial_median(df: DataFrame, m: float = -1.0, tol: float = 1e-8, max_iter: int = 500) -> Fit:
    """The location where r^m U sums to zero, with the scale of unweighted signs about it.

    ``shape`` is the diagonal with largest entry 1.
    """
    _power(m)
    (s,) = _samples(df)
    location, scale, residual, steps = _whole(s, m, tol, max_iter)
    d = scale * s.unit**2
    return Fit(s.shift + s.unit * location, residual, steps, True, shape=d / d.max())


@held
def weighted_max_test(df: DataFrame, mu=None, m: float = -1.0, tol: float = 1e-8, max_iter: int = 500) -> dict:
    """The largest standardised coordinate of the weighted median less ``mu``; Gumbel tail."""
    _power(m)
    (s,) = _samples(df)
    if s.p < 2:
        raise ValueError("at least two columns are needed")
    location, scale, _, _ = _whole(s, m, tol, max_iter)

    def f(x):
        r = np.linalg.norm((s.scaled(x) - location) / np.sqrt(scale), axis=1)
        return np.r_[(r ** (m - 1)).sum(), (r ** (2 * m)).sum()]

    first, second = total(s.df.select("x"), f) / s.n
    origin = ((np.zeros(s.p) if mu is None else np.asarray(mu, float)) - s.shift) / s.unit
    raw = float(s.n * ((location - origin) ** 2 / scale).max() * s.p * (1 - s.n**-0.5) * first**2 / second)
    g = raw - 2 * math.log(s.p) + math.log(math.log(s.p))
    return {"statistic": g, "p_value": tails.gumbel_sf(g), "raw": raw}


@held
def spatial_sign_maxsum(df: DataFrame, mu=None, tol: float = 1e-7, max_iter: int = 500) -> dict:
    """Cauchy combination of `spatial_sign_max_test` and `feng_sun_one_sample`."""
    return _combined(spatial_sign_max_test(df, mu, tol, max_iter), feng_sun_one_sample(df, mu, tol, max_iter))


@held
def weighted_maxsum(df: DataFrame, mu=None, m: float = -1.0, tol: float = 1e-8, max_iter: int = 500) -> dict:
    """Cauchy combination of `weighted_max_test` and `weighted_sign_sum`."""
    return _combined(weighted_max_test(df, mu, m, tol, max_iter), weighted_sign_sum(df, mu, m, tol, max_iter))


def _combined(largest: dict, summed: dict) -> dict:
    p = tails.cauchy_combination(largest["p_value"], summed["p_value"])
    return {"statistic": math.tan((0.5 - p) * math.pi), "p_value": p, "max": largest["statistic"], "sum": summed["statistic"], "p_max": largest["p_value"], "p_sum": summed["p_value"]}


def _two_sample(x: DataFrame, y: DataFrame, *settings) -> dict:
    return held(lambda a: held(lambda b: _crossed(a, b, *settings))(y))(x)


def _crossed_block(z: np.ndarray, w: np.ndarray, c1: np.ndarray, c2: np.ndarray, i1: np.ndarray, i2: np.ndarray, m: float) -> float:
    """Sum over pairs of rows ``z`` and ``w`` of their weighted signs' inner products, each row about the other's location by its own inverse roots.

    All come from products of matrices; pairs in which a row is so near the location that these would cancel are computed one by one.
    """

    def squared(z, c, i):
        a, size = i * i, ((z * i) ** 2).sum(1)[:, None]
        size = size + a @ (c * c).T
        r2 = size - 2 * (a * z) @ c.T
        k, j = np.nonzero(r2 < 1e-4 * size)
        r2[k, j] = (((z[k] - c[j]) * i[k]) ** 2).sum(1)
        return r2, k, j

    inner = (i1 * z) @ (i2 * w).T - (i1 * z * c1) @ i2.T - i1 @ (i2 * w * c2).T + (i1 * c1) @ (i2 * c2).T
    r, k, j = squared(z, c2, i1)
    other, l, h = squared(w, c1, i2)
    r *= other.T
    k, j = np.r_[k, h], np.r_[j, l]
    inner[k, j] = ((z[k] - c2[j]) * i1[k] * (w[j] - c1[k]) * i2[j]).sum(1)
    on = r > 0
    r[~on] = 1.0
    if m == 0:
        inner /= np.sqrt(r)
    elif m == -1:
        inner /= r
    else:
        inner *= r ** ((m - 1) / 2)
    return float(inner[on].sum())


def _kept_fits(s: _Sample, rows: DataFrame, n: int, m: float, tol: float, max_iter: int) -> DataFrame:
    """Fits without each of ``n`` rows, written."""
    spark = s.df.sparkSession
    tasks = min(n, max(spark.sparkContext.defaultParallelism, n // FITS))
    return States(spark).written(_settled(s, rows.select(F.array("id").alias("ids"), "x").repartition(tasks, "ids"), m, tol, max_iter))


def _own_sums(fits: DataFrame, p: int, m: float, tol: float, bridge: np.ndarray) -> np.ndarray:
    """Of rows by their own fits: those lost, both means' sums, bridged squares of rows with themselves, and the signs' products."""

    def f(*columns):
        out = np.zeros(4 + p * p)
        for row in zip(*(c.to_pylist() for c in columns), strict=True):
            _, z, location, scale, residual, _ = _unpacked(dict(zip(_NAMES, row, strict=True)), p)
            e = (z[:, 0] - location) / np.sqrt(scale)
            r = np.linalg.norm(e, axis=1)
            lost = (abs(residual[:, 0]) > tol) | (r == 0)
            r[lost] = 1.0
            u = e / r[:, None]
            out += np.r_[lost.sum(), (r ** (2 * m)).sum(), (r ** (m - 1)).sum(), ((u * u * bridge).sum(1) ** 2).sum(), (u.T @ u).ravel()]
        return out

    return total(fits.select(*_NAMES), f)


def _crossed_pairs(first: DataFrame, second: DataFrame, p: int, m: float) -> float:
    """`_crossed_block` over all pairs of blocks of fits."""

    def cross(*columns):
        out = 0.0
        for row in zip(*(c.to_pylist() for c in columns), strict=True):
            a, b = (_unpacked(dict(zip(_NAMES, half, strict=True)), p) for half in (row[: len(_NAMES)], row[len(_NAMES) :]))
            out += _crossed_block(a[1][:, 0], b[1][:, 0], a[2], b[2], a[3] ** -0.5, b[3] ** -0.5, m)
        return np.r_[out]

    return float(total(first.select(*_NAMES).crossJoin(second.select(*(F.col(c).alias(f"y_{c}") for c in _NAMES))), cross)[0])


def _crossed_sums(both: list[_Sample], m: float, tol: float, max_iter: int) -> tuple[float, list[np.ndarray], np.ndarray] | None:
    """The sum over pairs, `_own_sums` of both samples and their roots of scales' ratio: of rows that change a fit little
    from sums over rows, the others each.  None where these are more than a quarter, or a row lies at a location.
    """
    p, bound = both[0].p, float(np.cbrt(tol / REMAINDER)) if REMAINDER else math.inf
    # a row changes a variance by about so much at least
    if 64 * p**3 > SHARED_BYTES or min(s.n for s in both) * bound < 1:
        return None
    fits = []
    try:
        for s in both:
            e = pair_moments.Expansion(s, tol, max_iter, _curvature, _slopes, bool(m), bound)
            if 4 * e.heavy > s.n:
                return None
            fits.append(crossed_moments.Fits(s, e, m, tol, max_iter))
    except (ArithmeticError, np.linalg.LinAlgError):
        return None
    reach = [crossed_moments.reach(s, f, other.e.root, bound) for s, f, other in zip(both, fits, fits[::-1], strict=True)]
    if any(4 * heavy > s.n for s, (heavy, _) in zip(both, reach, strict=True)):
        return None
    sides = [crossed_moments.Side(f, other, far, bound) for f, other, (_, far) in zip(fits, fits[::-1], reach[::-1], strict=True)]
    ratio = fits[0].e.root / fits[1].e.root
    sums = [crossed_moments.side_sums(s, side, bridge) for s, side, bridge in zip(both, sides, (ratio, 1 / ratio), strict=True)]
    if any(4 * v["heavy"] > s.n for s, v in zip(both, sums, strict=True)):
        return None
    raw, own, heavy = crossed_moments.crossed(*sums), [v["own"] for v in sums], [None, None]
    for k, (s, v, side, bridge) in enumerate(zip(both, sums, sides, (ratio, 1 / ratio), strict=True)):
        if v["heavy"]:
            heavy[k] = _kept_fits(s, crossed_moments.heavy_rows(s, side), v["heavy"], m, tol, max_iter)
            own[k] = own[k] + _own_sums(heavy[k], p, m, tol, bridge)
    if heavy[0] and heavy[1]:
        raw += _crossed_pairs(*heavy, p, m)
    for k, (s, side) in enumerate(zip(both, sides, strict=True)):
        if heavy[1 - k]:
            light = States(s.df.sparkSession).written(_light_fits(s, side))
            raw += _crossed_pairs(*((light, heavy[1]) if k == 0 else (heavy[0], light)), p, m)
    return raw, own, ratio


def _light_fits(s: _Sample, side: crossed_moments.Side) -> DataFrame:
    """Blocks of fits without each of the rows that are not heavy, by derivatives."""
    shared = s.df.sparkSession.sparkContext.broadcast(side)

    def run(batches):
        from pyspark import TaskContext

        side, block = shared.value, TaskContext.get().partitionId() << 32
        for b in batches:
            for start in range(0, b.num_rows, FITS):
                c = b.slice(start, FITS)
                x = s.scaled(c.column(1))
                on = ~side.heavy(x)
                shift, log = side.fits.of(x[on])
                yield _packed(block, [c.column(0).to_numpy()[on].astype("<i8"), x[on], side.fits.location + shift, side.fits.e.scale * np.exp(log), np.zeros(on.sum()), np.zeros_like(shift)])
                block += 1

    return s.df.select("id", "x").mapInArrow(run, _BLOCK)


def _crossed(x: DataFrame, y: DataFrame, m: float, tol: float, max_iter: int) -> dict:
    """Each row's sign by its own sample's scale without it, about the other sample's location without the
    other row, weighted by r^m; less their mean inner product over pairs of the samples.
    """
    both = _samples(x, y)
    (a, b), p = both, both[0].p
    if min(a.n, b.n) < 3:
        raise ValueError("at least three rows a sample are needed")
    found = _crossed_sums(both, m, tol, max_iter)
    if found:
        raw, own, ratio = found
    else:
        scales = [_whole(s, 0.0, tol, max_iter)[1] for s in both]
        ratio = np.sqrt(scales[0] / scales[1])
        fits = [_kept_fits(s, s.df, s.n, m, tol, max_iter) for s in both]
        own = [_own_sums(f, p, m, tol, bridge) for f, bridge in zip(fits, (ratio, 1 / ratio), strict=True)]
    if own[0][0] + own[1][0]:
        raise ArithmeticError(f"{int(own[0][0] + own[1][0])} fits did not settle or lie on their own row")
    raw = -(raw if found else _crossed_pairs(*fits, p, m)) / (a.n * b.n)
    size, nu, c, gram = (a.n, b.n), [], [], []
    for k, t in zip(size, own, strict=True):
        nu.append(t[1] / k)
        c.append(t[2] / k)
        gram.append(t[4:].reshape(p, p))
    # sums over ordered pairs of different rows of one sample, less those of a row with itself
    within = [float((np.outer(v, v) * g * g).sum() - t[3]) for v, g, t in zip((ratio, 1 / ratio), gram, own, strict=True)]
    terms = [2 * (nu[k] * c[1 - k] / c[k]) ** 2 * within[k] / (size[k] * (size[k] - 1)) ** 2 for k in (0, 1)]
    mixed = 4 * nu[0] * nu[1] * float((gram[0] * gram[1]).sum()) / (a.n * b.n) ** 2
    return _standardised(raw, terms[0] + terms[1] + mixed)


def feng_zou_wang_two_sample(x: DataFrame, y: DataFrame, tol: float = 1e-7, max_iter: int = 500) -> dict:
    """The crossed sign statistic of two samples, without weights."""
    return _two_sample(x, y, 0.0, tol, max_iter)


def tinst_two_sample(x: DataFrame, y: DataFrame, tol: float = 1e-8, max_iter: int = 500) -> dict:
    """The crossed sign statistic weighted by inverse norms, about locations fitted with these weights."""
    return _two_sample(x, y, -1.0, tol, max_iter)
