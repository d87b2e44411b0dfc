"""Sums over all pairs of rows of two samples, each row about the other sample's location without the other row, from sums over rows.

A row's own fit follows to second order from derivatives at the fit of all rows (`pair_moments.Expansion`); the location
of weighted signs, fitted once more by the scale found, likewise (`Fits`).  Of a pair only the two shifts of location
meet, so to second order of these what it adds is a sum of products of a number of its first row and one of its second:
the sum over all pairs is one of products of sums over rows, and work grows with the rows.  What is left out is of third order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from orbweave.functions.partial import total
from orbweave.operators.pair_moments import _CHUNK, _COLUMNS, Expansion, _outer, _units, grouped


def _columns(p: int) -> list[slice]:
    return [slice(k, min(k + _COLUMNS, p)) for k in range(0, p, _COLUMNS)]


def _gathered(df, f, p: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Tensors [column, column, column] and a vector of sums of what ``f`` makes of rows in chunks."""
    columns = _columns(p)

    def spread(column, add):
        for tensors, small in f(column):
            for g, c in enumerate(columns):
                add(g, np.concatenate([t[c].ravel() for t in tensors]))
            add(len(columns), small)

    found = grouped(df, spread, lambda _, v: v, len(columns) + 1)
    split = [v.reshape(-1, c.stop - c.start, p, p) for v, c in zip(found, columns, strict=False)]
    return [np.concatenate([v[k] for v in split]) for k in range(len(split[0]))], found[-1]


class Fits:
    """A sample's locations and scales without each row, by derivatives at the fit of all rows."""

    def __init__(self, s, e: Expansion, m: float, tol: float, max_iter: int) -> None:
        self.e, self.m, self.n, self.p, self.location, self.near = e, m, s.n, s.p, e.location, e.last["near"]
        if m:
            self._weighted(s, tol, max_iter)

    def _weighted(self, s, tol: float, max_iter: int) -> None:
        """The location of weighted signs, from the mean, and its first and second derivatives."""
        m, p, root, location = self.m, self.p, self.e.root, s.sum / s.n
        for _ in range(max_iter):

            def f(x, location=location):
                u, r = _units((s.scaled(x) - location) / root)
                safe = np.where(r > 0, r, 1.0)
                return np.r_[safe**m @ u, (safe ** (m - 1)).sum(), (safe**m).sum(), (safe**-3.0).sum(), (r == 0).sum()]

            t = total(s.df.select("x"), f)
            if t[-1]:
                raise ArithmeticError("a fit lies on a row")
            if np.abs(t[:p]).max() / t[p + 1] <= tol:
                break
            location = location + root * t[:p] / t[p]
        else:
            raise ArithmeticError("a fit did not settle")
        self.location, self.near = location, (t[-2] / s.n) ** (1 / 3)

        def derivatives(column):
            rows = s.scaled(column)
            for at in range(0, len(rows), _CHUNK):
                u, r = _units((rows[at : at + _CHUNK] - location) / root)
                u2, a, b, c = u * u, *(u * (r**k)[:, None] for k in (m - 2, m - 1, m))
                yield [(v.T @ _outer(*w)).reshape(p, p, p) for v, w in ((a, (u, u)), (b, (u, u2)), (c, (u2, u2)))], np.r_[(r ** (m - 1)).sum(), a.sum(0), r ** (m - 1) @ u2, c.sum(0), (b.T @ u).ravel(), (c.T @ u2).ravel()]

        (e0, e1, e2), t = _gathered(s.df, derivatives, p)
        steps, (s0, s1, s2), (b, c) = t[0], t[1 : 1 + 3 * p].reshape(3, p), t[1 + 3 * p :].reshape(2, p, p)
        k = np.arange(p)
        #: Of the sum of weighted signs by e, and that times e.
        self.by_e, self.times_e = steps * np.eye(p) + (m - 1) * b, np.diag(s2) + (m - 1) * c
        self.inverse = np.linalg.inv(self.by_e).T
        # second derivatives [sum, change, change] by e, times e once and twice
        e0, e1, e2 = ((m - 3) * v for v in (e0, e1, e2))
        e0[k, k], e1[k, k], e2[k, k] = e0[k, k] + s0, e1[k, k] + s1, e2[k, k] + c
        e0[k, :, k] += s0
        e1[k, :, k] += b
        e2[k, :, k] += c
        e0[:, k, k] += s0[:, None]
        e1[:, k, k] += b
        e2[:, k, k] += c
        self.bent = np.concatenate([v.reshape(p, -1).T * (share * (m - 1)) for v, share in ((e0, 0.5), (e1, 0.5), (e2, 0.125))])

    def _by_row(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u, r = _units((x - self.location) / self.e.root)
        return u, r, u * (np.where(r > 0, r, 1.0) ** self.m)[:, None]

    def effects(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How much each row changes the fit, as `Expansion.effects`, also over the row's own radius; to first order, its shift of the location over root of scale."""
        change = self.e.changed(x)
        log, (_, r, own) = change[:, self.p :] - change[:, self.p :].mean(1)[:, None], self._by_row(x)
        shift = (-own - log @ self.times_e.T / 2) @ self.inverse if self.m else change[:, : self.p]
        with np.errstate(all="ignore"):
            size = np.abs(change[:, self.p :]).max(1) / 2 + np.linalg.norm(shift, axis=1) * np.maximum(self.near, 1 / r)
            size = np.maximum(size, self.e.effects(x))
        return np.where(np.isfinite(size), size, np.inf), shift

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without each row, the shift of the location and the log scales' changes."""
        p, m = self.p, self.m
        own = self.e.fits(x, False)["own"]
        shift, log = own[:, :p], own[:, p:]
        if m:
            u, r, weighted = self._by_row(x)
            shift = (-weighted - log @ self.times_e.T / 2) @ self.inverse
            # what both derivatives leave, less that of the row itself
            turned = shift + log * u * r[:, None] / 2
            left = (log * log) @ self.times_e.T / 8 + (shift * log) @ self.by_e.T / 2
            left += np.hstack([_outer(shift, shift), _outer(shift, log), _outer(log, log)]) @ self.bent
            left += (r ** (m - 1))[:, None] * (turned + (m - 1) * u * (u * turned).sum(1)[:, None])
            shift = shift + left @ self.inverse
        return shift * self.e.root, log + self._factor(x)[:, None]

    def _factor(self, x: np.ndarray) -> np.ndarray:
        """Without each row, the change of the mean log scale; signs without weights take it to first order, as it is not in them."""
        e, n, p = self.e, self.n, self.p
        if not self.m:
            return e.changed(x)[:, p:].mean(1)
        # derivatives by the row's weight, where `Expansion.changed` has differences
        y, q = x - e.sum / n, e.squares - e.sum**2 / n
        change = np.hstack([-y / np.sqrt(q / (n - 1)) / n, 1 / (n - 1) - y * y / q])
        for step in e.steps:
            u, r = _units((x - step["location"]) / step["root"])
            before, change = change, e._next(step, change, np.hstack([u, u * u]), 1 / r[:, None])
            change[:, p:] = before[:, p:] + (change[:, p:] - before[:, p:]) * ((n - 1) / n)
        return change[:, p:].mean(1) + e.together(x)[0] / 2


class Side:
    """One of two samples, whose rows meet the other's; rows that change a fit by more than ``bound``, or lie so near the other
    sample's location that its shifts do, are `heavy`."""

    def __init__(self, fits: Fits, other: Fits, reach: float, bound: float) -> None:
        self.fits, self.other, self.reach, self.bound = fits, other.location, reach, bound

    def heavy(self, x: np.ndarray) -> np.ndarray:
        near = np.linalg.norm((x - self.other) / self.fits.e.root, axis=1)
        return ~((self.fits.effects(x)[0] <= self.bound) & (self.reach <= self.bound * near))


def reach(s, fits: Fits, root: np.ndarray, bound: float) -> tuple[int, float]:
    """How many rows change the fit by more than ``bound``, and the largest shift of the location, over ``root``, without one of the others."""
    shared = s.df.sparkSession.sparkContext.broadcast(fits)

    def run(batches):
        fits = shared.value
        for b in batches:
            if b.num_rows:
                size, shift = fits.effects(s.scaled(b.column(0)))
                on = size <= bound
                far = np.linalg.norm(shift[on] * fits.e.root / root, axis=1).max(initial=0.0)
                yield pa.RecordBatch.from_arrays([pa.array([int((~on).sum())]), pa.array([float(far)])], names=["heavy", "far"])

    r = s.df.select("x").mapInArrow(run, "heavy long, far double").agg(F.sum("heavy").alias("heavy"), F.max("far").alias("far")).first()
    return r["heavy"], r["far"]


def heavy_rows(s, side: Side):
    """The rows (id, x) that are heavy."""
    shared = s.df.sparkSession.sparkContext.broadcast(side)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(shared.value.heavy(s.scaled(b.column(1)))))

    return s.df.select("id", "x").mapInArrow(run, "id long, x array<double>")


def side_sums(s, side: Side, bridge: np.ndarray) -> dict:
    """Over the rows that are not heavy, what the statistic and its variance take."""
    p, m = s.p, side.fits.m
    shared = s.df.sparkSession.sparkContext.broadcast(side)

    def f(column):
        side = shared.value
        rows = s.scaled(column)
        for at in range(0, len(rows), _CHUNK):
            x = rows[at : at + _CHUNK]
            heavy = side.heavy(x)
            x = x[~heavy]
            shift, log = side.fits.of(x)
            w = np.exp(log / -2) / side.fits.e.root
            u, r = _units((x - side.fits.location - shift) * w)
            lost = r == 0
            r[lost] = 1.0
            own = np.r_[heavy.sum(), lost.sum(), (r ** (2 * m)).sum(), (r ** (m - 1)).sum(), ((u * u * bridge).sum(1) ** 2).sum(), (u.T @ u).ravel()]
            a, r = _units((x - side.other) * w)
            aw, (less, one, full) = a * w, (a * (r**k)[:, None] for k in (m - 2, m - 1, m))
            wide, flat = w * (r ** (m - 1))[:, None], w * (r ** (m - 2))[:, None]
            small = [one.T @ aw, full.T @ shift, wide.T @ shift, flat.T @ aw, less.T @ (w * w)]
            yield [(v.T @ _outer(*b)).reshape(p, p, p) for v, b in ((one, (aw, shift)), (less, (aw, aw)), (full, (shift, shift)))], np.concatenate([own, full.sum(0), wide.sum(0), *(v.ravel() for v in small)])

    (turn, bend, shifts), t = _gathered(s.df, f, p)
    at, k = 5 + p * p, np.arange(p)
    (signs, steps), (by, shifted, own, mixed, squares) = t[at : at + 2 * p].reshape(2, p), t[at + 2 * p :].reshape(5, p, p)
    # derivatives of the weighted sign by the other location's shift, with the row's own shift, and second ones
    turn, bend = (m - 1) * turn, (m - 3) * bend
    turn[k, k] += own
    bend[k, k] += mixed
    bend[k, :, k] += mixed
    bend[:, k, k] += squares
    return {"heavy": int(t[0]), "own": t[1:at], "signs": signs, "by": np.diag(steps) + (m - 1) * by, "shifted": shifted, "turn": turn, "bend": (m - 1) * bend, "shifts": shifts}


def crossed(a: dict, b: dict) -> float:
    """The sum over pairs of both sides' rows of their weighted signs' inner products."""
    out = a["signs"] @ b["signs"] + (a["turn"] * b["turn"].transpose(0, 2, 1)).sum()
    for v, w in ((a, b), (b, a)):
        out += (v["bend"] * w["shifts"]).sum() / 2 - (v["by"] * w["shifted"]).sum()
    return float(out)
