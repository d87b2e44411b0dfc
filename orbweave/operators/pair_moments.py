"""Sums over all pairs of rows, each by the fit without both, from sums over rows.

A row's fit without it, and what two rows change together, follow to second order from derivatives at the
fit of all rows.  What a pair adds then is a sum of products of a number of its first row and one of its
second, so that the sum over all pairs is one of products of sums over rows, less what rows make with themselves: work grows
with the rows.  Inner products of signs are taken to second order of a row's effect.  Variances are taken to first, with the largest terms of
second order, as they are sums without differences: what either leaves out changes a statistic by about the inverse square of the number of rows.

Sums of three columns' products are kept by their first column; groups of these meet after a
shuffle, where they are multiplied, so that numbers alone come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orbweave.functions.partial import total

#: Rows that a task goes through at once.
_CHUNK = 256
#: Columns in a group.
_COLUMNS = 4


def grouped(df: DataFrame, f: Callable[[pa.Array, Callable[[int, np.ndarray], None]], None], finish: Callable[[int, np.ndarray], np.ndarray], groups: int) -> list[np.ndarray]:
    """For each group ``finish`` of its sum; ``f(x, add)`` adds to groups' vectors."""
    spark = df.sparkSession

    def spread(batches):
        sums: dict[int, np.ndarray] = {}

        def add(k, v):
            if k in sums:
                sums[k] += v
            else:
                sums[k] = np.array(v, float)

        for b in batches:
            if b.num_rows:
                f(b.column(0), add)
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["k", "sums"])

    def gather(batches):
        at, held = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.asarray(finish(at, held), float).tobytes()], pa.binary())], names=["k", "sums"])

        for b in batches:
            for k, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != at:
                    if at is not None:
                        yield out()
                    at, held = k, 0.0
                held = held + np.frombuffer(v)
        if at is not None:
            yield out()

    kind = "k int, sums binary"
    parts = df.select("x").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(spread, kind)
    found = {r["k"]: np.frombuffer(r["sums"]) for r in parts.repartition(min(groups, 4 * spark.sparkContext.defaultParallelism), "k").sortWithinPartitions("k").mapInArrow(gather, kind).collect()}
    return [found[k] for k in range(groups)]


def _units(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r = np.sqrt((e * e).sum(1))
    return e / np.where(r > 0, r, 1.0)[:, None], r


def _by_change(u: np.ndarray, inverse: np.ndarray, change: np.ndarray) -> np.ndarray:
    """What a change of (location over root of scale, log scale) makes of each row's U and U squared."""
    p = u.shape[1]
    d = -change[:, :p] * inverse - change[:, p:] * u / 2
    d -= u * (u * d).sum(1)[:, None]
    return np.hstack([d, 2 * u * d])


class Expansion:
    """The fit of all rows, step by step, and its derivatives by rows' weights."""

    def __init__(self, s, tol: float, max_iter: int, curvature: Callable, slopes: Callable, factors: bool, bound: float) -> None:
        n, p = s.n, s.p
        self.n, self.p, self.slopes, self.sum, self.squares = n, p, slopes, s.sum, s.squares
        self.factors = factors
        location = s.sum / n
        scale = (s.squares - n * location**2) / (n - 1)
        self.steps: list[dict] = []
        for _ in range(max_iter):
            root = np.sqrt(scale)

            def f(x, location=location, root=root):
                u, r = _units((s.scaled(x) - location) / root)
                inverse = 1 / np.where(r > 0, r, 1.0)
                own = np.hstack([u, u * u])
                return np.r_[(own.T @ np.hstack([u * inverse[:, None], u * u])).ravel(), (np.stack([np.ones_like(r), inverse, inverse**2]) @ own).ravel(), inverse.sum(), (inverse**3).sum(), (r == 0).sum()]

            t = total(s.df.select("x"), f)
            m, both, (steps, cubes, zeros) = t[: 4 * p * p].reshape(2 * p, 2 * p), t[4 * p * p : -3].reshape(3, 2 * p), t[-3:]
            if zeros:
                raise ArithmeticError("a fit lies on a row")
            sums, second_sums = both[0, :p], both[0, p:]
            second = second_sums * (p / n)
            by, k = np.empty((2 * p, 2 * p)), np.arange(p)
            by[:p, :p], by[:p, p:], by[p:, :p], by[p:, p:] = m[:p, :p].T, 2 * m[p:, :p].T, m[:p, p:].T / 2, m[p:, p:].T
            by[k, k] -= steps
            by[k, k + p] -= 2 * both[1, :p]
            by[k + p, k] -= sums / 2
            by[k + p, k + p] -= second_sums
            step = {"location": location, "root": root, "of_sums": by.copy(), "of_steps": np.r_[both[2, :p], both[1, p:] / 2], "first": sums, "second": second_sums, "inverse": steps, "near": (cubes / n) ** (1 / 3)}
            settled = max(np.abs(sums / n).max(), np.abs(second - 1).max()) <= tol
            if settled:
                self.last = step
                break
            move = sums / steps
            by[:, :p] -= np.outer(step["of_steps"], move)
            unit = np.r_[1 / (steps * np.sqrt(second)), n / ((n - 1) * second_sums)]
            by *= unit
            by[k, k] += 1 / np.sqrt(second)
            by[k + p, k] += move / (2 * np.sqrt(second))
            by[k + p, k + p] += 1
            self.steps.append(step | {"by": by, "unit": unit, "shift": move * unit[:p], "roots": np.sqrt(second)})
            location, scale = location + root * move, scale * second
        else:
            raise ArithmeticError("a fit did not settle")
        self.location, self.scale, self.root = location, scale, root
        common = np.r_[np.zeros(p), np.ones(p)]
        self.inverse = np.linalg.inv(self.last["of_sums"] - n / p**2 * np.outer(common, common))
        back = common / p
        for step in reversed(self.steps):
            a, b = back[:p] / step["roots"], back[p:]
            step["f"], step["g"], step["h"], step["b"] = a / step["inverse"], -(a @ step["first"]) / step["inverse"] ** 2, b / step["second"], b
            back = step["by"] @ back
        self.start = back

        #: Rows that change the fit by more than ``bound``.
        self.heavy = int(total(s.df.select("x"), lambda x: np.r_[(~(self.effects(s.scaled(x)) <= bound)).sum()])[0])
        if 4 * self.heavy > n:
            return

        def bend(x, add):
            x = s.scaled(x)
            u, r = _units((x - location) / root)
            for c in range(2 * p):
                one = np.eye(p)[c % p]
                add(c, curvature(u, 1 / r[:, None], one * (c < p), 0.0, one * (c >= p)).ravel())
            if factors:
                for c, step in enumerate(self.steps):
                    u, r = _units((x - step["location"]) / step["root"])
                    add(2 * p + c, curvature(u, 1 / r[:, None], step["f"], step["g"], step["h"]).ravel())

        bends = grouped(s.df, bend, lambda k, v: v, 2 * p + factors * len(self.steps))
        #: Second derivatives of what the fit changes by, but for the sums' inverse: [change, change, change]
        self.bent = np.stack(bends[: 2 * p], 1).reshape(2 * p, 2 * p, 2 * p) @ self.inverse
        for step, v in zip(self.steps, bends[2 * p :], strict=False):
            step["bent"] = v.reshape(2 * p, 2 * p)

    def begun(self, x: np.ndarray) -> np.ndarray:
        """What a row's absence changes of the mean and the log variances."""
        n, location, root = self.n, self.sum / self.n, (self.steps[0] if self.steps else self.last)["root"]
        mean = (self.sum - x) / (n - 1)
        return np.hstack([(mean - location) / root, (self.squares - x * x - (n - 1) * mean**2) / ((n - 2) * root**2) - 1])

    def changed(self, x: np.ndarray) -> np.ndarray:
        """What a row's absence changes of the fit, to first order."""
        change = self.begun(x)
        for step in self.steps:
            u, r = _units((x - step["location"]) / step["root"])
            change = self._next(step, change, np.hstack([u, u * u]), 1 / r[:, None])
        return change

    def _next(self, step: dict, change: np.ndarray, own: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        change = change @ step["by"] - own * step["unit"]
        change[:, : self.p] += inverse * step["shift"]
        change[:, self.p :] += 1 / (self.n - 1)
        return change

    def along(self, x: np.ndarray) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each step the rows' changes before it, and what of them second derivatives take."""
        change = self.begun(x)
        for step in self.steps:
            u, r = _units((x - step["location"]) / step["root"])
            inverse, own = 1 / r[:, None], np.hstack([u, u * u])
            by_e, times_e = self.slopes(u, inverse, step["f"], step["g"], step["h"])
            yield step, change, change @ step["of_sums"] - own, change @ step["of_steps"] - inverse[:, 0], np.hstack([-by_e, times_e / -2])
            change = self._next(step, change, own, inverse)

    def _left(self, step: dict, c: np.ndarray, moved: np.ndarray, slower: np.ndarray, slopes: np.ndarray) -> np.ndarray:
        """With rows' (moved, change, slopes, slower, 1) the changes of the mean log scale that two rows make together in a step."""
        p, f, g, h, first, steps = self.p, step["f"], step["g"], step["h"], step["first"], step["inverse"]
        log, d, e = c[:, p:], moved, slower[:, None]
        left = c @ step["bent"] - slopes
        left[:, p:] += f / 2 * d[:, :p] - f * first / (2 * steps) * e + f * first / 4 * log
        last = d[:, :p] @ (-f / steps) - 2 * g / steps * slower - log @ (f * first) / (2 * steps)
        return np.hstack([f / 2 * log - f / steps * e, -h / step["second"] * d[:, p:], left, -c, last[:, None], np.full((len(c), 1), step["b"].sum() / self.n**2)])

    def together(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """The second change of the mean log scale by each row with itself, and what makes that of two rows as a sum of products."""
        n, p = self.n, self.p
        y, q = x - self.sum / n, self.squares - self.sum**2 / n
        a, b = self.start[:p], self.start[p:]
        along = y @ (a / np.sqrt(q / (n - 1))) / n**2
        one = np.ones((len(x), 1))
        lefts = [np.hstack([(b.sum() / (n - 1) ** 2 - along)[:, None], -one, -y * (2 * b / (n * q)), -(y**2) * (b / q**2)])]
        rights = [np.hstack([one, along[:, None], y, y * y])]
        for step, change, moved, slower, slopes in self.along(x):
            lefts.append(self._left(step, change, moved, slower, slopes))
            rights.append(np.hstack([moved, change, slopes, slower[:, None], one]))
        return sum((u * v).sum(1) for u, v in zip(lefts, rights, strict=True)), lefts, rights

    def effects(self, x: np.ndarray) -> np.ndarray:
        """Half the largest change of a log scale plus that of the location over the rows' radii, at the start or the end."""
        begun, change = self.begun(x), self.changed(x)
        size = lambda c, near: np.abs(c[:, self.p :]).max(1) / 2 + np.linalg.norm(c[:, : self.p], axis=1) * near
        return np.maximum(size(begun, (self.steps[0] if self.steps else self.last)["near"]), size(change, self.last["near"]))

    def fits(self, x: np.ndarray, with_factor: bool) -> dict:
        """U and 1 / r at the fit of all rows, first and second changes without each row, and its fit's change."""
        p = self.p
        u, r = _units((x - self.location) / self.root)
        inverse = 1 / r[:, None]
        t = np.hstack([u, u * u - 1 / p]) @ self.inverse
        bent = np.einsum("na,nac->nc", t, (t @ self.bent.reshape(2 * p, -1)).reshape(len(t), 2 * p, 2 * p))
        second = 2 * _by_change(u, inverse, t) @ self.inverse - bent
        own = t + second / 2
        out = {"u": u, "inverse": inverse, "t": t, "second": second, "own": own}
        if with_factor:
            own[:, p:] += self.changed(x)[:, p:].mean(1)[:, None]
            out["both"], out["lefts"], out["rights"] = self.together(x)
        return out


def heavy_rows(s, e: Expansion, bound: float) -> np.ndarray:
    """The ids of rows that change the fit by more than ``bound``."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(~(e.effects(s.scaled(b.column(1))) <= bound)))], names=["id"])

    return np.array([r["id"] for r in s.df.select("id", "x").mapInArrow(run, "id long").collect()], np.int64)


def light_fits(s, e: Expansion, heavy: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids of the other rows; they, their own fits' location and scale, and the sum of all other rows' U about ``origin`` by that scale."""
    p, shared = s.p, s.df.sparkSession.sparkContext.broadcast(e)

    def about(x):
        u, _ = _units((s.scaled(x) - origin) / e.root)
        return np.r_[u.sum(0), ((u * u).T @ u).ravel()]

    t = total(s.df.select("x"), about)
    sums, turned = t[:p], (t[p:].reshape(p, p) - np.diag(t[:p])) / 2

    def run(batches):
        e = shared.value
        for b in batches:
            ids, rows = b.column(0).to_numpy(), s.scaled(b.column(1)) if b.num_rows else None
            for k in range(0, len(ids), _CHUNK):
                on = ~np.isin(ids[k : k + _CHUNK], heavy)
                x = rows[k : k + _CHUNK][on]
                own = e.fits(x, e.factors)["own"]
                scale = e.scale * np.exp(own[:, p:])
                found = [x, e.location + own[:, :p] * e.root, scale, sums + own[:, p:] @ turned - _units((x - origin) / np.sqrt(scale))[0]]
                yield pa.RecordBatch.from_arrays([pa.array([ids[k : k + _CHUNK][on].astype("<i8").tobytes()], pa.binary()), pa.array([np.hstack(found).tobytes()], pa.binary())], names=["ids", "fits"])

    parts = [(np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["fits"]).reshape(-1, 4 * p)) for r in s.df.select("id", "x").mapInArrow(run, "ids binary, fits binary").collect()]
    rows = np.concatenate([v for _, v in parts])
    return np.concatenate([i for i, _ in parts]), [np.ascontiguousarray(rows[:, k * p : (k + 1) * p]) for k in range(4)]


def _outer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] * b[:, None, :]).reshape(len(a), -1)


def pair_sums(s, e: Expansion, origin: np.ndarray, m: float, direct: bool, bound: float) -> np.ndarray:
    """`leave_out._pair_sums` over the pairs of rows whose effects are ``bound`` at most: rows at ``origin``, the inner
    products, and their squares about the fitted location or the direct variance's terms."""
    n, p, half = s.n, s.p, (1 - m) / 2
    groups = -(-p // _COLUMNS)
    spark = s.df.sparkSession
    mean, turned = np.zeros(p), np.zeros((p, p))
    if direct:

        def about(x):
            u, _ = _units((s.scaled(x) - origin) / e.root)
            return np.r_[u.sum(0), ((u * u).T @ u).ravel()]

        t = total(s.df.select("x"), about)
        mean, turned = t[:p] / (n - 2), (t[p:].reshape(p, p) - np.diag(t[:p])) / (2 * (n - 2))
    shared = spark.sparkContext.broadcast(e)

    def spread(column, add):
        e = shared.value
        rows = s.scaled(column)
        for at in range(0, len(rows), _CHUNK):
            x = rows[at : at + _CHUNK]
            x = x[e.effects(x) <= bound]
            if len(x):
                chunk(e, x, add)

    def chunk(e, x, add):
        f = e.fits(x, bool(m))
        t, own, u, inverse = f["t"], f["own"], f["u"], f["inverse"]
        log, y = own[:, p:], (x - origin) / e.root
        near = np.exp(-log)
        sign, r = _units(y * np.sqrt(near))
        lies, r = r == 0, np.where(r > 0, r, 1.0)
        P, D, W = y * near * (r ** (-2 * half))[:, None], near - 1, sign * sign
        size, a = (P * P).sum(1), (W * D).sum(1)
        h = f["second"][:, p:]
        alone = [lies.sum() * (n - 1.0), (size * (1 - 2 * half * a + half * (2 * half + 1) * a * a) - (P * P * h).sum(1) + 2 * half * size * (W * h).sum(1)).sum()]
        if m:
            alone[1] -= m * (size * f["both"]).sum()
        # what U and U squared, turned by the inverse, change by, weighted by W
        k = W @ e.inverse[:, p:].T
        v = k[:, :p] + 2 * k[:, p:] * u
        v -= u * (u * v).sum(1)[:, None]
        kappa = np.hstack([-v * inverse, -u * v / 2])
        uu, u2 = _outer(u, u), u * u
        WW, DD, WD, Wt = _outer(W, W), _outer(D, D), _outer(W, D), _outer(W, t)
        turns = [uu * inverse, _outer(u * inverse, u2), _outer(u, u2), _outer(u2, u2), inverse, u, u * inverse, u2]
        small = [P.sum(0)[:, None], P.T @ W, P.T @ D, P.T @ t, P.T @ kappa]
        if m:
            small += [P.T @ np.hstack(f["lefts"]), P.T @ np.hstack(f["rights"])]
        parts = [(P, [WW, DD, WD, Wt, *turns])]
        if direct:
            R = r ** (2 * m)
            beta, to_mean = sign @ mean, log @ turned - np.where(lies, 0.0, 1.0)[:, None] * sign / (n - 2)
            Ru, beta_r = sign * R[:, None], R * beta
            e_ii, omega, nu = (W * log).sum(1), (sign * log) @ mean, (to_mean * sign).sum(1)
            on = ~lies
            alone.append((R * R * ((1 - 2 * m * e_ii) - 2 * (beta + beta * e_ii * (0.5 - 2 * m) + 2 * nu - omega / 2) + beta * beta - 2 * m * beta * beta * e_ii + 2 * beta * (2 * nu + beta * e_ii / 2 - omega / 2) + 4 * nu * nu))[on].sum())
            B = sign * beta_r[:, None]
            # of each column: R U, R beta U, R nu.U U, and with U, nu, U squared, log scales; the last columns are of R beta and others
            small += [Ru.sum(0)[:, None], B.sum(0)[:, None], (Ru * nu[:, None]).sum(0)[:, None], Ru.T @ sign, Ru.T @ to_mean, Ru.T @ W, Ru.T @ log, B.T @ W, B.T @ log, to_mean.T @ Ru]
            add(groups, np.r_[alone, beta_r.sum(), (R * nu).sum(), beta_r @ W, beta_r @ log, beta_r @ to_mean, Ru.sum(0), (R * nu) @ to_mean])
            parts.append((Ru, [_outer(sign, W), _outer(sign, log)]))
        else:
            z = ((x - e.location) / e.root - own[:, :p]) * np.exp(-log / 2)
            v, r = _units(z)
            i = 1 / r[:, None]
            # of second order what a row's own shift makes along it, and its own scale of its inner products
            moved, turned_by = (v * own[:, :p]).sum(1), v * log
            alone.append(len(x) + (4 * (moved * i[:, 0] + (v * turned_by).sum(1) / 2) ** 2).sum())
            add(groups, np.r_[alone, (moved**2).sum(), (i**2).sum(), (moved * i[:, 0]).sum()])
            small += [v.T @ i, v.T @ v, turned_by.T @ i, v.T @ moved[:, None], turned_by.T @ moved[:, None], v.T @ turned_by, turned_by.T @ v, turned_by.T @ turned_by]
            parts.append((v, [_outer(v * i, v), _outer(v, v * v), _outer(v, own)]))
        for g in range(groups):
            c = slice(g * _COLUMNS, (g + 1) * _COLUMNS)
            add(g, np.concatenate([b[c].ravel() for b in small] + [(a[:, c].T @ b).ravel() for a, bs in parts for b in bs]))

    def finish(g, v):
        if g == groups:
            return v
        e = shared.value
        w, at = min(_COLUMNS, p - g * _COLUMNS), 0
        columns = np.arange(g * _COLUMNS, g * _COLUMNS + w)

        def take(*shape):
            nonlocal at
            size = w * int(np.prod(shape))
            at += size
            return v[at - size : at].reshape(w, *shape)

        P0, PW, PD, M, Pk = take(1), take(p), take(p), take(2 * p), take(2 * p)
        if m:
            size = 2 * p + 2 + len(e.steps) * (6 * p + 2)
            L, Rt = take(size), take(size)
        if direct:
            g0, g1, c1, G, V0, Y0, Z0, Y1, Z1 = take(1), take(1), take(1), *(take(p) for _ in range(6))
            V1 = take(p)
        else:
            vi, G, wi, vs, ws, vw, wv, ww = take(1), take(p), take(1), take(1), take(1), take(p), take(p), take(p)
        WW, DD, WD, A = take(p, p), take(p, p), take(p, p), take(p, 2 * p)
        uui, uu2i, uu2, u2u2, i, u, ui, u2 = take(p, p), take(p, p), take(p, p), take(p, p), take(1), take(p), take(p), take(p)
        K3, V3, L3 = (take(p, p), None, take(p, p)) if direct else (take(p, p), take(p, p), take(p, 2 * p))
        k = np.arange(p)
        turn = np.empty((w, 2 * p, 2 * p))  # derivatives of U and U squared, [change, sum]
        turn[:, :p, :p], turn[:, :p, p:], turn[:, p:, :p], turn[:, p:, p:] = uui, 2 * uu2i, uu2.transpose(0, 2, 1) / 2, u2u2
        turn[:, k, k] -= i
        turn[:, k, k + p] -= 2 * ui
        turn[:, k + p, k] -= u / 2
        turn[:, k + p, k + p] -= u2
        inverse, bent = e.inverse[:, p:], e.bent[:, :, p:]
        cross = (P0 * P0).sum() - 2 * half * (PW * PD).sum() + half * (half + 1) * (WW * DD).sum() + half * half * (WD * WD.transpose(0, 2, 1)).sum()
        for c, column in enumerate(columns):
            moved = M[c] @ turn[c]
            cross += -2 * moved @ inverse[:, column] + M[c] @ bent[:, :, column] @ M[c]
            cross += 2 * half * (Pk[c] @ M[c] + ((A[c] @ turn[c]) * inverse.T).sum() - (A[c].T * (np.tensordot(M[c], bent, (0, 1)))).sum())
        if m:
            cross -= m * (L * Rt).sum()
        if direct:
            own = np.arange(w), columns
            square = (G * G).sum() + 2 * (1 - m) * (K3 * L3).sum() - 2 * (G * L3[:, k, k]).sum()
            square -= 2 * ((g1 * g0).sum() + (1 - m) * (Y1 * Z0).sum() + (0.5 - m) * (Z1 * Y0).sum() - (Z1[own] @ g0[:, 0] + g1[:, 0] @ Z0[own]) / 2 + (c1 * g0).sum() + (G * V0).sum() - (G * Z0 * mean).sum() / 2)
            square += (V0 * V1).sum()
        else:
            square = (G * G).sum() + 4 * ((K3 * L3[:, :, :p]).sum() - (vi * L3[:, k, k]).sum() + ((V3 * L3[:, :, p:]).sum() - (G * L3[:, k, k + p]).sum()) / 2)
            square += 2 * ((vi * ws).sum() + (wi * vs).sum()) + ((G * ww).sum() + (vw * wv).sum()) / 2
        return np.r_[cross, square]

    found = grouped(s.df, spread, finish, groups + 1)
    last = found[-1]
    cross, square = np.sum(found[:-1], axis=0)
    cross, square = cross - last[1], square - last[2]
    if direct:
        b0, nu, at_w, at_log, at_mean, g0, nu_mean = last[3], last[4], *last[5:].reshape(5, p)
        square += b0 * b0 + (1 - 2 * m) * at_w @ at_log + 2 * b0 * nu + 2 * at_mean @ g0 - mean @ (g0 * at_log) + nu * nu + 2 * nu_mean @ g0
    else:
        square += 2 * (last[3] * last[4] + last[5] ** 2)
    return np.r_[0.0, last[0], cross / 2, square / 2]
