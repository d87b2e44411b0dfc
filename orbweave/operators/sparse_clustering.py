"""Clustering with feature weights, a common metric or screened features, and their gap statistics.

A sample, and any number of copies of it whose columns are permuted, is one table of
numbered blocks of rows.  A fit is small: centres and a metric.  All fits over all
copies go on in step: one pass over the blocks assigns rows for each of them and
adds up what its next step needs, so that passes do not grow with the number
of copies or settings.  Labels are never stored; they follow from centres and
metric.

Exact medians of columns, for all clusters at once, take two passes: one counts values
between given cuts, one fetches those between the cuts around the middle; where these are too many, eight passes each find
eight bits of the middle values.  Spatial medians of all clusters take
their steps together.  Permutations are bijections of row numbers by a keyed
network, so that each value knows where it goes and none is sorted.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions.partial import BLOCK_ROWS, FAN_IN, total
from orbweave.operators.foundations import signs
from orbweave.sources.samples import dimensions, rows_of

#: Bytes of a sample's copies in a task.
TASK_BYTES = 32 << 20
#: Cuts of a column are quantiles of about so many rows; between them lie so many ranges.
CUT_ROWS, RANGES = 4096, 256
#: So many values around medians are fetched at most.
FETCHED = 1 << 19
_STORED = "copy int, begin long, rows binary"


@dataclass(frozen=True)
class State:
    """What a fit's labels follow from: a copy of the sample, centres, a metric, rows moved to empty clusters.

    The metric is None, a weight a column, or a matrix whose product with a difference has the distance as its norm.
    """

    copy: int
    centers: np.ndarray
    metric: np.ndarray | None = None
    moved: dict[int, int] = field(default_factory=dict)


class Sample:
    """A sample as kept blocks of rows, numbered from 0 in the order of ids, and copies with permuted columns."""

    def __init__(self, df: DataFrame):
        self.n, self.p = dimensions(df)
        self.copies, self._cuts = 0, None
        self.cores = df.sparkSession.sparkContext.defaultParallelism
        self.partitions = self._tasks(1)
        ordered = df.select("id", "x").repartitionByRange(self.partitions, "id").sortWithinPartitions("id", "x")

        def pack(batches):
            from pyspark import TaskContext

            part, number, held, n = TaskContext.get().partitionId(), 0, [], 0
            for b in batches:
                if b.num_rows:
                    held.append(rows_of(b.column(1)))
                    n += b.num_rows
                while n >= BLOCK_ROWS:
                    whole = np.concatenate(held)
                    yield block(part, number, whole[:BLOCK_ROWS])
                    held, n, number = [whole[BLOCK_ROWS:]], n - BLOCK_ROWS, number + 1
            if n:
                yield block(part, number, np.concatenate(held))

        def block(part, number, rows):
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), pa.array([len(rows)]), pa.array([np.ascontiguousarray(rows, float).tobytes()], pa.binary())], names=["part", "number", "n", "rows"])

        packed = ordered.mapInArrow(pack, "part long, number long, n long, rows binary").persist()
        before, base = 0, {}
        for r in sorted(packed.groupBy("part").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["part"]):
            base[r["part"]], before = before, before + r["n"]

        def place(batches):
            for b in batches:
                begin = [base[a] + k * BLOCK_ROWS for a, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b.num_rows, np.int32)), pa.array(begin, pa.int64()), b.column(3)], names=["copy", "begin", "rows"])

        self._kept = [packed]
        self._keep(packed.mapInArrow(place, _STORED))

    def _tasks(self, copies: int) -> int:
        """Partitions for some copies: a task a core, no more than blocks, and of ``TASK_BYTES`` at most."""
        return min(copies * -(-self.n // BLOCK_ROWS), max(self.cores, -(-copies * self.n * self.p * 8 // TASK_BYTES)))

    def _keep(self, blocks: DataFrame) -> None:
        """Keep the blocks as they are passed over, and no longer what they come from."""
        self.blocks = blocks.persist()
        self.blocks.count()
        for x in self._kept:
            x.unpersist()
        self._kept = [self.blocks]

    def __enter__(self) -> Sample:
        return self

    def __exit__(self, *_) -> None:
        for x in self._kept:
            x.unpersist()

    def permute(self, copies: int, where: Callable[[int, int, np.ndarray], np.ndarray]) -> None:
        """Add copies 1, 2, ...: row i has, in column j of copy b, what ``where(b, j, rows)`` sends there.

        ``where`` gives, for some rows' numbers, the rows that their values in column j go to; it is
        a bijection for every b and j.
        """
        p, n = self.p, self.n

        def scatter(batches):
            for b in batches:
                for begin, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    x = np.frombuffer(data).reshape(-1, p)
                    own = np.arange(begin, begin + len(x))
                    for copy in range(1, copies + 1):
                        to = np.stack([where(copy, j, own) for j in range(p)], 1)
                        order = np.argsort(to // BLOCK_ROWS, axis=None, kind="stable")
                        flat, column, value = to.ravel()[order], np.tile(np.arange(p), len(x))[order], x.ravel()[order]
                        cuts = np.flatnonzero(np.diff(flat // BLOCK_ROWS)) + 1
                        begins = np.r_[0, cuts, len(flat)]
                        payload = [(np.r_[flat[i:j] % BLOCK_ROWS * p + column[i:j]].astype("<i8").tobytes() + value[i:j].tobytes()) for i, j in zip(begins[:-1], begins[1:], strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(payload), copy, np.int32)), pa.array(flat[begins[:-1]] // BLOCK_ROWS), pa.array(payload, pa.binary())], names=["copy", "block", "entries"])

        def gather(batches):
            now, out, begin = None, None, 0

            def done():
                return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([begin], pa.int64()), pa.array([out.tobytes()], pa.binary())], names=["copy", "begin", "rows"])

            for b in batches:
                for copy, block, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if (copy, block) != now:
                        if now:
                            yield done()
                        now, begin = (copy, block), block * BLOCK_ROWS
                        out = np.empty(min(BLOCK_ROWS, n - begin) * p)
                    half = len(data) // 2
                    out[np.frombuffer(data, "<i8", half // 8)] = np.frombuffer(data, float, half // 8, half)
            if now:
                yield done()

        spread = self.blocks.mapInArrow(scatter, "copy int, block long, entries binary").repartition(self._tasks(copies), "copy", "block").sortWithinPartitions("copy", "block")
        self.copies, self.partitions = copies, self._tasks(copies + 1)
        self._keep(self.blocks.union(spread.mapInArrow(gather, _STORED)).coalesce(self.partitions))

    def total(self, f: Callable[[int, np.ndarray, np.ndarray, np.ndarray], None], size: int, of: DataFrame | None = None) -> np.ndarray:
        """What ``f(copy, rows' numbers, rows, out)`` adds to ``out``, a vector of ``size``, over all blocks."""
        p = self.p

        def g(copy, begin, rows):
            out = np.zeros(size)
            for c, a, data in zip(copy.to_pylist(), begin.to_pylist(), rows.to_pylist(), strict=True):
                x = np.frombuffer(data).reshape(-1, p)
                f(c, np.arange(a, a + len(x)), x, out)
            return out

        return total(self.blocks if of is None else of, g, self.partitions if of is None else None)

    def cuts(self) -> np.ndarray:
        """For each column, increasing values that part its rows about evenly; any would do.  Copies have the same columns."""
        if self._cuts is None:
            p, count = self.p, -(-self.n // BLOCK_ROWS)
            each, every = max(1, CUT_ROWS // count), max(1, count // CUT_ROWS)

            def some(batches):
                for b in batches:
                    for c, a, data in zip(*(x.to_pylist() for x in b.columns), strict=True):
                        if c == 0 and a // BLOCK_ROWS % every == 0:
                            x = np.frombuffer(data).reshape(-1, p)
                            yield pa.RecordBatch.from_arrays([pa.array([x[:: -(-len(x) // each)].tobytes()], pa.binary())], names=["rows"])

            rows = np.concatenate([np.frombuffer(r["rows"]).reshape(-1, p) for r in self.blocks.mapInArrow(some, "rows binary").collect()])
            self._cuts = np.quantile(rows, np.arange(1, RANGES) / RANGES, axis=0).T.copy()
        return self._cuts

    def fetched(self, f: Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """All (key, value) that ``f(copy, rows' numbers, rows)`` gives, in order."""
        p = self.p

        def run(batches):
            for b in batches:
                for c, a, data in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    x = np.frombuffer(data).reshape(-1, p)
                    key, value = f(c, np.arange(a, a + len(x)), x)
                    yield pa.RecordBatch.from_arrays([pa.array([key.astype("<i8").tobytes()], pa.binary()), pa.array([value.astype(float).tobytes()], pa.binary())], names=["key", "value"])

        rows = self.blocks.mapInArrow(run, "key binary, value binary").collect()
        key, value = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("key", "<i8"), ("value", float)))
        order = np.lexsort((value, key))
        return key[order], value[order]

    def best(self, f: Callable[[int, np.ndarray, np.ndarray], list[tuple[int, float, int]]]) -> dict[int, tuple[int, np.ndarray]]:
        """For every key, the number and row of largest value, the first of several; ``f`` gives (key, value, index) of a block's rows."""
        p = self.p

        def run(batches):
            found = {}
            for b in batches:
                for c, a, data in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    x = np.frombuffer(data).reshape(-1, p)
                    for key, value, i in f(c, np.arange(a, a + len(x)), x):
                        if key not in found or (value, -a - i) > found[key][:2]:
                            found[key] = value, -a - i, x[i].tobytes()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), *(pa.array([v[k] for v in found.values()], t) for k, t in enumerate((pa.float64(), pa.int64(), pa.binary())))], names=["key", "value", "less", "row"])

        rows = self.blocks.mapInArrow(run, "key long, value double, less long, row binary")
        if self.partitions > FAN_IN:
            rows = rows.groupBy("key").agg(F.max_by(F.struct("value", "less", "row"), F.struct("value", "less")).alias("r")).select("key", "r.*")
        # last the largest value, of equal ones the first row
        found = sorted(rows.collect(), key=lambda r: (r["value"], r["less"]))
        return {r["key"]: (-r["less"], np.frombuffer(bytes(r["row"]))) for r in found}

    def rows_at(self, numbers: list[int]) -> dict[int, np.ndarray]:
        """By copy, the rows of some numbers, in their order."""
        keys = {k: i for i, k in enumerate(numbers)}

        def some(copy, own, x):
            return [(copy * len(keys) + keys[k], 0.0, i) for i, k in enumerate(own.tolist()) if k in keys]

        found = self.best(some)
        return {c: np.array([found[c * len(keys) + i][1] for i in range(len(keys))]) for c in range(self.copies + 1)}


def keyed_bijection(seed: int, n: int) -> Callable[[int, int, np.ndarray], np.ndarray]:
    """For `Sample.permute`: permutations of 0 .. n - 1, one for each copy and column, by a keyed Feistel network.

    Numbers that leave the range go through it again until they are within.
    """
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def where(copy: int, column: int, rows: np.ndarray) -> np.ndarray:
        keys = np.random.Generator(np.random.Philox(key=[seed, copy << 32 | column])).integers(0, 1 << 63, 4, np.uint64)
        out, at = rows.astype(np.uint64), np.arange(len(rows))
        while len(at):
            left, right = out[at] >> np.uint64(half), out[at] & mask
            for k in keys:
                h = (right + k) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ (h >> np.uint64(64 - half))
            out[at] = left << np.uint64(half) | right
            at = at[out[at] >= n]
        return out.astype(np.int64)

    return where


def _given(permutations) -> Callable[[int, int, np.ndarray], np.ndarray]:
    """Explicit permutations [copy][column], each the row (from 0) whose value comes to every row."""
    back = np.argsort(np.asarray(permutations, np.int64), axis=-1)
    return lambda copy, column, rows: back[copy - 1, column][rows]


def _spread(x: np.ndarray, s: State, absolute: bool) -> np.ndarray:
    """Distances of rows from centres, squared unless ``absolute``: a column a centre."""
    out = np.empty((len(x), len(s.centers)))
    for k, c in enumerate(s.centers):
        d = x - c
        if s.metric is not None and s.metric.ndim == 2:
            out[:, k] = ((d @ s.metric) ** 2).sum(1)
        else:
            d = np.abs(d) if absolute else d * d
            out[:, k] = d.sum(1) if s.metric is None else d @ s.metric
    return out


def _labels(x: np.ndarray, own: np.ndarray, s: State, absolute: bool) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of every row, the first of several, and its distance."""
    d = _spread(x, s, absolute)
    label = d.argmin(1)
    for number, k in s.moved.items():
        if own[0] <= number <= own[-1]:
            label[number - own[0]] = k
    return label, d[np.arange(len(x)), label]


#: Numbers that tell a state's labels apart: four sums of 20 bits a row.
_LANES = 4


def _lanes(own: np.ndarray, label: np.ndarray) -> np.ndarray:
    h = (own.astype(np.uint64) * np.uint64(1 << 10) + label.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return np.array([((h >> np.uint64(16 * k)) & np.uint64((1 << 20) - 1 if k < 3 else (1 << 16) - 1)).sum() for k in range(_LANES)], float)


def _look(data: Sample, states: list[State], last: list[State | None], absolute: bool, rooted: bool) -> list[dict]:
    """One pass: for each state sizes, sums of rows by cluster, loss, labels' numbers, and rows that changed since ``last``."""
    k, p = len(states[0].centers), data.p
    size = 2 + _LANES + k + k * p

    def f(copy, own, x, out):
        for i, s in enumerate(states):
            if s.copy == copy:
                label, d = _labels(x, own, s, absolute)
                one = np.eye(k)[label]
                changed = len(x) if last[i] is None else (_labels(x, own, last[i], absolute)[0] != label).sum()
                out[i * size : (i + 1) * size] += np.r_[changed, (np.sqrt(d) if rooted else d).sum(), _lanes(own, label), one.sum(0), (one.T @ x).ravel()]

    t = data.total(f, size * len(states)).reshape(len(states), size)
    return [{"changed": int(r[0]), "loss": float(r[1]), "key": tuple(r[2 : 2 + _LANES]), "sizes": r[2 + _LANES : 2 + _LANES + k], "sums": r[2 + _LANES + k :].reshape(k, p)} for r in t]


def _settled(data: Sample, states: list[State], last: list[State | None], absolute: bool, rooted: bool, empty_action: str, partial: Callable[[list[State], list[dict]], list[np.ndarray]]) -> tuple[list[State], list[dict]]:
    """A pass whose clusters all have rows: an empty one is an error or, for "farthest", gets a row.

    That is the row farthest from its own centre, of those in clusters of two or more, the first of
    several; one cluster at a time, from the first, with centres brought up to date in between.
    """
    if empty_action not in ("error", "farthest"):
        raise ValueError(f"no action {empty_action!r}")
    states, found = list(states), _look(data, states, last, absolute, rooted)
    centers = [s.centers for s in states]
    while any((r["sizes"] == 0).any() for r in found):
        if empty_action == "error":
            raise ArithmeticError("an empty cluster")
        need = [i for i, r in enumerate(found) if (r["sizes"] == 0).any()]

        def far(copy, own, x, need=need, states=tuple(states), centers=tuple(centers), sizes=tuple(r["sizes"] for r in found)):
            out = []
            for i in need:
                if states[i].copy == copy:
                    label, _ = _labels(x, own, states[i], absolute)
                    d = _spread(x, replace(states[i], centers=centers[i]), absolute)[np.arange(len(x)), label]
                    d = np.where(sizes[i][label] >= 2, d, -1.0)
                    if d.max() >= 0:
                        out.append((i, float(d.max()), int(d.argmax())))
            return out

        best = data.best(far)
        for i in need:
            if i not in best:
                raise ArithmeticError("no cluster can give a row to an empty one")
            states[i] = replace(states[i], moved={**states[i].moved, best[i][0]: int(np.flatnonzero(found[i]["sizes"] == 0)[0])})
        found = _look(data, states, last, absolute, rooted)
        centers = partial(states, found)
    return states, found


def _start(data: Sample, k: int, initial, first_index: int, seed: int | None) -> dict[int, np.ndarray]:
    """Starting centres by copy.

    ``initial`` is "maxmin" (the row ``first_index`` counted from 1 by id, then always the row farthest
    from all chosen, the first of several), "random" (different rows by ``seed``), k
    different row numbers from 1, or centres.
    """
    if isinstance(initial, str) and initial == "random":
        if seed is None:
            raise ValueError("a random start needs a seed")
        picked: list[int] = []  # a number of rows drawn one by one, without a list of all
        g = np.random.default_rng(seed)
        while len(picked) < k:
            i = int(g.integers(data.n))
            if i not in picked:
                picked.append(i)
        return data.rows_at(picked)
    if not isinstance(initial, str):
        a = np.asarray(initial)
        if a.ndim == 2:
            if a.shape != (k, data.p):
                raise ValueError("centres of another shape")
            return {c: a.astype(float) for c in range(data.copies + 1)}
        numbers = [int(v) - 1 for v in a.tolist()]
        if len(set(numbers)) != k or min(numbers) < 0 or max(numbers) >= data.n:
            raise ValueError("as many different rows as clusters are needed")
        return data.rows_at(numbers)
    if initial != "maxmin":
        raise ValueError(f"no start {initial!r}")
    if not 1 <= first_index <= data.n:
        raise ValueError("no such first row")
    found = data.rows_at([first_index - 1])
    while len(next(iter(found.values()))) < k:

        def far(copy, own, x, found=found):
            d = _spread(x, State(copy, found[copy]), False).min(1)
            return [(copy, float(d.max()), int(d.argmax()))]

        for c, (_, row) in data.best(far).items():
            if not ((found[c] - row) ** 2).sum(1).min() > 0:
                raise ValueError("fewer different rows than centres")
            found[c] = np.vstack([found[c], row])
    return found


def feature_weights(scores: np.ndarray, bound: float) -> np.ndarray:
    """The w >= 0 with largest w . scores, norm 1 at most and sum ``bound`` at most.

    It is proportional to the scores less a threshold; with the m largest above it,
    the threshold solves a quadratic equation.  For a bound of 1 the first
    largest score has all weight.
    """
    a = np.asarray(scores, float)
    if not np.isfinite(a).all() or (a < 0).any() or not a.max(initial=0) > 0:
        raise ArithmeticError("scores must be finite, not negative and not all zero")
    if bound == 1:
        return np.eye(len(a))[a.argmax()]
    threshold = 0.0
    if a.sum() > bound * np.linalg.norm(a):
        top = a.max()
        b = np.sort(a / top)[::-1]
        m = np.arange(1, len(b) + 1)
        s1, s2 = np.cumsum(b), np.cumsum(b * b)
        # (s1 - m t)^2 = bound^2 (s2 - 2 t s1 + m t^2), at the smaller root, for the m whose t lies between b[m] and b[m - 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (s1 - bound * np.sqrt(np.maximum(m * s2 - s1**2, 0) / (m - bound**2))) / m
        fits = (m > bound**2) & (t <= b) & (t >= np.r_[b[1:], 0.0])
        if not fits.any():  # largest scores that tie: more of them than the bound lets through
            raise ArithmeticError("largest scores tie: no weights are defined")
        threshold = float(t[fits][-1]) * top
    w = np.maximum(a - threshold, 0)
    return w / np.linalg.norm(w)


def _means(states: list[State], found: list[dict]) -> list[np.ndarray]:
    return [np.where(r["sizes"][:, None] > 0, r["sums"] / np.maximum(r["sizes"], 1)[:, None], s.centers) for s, r in zip(states, found, strict=True)]


_TOP = np.uint64(1 << 63)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Numbers in the order of some doubles."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits & _TOP, ~bits, bits | _TOP)


def _double(key: np.ndarray) -> np.ndarray:
    return np.where(key & _TOP, key ^ _TOP, ~key).view(float)


def column_medians(data: Sample, states: list[State], sizes: list[np.ndarray], absolute: bool = True) -> list[np.ndarray]:
    """The medians, between the two middle values, of each column in each cluster of each state.

    An empty cluster keeps its centre.
    """
    k, p, cuts = len(states[0].centers), data.p, data.cuts()

    def ranges(x):
        return np.stack([np.searchsorted(cuts[j], x[:, j], side="right") for j in range(p)], 1)

    def count(copy, own, x, out):
        found = None
        for i, s in enumerate(states):
            if s.copy == copy:
                found = ranges(x) if found is None else found
                label, _ = _labels(x, own, s, absolute)
                at = ((i * k + label[:, None]) * p + np.arange(p)) * RANGES + found
                out += np.bincount(at.ravel(), minlength=len(out))

    ends = data.total(count, len(states) * k * p * RANGES).reshape(len(states), k, p, RANGES).cumsum(-1).astype(np.int64)
    n = np.stack(sizes).astype(np.int64)[..., None]
    ranks = np.maximum(n - 1, 0) // 2, n // 2
    low, high = (np.minimum((ends <= r[..., None]).sum(-1), RANGES - 1) for r in ranks)  # ranges of the middle values
    before = np.where(low > 0, np.take_along_axis(ends, np.maximum(low - 1, 0)[..., None], -1)[..., 0], 0)
    within = np.where(n > 0, np.take_along_axis(ends, high[..., None], -1)[..., 0] - before, 0)
    if within.sum() > FETCHED:
        return _medians_by_bits(data, states, sizes, absolute)

    def middle(copy, own, x):
        found, keys, values = None, [np.empty(0, np.int64)], [np.empty(0)]
        for i, s in enumerate(states):
            if s.copy == copy:
                found = ranges(x) if found is None else found
                label, _ = _labels(x, own, s, absolute)
                row, column = np.nonzero((found >= low[i][label]) & (found <= high[i][label]))
                keys.append((i * k + label[row]) * p + column)
                values.append(x[row, column] + 0.0)
        return np.concatenate(keys), np.concatenate(values)

    _, values = data.fetched(middle)
    first = (np.cumsum(within) - within.ravel()).reshape(within.shape) - before
    a, b = (values[np.where(n > 0, first + r, 0)] for r in ranks)
    return [np.where(m > 0, u / 2 + v / 2, s.centers) for s, m, u, v in zip(states, n, a, b, strict=True)]


def _medians_by_bits(data: Sample, states: list[State], sizes: list[np.ndarray], absolute: bool) -> list[np.ndarray]:
    """`column_medians` whatever the number of values around them."""
    k, p = len(states[0].centers), data.p
    rank = np.stack([np.stack([(n - 1) // 2, n // 2], 0) for n in sizes]).astype(np.int64)  # state, lower or upper, cluster; from 0
    left = np.repeat(np.maximum(rank, 0)[..., None], p, -1)
    prefix = np.zeros((len(states), 2, k, p), np.uint64)
    for shift in range(56, -8, -8):
        same = bool((prefix[:, 0] == prefix[:, 1]).all())

        def f(copy, own, x, out, prefix=prefix, shift=shift, kinds=1 if same else 2):
            key = _ordered(x)
            head, digit = (key >> np.uint64(shift + 8) if shift < 56 else np.zeros_like(key)), (key >> np.uint64(shift) & np.uint64(255)).astype(np.int64)
            count = out.reshape(len(states), 2, k, p * 256)
            column = np.arange(p) * 256
            for i, s in enumerate(states):
                if s.copy == copy:
                    label, _ = _labels(x, own, s, absolute)
                    for c in range(k):
                        rows = label == c
                        for kind in range(kinds):
                            at = head[rows] == prefix[i, kind, c]
                            count[i, kind, c] += np.bincount((digit[rows] + column)[at], minlength=p * 256)

        t = data.total(f, len(states) * 2 * k * p * 256).reshape(len(states), 2, k, p, 256)
        if same:
            t[:, 1] = t[:, 0]
        ends = t.cumsum(-1)
        digit = (ends <= left[..., None]).sum(-1)
        digit = np.minimum(digit, 255)
        left = left - (np.take_along_axis(ends, digit[..., None], -1) - np.take_along_axis(t, digit[..., None], -1))[..., 0].astype(np.int64)
        prefix = prefix << np.uint64(8) | digit.astype(np.uint64)
    low, high = _double(prefix[:, 0]), _double(prefix[:, 1])
    return [np.where(n[:, None] > 0, a / 2 + b / 2, s.centers) for s, n, a, b in zip(states, sizes, low, high, strict=True)]


def _trace(objectives: list[float], rising: bool) -> float:
    """The largest step in the wrong direction."""
    steps = np.diff(objectives)
    return float(max([0.0, *(-steps if rising else steps)]))


def _weighted(data: Sample, k: int, bounds: list[float], copies: list[int], medians: bool, initial, first_index: int, seed, empty_action: str, max_iter: int | None, tol: float) -> list[dict]:
    """Fits of feature-weighted means or medians, one for each pair of bound and copy, in step."""
    if not all(1 <= b <= math.sqrt(data.p) for b in bounds):
        raise ValueError("bounds must lie between 1 and the root of the number of columns")
    if not 1 <= k <= data.n:
        raise ValueError("no such number of clusters")
    start = _start(data, k, initial, first_index, seed)

    def partial(states, found):
        return column_medians(data, states, [r["sizes"] for r in found]) if medians else _means(states, found)

    begun = {c: State(c, start[c]) for c in copies}
    states, found = _settled(data, list(begun.values()), [None] * len(begun), medians, False, empty_action, partial)
    centers = partial(states, found)
    whole = _whole(data, copies, medians)
    first = dict(zip(copies, zip(states, found, centers, strict=True), strict=True))
    fits = [{"bound": b, "copy": c, "state": first[c][0], "found": first[c][1], "centers": first[c][2], "seen": {first[c][1]["key"]}, "trace": [], "iterations": 0, "converged": False, "cycle": False} for c in copies for b in bounds]
    going = fits
    for it in itertools.count(1) if max_iter is None else range(1, max_iter + 1):
        for fit, scores in zip(going, _scores(data, going, whole, medians), strict=True):
            fit["scores"], fit["weights"] = scores, feature_weights(scores, fit["bound"])
            fit["trace"].append(float(fit["weights"] @ scores))
        new = [State(f["copy"], f["centers"], f["weights"]) for f in going]
        new, found = _settled(data, new, [f["state"] for f in going], medians, False, empty_action, partial)
        centers = partial(new, found)
        for fit, s, r, c in zip(going, new, found, centers, strict=True):
            fit.update(state=s, found=r, centers=c, iterations=it, converged=r["changed"] == 0, cycle=r["changed"] > 0 and r["key"] in fit["seen"])
            fit["seen"].add(r["key"])
        going = [f for f in going if not (f["converged"] or f["cycle"])]
        if not going:
            break
    for fit, scores in zip(fits, _scores(data, fits, whole, medians), strict=True):
        fit["scores"], fit["weights"] = scores, feature_weights(scores, fit["bound"])
        fit["objective"] = float(fit["weights"] @ scores)
        if fit["objective"] != fit["trace"][-1]:
            fit["trace"].append(fit["objective"])
        fall = _trace(fit["trace"], True)
        fit["certified"] = fit["converged"] and fall <= tol * max(1.0, abs(fit["trace"][0]))
        if not fit["certified"]:
            raise ArithmeticError("labels came again" if fit["cycle"] else "the objective fell" if fit["converged"] else "the clusters did not settle")
        fit["sizes"] = fit["found"]["sizes"].astype(int)
    return fits


def _whole(data: Sample, copies: list[int], medians: bool) -> dict[int, np.ndarray]:
    """Of each copy, the columns' medians and absolute deviations from them, or their means."""
    one = [State(c, np.zeros((1, data.p))) for c in copies]
    if not medians:
        return {c: r["sums"][0] / data.n for c, r in zip(copies, _look(data, one, [None] * len(one), False, False), strict=True)}
    found = column_medians(data, one, [np.array([data.n])] * len(one))
    return dict(zip(copies, _deviations(data, [replace(s, centers=m) for s, m in zip(one, found, strict=True)], found), strict=True))


def _deviations(data: Sample, states: list[State], centers: list[np.ndarray]) -> list[np.ndarray]:
    """Of each state's rows, the summed absolute deviations, a column each, from some centres of their clusters."""
    p = data.p

    def f(copy, own, x, out):
        for i, s in enumerate(states):
            if s.copy == copy:
                label, _ = _labels(x, own, s, True)
                out[i * p : (i + 1) * p] += np.abs(x - centers[i][label]).sum(0)

    return list(data.total(f, p * len(states)).reshape(-1, p))


def _scores(data: Sample, fits: list[dict], whole: dict[int, np.ndarray], medians: bool) -> list[np.ndarray]:
    """How much each column gains by the clusters.

    For means twice the sum of squares between them, which is that over ordered pairs; for medians
    the absolute deviations from the columns' medians less those from the clusters'.
    """
    if not medians:
        return [2 * (f["found"]["sizes"][:, None] * (f["centers"] - whole[f["copy"]]) ** 2).sum(0) for f in fits]
    within = _deviations(data, [f["state"] for f in fits], [f["centers"] for f in fits])
    out = []
    for f, d in zip(fits, within, strict=True):
        gain = whole[f["copy"]] - d
        if (gain < -1e-10 * np.maximum(1.0, whole[f["copy"]])).any():
            raise ArithmeticError("a column's deviations grew")
        out.append(np.maximum(gain, 0.0))
    return out


def sparse_kmeans(df: DataFrame, k: int, s: float, initial="maxmin", first_index: int = 1, seed: int | None = None, empty_action: str = "error", max_iter: int | None = None, tol: float = 1e-10) -> dict:
    """k-means whose columns are weighted, weights of norm 1 and of sum ``s`` at most.

    Weights that make the weighted sum of squares between clusters largest, and nearest centres under
    them, take turns until no row changes; rows at the same distance go to the first centre.  Labels that come again, a falling objective and
    an empty cluster (unless ``empty_action`` is "farthest") are errors.  Labels are finitely many, so that turns
    end by themselves; there are more of them the more rows there are.  With ``max_iter``, more turns are an error.
    """
    with Sample(df) as data:
        return _weighted(data, k, [s], [0], False, initial, first_index, seed, empty_action, max_iter, tol)[0]


def sparse_kmedian(df: DataFrame, k: int, s: float, initial="maxmin", first_index: int = 1, seed: int | None = None, empty_action: str = "error", max_iter: int | None = None, tol: float = 1e-10) -> dict:
    """`sparse_kmeans` with medians of columns, between the middle values, and absolute distances."""
    with Sample(df) as data:
        return _weighted(data, k, [s], [0], True, initial, first_index, seed, empty_action, max_iter, tol)[0]


def weighted_assign(df: DataFrame, centers: np.ndarray, weights: np.ndarray, absolute: bool = False) -> DataFrame:
    """Rows (id, cluster, distance): the nearest centre under weights, the first of several, and its (squared) distance."""
    s = State(0, np.asarray(centers, float), np.asarray(weights, float))

    def run(batches):
        for b in batches:
            if b.num_rows:
                label, d = _labels(rows_of(b.column(1)), np.zeros(b.num_rows), s, absolute)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label.astype(np.int32)), pa.array(d)], names=["id", "cluster", "distance"])

    return df.select("id", "x").mapInArrow(run, "id long, cluster int, distance double")


def _copies(data: Sample, B: int | None, seed: int | None, permutations) -> int:
    """Add permuted copies by a seed, or as given: [copy][column][row], rows from 0."""
    if (permutations is None) == (B is None or seed is None):
        raise ValueError("either permutations, or their number and a seed")
    if permutations is not None:
        a = np.asarray(permutations)
        if a.ndim != 3 or a.shape[1:] != (data.p, data.n) or (np.sort(a, -1) != np.arange(data.n)).any():
            raise ValueError("every column of every copy needs a permutation of the rows")
        data.permute(len(a), _given(a))
    else:
        data.permute(B, keyed_bijection(seed, data.n))
    return data.copies


def _gaps(grid: list[float], objectives: np.ndarray) -> list[dict]:
    """By setting, the log objective of the sample less the mean of the copies'; ``objectives`` has a row a copy, the sample's first."""
    if not np.isfinite(objectives).all() or (objectives <= 0).any():
        raise ArithmeticError("every objective must be finite and positive")
    logs = np.log(objectives)
    n = len(logs) - 1
    sd = logs[1:].std(0, ddof=1) if n > 1 else np.full(len(grid), np.nan)
    return [{"setting": g, "objective": float(objectives[0, i]), "mean_log": float(logs[1:, i].mean()), "sd_log": float(sd[i]), "se": float(math.sqrt(1 + 1 / n) * sd[i]), "gap": float(logs[0, i] - logs[1:, i].mean())} for i, g in enumerate(grid)]


def sparse_kmeans_select_s(df: DataFrame, k: int, s_grid: list[float], B: int | None = None, seed: int | None = None, permutations=None, selection: str = "max", initial="maxmin", first_index: int = 1, clustering_seed: int | None = None, empty_action: str = "error", max_iter: int | None = None, tol: float = 1e-10) -> dict:
    """The bound of `sparse_kmeans` by the gap to samples whose columns are permuted.

    All fits, of the sample and of ``B`` copies for every bound, go on in step.
    "max" takes the smallest bound of largest gap; "one_se" the smallest whose gap is
    at least that less its standard error.
    """
    grid = sorted(set(map(float, s_grid)))
    if selection not in ("max", "one_se") or len(grid) != len(s_grid) or not grid:
        raise ValueError("a rule and different bounds are needed")
    with Sample(df) as data:
        n = _copies(data, B, seed, permutations)
        if selection == "one_se" and n < 2:
            raise ValueError("two copies at least are needed")
        fits = _weighted(data, k, grid, list(range(n + 1)), False, initial, first_index, clustering_seed, empty_action, max_iter, tol)
    table = _gaps(grid, np.array([f["objective"] for f in fits]).reshape(n + 1, len(grid)))
    gaps = np.array([r["gap"] for r in table])
    at = int(gaps.argmax())
    if selection == "one_se":
        at = int(np.flatnonzero(gaps >= gaps[at] - table[at]["se"])[0])
    return {"selected": grid[at], "fit": fits[at], "table": table, "objectives": np.array([f["objective"] for f in fits]).reshape(n + 1, len(grid))}


def spatial_medians(data: Sample, groups: list[tuple[State, int | None, np.ndarray | None]], start: list[np.ndarray], tol: float = 1e-8, max_iter: int = 500, zero_tol: float = 0.0, of: DataFrame | None = None, squares: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Spatial medians of some groups of rows, all by steps together.

    A group is a state's cluster (None: all rows of its copy), over some columns (None:
    all; the others are 0).  Steps are Newton's while each leaves a smaller sum of directions;
    after one that does not, the group goes back and on by weighted means.  A median that does not settle is an error.
    ``squares`` gets, for each group, the sum of its rows' squared directions from the median.
    """
    p = data.p
    masks = [np.ones(p) if g[2] is None else np.asarray(g[2], float) for g in groups]
    at = [np.asarray(y, float) * m for y, m in zip(start, masks, strict=True)]
    done: list[np.ndarray | None] = [None] * len(groups)
    size = p + 3 + p * p * (1 + (squares is not None))
    best: list[tuple] = [(math.inf,)] * len(groups)  # length of the sum of directions, where, and the plain step from there
    newton, found = [True] * len(groups), [None] * len(groups)

    def members(copy, own, x, wanted):
        """Each wanted group's rows in a block; labels once a state."""
        label: dict[int, np.ndarray] = {}
        for i in wanted:
            s, k, _ = groups[i]
            if s.copy == copy:
                if k is not None and id(s) not in label:
                    label[id(s)] = _labels(x, own, s, False)[0]
                yield i, (np.arange(len(x)) if k is None else np.flatnonzero(label[id(s)] == k))

    for it in range(max_iter + 1):
        going = [i for i, d in enumerate(done) if d is None]
        if not going:
            if squares is not None:
                squares.extend(found)
            return done
        tries = {(i, 0): at[i] for i in going}
        if it % 10 == 9:  # a median may be a row, which steps only come near to

            def near(copy, own, x, going=tuple(going), at=tuple(at)):
                out = []
                for i, rows in members(copy, own, x, going):
                    if len(rows):
                        d = (((x[rows] - at[i]) * masks[i]) ** 2).sum(1)
                        out.append((i, -float(d.min()), int(rows[d.argmin()])))
                return out

            tries |= {(i, 1): row * masks[i] for i, (_, row) in data.best(near).items()}
        keys = list(tries)

        def sums(copy, own, x, out, keys=tuple(keys), tries=tries, going=tuple(going)):
            rows_of_group = dict(members(copy, own, x, going))
            for j, (i, t) in enumerate(keys):
                if i in rows_of_group:
                    u, r = signs((x[rows_of_group[i]] - tries[i, t]) * masks[i], zero_tol)
                    on = r > zero_tol
                    w = u[on]
                    out[j * size : (j + 1) * size] += np.concatenate([u.sum(0), [(1 / r[on]).sum(), len(r) - on.sum(), len(r)], ((w / r[on, None]).T @ w).ravel(), *([(w.T @ w).ravel()] if size > p + 3 + p * p else [])])

        t = data.total(sums, size * len(keys), of).reshape(len(keys), size)
        for (i, kind), r in zip(keys, t, strict=True):
            direction, inverse, same, n = r[:p], r[p], r[p + 1], r[p + 2]
            length = float(np.linalg.norm(direction))
            if done[i] is None and (inverse == 0 or max(0.0, length - same) / n <= tol):
                done[i], found[i] = tries[i, kind], r[p + 3 + p * p :].reshape(-1, p)
            elif done[i] is None and kind == 0:
                plain = (1 - min(1.0, same / length)) * direction / inverse
                if newton[i] and length >= best[i][0]:
                    newton[i], at[i] = False, best[i][1] + best[i][2]
                    continue
                best[i] = length, at[i], plain
                if newton[i] and same == 0:
                    bend = (1 + 1e-12) * inverse * np.eye(p) - r[p + 3 : p + 3 + p * p].reshape(p, p)
                    at[i] = at[i] + np.linalg.solve(bend, direction) * masks[i]
                else:
                    at[i] = at[i] + plain
    raise ArithmeticError("a spatial median did not converge")


def _active(scores: np.ndarray, tau: float, empty_active: str) -> np.ndarray:
    """Columns whose score is ``tau`` at least; where none is, an error, the first largest, or all."""
    on = scores >= tau
    if not on.any():
        if empty_active == "error":
            raise ArithmeticError("no column is left")
        on = np.arange(len(scores)) == scores.argmax() if empty_active == "largest" else np.ones(len(scores), bool)
    return on


def _metric(m: np.ndarray, ridge: float) -> np.ndarray:
    """A root of the inverse of the mean square of residual directions with a ridge."""
    values, vectors = np.linalg.eigh((m + m.T) / 2 + ridge * np.eye(len(m)))
    if not values.min() > 0:
        raise ArithmeticError("the metric is not positive definite")
    return vectors / np.sqrt(values)


def _medians_in_step(data: Sample, k: int, settings: list[dict], copies: list[int], initial, first_index: int, seed, tol: float, max_iter: int, spatial_max_iter: int, zero_tol: float, empty_action: str, empty_active: str, cycle_action: str) -> list[dict]:
    """Clusterings by spatial medians, one for each pair of copy and setting: {"tau"}, {"ridge"} or {}."""
    if cycle_action not in ("error", "return") or empty_active not in ("error", "largest", "all"):
        raise ValueError("no such action")
    if not 1 <= k <= data.n:
        raise ValueError("no such number of clusters")
    start = _start(data, k, initial, first_index, seed)

    def settled(states, last):
        # a moved row's new cluster is no nearer; its old centres stay for the next choice
        return _settled(data, states, last, False, True, empty_action, lambda ss, _: [s.centers for s in ss])

    def step(going):
        """New centres, and what screens or turns the columns, of some fits' labels."""
        groups = [(f["state"], c, None) for f in going for c in range(k)]
        at = [f["found"]["sums"][c] / f["found"]["sizes"][c] if f["fresh"] else f["centers"][c] for f in going for c in range(k)]
        squares = [] if "ridge" in going[0] else None
        found = spatial_medians(data, groups, at, tol, spatial_max_iter, zero_tol, squares=squares)
        centers = [np.array(found[i * k : (i + 1) * k]) for i in range(len(going))]
        for i, (f, c) in enumerate(zip(going, centers, strict=True)):
            f.update(centers=c, fresh=False, scores=np.abs(c - c.mean(0)).sum(0), metric=None if squares is None else _metric(sum(squares[i * k : (i + 1) * k]) / data.n, f["ridge"]))
            if "tau" in f:
                f["active"] = _active(f["scores"], f["tau"], empty_active)
                f["metric"] = f["active"].astype(float)

    begun = [State(c, start[c]) for c in copies]
    states, found = settled(begun, [None] * len(begun))
    first = dict(zip(copies, zip(states, found, strict=True), strict=True))
    fits = [{**s, "copy": c, "state": first[c][0], "found": first[c][1], "centers": start[c], "fresh": True, "seen": {(first[c][1]["key"], b"")}, "history": [first[c][1]["loss"]], "iterations": 0, "converged": False, "cycle": False} for c in copies for s in settings]
    going = fits
    for it in range(1, max_iter + 1):
        step(going)
        new, found = settled([State(f["copy"], f["centers"], f["metric"]) for f in going], [f["state"] for f in going])
        for f, s, r in zip(going, new, found, strict=True):
            key = r["key"], f["active"].tobytes() if "tau" in f else b""
            f.update(iterations=it, converged=r["changed"] == 0, cycle=r["changed"] > 0 and key in f["seen"])
            f["history"].append(r["loss"])
            f["seen"].add(key)
            f["final"] = r["loss"]
            f.update(state=s, found=r)
            if f["cycle"] and cycle_action == "error":
                raise ArithmeticError("labels came again")
        going = [f for f in going if not (f["converged"] or f["cycle"])]
        if not going:
            break
    if left := [f for f in fits if not f["converged"]]:  # centres of the labels given back
        step(left)
    for f in fits:
        f["sizes"] = f["found"]["sizes"].astype(int)
        f["objective"] = f["history"][-1]
    return fits


def sm_sscm(df: DataFrame, k: int, ridge: float, initial="maxmin", first_index: int = 1, seed: int | None = None, tol: float = 1e-8, max_iter: int = 100, spatial_max_iter: int = 500, zero_tol: float = 0.0, empty_action: str = "error", cycle_action: str = "error") -> dict:
    """Clusters about spatial medians, nearest in the metric of the inverse of residual signs' mean square plus a ridge."""
    if not 0 < ridge < math.inf:
        raise ValueError("the ridge must be positive")
    with Sample(df) as data:
        return _medians_in_step(data, k, [{"ridge": ridge}], [0], initial, first_index, seed, tol, max_iter, spatial_max_iter, zero_tol, empty_action, "error", cycle_action)[0]


def sparse_k_spatial_median(df: DataFrame, k: int, tau: float, initial="maxmin", first_index: int = 1, seed: int | None = None, tol: float = 1e-8, max_iter: int = 100, spatial_max_iter: int = 500, zero_tol: float = 0.0, empty_action: str = "error", empty_active: str = "error", cycle_action: str = "error", reset_excluded: str = "none") -> dict:
    """Clusters about spatial medians, nearest in the columns whose centres differ enough.

    A column stays if its centres' absolute deviations from their mean add up to ``tau`` at least.
    With "overall_spatial_median", the centres given back have, in the other columns, those of all rows' median.
    """
    if not 0 <= tau < math.inf or reset_excluded not in ("none", "overall_spatial_median"):
        raise ValueError("tau must not be negative, and the reset a known one")
    with Sample(df) as data:
        fit = _medians_in_step(data, k, [{"tau": tau}], [0], initial, first_index, seed, tol, max_iter, spatial_max_iter, zero_tol, empty_action, empty_active, cycle_action)[0]
        fit["algorithm_centers"] = fit["centers"]
        if reset_excluded != "none" and not fit["active"].all():
            s = State(0, fit["centers"])
            overall = spatial_medians(data, [(s, None, None)], [(fit["sizes"][:, None] * fit["centers"]).sum(0) / data.n], tol, spatial_max_iter, zero_tol)[0]
            fit["centers"] = np.where(fit["active"], fit["centers"], overall)
        return fit


def _tau_gaps(data: Sample, k: int, grid: list[float], settings: dict) -> dict:
    """Fits of all copies and thresholds in step, and the gap of the dispersion between their centres."""
    fits = _medians_in_step(data, k, [{"tau": t} for t in grid], list(range(data.copies + 1)), **settings)
    middle = spatial_medians(data, [(f["state"], None, f["active"]) for f in fits], [(f["sizes"][:, None] * f["centers"]).sum(0) / data.n for f in fits], settings["tol"], settings["spatial_max_iter"], settings["zero_tol"])
    between = np.array([(f["sizes"] * (((f["centers"] - m) * f["active"]) ** 2).sum(1)).sum() for f, m in zip(fits, middle, strict=True)]).reshape(-1, len(grid))
    table = _gaps(grid, between)
    at = int(np.argmax([r["gap"] for r in table]))
    return {"selected": grid[at], "fit": fits[at], "table": table, "objectives": between}


def _grid(values) -> list[float]:
    grid = sorted(set(map(float, values)))
    if not grid or grid[0] < 0 or not math.isfinite(grid[-1]):
        raise ValueError("thresholds must be finite and not negative")
    return grid


def sparse_sm_select_tau(df: DataFrame, k: int, tau_grid: list[float], B: int | None = None, seed: int | None = None, permutations=None, initial="maxmin", first_index: int = 1, clustering_seed: int | None = None, tol: float = 1e-8, max_iter: int = 100, spatial_max_iter: int = 500, zero_tol: float = 0.0, empty_action: str = "error", empty_active: str = "error", cycle_action: str = "error") -> dict:
    """The threshold of `sparse_k_spatial_median` by the gap; the smallest of several.

    The objective is the squared distance of the centres from all rows' spatial median, in the
    columns kept, a row each.
    """
    with Sample(df) as data:
        _copies(data, B, seed, permutations)
        return _tau_gaps(data, k, _grid(tau_grid), {"initial": initial, "first_index": first_index, "seed": clustering_seed, "tol": tol, "max_iter": max_iter, "spatial_max_iter": spatial_max_iter, "zero_tol": zero_tol, "empty_action": empty_action, "empty_active": empty_active, "cycle_action": cycle_action})


def sparse_sm_select_k(df: DataFrame, k_grid: list[int], tau_grid: list[float], B: int | None = None, seed: int | None = None, permutations=None, initial="maxmin", first_index: int = 1, clustering_seed: int | None = None, tol: float = 1e-8, max_iter: int = 100, spatial_max_iter: int = 500, zero_tol: float = 0.0, empty_action: str = "error", empty_active: str = "error", cycle_action: str = "error") -> dict:
    """The number of clusters whose medians lie farthest apart for what lies around them; the smallest of several.

    For each number, the threshold by `sparse_sm_select_tau`; then, in the columns
    kept, the medians' mean distance over k - 1 against the rows' mean distance from them over n - k.
    """
    settings = {"initial": initial, "first_index": first_index, "seed": clustering_seed, "tol": tol, "max_iter": max_iter, "spatial_max_iter": spatial_max_iter, "zero_tol": zero_tol, "empty_action": empty_action, "empty_active": empty_active, "cycle_action": cycle_action}
    ks, grid = sorted(set(map(int, k_grid))), _grid(tau_grid)
    table, fits = [], []
    with Sample(df) as data:
        if not ks or ks[0] < 2 or ks[-1] >= data.n:
            raise ValueError("numbers of clusters must be from 2 to the rows less one")
        _copies(data, B, seed, permutations)
        for k in ks:
            fit = _tau_gaps(data, k, grid, settings)["fit"]
            on = fit["active"]
            centers = np.array(spatial_medians(data, [(fit["state"], c, on) for c in range(k)], list(fit["centers"]), tol, spatial_max_iter, zero_tol))

            def loss(copy, own, x, out, fit=fit, on=on, centers=centers):
                if copy == 0:
                    label, _ = _labels(x, own, fit["state"], False)
                    out[0] += np.sqrt((((x - centers[label]) * on) ** 2).sum(1)).sum()

            within = data.total(loss, 1)[0] / data.n
            if not within > 0:
                raise ArithmeticError(f"no distance within {k} clusters")
            apart = np.mean([np.linalg.norm(centers[i] - centers[j]) for i in range(k) for j in range(i)])
            table.append({"k": k, "tau": fit["tau"], "active": int(on.sum()), "between": float(apart), "within": float(within), "ratio": float(apart / (k - 1) / (within / (data.n - k)))})
            fits.append(fit)
    at = int(np.argmax([r["ratio"] for r in table]))
    return {"selected": ks[at], "fit": fits[at], "table": table}
