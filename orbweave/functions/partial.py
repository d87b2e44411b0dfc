"""Sums of numpy vectors over a sample, and over pairs of its rows in blocks."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.sources.samples import rows_of

BLOCK_ROWS = 1024
_PART = pa.schema([("part", pa.int32()), ("total", pa.binary())])


def _totals(f: Callable[..., np.ndarray]):
    def run(batches):
        from pyspark import TaskContext

        total = None
        for b in batches:
            if b.num_rows:
                v = np.asarray(f(*b.columns), float)
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], schema=_PART)

    return run


#: A task, and at last the driver, adds about so many vectors.
FAN_IN = 64


def total(df: DataFrame, f: Callable[..., np.ndarray], partitions: int | None = None) -> np.ndarray:
    """Sum over all Arrow batches of ``f(*columns)``, a vector of one length.

    Each partition adds its batches up; while these may be more than ``FAN_IN``, groups of
    so many are added on executors before the driver adds what is left, in order.
    ``partitions`` tells their number where the sizes of what is scanned do not.
    """
    parts = df.mapInArrow(_totals(f), "part int, total binary")
    left = partitions or _partitions(df)
    while left > FAN_IN:
        left = -(-left // FAN_IN)
        parts = parts.repartition(left, F.pmod("part", F.lit(left))).sortWithinPartitions("part").mapInArrow(_totals(lambda _, t: sum(np.frombuffer(x) for x in t.to_pylist())), "part int, total binary")
    rows = sorted(parts.collect(), key=lambda r: r["part"])
    if not rows:
        raise ValueError("an empty sample")
    return np.sum([np.frombuffer(r["total"]) for r in rows], axis=0)


def _partitions(df: DataFrame) -> int:
    """How many partitions there may be: the cores or, by the size of what is scanned, file splits."""
    spark = df.sparkSession
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    # tables without known sizes count as larger than any
    return max(spark.sparkContext.defaultParallelism, -(-size // split)) if size < 1 << 60 else max(spark.sparkContext.defaultParallelism, FAN_IN**2)


def held(f: Callable) -> Callable:
    """For functions that pass over a sample many times: its rows are read once and kept by the executors.

    A sample that is kept already, by the caller or a function around, is left as it is.
    """

    @wraps(f)
    def run(df: DataFrame, *args, **settings):
        if df.storageLevel.useMemory or df.storageLevel.useDisk:
            return f(df, *args, **settings)
        data = df.persist()
        try:
            return f(data, *args, **settings)
        finally:
            data.unpersist()

    return run


def moments(df: DataFrame, p: int, center=None) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean, and Gram matrix about ``center`` (the mean where None)."""
    if center is None:
        first = total(df.select("x"), lambda x: np.r_[len(x), rows_of(x).sum(0)])
        center = first[1:] / first[0]
    c = np.asarray(center, float)

    def gram(x):
        d = rows_of(x) - c
        return np.r_[len(x), d.sum(0), (d.T @ d).ravel()]

    t = total(df.select("x"), gram)
    return int(t[0]), c + t[1 : 1 + p] / t[0], t[1 + p :].reshape(p, p)


def blocks(df: DataFrame) -> DataFrame:
    """Rows (block, ids binary, rows binary): up to BLOCK_ROWS rows in one."""

    def run(batches):
        from pyspark import TaskContext

        part, k, ids, held = TaskContext.get().partitionId(), 0, [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            held += list(rows_of(b.column(1)))
            while len(ids) >= BLOCK_ROWS:
                yield make(part, k, ids[:BLOCK_ROWS], held[:BLOCK_ROWS])
                k, ids, held = k + 1, ids[BLOCK_ROWS:], held[BLOCK_ROWS:]
        if ids:
            yield make(part, k, ids, held)

    def make(part, k, ids, held):
        return pa.RecordBatch.from_arrays([pa.array([part << 32 | k]), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([np.array(held).tobytes()], pa.binary())], names=["block", "ids", "rows"])

    return df.select("id", "x").mapInArrow(run, "block long, ids binary, rows binary")


#: Bytes of one side of the pairs that a task goes through.
SIDE_BYTES = 64 << 20


def sides(spark: SparkSession, n: int, m: int, p: int) -> tuple[int, int]:
    """Partitions of both sides of pairs of ``n`` and ``m`` rows: few of the second, so that few sums of a row are
    shuffled; of the first enough for all cores, with some tasks a core where there are many blocks."""
    second = -(-m * p * 8 // SIDE_BYTES)
    return max(1, min(-(-n // BLOCK_ROWS), 8 * spark.sparkContext.defaultParallelism)), second


def block_pairs(x: DataFrame, y: DataFrame | None = None, into: tuple[int, int] | None = None) -> DataFrame:
    """All pairs of blocks: (x_ids, x_rows, y_ids, y_rows).

    Without ``y``, each pair of blocks of ``x`` once, a block with itself included.  The blocks are
    shuffled once, so that none is built for every partition of the other side.  ``into`` tells the
    partitions of both sides; a block's pairs within a partition of the other side follow each other.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        dealt = blocks(df).repartition(into[name == "y"]) if into else blocks(df).repartition("block")
        return dealt.select(*(F.col(c).alias(f"{name}_{c}") for c in ("block", "ids", "rows")))

    pairs = side(x, "x").crossJoin(side(x if y is None else y, "y"))
    pairs = pairs.where("x_block <= y_block") if y is None else pairs
    return pairs.select("x_ids", "x_rows", "y_ids", "y_rows")


def pairs_total(pairs: DataFrame, f: Callable[..., np.ndarray], into: tuple[int, int] | None = None) -> np.ndarray:
    """`total` over `block_pairs`: a task for each pair of partitions."""
    return total(pairs, f, into[0] * into[1] if into else int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 2)


def over_pairs(f: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], p: int):
    """A function for `total` over `block_pairs` from one of (ids, rows, ids, rows)."""

    def g(*columns):
        out = 0.0
        for a, b, c, d in zip(*(x.to_pylist() for x in columns), strict=True):
            out = out + np.asarray(f(np.frombuffer(a, "<i8"), np.frombuffer(b).reshape(-1, p), np.frombuffer(c, "<i8"), np.frombuffer(d).reshape(-1, p)), float)
        return out

    return g
