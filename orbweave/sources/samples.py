"""Samples: DataFrames of an id and a vector, checked once where they come in."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sample(df: DataFrame, id_column: str, vector: str | list[str]) -> DataFrame:
    """Rows (id, x array<double>) from a vector column or from numeric columns."""
    x = F.col(vector).cast("array<double>") if isinstance(vector, str) else F.array(*(F.col(c).cast("double") for c in vector))
    return df.select(F.col(id_column).cast("long").alias("id"), x.alias("x"))


def dimensions(df: DataFrame) -> tuple[int, int]:
    """Rows and columns; ValueError for nulls, NaN, infinities or unequal lengths."""
    bad = F.col("x").isNull() | F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    r = df.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high"), F.count_if(bad).alias("bad")).first()
    if not r["n"] or r["bad"] or r["low"] != r["high"] or r["low"] < 1:
        raise ValueError("a sample needs rows of equal length without missing or infinite values")
    return r["n"], r["low"]


def rows_of(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.empty((0, 0))


def relliptical(spark: SparkSession, n: int, location: list[float], shape: np.ndarray | None = None, radial: Callable[[np.ndarray, np.random.Generator], np.ndarray] | None = None, seed: int = 0) -> DataFrame:
    """Rows (id, x): location + radius * root of shape * uniform direction.

    The radius is chi with p degrees of freedom, or what ``radial`` gives for an
    array of row ids and a generator.  Every block of 1024 ids has a generator of
    its own, keyed by seed and block, so a lost task makes the same rows again.
    """
    mean = np.asarray(location, float)
    p = len(mean)
    values, vectors = np.linalg.eigh(np.eye(p) if shape is None else np.asarray(shape, float))
    if values.min() < -1e-10 * max(1.0, values.max()):
        raise ValueError("shape is not positive semidefinite")
    root = vectors * np.sqrt(np.maximum(values, 0))

    def make(batches):
        for b in batches:
            for block in b.column(0).to_pylist():
                ids = np.arange(block * 1024, min(n, (block + 1) * 1024))
                g = np.random.Generator(np.random.Philox(key=[seed, block]))
                z = g.standard_normal((len(ids), p))
                size = np.linalg.norm(z, axis=1)
                radius = size if radial is None else np.asarray(radial(ids, g), float)
                x = mean + (radius / size)[:, None] * z @ root.T
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "x"])

    return spark.range(-(-n // 1024)).mapInArrow(make, "id long, x array<double>")


def rspherical(spark: SparkSession, n: int, p: int, location: list[float] | None = None, radial=None, seed: int = 0) -> DataFrame:
    return relliptical(spark, n, [0.0] * p if location is None else location, None, radial, seed)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row, also where ``f`` uses it for every element of an array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def largest(a: Column) -> Column:
    return F.array_max(F.transform(a, F.abs))


def norm(a: Column) -> Column:
    """Euclidean norm, scaled by the largest absolute value first."""

    def scaled(top: Column) -> Column:
        square = F.aggregate(a, F.lit(0.0), lambda s, v: s + (v / top) * (v / top))
        return F.when(top == 0, F.lit(0.0)).otherwise(top * F.sqrt(square))

    return bound(largest(a), scaled)


def vector(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))
