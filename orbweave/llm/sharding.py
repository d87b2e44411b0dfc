"""Sharding by jump consistent hashing: no ring table, least movement.

The hash walks from shard to shard with a 64-bit linear congruential generator
seeded by the key and stops before it would leave the shards there are.  When
shards are appended, a key either stays or moves into one of the new shards.

Everything is a DataFrame expression.  Spark's integers raise on overflow, so
the generator's state is kept as two 32-bit halves and multiplied in limbs that
fit a long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.llm.common import partitions, written

#: Fixed value: the multiplier of the published generator.
MULTIPLIER = 2862933555777941757
#: Above so many runs of a shard in a range, they are joined by a shuffle.
BROADCAST_RUNS = 1 << 18
_HIGH, _LOW, _MASK = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF, 0xFFFFFFFF


def _lit(n: int) -> Column:
    return F.lit(n).cast("long")


def _low_product(a: Column, m: int) -> Column:
    """The low 32 bits of the product of a 32-bit column and a constant."""
    return (a * _lit(m & 0xFFFF) + F.shiftleft((a * _lit(m >> 16)).bitwiseAND(_lit(0xFFFF)), 16)).bitwiseAND(_lit(_MASK))


def _step(state: Column, shards: int) -> Column:
    """The next state (hi, lo, b, j), or the same once j has left the shards."""
    hi, lo, j = state["hi"], state["lo"], state["j"]
    upper = lo * _lit(_LOW >> 16)
    low = lo * _lit(_LOW & 0xFFFF) + F.shiftleft(upper.bitwiseAND(_lit(0xFFFF)), 16) + _lit(1)
    high = F.shiftrightunsigned(upper, 16) + F.shiftrightunsigned(low, 32) + _low_product(hi, _LOW) + _low_product(lo, _HIGH)
    high = high.bitwiseAND(_lit(_MASK))
    jump = F.floor((j + _lit(1)).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(high, 1) + _lit(1)).cast("double"))).cast("long")
    moved = F.struct(high.alias("hi"), low.bitwiseAND(_lit(_MASK)).alias("lo"), j.alias("b"), jump.alias("j"))
    return F.when(j < _lit(shards), moved).otherwise(state)


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, from 0, of a 64-bit integer key; of a null key, shard 0."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = F.coalesce(key.cast("long"), _lit(0))
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(_lit(_MASK)).alias("lo"), _lit(-1).alias("b"), _lit(0).alias("j"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, lambda s, _: _step(s, shards), lambda s: s["b"].cast("int"))


def stable_key(df: DataFrame, column: str) -> Column:
    """A 64-bit key: integers as they are, anything else by its md5."""
    if isinstance(df.schema[column].dataType, T.IntegralType):
        return F.col(f"`{column}`").cast("long")
    digest = F.md5(F.col(f"`{column}`").cast("string"))
    return F.shiftleft(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), 32) + F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")


def assign_shards(docs: DataFrame, shards: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    The id and the number of shards decide (law ``key``); ``grown_shard`` is the
    shard with one more.  ``size`` is the text's UTF-8 bytes plus 1, a null text
    having none (and crc32 0).  ``slot`` numbers a shard's rows from 0 in order
    of (id, size, crc32), null ids first.  Rows with equal ids share a shard and
    get slots of their own.  Other columns are ignored; an empty table stays so.

    Only ids, sizes and checksums are shuffled, once, by ranges of ids.  Within
    a range the rows are sorted by shard, so a row's place there, less the place
    of its shard's first row, plus the shard's rows in the ranges before, is its
    slot.  One row a range and shard is joined back, by broadcast where ranges
    times shards are at most ``BROADCAST_RUNS``.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    key = stable_key(docs, id_column)
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), key.alias("k"), (F.octet_length(text) + _lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id", "size", "text_crc32").withColumn("shard", jump_hash(F.col("k"), shards)).withColumn("grown_shard", jump_hash(F.col("k"), shards + 1)).drop("k")
    at = F.monotonically_increasing_id()
    rows = rows.sortWithinPartitions("shard", "doc_id", "size", "text_crc32").withColumn("at", at)
    rows = written(rows, "shards").withColumn("part", F.shiftright("at", 33))
    runs = rows.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("shard", "part", (F.coalesce(F.sum("n").over(before), _lit(0)) - F.col("first")).alias("shift"))
    runs = F.broadcast(runs) if partitions(spark) * shards <= BROADCAST_RUNS else runs
    return rows.join(runs, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("at") + F.col("shift")).alias("slot"), "grown_shard")
