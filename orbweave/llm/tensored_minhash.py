"""Near duplicates by minhash with tensored banding.

A document has two collections of ``GROUPS`` values each, every one the mix of
``EACH`` minhashes of its shingles.  A table's key is one value of the first
collection with one of the second, so that ``GROUPS`` ** 2 tables of 2 * ``EACH``
minhashes a key take 2 * ``GROUPS`` * ``EACH`` minhashes instead of ``GROUPS`` times
as many.  Two documents of similarity s meet in a table with the probability
(1 - (1 - s ** EACH) ** GROUPS) ** 2: 0.99998 at 0.85, 0.07 at 0.3.

A value that one set alone has meets nothing in any table.  So the values that
several sets have are found first, and only keys of two such are formed: exactly
those tables' lists of several sets, and possibly others, remain.

The lists go to the n-gram join's machinery: short ones give pairs, long ones
are compared with their first set.  Copies of one text meet in nearly all tables; so
what is still apart then meets once more by the values of the first collection
alone, at most 12 lists a set, until no two sets of a list
that might be alike stay apart unseen.  Every pair is confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import ddl, discard, id_and_text, join_hot, partitions, slices, written
from orbweave.llm.jaccard_join import LISTS, SALT_FROM, _lists, listed_components
from orbweave.llm.text_kernels import mix, set_keys, shingle_sets

#: Values in each of the two collections, and minhashes a value.
GROUPS, EACH = 12, 3

SKETCHES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("values", pa.binary())])
VALUES = pa.schema([("v", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("size", pa.int32())])

_FACTORS = mix(np.arange(2 * GROUPS * EACH, dtype=np.uint64), 31) | np.uint64(1)


def sketch(flat: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The values of both collections, a row a set; sets are not empty, their hashes well mixed.

    The lowest bit of a value tells the collection; equal values are of one group.
    """
    out = np.empty((len(begins) - 1, 2 * GROUPS), np.uint64)
    for g in range(2 * GROUPS):
        value = np.zeros(len(begins) - 1, np.uint64)
        for k in range(EACH):
            value = mix(value ^ np.minimum.reduceat(flat * _FACTORS[g * EACH + k], begins[:-1]), 40 + g)
        out[:, g] = value & ~np.uint64(1) | np.uint64(g >= GROUPS)
    return out


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                n, k1, k2, values = [], [], [], []
                for flat, at in shingle_sets([t.encode() if t else b"" for t in b.column(1).to_pylist()], words):
                    size = np.diff(at)
                    one, two = set_keys(flat, at)
                    some = np.flatnonzero(size)
                    rows: list[bytes | None] = [None] * len(size)
                    if len(some):
                        for d, v in zip(some.tolist(), sketch(flat, np.r_[at[some], at[-1]]), strict=True):
                            rows[d] = v.tobytes()
                    n.append(size)
                    k1.append(one)
                    k2.append(two)
                    values += rows
                if n:
                    yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.concatenate(x)) for x in (n, k1, k2)), pa.array(values, pa.binary())], schema=SKETCHES)

    return run


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole):
            of = np.repeat(np.arange(b.num_rows), 2 * GROUPS)
            v = np.frombuffer(b"".join(b.column(3).to_pylist()), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(v), *(b.column(k).take(pa.array(of)) for k in (0, 1)), b.column(2).cast(pa.int32()).take(pa.array(of))], schema=VALUES)


def table_keys(sets: DataFrame) -> DataFrame:
    """Rows (h, a, k1, k2, size): the tables' keys of different sets (k1, k2, n, values) that may meet others.

    ``a`` is the key's value of the first collection.
    """
    values = written(sets.select("k1", "k2", "n", "values").mapInArrow(_values, ddl(VALUES)), "values")
    several = written(values.groupBy("v").agg(F.count("*").alias("times")).where("times > 1"), "several")
    size = several.agg(F.sum("times").alias("n"), F.max("times").alias("most")).first()
    shared = join_hot(values, several, ["v"], "times", size["n"] or 0, size["most"] or 0)
    # a set has 2 * GROUPS values at most
    first = F.collect_set(F.when(F.col("v").bitwiseAND(1) == 0, F.col("v")))
    second = F.collect_set(F.when(F.col("v").bitwiseAND(1) == 1, F.col("v")))
    both = shared.groupBy("k1", "k2", "size").agg(first.alias("a"), second.alias("b"))
    keys = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.struct(F.xxhash64(x, y).alias("h"), x.alias("a")))))
    return both.select("k1", "k2", "size", F.explode(keys).alias("key")).select("key.h", "key.a", "k1", "k2", "size")


def minhash_components(docs: DataFrame, words: int = 3, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one a row of ``docs``.

    Shingles are of ``words`` words of the text with A-Z in lower case; a text of
    fewer words is one shingle; a text without words, or null, has none and is
    linked with nothing.  Two documents link when 100 * intersection >= percent *
    union and a table has both; links are confirmed on full sets.  ``component_id``
    is the least doc_id reachable by links, the document itself included; the
    document that has it is ``kept``, as are all rows with a null id, which have a null
    component and link nothing.  Rows with equal ids are one document with several
    texts.  Other columns are ignored; an empty table stays empty.
    """
    spark = docs.sparkSession
    texts = id_and_text(docs, id_column, text_column)
    sketches = written(texts.mapInArrow(_sketches(words), ddl(SKETCHES)), "sketches")
    members = sketches.select("doc_id", "n", "k1", "k2")
    sets = sketches.where("doc_id is not null and n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("values").alias("values"))
    sets = written(sets, "sets")
    keys = written(table_keys(sets), "keys")
    # tables with very many sets under one key are dealt out in parts
    size = keys.count()
    limit = max(SALT_FROM, size >> 16)
    hot = keys.groupBy("h").agg(F.count("*").alias("times")).where(F.col("times") > limit).select("h", F.floor(F.col("times") / limit + 1).cast("int").alias("parts"))
    salt = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("h", "k1", "k2"), F.col("parts")) + 1).cast("int")
    postings = keys.join(F.broadcast(hot), "h", "left").select("h", salt.alias("salt"), "k1", "k2", "size", F.lit(0).alias("place"))
    postings = postings.repartition(partitions(spark), "h", "salt").sortWithinPartitions("h", "salt", "k1", "k2")
    listed = written(postings.mapInArrow(_lists(percent), ddl(LISTS)), "listed")
    # sets of a long list also meet in the lists of their values of the first collection, which are fewer
    long = listed.where("h is not null").select("h").distinct()
    firsts = written(keys.join(long, "h", "left_semi").select("a").distinct(), "firsts")
    # a set's keys have each of its first values up to GROUPS times: once is enough, and is written so that the join does not go before it
    once = written(keys.groupBy("a", "k1", "k2").agg(F.first("size").alias("size")), "once")
    members_of = once.join(firsts, "a", "left_semi")
    none = F.lit(None).cast("long")
    lists = listed.where("h is null").union(members_of.select(F.col("a").alias("h"), "k1", "k2", "size", F.lit(0).alias("place"), none.alias("b1"), none.alias("b2")))
    lists = written(lists, "lists")
    discard(keys, listed, once)
    found = listed_components(texts, members, sets.select("k1", "k2", "node", "copies"), lists, words, percent)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
