"""Connected components of a table of links, by alternating stars.

While there are more than ``LAST_LINKS`` links, they are contracted in rounds; what is
left, some MB at most, is joined in one task.

Every round joins each node's larger neighbours to its smallest one, then its
smaller neighbours.  Rounds are written to the shared folder, the one before goes;
groups of links are only ever reduced to their minimum and number, which combine
before the shuffle, and the centres of large stars get their minimum by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import ddl, discard, join_hot, written

#: At most so many links, of 16 bytes, are joined in one task.
LAST_LINKS = 1 << 18
LABELS = pa.schema([("node", pa.int64()), ("component", pa.int64())])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of some links with the least node it reaches, by union-find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = root(parent.setdefault(u, u)), root(parent.setdefault(v, v))
            if a != c:
                parent[max(a, c)] = min(a, c)
    nodes = list(parent)
    for k in range(0, len(nodes), 1 << 16):
        some = nodes[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], schema=LABELS)


def _least(edges: DataFrame, total: int, most: int) -> DataFrame:
    """Edges (u, v) with the least of u and its neighbours as m."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_hot(edges, least, ["u"], "n", total, most)


def _round(edges: DataFrame, total: int, most: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _least(both, 2 * total, most).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    small = _least(down, 2 * total, most)
    return small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component): every linked node with the least node it reaches.

    ``a`` and ``b`` are long columns without nulls.  Links of a node to itself
    are dropped, so that an unlinked node has no row; repeated links are one.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    few = edges.count() <= LAST_LINKS
    state = None
    for _ in range(max_rounds):
        if few:
            found = written(edges.coalesce(1).mapInArrow(_joined, ddl(LABELS)), "components")
            discard(edges)
            return found
        # how many edges, a sum of their hashes, and the edges of the largest star, each edge seen from both ends
        ends = edges.select(F.explode(F.array("u", "v")).alias("node"), F.xxhash64("u", "v").cast("decimal(38,0)").alias("h")).groupBy("node").agg(F.count("*").alias("n"), F.sum("h").alias("s"))
        found = ends.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("s").alias("s"), F.max("n").alias("most")).first()
        if found["n"] == 0 or (found["n"], found["s"]) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = found["n"], found["s"]
        last, edges = edges, written(_round(edges, found["n"] // 2, found["most"]), "links")
        discard(last)
        few = edges.count() <= LAST_LINKS
    raise RuntimeError("components did not settle")
