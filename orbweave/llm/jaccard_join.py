"""N-gram Jaccard join: documents whose shingle sets are alike, exactly.

1.  Every text becomes its set of shingles; equal sets are one node.
2.  Shingles get one order, rarest first, by how often partitions see them
    repeatedly; any order gives right results.  Two sets alike share a shingle
    among the first ``size - ceil(t * size) + 1`` of each: the prefix.
3.  The prefixes make inverted lists.  A list of up to ``SHORT_LIST`` nodes gives
    the pairs that size and place in the prefix allow.  A longer one is compared
    with its first node only.  Where a shingle is very frequent its list is split
    into parts, compared likewise; all the list's nodes count as one long list in 5.
4.  Parities of the sets' hashes, a bit or two a shingle, bound a pair's overlap from
    above (`parities`); pairs that cannot reach the threshold go no further.
    Each first node of a pair that may is a query against the block of its candidates:
    their inverted lists are searched for the documents that reach the required
    overlap (`t_occurrence`).  Large blocks are split.
5.  Links make components.  While the nodes of a long list are in several
    components, three rounds compare them: its node on the most long lists, as the
    text that the others vary is, with all of them; then each node outside the
    largest component with its likest; then with all others.  In the last two, blocks
    of nodes meet blocks of nodes, and only pairs whose parities may reach the
    threshold leave a block.  Pairs are searched as in 4.

So a link between different components is never missed, while a group of
thousands of near copies costs a search a member and not one a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import BATCH_BYTES, ddl, give_back, id_and_text, join_hot, partitions, slices, written
from orbweave.llm.components import components
from orbweave.llm.t_occurrence import search
from orbweave.llm.text_kernels import mix, ragged, set_keys, shingle_sets

SHORT_LIST = 32
BLOCK = 256
#: Shingles whose repetitions a task looks for at once, and shingles of candidates searched at once, at least a set.
HEAVY_BUFFER, SEARCH_BUFFER = 1 << 21, 1 << 19
#: At most so many frequent shingles are broadcast (16 bytes each); the order of the rest is by hash.
FREQUENT = 1 << 20
SALT_FROM = 50_000
#: Nodes of a long list on either side of a cell, and words of parities compared at once.
CELL = 4096
CELL_WORDS = 1 << 20
STAR, LIKEST, ALL = range(3)
#: Above so many rows of work, documents are joined by a shuffle, not a broadcast.
BROADCAST_ROWS = 1 << 20

SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("h", pa.int64()), ("seen", pa.int64())])
POSTINGS = pa.schema([("h", pa.int64()), ("salt", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("size", pa.int32()), ("place", pa.int32())])
LISTS = pa.schema([("h", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("size", pa.int32()), ("place", pa.int32()), ("b1", pa.int64()), ("b2", pa.int64())])
BLOCKS = pa.schema([("x", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("part", pa.int32()), ("y", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("shingles", pa.binary())])
PARITIES = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])
REST = pa.schema([(c, pa.int64()) for c in ("x", "x1", "x2", "y", "y1", "y2")])
LINKS = pa.schema([(c, pa.int64()) for c in ("x", "x1", "x2", "y", "y1", "y2", "overlap", "union")])


def required(sizes_a, sizes_b, percent: int):
    """Least overlap of two sets with 100 * overlap >= percent * union."""
    return -(-percent * (sizes_a + sizes_b) // (100 + percent))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch)
    give_back()


def _texts(column: pa.Array) -> list[bytes]:
    return [t.encode() if t else b"" for t in column.to_pylist()]


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def heavy() -> pa.RecordBatch:
            flat = np.sort(np.concatenate(held))
            held.clear()
            at = np.r_[0, np.flatnonzero(flat[1:] != flat[:-1]) + 1, len(flat)]
            n = np.diff(at)
            h, n = flat[at[:-1]][n > 1].view(np.int64), n[n > 1]
            none = pa.nulls(len(h), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(h), pa.array(n)], schema=SETS)

        size = 0
        for b in _parts(batches):
            n, k1, k2 = [], [], []
            for flat, at in shingle_sets(_texts(b.column(1)), words):
                n.append(np.diff(at))
                one, two = set_keys(flat, at)
                k1.append(one)
                k2.append(two)
                held.append(flat)
                size += len(flat)
                if size >= HEAVY_BUFFER:
                    yield heavy()
                    size = 0
            if n:
                none = pa.nulls(b.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.concatenate(x)) for x in (n, k1, k2)), none, none], schema=SETS)
        if size:
            yield heavy()

    return run


def _frequent(seen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and how often partitions saw them."""
    table = written(seen.groupBy("h").agg(F.sum("seen").alias("seen")).where("seen >= 8"), "frequent")
    counts = table.groupBy(F.least("seen", F.lit(1 << 16)).alias("seen")).count().collect()
    least, total = 1 << 16, 0
    for r in sorted(counts, key=lambda r: -r["seen"]):
        total += r["count"]
        if total > FREQUENT:
            break
        least = r["seen"]
    rows = table.where(F.col("seen") >= least).toArrow()
    h, n = rows.column("h").to_numpy().view(np.uint64), rows.column("seen").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _postings(words: int, percent: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = frequent.value
        done: set[tuple[int, int]] = set()
        level = np.r_[np.minimum(4 * np.log2(np.maximum(seen, 1)), 255).astype(np.uint64), np.uint64(0)]
        for b in _parts(batches):
            for flat, at in shingle_sets(_texts(b.column(1)), words):
                if not len(flat):
                    continue
                k1, k2 = set_keys(flat, at)
                found = np.searchsorted(known, flat)
                if len(known):
                    found[known[np.minimum(found, len(known) - 1)] != flat] = len(known)
                key = level[found] << np.uint64(56) | flat >> np.uint64(8)
                sizes = np.diff(at)
                take = np.where(sizes > 0, sizes + (-percent * sizes // 100) + 1, 0)
                if len(done) > 1 << 20:
                    done.clear()
                chosen, n = [], np.zeros(len(sizes), np.int64)
                for d, (i, j, p, a, c) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), take.tolist(), k1.tolist(), k2.tolist(), strict=True)):
                    if p and (a, c) not in done:
                        done.add((a, c))
                        chosen.append(i + np.argsort(key[i:j], kind="stable")[:p])
                        n[d] = p
                if not chosen:
                    continue
                index, doc = np.concatenate(chosen), np.repeat(np.arange(len(n)), n)
                h = flat[index]
                parts = np.r_[seen // SALT_FROM + 1, 1][found[index]].astype(np.uint64)
                # 0: the shingle's list is whole; from 1 on: one of several parts
                salt = (mix(h ^ k1.view(np.uint64)[doc]) % parts).astype(np.int32) + (parts > 1)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(salt), pa.array(k1[doc]), pa.array(k2[doc]), pa.array(sizes[doc].astype(np.int32)), pa.array((ragged(np.zeros(len(n), np.int64), n)).astype(np.int32))], schema=POSTINGS)

    return run


def _may_link(size_a, place_a, size_b, place_b, percent: int):
    """Whether two sets may be alike, from their sizes and places of one common shingle."""
    most = np.minimum(size_a - place_a, size_b - place_b) + np.minimum(place_a, place_b)
    fits = (100 * size_a >= percent * size_b) & (100 * size_b >= percent * size_a)
    return fits & (most >= required(size_a, size_b, percent))


def _lists(percent: int):
    """Candidate pairs (k1, k2, b1, b2), and the members (h not null) of long and of split lists."""

    def pairs(c: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        ok = _may_link(c[4][a].astype(np.int64), c[5][a].astype(np.int64), c[4][b].astype(np.int64), c[5][b].astype(np.int64), percent)
        a, b = a[ok], b[ok]
        none, small = pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32())
        return pa.RecordBatch.from_arrays([none, pa.array(c[2][a]), pa.array(c[3][a]), small, small, pa.array(c[2][b]), pa.array(c[3][b])], schema=LISTS)

    def scan(c: list[np.ndarray], going: bool, end: bool) -> Iterator[tuple[pa.RecordBatch | None, list[np.ndarray] | None, bool]]:
        """Batches of what whole lists give; at last (None, rows held back, whether their list is long)."""
        # the same node may come from several partitions
        new = np.ones(len(c[0]), bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in c[:4]], 0)
        c = [x[new] for x in c]
        begins = np.r_[0, np.flatnonzero((c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])) + 1, len(c[0])]
        long = np.diff(begins) > SHORT_LIST
        long[0] |= going
        held, going = None, bool(long[-1]) and not end
        if going:  # the list may go on: its first node stays, and the last, which may come again
            held = [np.r_[x[begins[-2] : begins[-2] + 1], x[-1:]] for x in c]
        elif not end:
            held = [x[begins[-2] :] for x in c]
            begins, long = begins[:-1], long[:-1]
        sizes = np.diff(begins)
        for length in np.unique(sizes[(sizes > 1) & ~long]).tolist():
            at = begins[:-1][(sizes == length) & ~long]
            i, j = np.triu_indices(length, 1)
            step = max(1, (1 << 18) // len(i))
            for k in range(0, len(at), step):
                yield pairs(c, (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()), None, False
        for at, length in zip(begins[:-1][long].tolist(), sizes[long].tolist(), strict=True):
            yield pairs(c, np.full(length - 1, at), np.arange(at + 1, at + length)), None, False
        # a part of a split list, however short, has yet to meet the other parts
        told = np.flatnonzero(np.repeat(long | (c[1][begins[:-1]] > 0), sizes))
        if len(told):
            none = pa.nulls(len(told), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c[k][told]) for k in (0, 2, 3, 4, 5)), none, none], schema=LISTS), None, False
        yield None, held, going

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, going = None, False
        for b in batches:
            if not b.num_rows:
                continue
            c = [x.to_numpy() for x in b.columns]
            if held is not None:
                c = [np.concatenate(x) for x in zip(held, c, strict=True)]
            for batch, held, going in scan(c, going, False):  # noqa: B007
                if batch is not None:
                    yield batch
        if held is not None:
            for batch, _, _ in scan(held, going, True):
                if batch is not None:
                    yield batch

    return run


def _blocks(words: int):
    """The shingle sets of documents that take part in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            text, x, x1, x2, part, y, k1, k2 = b.columns
            texts = _texts(text)
            # a document in several blocks comes in neighbouring rows
            first = [i for i in range(len(texts)) if not i or texts[i] != texts[i - 1]]
            owner = np.searchsorted(first, np.arange(len(texts)), side="right") - 1
            data, keys = [], []
            for flat, at in shingle_sets([texts[i] for i in first], words):
                data += [flat[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                keys += list(zip(*(k.tolist() for k in set_keys(flat, at)), strict=True))
            wanted = list(zip(k1.to_pylist(), k2.to_pylist(), strict=True))
            keep = [i for i in range(len(texts)) if keys[owner[i]] == wanted[i]]
            ends, at = np.cumsum([len(data[owner[k]]) for k in keep], dtype=np.int64), 0
            while at < len(keep):
                until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, side="right")))
                some = pa.array(keep[at:until], pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(some) for c in (x, x1, x2, part, y, k1, k2)), pa.array([data[owner[k]] for k in keep[at:until]], pa.binary())], schema=BLOCKS)
                at = until

    return run


def _search(percent: int):
    """Links found in blocks: the query's row comes first, with y null.

    Sets are told apart by their keys, as one document may have several texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, query, last, ys, sets, size = None, None, None, [], [], 0
        out: list[tuple[int, ...]] = []

        def close() -> None:
            if query is None or not sets:
                return
            sizes = np.array([len(s) for s in sets])
            found = search(query, sets, required(len(query), sizes, percent).tolist())
            out.extend((*now[:3], *ys[k], n, len(query) + int(sizes[k]) - n) for k, n in found.items())

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 8)], schema=LINKS)
            out.clear()
            return batch

        for b in _parts(batches):
            for x, x1, x2, part, y, k1, k2, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (x, x1, x2, part) != now:
                    close()
                    now, query, last, ys, sets, size = (x, x1, x2, part), None, None, [], [], 0
                s = np.frombuffer(data, np.uint64)
                if y is None:
                    query = s
                elif last != (y, k1, k2):
                    last = y, k1, k2
                    ys.append(last)
                    sets.append(s)
                    size += len(s)
                    if len(sets) >= 4 * BLOCK or size >= SEARCH_BUFFER:
                        close()
                        ys, sets, size = [], [], 0
            yield flush()
        close()
        yield flush()

    return run


def _links(spark: SparkSession, texts: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links among candidate pairs (x, x1, x2, y, y1, y2): ids and set keys."""
    n = pairs.count()
    query = ["x", "x1", "x2"]
    sizes = pairs.groupBy(query).agg(F.count("*").alias("n")).select(*query, F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    placed = pairs.join(sizes, query).withColumn("part", F.pmod(F.xxhash64("y"), F.col("parts")).cast("int"))
    queries = sizes.select(F.col("x").alias("doc_id"), *query, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("y"), F.col("x1").alias("k1"), F.col("x2").alias("k2"))
    work = placed.select(F.col("y").alias("doc_id"), *query, "part", "y", F.col("y1").alias("k1"), F.col("y2").alias("k2")).union(queries)
    work = F.broadcast(work) if n <= BROADCAST_ROWS else work
    blocks = texts.join(work, "doc_id").select("text", *query, "part", "y", "k1", "k2").mapInArrow(_blocks(words), ddl(BLOCKS))
    blocks = blocks.repartition(partitions(spark), *query, "part").sortWithinPartitions(*query, "part", F.col("y").asc_nulls_first(), "k1", "k2")
    return written(blocks.mapInArrow(_search(percent), ddl(LINKS)), "similar")


def _start(texts: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their sets' keys, different sets (k1, k2, node, copies), and what their lists give."""
    sets = written(texts.mapInArrow(_sets(words), ddl(SETS)), "sets")
    frequent = texts.sparkSession.sparkContext.broadcast(_frequent(sets.where("h is not null").select("h", "seen")))
    # the rows of documents have a key; those of frequent shingles have none
    members = sets.where("k1 is not null").select("doc_id", "n", "k1", "k2")
    nodes = written(members.where("doc_id is not null and n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "nodes")
    postings = texts.where("doc_id is not null").select("doc_id", "text").mapInArrow(_postings(words, percent, frequent), ddl(POSTINGS))
    postings = postings.repartition(partitions(texts.sparkSession), "h", "salt").sortWithinPartitions("h", "salt", "k1", "k2")
    return members, nodes, written(postings.mapInArrow(_lists(percent), ddl(LISTS)), "lists")


def _listed(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (x, x1, x2, y, y1, y2) that the lists give."""
    x = nodes.select(F.col("k1").alias("x1"), F.col("k2").alias("x2"), F.col("node").alias("x"))
    y = nodes.select(F.col("k1").alias("y1"), F.col("k2").alias("y2"), F.col("node").alias("y"))
    pairs = lists.where("h is null").select(F.col("k1").alias("x1"), F.col("k2").alias("x2"), F.col("b1").alias("y1"), F.col("b2").alias("y2")).distinct()
    return pairs.join(x, ["x1", "x2"]).join(y, ["y1", "y2"])


def jaccard_links(docs: DataFrame, words: int = 4, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All links: rows (x, x1, x2, y, y1, y2, overlap, union), one a pair of different sets alike.

    ``x1, x2`` and ``y1, y2`` are the sets' keys, ``x`` and ``y`` the least ids of
    documents with them.  Documents with equal sets are one here.  A family of m
    near copies has up to m * (m - 1) / 2 links, and all are searched.
    """
    spark = docs.sparkSession
    texts = id_and_text(docs, id_column, text_column)
    _, nodes, lists = _start(texts, words, percent)
    nodes = written(nodes.drop("copies").withColumn("component", F.monotonically_increasing_id()), "nodes")
    pairs = _plausible(texts, _listed(lists, nodes), words, percent)
    # every set is a component of its own, and none is a list's largest: all meet all
    long = written(lists.where("h is not null").select("h", "k1", "k2", "size", "place").distinct().join(nodes, ["k1", "k2"]).withColumn("main", F.lit(-1).cast("long")), "long")
    bits = _node_parities(texts, long.select(F.col("node").alias("doc_id"), "k1", "k2"), words)
    more = _cells(spark, long.join(bits.drop("n"), ["k1", "k2"]), percent, False)
    a, b = (F.struct(*(F.col(f"{c}{k}").alias(n) for k, n in (("1", "k1"), ("2", "k2"), ("", "node")))) for c in "xy")
    both = pairs.select(*REST.names).union(more.select(*REST.names)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    both = both.select(*(F.col(f"{s}.{n}").alias(f"{c}{k}") for s, c in (("a", "x"), ("b", "y")) for n, k in (("node", ""), ("k1", "1"), ("k2", "2"))))
    return _links(spark, texts, written(both, "all-pairs"), words, percent)


def jaccard_link_counts(docs: DataFrame, words: int = 4, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, n_links), one a row of ``docs``: how many different sets are alike to its own."""
    links = jaccard_links(docs, words, percent, id_column, text_column)
    ends = links.select(F.col("x1").alias("k1"), F.col("x2").alias("k2")).union(links.select("y1", "y2")).groupBy("k1", "k2").agg(F.count("*").alias("n_links"))
    members = id_and_text(docs, id_column, text_column).mapInArrow(_sets(words), ddl(SETS)).where("k1 is not null").select("doc_id", "n", "k1", "k2")
    found = members.join(ends, ["k1", "k2"], "left")
    return found.select("doc_id", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"))


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one a row of ``docs``.

    Shingles are of ``words`` words of the text with A-Z in lower case; a text of
    fewer words is one shingle; a text without words, or null, has none and is
    linked with nothing.  Two documents link when 100 * intersection >= percent *
    union.  ``component_id`` is the least doc_id reachable by links, the
    document itself included.  Rows with equal ids are one document with several
    texts.  Rows with a null id are answered with a null component and link
    nothing.  Other columns are ignored; an empty table stays empty.
    """
    texts = id_and_text(docs, id_column, text_column)
    members, nodes, lists = _start(texts, words, percent)
    return listed_components(texts, members, nodes, lists, words, percent)


def listed_components(texts: DataFrame, members: DataFrame, nodes: DataFrame, lists: DataFrame, words: int, percent: int) -> DataFrame:
    """Components of the links among sets that meet in a list: rows (doc_id, n_shingles, component_id).

    ``members`` (doc_id, n, k1, k2) are the documents with their sets, ``nodes`` (k1,
    k2, node, copies) the different sets, ``lists`` what `_lists` makes of the lists.
    """
    spark = texts.sparkSession
    linkable = members.where("doc_id is not null and n > 0")
    total, most = (x or 0 for x in nodes.agg(F.sum("copies"), F.max("copies")).first())
    pairs = _plausible(texts, _listed(lists, nodes).where("x <> y"), words, percent)
    links = _links(spark, texts, pairs, words, percent).select("x", "y")
    # one document with several texts joins their nodes
    key = F.struct("k1", "k2")
    several = linkable.groupBy("doc_id").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a <> b").select("doc_id")
    several = written(linkable.join(several, "doc_id", "left_semi").distinct(), "several")
    if not several.isEmpty():
        links = links.union(join_hot(several, nodes, ["k1", "k2"], "copies", total, most).where("doc_id <> node").select(F.col("doc_id").alias("x"), F.col("node").alias("y")))
    found = components(links, "x", "y")
    long = lists.where("h is not null").select("h", "k1", "k2", "size", "place").distinct()
    if not long.isEmpty():
        long = written(long.join(nodes.drop("copies"), ["k1", "k2"]), "long")
        bits = None
        for k in (STAR, LIKEST, ALL):
            at = _unresolved(long, found)
            if at.isEmpty():
                break
            if k == STAR:
                more = _plausible(texts, _star(at, long, percent).distinct(), words, percent)
            else:
                bits = _node_parities(texts, at.select(F.col("node").alias("doc_id"), "k1", "k2"), words) if bits is None else bits
                more = written(_cells(spark, at.join(bits.drop("n"), ["k1", "k2"]), percent, k == LIKEST).distinct(), "rest-pairs")
            if more.isEmpty():
                continue
            # the components so far are stars, which the new links join
            stars = found.select(F.col("node").alias("x"), F.col("component").alias("y"))
            found = components(stars.union(_links(spark, texts, more, words, percent).select("x", "y")), "x", "y")
    # a row a set, then a row a document: copies of one set, however many, do not meet in one task
    labels = nodes.join(found.withColumnRenamed("node", "n0"), F.col("node") == F.col("n0"), "left")
    labels = written(labels.select("k1", "k2", F.coalesce("component", "node").alias("component_id"), "copies"), "labels")
    linked = join_hot(linkable, labels, ["k1", "k2"], "copies", total, most).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = members.where("doc_id is null or n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.union(alone)


def _unresolved(long: DataFrame, found: DataFrame) -> DataFrame:
    """The members of long lists in several components, with their own and the list's largest."""
    at = long.join(found.withColumnRenamed("node", "n0"), F.col("node") == F.col("n0"), "left").drop("n0")
    at = at.withColumn("component", F.coalesce("component", "node"))
    sizes = at.groupBy("h", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("h").agg(F.count("*").alias("kinds"), F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("members")).where("kinds > 1")
    main = written(main.select("h", "main", "members"), "main")
    size = main.agg(F.sum("members").alias("n"), F.max("members").alias("most")).first()
    return written(join_hot(at, main, ["h"], "members", size["n"] or 0, size["most"] or 0), "rest")


def _star(at: DataFrame, long: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, x1, x2, y, y1, y2) of each list's node on the most long lists with the others."""
    often = long.groupBy("node").agg(F.count("*").alias("lists"))
    first = at.join(often, "node").groupBy("h").agg(F.max_by("node", F.struct("lists", "node")).alias("node"))
    names = ("k1", "k2", "size", "place", "node", "component")
    a = at.join(first, ["h", "node"]).select("h", *(F.col(c).alias(f"a_{c}") for c in names))
    b = at.select("h", *(F.col(c).alias(f"b_{c}") for c in names))
    most = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place")) + F.least("a_place", "b_place")
    fits = (F.col("a_size") * 100 >= F.col("b_size") * percent) & (F.col("b_size") * 100 >= F.col("a_size") * percent) & (most * (100 + percent) >= (F.col("a_size") + F.col("b_size")) * percent)
    both = a.join(b, "h").where((F.col("a_component") != F.col("b_component")) & fits)
    return both.select(F.col("a_node").alias("x"), F.col("a_k1").alias("x1"), F.col("a_k2").alias("x2"), F.col("b_node").alias("y"), F.col("b_k1").alias("y1"), F.col("b_k2").alias("y2"))


def parities(s: np.ndarray) -> bytes:
    """For each of some bits, one or two a shingle, whether an odd number of hashes fall on it.

    The number of bits is a power of two, by a shingle's low bits, so that the halves
    of a larger one, combined, are a smaller one.  Bits in which two differ are
    at most the shingles in which the sets differ.
    """
    bits = 1 << max(6, (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _node_parities(texts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """Size and parities (k1, k2, n, bits) of some sets (doc_id, k1, k2), once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            wanted = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            rows, d = [], 0
            for flat, begins in shingle_sets(_texts(b.column(0)), words):
                for i, j, *key in zip(begins[:-1].tolist(), begins[1:].tolist(), *(k.tolist() for k in set_keys(flat, begins)), strict=True):
                    if tuple(key) == wanted[d]:
                        rows.append((*key, j - i, parities(flat[i:j])))
                    d += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, PARITIES.types, strict=True)], schema=PARITIES)

    work = written(nodes.distinct(), "wanted")
    work = F.broadcast(work) if work.count() <= BROADCAST_ROWS else work
    found = texts.join(work, "doc_id").select("text", "k1", "k2").mapInArrow(run, ddl(PARITIES))
    return written(found.dropDuplicates(["k1", "k2"]), "parities")


def _plausible(texts: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of some pairs (x, x1, x2, y, y1, y2) whose parities may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            left, right = b.column("x_bits"), b.column("y_bits")
            widths = np.stack([pc.binary_length(c).to_numpy() // 8 for c in (left, right)])
            total = b.column("x_n").to_numpy() + b.column("y_n").to_numpy()
            n = np.zeros(b.num_rows, np.int64)
            for i, j in np.unique(widths, axis=1).T.tolist():
                at = np.flatnonzero((widths[0] == i) & (widths[1] == j))
                one, two = (_fold(np.frombuffer(b"".join(c.take(pa.array(at)).to_pylist()), np.uint64).reshape(-1, w), min(i, j)) for c, w in ((left, i), (right, j)))
                n[at] = np.bitwise_count(one ^ two).sum(1, dtype=np.int64)
            yield b.select(REST.names).filter(pa.array((total - n) // 2 >= required(total, 0, percent)))

    pairs = written(pairs.select(*REST.names), "candidates")
    sides = [pairs.select(F.col(c).alias("doc_id"), F.col(f"{c}1").alias("k1"), F.col(f"{c}2").alias("k2")) for c in "xy"]
    bits = _node_parities(texts, sides[0].union(sides[1]), words)
    for c in "xy":
        pairs = pairs.join(bits.select(F.col("k1").alias(f"{c}1"), F.col("k2").alias(f"{c}2"), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits")), [f"{c}1", f"{c}2"])
    return written(pairs.mapInArrow(run, ddl(REST)), "pairs")


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _may_reach(a: dict, b: dict, percent: int, likest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes in two blocks of one list that may join components, some at a time.

    Where ``likest``, only the likest for each node of the first block.
    """
    n_own = len(a["size"])
    best, partner = np.full(n_own, np.inf), np.full(n_own, -1, np.int64)
    for i in a["bits"]:
        for j in b["bits"]:
            width = min(i, j)
            own, left = a["bits"][i]
            other, right = b["bits"][j]
            left, right = _fold(left, width), _fold(right, width)
            step = max(1, CELL_WORDS // (4 * len(other)))
            for k in range(0, len(own), step):
                some = own[k : k + step, None]
                differ = (a["component"][some] != b["component"][other]) & ((b["component"][other] == b["main"][other]) | (a["component"][some] < b["component"][other]))
                p, q = np.nonzero(differ & _may_link(a["size"][some], a["place"][some], b["size"][other], b["place"][other], percent))
                total = a["size"][own[k + p]] + b["size"][other[q]]
                for m in range(0, len(p), max(1, CELL_WORDS // width)):
                    x, y, t = (c[m : m + max(1, CELL_WORDS // width)] for c in (p, q, total))
                    n = np.bitwise_count(left[k + x] ^ right[y]).sum(1, dtype=np.int64)
                    ok = (t - n) // 2 >= required(t, 0, percent)
                    x, y, unlike = own[k + x[ok]], other[y[ok]], n[ok] / t[ok]
                    if not likest:
                        yield x, y
                        continue
                    order = np.lexsort((y, unlike, x))
                    x, y, unlike = x[order], y[order], unlike[order]
                    first = np.r_[True, x[1:] != x[:-1]][: len(x)]
                    x, y, unlike = x[first], y[first], unlike[first]
                    better = (unlike < best[x]) | (unlike == best[x]) & (y < partner[x])
                    best[x[better]], partner[x[better]] = unlike[better], y[better]
    if likest:
        x = np.flatnonzero(partner >= 0)
        yield x, partner[x]


def _meet(percent: int, likest: bool):
    """Pairs from cells: sorted rows (h, i, j, side, k1, k2, node, component, main, size, place, bits)."""
    names = ("h", "i", "j", "side", "k1", "k2", "node", "component", "main", "size", "place")

    def pairs(c: dict, bits: list[bytes], begin: int, end: int) -> Iterator[pa.RecordBatch]:
        cut = begin + int(np.searchsorted(c["side"][begin:end], 1))
        if cut in (begin, end):
            return
        sides = []
        for i, j in ((begin, cut), (cut, end)):
            side = {n: c[n][i:j] for n in names}
            widths = np.array([len(x) // 8 for x in bits[i:j]])
            side["bits"] = {}
            for w in np.unique(widths).tolist():
                own = np.flatnonzero(widths == w)
                side["bits"][w] = own, np.frombuffer(b"".join(bits[i + k] for k in own.tolist()), np.uint64).reshape(-1, w)
            sides.append(side)
        a, b = sides
        for x, y in _may_reach(a, b, percent, likest):
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(s[n][k]) for s, k in ((a, x), (b, y)) for n in ("node", "k1", "k2")], schema=REST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def whole(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            c = {n: held.column(n).to_numpy().astype(np.int64) for n in names}
            new = np.flatnonzero(np.any([np.diff(c[n]) != 0 for n in ("h", "i", "j")], 0)) + 1
            begins = [0, *new.tolist()] + [held.num_rows] * last
            bits = held.column("bits").to_pylist()
            for i, j in zip(begins[:-1], begins[1:], strict=True):
                yield from pairs(c, bits, i, j)
            held = held.slice(begins[-1]).combine_chunks()

        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                held = t if held is None else pa.concat_tables([held, t])
                yield from whole(False)
        if held is not None and held.num_rows:
            yield from whole(True)

    return run


def _cells(spark: SparkSession, at: DataFrame, percent: int, likest: bool) -> DataFrame:
    """Pairs (x, x1, x2, y, y1, y2) of long lists' nodes that may join two components.

    The nodes outside a list's largest component, in blocks, meet all its nodes, in blocks.
    """
    n = at.groupBy("h").agg(F.ceil(F.count("*") / CELL).cast("int").alias("right"), F.ceil(F.count_if(F.col("component") != F.col("main")) / CELL).cast("int").alias("left"))
    at = at.join(n, "h")
    place = F.xxhash64("k1", "k2")

    def cells(rows: DataFrame, side: int, own: str, other: str) -> DataFrame:
        block, each = F.pmod(place, F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        rows = rows.select("*", block.alias("own"), each.alias("each"))
        i, j = ("own", "each") if side == 0 else ("each", "own")
        return rows.select("h", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(side).alias("side"), "k1", "k2", "node", "component", "main", "size", "place", "bits")

    both = cells(at.where("component <> main"), 0, "left", "right").union(cells(at, 1, "right", "left"))
    both = both.repartition(partitions(spark), "h", "i", "j").sortWithinPartitions("h", "i", "j", "side", "k1", "k2")
    return both.mapInArrow(_meet(percent, likest), ddl(REST))
