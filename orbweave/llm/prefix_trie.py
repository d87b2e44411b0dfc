"""Prefix trie of conversations: shared beginnings as nodes, without a trie in memory.

1.  Every turn becomes a digest of 128 bits.  Turns are sorted by conversation
    and place over ranges of rows, and running sums of digests, each times a power of its
    place, are digests of prefixes (`running`).  As the sums are taken by range, one
    conversation may fill many of them.
2.  A prefix's least conversation owns it: its minimum over all conversations, with
    their number, makes the table of nodes.  Who owns a prefix owns all its longer ones.
3.  So the first depth that a conversation owns is found by binary search, one batch of
    prefixes a step for all conversations, joined to the table of minima.  The
    last prefix on the way that another owns is where it branches off.
4.  The depths that a conversation owns are a chain; chains hang on chains.  Chains
    without others on them give their sums to the place they hang on, and go; after as many
    rounds as chains are nested, all sums are there, and running sums along each chain
    tell those of every node's subtree.
5.  The conversations that end in a node are sorted over ranges too and joined to texts of
    bounded length, which one task a node passes to SHA-256.

Prefixes with equal digests count as equal.  The digests are two polynomials modulo
2**64 in the turns' hashes, which are of 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import ddl, discard, join_hot, partitions, slices, written

#: A conversation takes over turns of the first of its ``FAMILY``, fewer than ``HEADS``.
FAMILY, HEADS = 100, 6
#: Odd factors of the two polynomials.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Letters of joined ids that are one row.
CHUNK = 1 << 16
#: Rounds of nested chains, and steps of the binary search, at most.
MOST_ROUNDS, MOST_STEPS = 1 << 16, 64

_WHOLE = 1 << 64
TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("chars", pa.int64())])
REBUILT = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("chars", pa.int64())])


def turn_digest(role: str, text: str) -> bytes:
    """128 bits of a turn."""
    head = role.encode()
    return hashlib.blake2b(b"%d:%s%s" % (len(head), head, text.encode()), digest_size=16).digest()


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole):
            both = [(r or "", t or "") for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            t = np.frombuffer(b"".join(turn_digest(r, x) for r, x in both), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(t[:, 0]), pa.array(t[:, 1]), pa.array([len(x) for _, x in both], pa.int64())], schema=TURNS)


def _power(base: int, n: int) -> np.uint64:
    """A power modulo 2**64 of an odd number, for any whole exponent."""
    return np.uint64(pow(base, n % (1 << 62), _WHOLE))  # the order of every odd number divides 2**62


def _runs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal numbers begin and how long they are."""
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return begins, np.diff(np.r_[begins, len(group)])


def running(rows: DataFrame, group: str, order: list[Column], names: list[str], values: list[str], bases: tuple[int, ...], keep: list[str]) -> DataFrame:
    """Rows (group, place, sums named as the values, keep) in the order of the columns ``order`` in every group.

    ``group`` and the values are longs without nulls, ``keep`` longs.  The place counts
    from 1; a sum at place k is that of value j times base ** (j - 1) for j = 1 .. k,
    modulo 2**64.  ``names`` are those columns of ``order`` that ranges go by.
    Ranges of the order are summed each on its own; what the group at a range's
    beginning has in earlier ranges, a few numbers a range, is summed on the driver.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("part", group, "place", *values, *keep)])
    sorts = [F.col(group), *order]
    picked = rows.select(group, *dict.fromkeys([*names, *values, *keep]))
    ordered = picked.repartitionByRange(partitions(rows.sparkSession), *sorts).sortWithinPartitions(*sorts).select(group, *values, *keep)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, count, sums = TaskContext.get().partitionId(), None, 0, [np.uint64(0)] * len(values)
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(0).to_numpy()
            begins, lengths = _runs(g)
            index = np.arange(len(g)) - np.repeat(begins, lengths)
            again = lengths[0] if g[0] == last else 0
            place = index + 1
            place[:again] += count
            out = []
            for k, base in enumerate(bases):
                powers = np.cumprod(np.r_[np.uint64(1), np.full(len(g), base % _WHOLE, np.uint64)])
                total = np.cumsum(b.column(1 + k).to_numpy().view(np.uint64) * powers[index])
                before = np.r_[np.uint64(0), total[begins[1:] - 1]]
                total = total - np.repeat(before, lengths)
                if again:
                    total[:again] = sums[k] + _power(base, count) * total[:again]
                sums[k] = total[-1]
                out.append(pa.array(total.view(np.int64)))
            last, count = g[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), part)), b.column(0), pa.array(place), *out, *(b.column(1 + len(values) + k) for k in range(len(keep)))], schema=schema)

    found = written(ordered.mapInArrow(local, ddl(schema)), "running")
    ends = found.groupBy("part").agg(F.min(group).alias("first"), F.max(F.struct(group, "place", *values)).alias("end")).collect()
    carry: dict[int, tuple] = {}
    last, count, sums = None, 0, [0] * len(values)
    for r in sorted(ends, key=lambda r: r["part"]):
        own, n, s = r["end"][group], r["end"]["place"], [r["end"][v] % _WHOLE for v in values]
        if r["first"] == last:
            carry[r["part"]] = last, count, [np.uint64(x) for x in sums]
        if own == last:
            s = [(x + int(_power(b, count)) * y) % _WHOLE for x, y, b in zip(sums, s, bases, strict=True)]
            n += count
        last, count, sums = own, n, s
    shared = rows.sparkSession.sparkContext.broadcast(carry)

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c = [x.to_numpy() for x in b.columns]
            c = [c[0], c[1], *(x.copy() for x in c[2 : 3 + len(values)]), *b.columns[3 + len(values) :]]
            for part in np.unique(c[0]).tolist():
                if part in shared.value:
                    g, count, sums = shared.value[part]
                    at = np.flatnonzero((c[0] == part) & (c[1] == g))
                    c[2][at] += count
                    for k, base in enumerate(bases):
                        c[3 + k][at] = (sums[k] + _power(base, count) * c[3 + k][at].view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in c[1:]], schema=pa.schema(list(schema)[1:]))

    return found.mapInArrow(carried, ddl(pa.schema(list(schema)[1:])))


def prefixes(conversations: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """Rows (conv_id, depth, p1, p2, chars): every prefix's digest and its last text's code points.

    Turns go by their number, null first, and by their digests where numbers are equal.
    """
    names = F.col(f"`{conv_column}`").cast("long"), F.col(f"`{turn_column}`").cast("long"), F.col(f"`{role_column}`").cast("string"), F.col(f"`{text_column}`").cast("string")
    rows = conversations.select(*(c.alias(n) for c, n in zip(names, ("conv_id", "turn", "role", "text"), strict=True)))
    turns = rows.where("conv_id is not null").mapInArrow(_turns, ddl(TURNS))
    turns = turns.withColumns({"p1": F.col("t1"), "p2": F.col("t2")})
    found = running(turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")], ["turn", "t1", "t2"], ["p1", "p2"], BASES, ["chars"])
    return found.withColumnRenamed("place", "depth")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefixes (conv_id, depth, p1, p2, chars) of conversations that begin as the first of their family does, and (conv_id, depths).

    Of conversation c, with h the remainder of crc32 of c's decimals by ``HEADS``, the
    first h turns are those of the family's first, c - c % ``FAMILY``, as far as it
    has them; its own turns after its first h follow.
    """
    heads = written(own.where(F.col("depth") < HEADS), "heads")
    convs = own.groupBy("conv_id").agg(F.max("depth").alias("turns"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h")
    convs = written(convs.select("conv_id", "turns", h, (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")), "convs")
    # at most FAMILY conversations, and HEADS prefixes, a base
    bases = convs.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_turns", F.lit(0))))
    e = heads.select(F.col("conv_id").alias("base"), F.col("depth").alias("taken"), F.col("p1").alias("e1"), F.col("p2").alias("e2"))
    o = heads.select("conv_id", F.col("depth").alias("h"), F.col("p1").alias("o1"), F.col("p2").alias("o2"))
    zero = F.lit(0).cast("long")
    convs = convs.join(e, ["base", "taken"], "left").join(o, ["conv_id", "h"], "left")
    convs = written(convs.select("conv_id", "base", "turns", *(F.col(c).cast("long").alias(c) for c in ("h", "taken")), *(F.coalesce(c, zero).alias(c) for c in ("e1", "e2", "o1", "o2"))), "starts")
    size = convs.agg(F.sum("turns").alias("n"), F.max("turns").alias("most")).first()
    first = heads.withColumnRenamed("conv_id", "base").join(convs.where("taken > 0").select("conv_id", "base", "taken"), "base").where("depth <= taken")
    later = join_hot(own, convs.select("conv_id", "turns", "h", "taken", "e1", "e2", "o1", "o2"), ["conv_id"], "turns", size["n"] or 0, size["most"] or 0).where("depth > h")

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c = {n: b.column(n).to_numpy() for n in ("depth", "h", "taken")}
            sums = []
            for k, base in enumerate(BASES, 1):
                p, e, o = (b.column(f"{n}{k}").to_numpy().view(np.uint64) for n in "peo")
                shift = np.array([_power(base, d) for d in range(1 - HEADS, HEADS)], np.uint64)[c["taken"] - c["h"] + HEADS - 1]
                sums.append(pa.array((e + shift * (p - o)).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(c["depth"] - c["h"] + c["taken"]), *sums, b.column("chars")], schema=REBUILT)

    later = later.select("conv_id", "depth", "p1", "p2", "chars", "h", "taken", "e1", "e2", "o1", "o2").mapInArrow(moved, ddl(REBUILT))
    depths = convs.select("conv_id", (F.col("taken") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("depths"))
    return first.select(*REBUILT.names).union(later), depths


def first_owned(prefix: DataFrame, depths: DataFrame, minima: DataFrame) -> DataFrame:
    """Rows (conv_id, depths, first, parent): the first depth a conversation owns, and who owns the one before.

    ``first`` is ``depths`` + 1 if it owns none; ``parent`` is null at depth 0.
    """
    found = minima.agg(F.sum("n_convs").alias("n"), F.max("n_convs").alias("most")).first()
    state = written(depths.select("conv_id", "depths", F.lit(1).cast("long").alias("low"), (F.col("depths") + 1).alias("high"), F.lit(None).cast("long").alias("parent")), "search")
    done = None
    key = ["depth", "p1", "p2"]
    for _ in range(MOST_STEPS):
        ended = state.where("low >= high").select("conv_id", "depths", F.col("low").alias("first"), "parent")
        done = ended if done is None else done.union(ended)
        state = state.where("low < high")
        if state.isEmpty():
            return done
        asked = state.withColumn("depth", F.floor((F.col("low") + F.col("high")) / 2).cast("long")).join(prefix.select("conv_id", *key), ["conv_id", "depth"])
        told = join_hot(asked, minima.select(*key, "owner", "n_convs"), key, "n_convs", found["n"] or 0, found["most"] or 0)
        own = F.col("owner") == F.col("conv_id")
        state = written(told.select("conv_id", "depths", F.when(own, F.col("low")).otherwise(F.col("depth") + 1).alias("low"), F.when(own, F.col("depth")).otherwise(F.col("high")).alias("high"), F.when(own, F.col("parent")).otherwise(F.col("owner")).alias("parent")), "search")
    raise RuntimeError("the search did not end")


def _hashed(ends: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, ends_sha256) of ends (owner, depth, conv_id), ids in ascending order."""
    spark = ends.sparkSession
    chunks_of = pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("least", pa.int64()), ("chunk", pa.string())])
    hashes = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, letters = None, [], 0
        out: list[tuple] = []
        for b in batches:
            for owner, depth, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (owner, depth) != now or letters >= CHUNK:
                    if ids:
                        out.append((*now, ids[0], ",".join(map(str, ids))))
                    now, ids, letters = (owner, depth), [], 0
                ids.append(c)
                letters += len(str(c)) + 1
            yield table(out, chunks_of)
            out = []
        if ids:
            yield table([(*now, ids[0], ",".join(map(str, ids)))], chunks_of)

    def table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema.types, strict=True)], schema=schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for whole in batches:
            out: list[tuple] = []
            for b in slices(whole):
                for owner, depth, _, chunk in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    if (owner, depth) != now:
                        if h:
                            out.append((*now, h.hexdigest()))
                        now, h = (owner, depth), hashlib.sha256(chunk.encode())
                    else:
                        h.update(b"," + chunk.encode())
            yield table(out, hashes)
        if h:
            yield table([(*now, h.hexdigest())], hashes)

    sorts = ["owner", "depth", "conv_id"]
    parts = ends.select(*sorts).repartitionByRange(partitions(spark), *sorts).sortWithinPartitions(*sorts).mapInArrow(chunks, ddl(chunks_of))
    return parts.repartition(partitions(spark), "owner", "depth").sortWithinPartitions("owner", "depth", "least").mapInArrow(digests, ddl(hashes))


def _sums(nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """What hangs on each place: rows (conv_id, depth, leaves, saved), of all chains on it with what hangs on them."""
    own = nodes.groupBy("conv_id").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    going = written(chains.where("parent is not null").join(own, "conv_id"), "chains")
    given: list[DataFrame] = []
    for _ in range(MOST_ROUNDS):
        if going.isEmpty():
            break
        parents = going.select(F.col("parent").alias("conv_id")).distinct()
        ready = going.join(parents, "conv_id", "left_anti")
        given.append(written(ready.groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "given"))
        # chains wait for those on them, and take their sums
        got = given[-1].groupBy("conv_id").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        rest = going.join(parents, "conv_id", "left_semi").join(got, "conv_id", "left")
        last, going = going, written(rest.select("conv_id", "parent", "at", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved"))), "chains")
        discard(last)
    out = nodes.select("conv_id", "depth", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")).limit(0)
    for x in given:
        out = out.union(x)
    return out


def prefix_trie(conversations: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """The trie's nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are those of `rebuilt`.  A node is a sequence of turns with which
    some begin; it goes by the least of them and its depth.  ``n_convs`` is their
    number, ``n_leaves`` that of the nodes without children in its subtree, itself
    included, ``saved_tokens`` the subtree's sum of code points of the nodes' last
    texts, each times n_convs - 1, and ``ends_sha256`` the SHA-256 of the ids, in
    ascending order with commas, of those that end there.

    A null role or text is empty.  Turns come by number, null first; of turns with
    one number, that with the least digest comes first; repeated rows are turns of
    their own.  Rows without a conversation are left out.  Other columns are ignored.
    An empty table has no root.
    """
    own = written(prefixes(conversations, conv_column, turn_column, role_column, text_column), "prefixes")
    prefix, depths = rebuilt(own)
    prefix, depths = written(prefix, "rebuilt"), written(depths, "depths")
    whole = depths.agg(F.min("conv_id").alias("least"), F.count("*").alias("n")).first()
    root, n_convs = whole["least"], whole["n"]
    spark = conversations.sparkSession
    if root is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    minima = written(prefix.groupBy("depth", "p1", "p2").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("chars").alias("chars")), "minima")
    found = written(first_owned(prefix, depths, minima), "owned")
    parent = F.when(F.col("first") > 1, F.col("parent")).otherwise(F.lit(root))
    is_root, none = F.col("conv_id") == root, F.lit(None).cast("long")
    # the root's chain begins at depth 0; all others hang on the node before their first
    chains = found.where((F.col("first") <= F.col("depths")) | is_root)
    chains = written(chains.select("conv_id", "depths", F.when(is_root, none).otherwise(parent).alias("parent"), F.when(is_root, F.lit(0)).otherwise(F.col("first")).cast("long").alias("first"), F.when(is_root, none).otherwise(F.col("first") - 1).alias("at")), "chains")
    owns = (F.col("first") <= F.col("depths")) | is_root
    ends = found.select(F.when(owns, F.col("conv_id")).otherwise(parent).alias("owner"), F.col("depths").alias("depth"), "conv_id")
    # one row a place and kind, then one a node
    zero = F.lit(0).cast("long")
    columns = ["conv_id", "depth", "n_convs", "chars", "parent", "kids", "last"]
    rows = minima.select(F.col("owner").alias("conv_id"), "depth", "n_convs", "chars", none.alias("parent"), zero.alias("kids"), zero.alias("last"))
    rows = rows.union(spark.createDataFrame([(root, 0, n_convs, 0, None, 0, 0)], ", ".join(f"{c} long" for c in columns)))
    rows = rows.union(chains.where("parent is not null").select("conv_id", F.col("first").alias("depth"), zero, zero, "parent", zero, zero))
    rows = rows.union(chains.select("conv_id", F.col("depths").alias("depth"), zero, zero, none, zero, F.lit(1).cast("long")))
    rows = rows.union(chains.where("parent is not null").groupBy("parent", "at").agg(F.count("*").alias("kids")).select(F.col("parent").alias("conv_id"), F.col("at").alias("depth"), zero, zero, none, "kids", zero))
    nodes = rows.groupBy("conv_id", "depth").agg(F.max("n_convs").alias("n_convs"), F.max("chars").alias("chars"), F.max("parent").alias("parent"), (F.sum("kids") + 1 - F.max("last")).alias("n_children"))
    nodes = nodes.select("conv_id", "depth", "n_convs", F.when(F.col("depth") == 0, none).otherwise(F.coalesce("parent", "conv_id")).alias("parent_conv_id"), "n_children", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    nodes = written(nodes, "nodes")
    hung = _sums(nodes, chains.select("conv_id", "parent", "at"))
    here = nodes.select("conv_id", "depth", F.col("leaf").alias("leaves"), "saved").union(hung).groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    below = running(here, "conv_id", [F.col("depth").desc()], ["depth"], ["leaves", "saved"], (1, 1), ["depth"])
    below = below.select("conv_id", "depth", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    table = nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children").join(below, ["conv_id", "depth"]).join(_hashed(ends), ["conv_id", "depth"], "left")
    return table.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
