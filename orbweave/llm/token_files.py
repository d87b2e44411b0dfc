"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are renumbered by how often all documents use them, so that the commonest
256 take one byte.  A block holds about ``BLOCK_TOKENS`` tokens of consecutive
documents:

    "OWT1" | documents, tokens (two little-endian uint32)
    control bytes, then data bytes, of the documents' token counts
    control bytes, then data bytes, of the tokens' ranks
    crc32 of all that (little-endian uint32)

A control byte tells of four numbers, two bits each, how many bytes they take
less one, the first number in the lowest bits; the data bytes are little-endian.
The last group is filled with zeros.  Reading looks the four lengths of every
control byte up in a table and gathers the bytes with numpy.

Blocks are rows of the Parquet table ``blocks`` of a folder, since executors can
write only through Spark.  Beside it lies ``ranks``, one row that names the ids by
rank, so that the folder alone is enough to read all ids back:

    "OWR1" | ids used (little-endian uint32)
    control bytes, then data bytes, of the ids in order of rank
    crc32 of all that (little-endian uint32)
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import binary_array, ddl, discard, fresh_path, id_and_text, in_batches, partitions, slices, written
from orbweave.llm.word_tokens import load, with_end

BLOCK_TOKENS = 1 << 18
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def encode_numbers(values: np.ndarray) -> bytes:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    v = np.zeros(-(-len(values) // 4) * 4, "<u4")
    v[: len(values)] = values
    size = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    control = (size.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= size[:, None]]
    return control.tobytes() + data.tobytes()


def decode_numbers(data: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """``n`` numbers from the start of some bytes, and the bytes they take."""
    groups = -(-n // 4)
    sizes = _LENGTHS[data[:groups]].ravel()
    ends = np.cumsum(sizes) + groups
    starts = ends - sizes
    padded = np.r_[data, np.zeros(4, np.uint8)]
    out = np.zeros(len(sizes), np.uint32)
    for k in range(4):
        out |= np.where(sizes > k, padded[starts + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out[:n], int(ends[-1]) if groups else 0


def encode_block(lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    body = b"OWT1" + np.array([len(lengths), len(ranks)], "<u4").tobytes() + encode_numbers(lengths) + encode_numbers(ranks)
    return body + np.array([zlib.crc32(body)], "<u4").tobytes()


def decode_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    if block[:4] != b"OWT1" or zlib.crc32(block[:-4]) != int.from_bytes(block[-4:], "little"):
        raise ValueError("not an intact token block")
    data = np.frombuffer(block, np.uint8)
    documents, tokens = np.frombuffer(block, "<u4", 2, 4).tolist()
    lengths, taken = decode_numbers(data[12:-4], documents)
    return lengths, decode_numbers(data[12 + taken : -4], tokens)[0]


def encode_ranks(ids: np.ndarray) -> bytes:
    """The file of the ids used, in order of rank."""
    body = b"OWR1" + np.array([len(ids)], "<u4").tobytes() + encode_numbers(ids)
    return body + np.array([zlib.crc32(body)], "<u4").tobytes()


def decode_ranks(data: bytes) -> np.ndarray:
    if data[:4] != b"OWR1" or zlib.crc32(data[:-4]) != int.from_bytes(data[-4:], "little"):
        raise ValueError("not an intact table of ranks")
    return decode_numbers(np.frombuffer(data, np.uint8)[8:-4], int.from_bytes(data[4:8], "little"))[0]


ENCODED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary())])
COUNTS = pa.schema([("id", pa.int64()), ("uses", pa.int64())])
BLOCKS = pa.schema([("part", pa.int32()), ("block_number", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("null_ids", pa.int64()), ("doc_ids", pa.binary()), ("block", pa.binary())])
DECODED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> str:
    """Write all documents' ids, in ascending order of doc_id; the folder.

    Without a ``folder``, a new one in the shared folder.  A null text counts as
    empty, with just ``end_id``.  Null ids come first; rows with the same id are
    separate documents, ordered by their length and ids.  An empty table gives
    no blocks.  Other columns are ignored.  The counts that are gathered and the
    ranks that are broadcast are bounded by the vocabulary.
    """

    def tokens(ids: pa.Array, texts: pa.Array) -> list:
        flat, at = with_end(*load(tokenizer).encode([t or "" for t in texts.to_pylist()]), end_id)
        data = flat.astype("<u2" if small else "<u4").tobytes()
        at = at * (2 if small else 4)
        return [ids, np.diff(at) // (2 if small else 4), [zlib.crc32(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], binary_array(data, at)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses = np.zeros(size, np.int64)
        for whole in batches:
            for b in slices(whole):
                uses += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u2" if small else "<u4"), minlength=size)
        seen = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(uses[seen])], schema=COUNTS)

    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-files")
    size = max(load(tokenizer).size, end_id + 1)
    small = size <= 1 << 16
    encoded = written(id_and_text(docs, id_column, text_column).mapInArrow(in_batches(["doc_id", "text"], ENCODED, tokens), ddl(ENCODED)), "tokens")
    uses = encoded.select("ids").mapInArrow(count, ddl(COUNTS)).groupBy("id").agg(F.sum("uses").alias("uses")).toPandas()
    used = uses.sort_values(["uses", "id"], ascending=[False, True])["id"].to_numpy().astype(np.uint32)
    rank = np.zeros(size, np.uint32)
    rank[used] = np.arange(len(used))
    spark.createDataFrame([(encode_ranks(used),)], "ranks binary").coalesce(1).write.parquet(f"{folder}/ranks")
    to_rank = spark.sparkContext.broadcast(rank)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, before, held, tokens_held = TaskContext.get().partitionId(), 0, 0, [], 0

        def close() -> pa.RecordBatch:
            nulls = sum(x[0] is None for x in held)
            ids = np.array([x[0] or 0 for x in held], "<i8")
            flat = np.frombuffer(b"".join(x[2] for x in held), "<u2" if small else "<u4")
            block = encode_block(np.array([x[1] for x in held], np.uint32), to_rank.value[flat])
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), *(pa.array([x]) for x in (before, len(flat), nulls)), pa.array([ids.tobytes()], pa.binary()), pa.array([block], pa.binary())], schema=BLOCKS)

        for whole in batches:
            for b in slices(whole):
                for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "ids")), strict=True):
                    held.append(row)
                    tokens_held += row[1]
                    if tokens_held >= BLOCK_TOKENS:
                        yield close()
                        number, before, held, tokens_held = number + 1, before + tokens_held, [], 0
        if held:
            yield close()

    # rows of one id, or without one, may be many: ranges also go by length and checksum
    order = ("doc_id", "n", "crc")
    ordered = encoded.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "ids")
    ordered.mapInArrow(blocks, ddl(BLOCKS)).write.option("compression", "zstd").parquet(f"{folder}/blocks")
    discard(encoded)
    return folder


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) from the files of a folder alone.

    ``start`` counts the tokens of all documents before; ids are little-endian
    unsigned 32-bit.  A block knows the tokens before it in its part; those of
    the earlier parts, one number a part, are summed on the driver.
    """
    blocks = spark.read.schema(ddl(BLOCKS)).parquet(f"{folder}/blocks")
    sizes = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    base, total = {}, 0
    for p in sorted(sizes):
        base[p], total = total, total + sizes[p]
    table = decode_ranks(bytes(spark.read.parquet(f"{folder}/ranks").first()["ranks"])).astype("<u4")
    shared = spark.sparkContext.broadcast((table, base))

    def decode(part: pa.Array, before: pa.Array, nulls: pa.Array, doc_ids: pa.Array, block: pa.Array) -> list:
        to_id, base = shared.value
        ids, start, counts, flats, null = [], [], [], [b""], []
        for p, s, k, d, data in zip(*(x.to_pylist() for x in (part, before, nulls, doc_ids, block)), strict=True):
            n, ranks = decode_block(data)
            ids.append(np.frombuffer(d, "<i8"))
            null.append(np.arange(len(n)) < k)
            start.append(base[p] + s + np.cumsum(n, dtype=np.int64) - n)
            counts.append(n.astype(np.int64))
            flats.append(to_id[ranks].tobytes())
        counts = np.concatenate(counts)
        return [pa.array(np.concatenate(ids), mask=np.concatenate(null)), np.concatenate(start), counts, binary_array(b"".join(flats), 4 * np.r_[0, np.cumsum(counts)])]

    return blocks.mapInArrow(in_batches(["part", "before", "null_ids", "doc_ids", "block"], DECODED, decode), ddl(DECODED))
