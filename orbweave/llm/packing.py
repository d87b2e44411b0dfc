"""Packing: neighbouring documents along a space-filling curve share sequences.

Every document becomes a vector: its token ids are hashed to signed weights in
``DIMENSIONS`` directions and averaged, so that documents with the same tokens
lie together, however long they are.  Each direction is cut into ``2 ** BITS``
cells that hold equal shares of all tokens (quantiles of the whole corpus, from a
histogram of ``BINS`` bins), and the cells' Hilbert number orders the documents.
Documents go along the line in rows of at most one sequence, so that ranges of
rows are ranges of about as many tokens.  A range sort by (Hilbert number, id)
lays all tokens on one line; the line is cut every ``length`` tokens.  So each
token lies in exactly one piece and only the very last sequence is padded.

Each partition of the range sort counts its own tokens; what the earlier
partitions hold, one number a partition, is summed on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import binary_array, ddl, discard, id_and_text, in_batches, partitions, slices, written
from orbweave.llm.text_kernels import mix, ragged
from orbweave.llm.word_tokens import load, with_end

DIMENSIONS, BITS, BINS = 4, 12, 1 << 14
_AXES = [f"c{k}" for k in range(DIMENSIONS)]


def directions(vocabulary: int) -> np.ndarray:
    """Fixed pseudo-random weights, below 1.75, a token id and direction.

    Later ids of a merge table stand for rarer, more telling strings and weigh
    more.
    """
    ids = np.arange(vocabulary, dtype=np.uint64)
    signs = np.stack([(mix(ids, 21 + k) >> np.uint64(11)).astype(float) / 2**52 - 1 for k in range(DIMENSIONS)], 1)
    return signs * np.sqrt(3 * (ids[:, None] + 1.0) / vocabulary)


def coordinates(ids: np.ndarray, begins: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The mean weight in each direction of texts, none of them empty: within +-2."""
    n = np.diff(begins)
    return np.stack([np.add.reduceat(weights[:, k][ids], begins[:-1]) / n for k in range(DIMENSIONS)], 1) if len(n) else np.empty((0, DIMENSIONS))


def bins(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((values + 2) * (BINS / 4)), 0, BINS - 1).astype(np.int64)


def quantile_cells(weights: np.ndarray) -> np.ndarray:
    """By bin, the cell among ``2 ** BITS`` by the share of weight below the bin's middle."""
    middle = np.cumsum(weights) - weights / 2
    return np.minimum(middle / max(weights.sum(), 1) * 2**BITS, 2**BITS - 1).astype(np.int64)


def hilbert(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """Number along the Hilbert curve of points with integer coordinates.

    The coordinates are first turned, from the top bit down, into the curve's
    transposed Gray code; its bits, interleaved, are the number.
    """
    x = coordinates.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        top, rest = 1 << level, (1 << level) - 1
        for k in range(n):
            up = (x[k] & top) != 0
            swap = np.where(up, 0, (x[0] ^ x[k]) & rest)
            x[0] ^= np.where(up, rest, swap)
            if k:
                x[k] ^= swap
    for k in range(1, n):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for k in range(n):
            key = key << 1 | (x[k] >> level & 1)
    return key


TOKENS = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), *((c, pa.float64()) for c in _AXES), ("start", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
PLACED = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("part", pa.int32()), ("before", pa.int64()), ("ids", pa.binary())])
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _cell_tables(encoded: DataFrame) -> np.ndarray:
    """Cells by direction and bin, from the tokens of all documents; a bounded histogram is gathered."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("axis"), F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col(c) + 2) * (BINS / 4)))).alias("bin")) for k, c in enumerate(_AXES))))
    found = encoded.select("n", each.alias("e")).groupBy("e.axis", "e.bin").agg(F.sum("n").alias("n")).toPandas()
    weights = np.zeros((DIMENSIONS, BINS))
    weights[found["axis"].to_numpy(int), found["bin"].to_numpy(int)] = found["n"].to_numpy(float)
    return np.stack([quantile_cells(w) for w in weights])


def on_curve(encoded: DataFrame) -> DataFrame:
    """The rows with their documents' place on the curve."""
    tables = _cell_tables(encoded)

    @F.pandas_udf("long")
    def curve(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        cells = np.stack([tables[k][bins(x.to_numpy())] for k, x in enumerate((a, b, c, d))], 1)
        return pd.Series(hilbert(cells, BITS))

    return encoded.withColumn("curve", curve(*_AXES))


def line(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All tokens in the line's order: rows of up to ``length`` tokens of one document.

    Columns: doc_id, doc_tokens, start, n, part, before (the tokens before the row
    in its part; parts follow one another), ids (2 or 4 bytes each).
    """

    def tokens(ids: pa.Array, texts: pa.Array) -> list:
        words = load(tokenizer)
        if not hasattr(words, "directions"):
            words.directions = directions(max(words.size, end_id + 1))
        flat, at = with_end(*words.encode([t or "" for t in texts.to_pylist()]), end_id)
        width = np.uint16 if words.size <= 1 << 16 and end_id < 1 << 16 else np.uint32
        n = np.diff(at)
        count = -(-n // length)
        doc = np.repeat(np.arange(len(n)), count)
        start = ragged(np.zeros(len(n), np.int64), count) * length
        place = coordinates(flat, at, words.directions)[doc]
        begins = np.r_[at[doc] + start, at[-1]]
        return [ids.take(pa.array(doc)), n[doc], *place.T, start, np.diff(begins), binary_array(flat.astype(width).tobytes(), begins * np.dtype(width).itemsize)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column("n").to_numpy()
            ends = total + np.cumsum(n)
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "doc_tokens", "start", "n")), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), b.column("ids")], schema=PLACED)

    encoded = written(id_and_text(docs, id_column, text_column).mapInArrow(in_batches(["doc_id", "text"], TOKENS, tokens), ddl(TOKENS)), "pack-tokens")
    # the first direction tells documents of one id and length apart
    order = ("curve", "doc_id", "doc_tokens", _AXES[0], "start")
    ordered = on_curve(encoded).select(*order, "n", "ids").repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order, "ids")
    placed = written(ordered.mapInArrow(place, ddl(PLACED)), "pack-line")
    discard(encoded)
    return placed


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pack all documents into sequences of ``length`` tokens.

    Returns a row a piece: doc_id, start (the document's tokens before it),
    length, ids (little-endian unsigned 32-bit), doc_tokens (with ``end_id``),
    sequence_id and offset (place there).  A document of more than ``length``
    tokens is also cut every ``length`` of its own.  A null text counts as empty
    and has just ``end_id``.  Rows with equal or null ids are separate documents.
    An empty table gives no pieces.  Other columns are ignored.
    """
    placed = line(docs, tokenizer, end_id, length, id_column, text_column)
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    base, total = {}, 0
    for p in sorted(sizes):
        base[p], total = total, total + sizes[p]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in slices(whole)):
            ids, doc_tokens, start, n, part, before, data = b.columns
            n = n.to_numpy()
            width = np.uint16 if len(data[0].as_py()) == 2 * n[0] else np.uint32
            flat = np.frombuffer(b"".join(data.to_pylist()), width).astype("<u4")
            at = before.to_numpy() + np.array([base[p] for p in part.to_pylist()], np.int64)
            first, last = at // length, (at + n - 1) // length
            count = last - first + 1
            row = np.repeat(np.arange(len(n)), count)
            sequence = ragged(first, count)
            begin = np.maximum(sequence * length, at[row])
            end = np.minimum((sequence + 1) * length, (at + n)[row])
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row)), *map(pa.array, (start.to_numpy()[row] + begin - at[row], end - begin)), binary_array(flat.tobytes(), 4 * np.r_[0, np.cumsum(end - begin)]), *map(pa.array, (doc_tokens.to_numpy()[row], sequence, begin - sequence * length))], schema=PIECES
            )

    return placed.mapInArrow(cut, ddl(PIECES))
