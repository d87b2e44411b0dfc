"""What the operators share: the shared folder, written tables, sizes of work."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python functions get at most about so many bytes of values at once, or one row.
BATCH_BYTES = 4 << 20
#: A key with more rows than this may be hot; there are at most HOT_KEYS hot ones.
HOT_ROWS, HOT_KEYS = 1 << 14, 1 << 16

_OWN: list[str] = []
_FOLDERS: set[str] = set()
_TOOL: dict[Any, Any] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset and all is one machine, as in tests, a temporary folder;
    on a cluster that is an error.  What is in it goes when the application ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="orbweave-"))
        named = _OWN[0]
    folder = f"{named.rstrip('/')}/orbweave-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        path, system = _hadoop(spark, folder)
        system.deleteOnExit(path)
    return folder


def _hadoop(spark: SparkSession, path: str) -> tuple[Any, Any]:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again.

    Lineage ends here: a lost executor costs at most the tasks that read it.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path, partitionBy=partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path, system = _hadoop(table.sparkSession, folder)
            system.delete(path, True)


def give_back() -> None:
    """Give a Python worker's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the C library that has it
        pass


def tool(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: the tool of one key.

    Workers are reused by later stages; asking for another key drops the tool of
    the last one and gives its memory back to the system.
    """
    if key not in _TOOL:
        _TOOL.clear()
        gc.collect()
        give_back()
        _TOOL[key] = make()
    return _TOOL[key]


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], n: str, total: int, most: int) -> DataFrame:
    """``rows`` joined to ``table``, which has a row a key and, in ``n``, the key's rows.

    ``total`` is the number of rows, ``most`` that of the most frequent key.  Keys
    with many rows are joined by broadcast, as there are few of them: at most
    ``total / max(HOT_ROWS, total / HOT_KEYS)``, so that none meets in one task;
    all others by a shuffle.  Null keys join nothing.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    if most <= limit:
        return rows.join(table.drop(n), keys)
    hot = F.col(n) > limit
    many, few = table.where(hot).drop(n), table.where(~hot).drop(n)
    on = [F.col(f"`{k}`") for k in keys]
    left = rows.join(F.broadcast(many.select(*on)), keys, "left_anti")
    return rows.join(F.broadcast(many), keys).unionByName(left.join(few, keys))


def row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """About how many bytes each row's values take."""
    import pyarrow.compute as pc

    n = np.full(batch.num_rows, 8 * batch.num_columns, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            n += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    return n


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch's rows in parts of about ``BATCH_BYTES``; a larger row is one part."""
    if not batch.num_rows:
        return
    ends = np.cumsum(row_bytes(batch))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        until = max(at + 1, int(np.searchsorted(ends, before + BATCH_BYTES, side="right")))
        yield batch.slice(at, until - at)
        at = until


def in_batches(columns: list[str], schema: pa.Schema, f: Callable[..., list]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: ``f`` gets the columns, a few MB at once, and gives arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(f(*(batch.column(batch.schema.get_field_index(c)) for c in columns)), schema.types, strict=True)], schema=schema)

    return run


def binary_array(flat: bytes, begins) -> pa.Array:
    """A binary column from one buffer and the byte offsets of its values."""
    if begins[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(np.ascontiguousarray(begins, np.int32)), pa.py_buffer(flat)])
    return pa.array([flat[a:b] for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)], pa.binary())


def ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Just these two columns, under fixed names, whatever else the table has."""
    return docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
