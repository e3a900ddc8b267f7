"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import pickle
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or one set here where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="weftline-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file in the shared folder, by Spark's own file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    try:
        for i in range(0, len(data), 1 << 20):
            stream.write(data[i : i + (1 << 20)])
    finally:
        stream.close()


def filesystem(uri: str):
    """A pyarrow file system and the path in it, for any store that pyarrow knows (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri if uri.startswith("file:") else f"file://{uri}")


def put(folder: str, name: str, data: Any) -> None:
    """Keep data under a name in a shared folder. Tasks that run twice put the same, so the first one whole is as good as any."""
    store, root = filesystem(folder)
    store.create_dir(root, recursive=True)
    draft = f"{root}/{name}-{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(draft) as f:
        f.write(pickle.dumps(data, protocol=5))
    if store.get_file_info(f"{root}/{name}").type.name == "NotFound":
        store.move(draft, f"{root}/{name}")
    else:
        store.delete_file(draft)


def drop(folder: str, name: str) -> None:
    """Delete what was kept under a name, if it is still there."""
    store, root = filesystem(folder)
    if store.get_file_info(f"{root}/{name}").type.name == "File":
        store.delete_file(f"{root}/{name}")


def take(folder: str, name: str) -> Any:
    store, root = filesystem(folder)
    with store.open_input_stream(f"{root}/{name}") as f:
        return pickle.loads(f.read())


def forget(*tables: DataFrame, folders: tuple[str, ...] = ()) -> None:
    """Delete written tables and folders that no later step reads, and let the session drop the shuffle files of finished steps."""
    spark = SparkSession.active()
    jvm = spark.sparkContext._jvm
    for written_path in (*(df.written_path for df in tables), *folders):
        path = jvm.org.apache.hadoop.fs.Path(written_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    trim()
    jvm.System.gc()  # shuffle files go with the plans that made them, when these are collected


def strings(column: pa.Array) -> list[str]:
    """Python strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Parts of a batch whose texts hold about `most` bytes, one row at least: bounds a worker's memory."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
    trim()


def trim() -> None:
    """Give freed memory back to the system: workers are reused, and what one operator has freed the next one can't always use."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _libc = None
_held: dict = {}


def only(key: tuple, make: Callable[[], Any]) -> Any:
    """The table under this key, made where it isn't there; a worker holds one table at a time, whatever operators it serves."""
    if key not in _held:
        _held.clear()
        gc.collect()
        trim()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Drop the table that this worker holds for an operator that ran before."""
    if _held:
        _held.clear()
        gc.collect()
        trim()


def by_doc(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The two columns that the operators read, whatever else there is."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def ascii_lower(text: str) -> str:
    """A-Z lower-cased, everything else as it is."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


_LOWER = {i: i + 32 for i in range(65, 91)}
