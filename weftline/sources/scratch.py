"""Tables that steps of a job hand to each other, in a folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of its own on a local master, and an error on a cluster, whose executors wouldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftline-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete written tables that no later step reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def put(folder: str, name: str, table: pa.Table) -> None:
    """Keep a table under a name in a shared folder; a task that runs again puts the same one."""
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    draft = f"{root}/{name}-{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(draft) as f, pa.ipc.new_stream(f, table.schema) as out:
        out.write_table(table)
    store.move(draft, f"{root}/{name}")


def take(folder: str, name: str) -> pa.Table:
    store, root = _store(folder)
    with store.open_input_stream(f"{root}/{name}") as f:
        return pa.ipc.open_stream(f).read_all()
