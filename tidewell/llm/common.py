"""Helpers shared by the text operators: reading tables, batches, identifiers."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch that carries whole texts, so that a batch of long texts stays small.
TEXT_BATCH_ROWS = 1000
#: A table is broadcast only if it was counted and holds at most so many rows.
BROADCAST_ROWS = 100_000
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Set what every text operator relies on: small batches, importable code, a shared folder.

    Code reaches local workers by PYTHONPATH; on a cluster, ship the package with --py-files.
    The checkpoint folder is the session's; only a local session that has none gets one of its own.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != TEXT_BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))
    sc = spark.sparkContext
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            given = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(given)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage, upon which Spark deletes the shuffle files of plans that are no longer referred to.

    Called after a checkpoint that ends a large plan; otherwise these files stay until the driver happens to collect.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sealed(documents: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``documents`` with all columns but ``own`` under names that no operator uses, and what gives the names and their order back."""
    columns = documents.columns
    names = {c: c if c in own else f"rest_{i}" for i, c in enumerate(columns)}
    quoted = lambda c: F.col(f"`{c}`")
    return documents.select(*(quoted(c).alias(n) for c, n in names.items())), lambda df: df.select(*(F.col(n).alias(c) for c, n in names.items()))


def bounded(df: DataFrame, count: int) -> DataFrame:
    """Mark ``df`` for broadcast if its counted size allows it; else leave the join to shuffles."""
    return F.broadcast(df) if count <= BROADCAST_ROWS else df


#: Rows of a narrow table in one file of the shared folder.
STORED_ROWS = 20_000


def stored(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most about ``rows`` rows, written to the shared folder in no more files than these rows need."""
    return df.coalesce(partitions_for(rows, STORED_ROWS)).checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, smaller than a checkpoint and read by column."""
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch; batches without rows are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null is empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column from one numpy array a row."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def column_lists(column: pa.Array) -> list[np.ndarray]:
    """The numpy arrays of a list column without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(column) else []


#: One beyond the greatest long.
LONG = 2**63


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of whole numbers, beyond a long the nearest long."""
    most = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(1, a.shape[1])
    if most < float(2**53):
        return (a @ b.T).astype(np.int64)
    if most < LONG / 2:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    return np.clip(whole(a) @ whole(b).T, -LONG, LONG - 1).astype(np.int64)


def partitions_for(rows: int, per_partition: int) -> int:
    return max(1, -(-rows // per_partition))
