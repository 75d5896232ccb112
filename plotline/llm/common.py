"""Helpers that the corpus operators share: reading tables, shared storage, digests."""

from __future__ import annotations

import ctypes
import gc
import math
import os
import pickle
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the session names none, a temporary folder takes its place on a ``local`` master, whose driver
    and executor are one process; on a cluster that is an error, since no folder is known to be shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "plotline-shared")
    path = f"{root.rstrip('/')}/plotline-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_written: dict[str, list[str]] = {}


def drop_shared(spark: SparkSession) -> int:
    """Delete the tables that this application has written below the shared folder; results still unread are lost.

    For a job's end: the library can't tell when a lazy result has been read for the last time.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What ``owner`` remembers in this Python worker. Workers are reused, so all that others remember is dropped."""
    if owner not in _kept:
        if _kept:
            _kept.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)  # else the freed pages stay with the worker
        _kept[owner] = {}
    return _kept[owner]


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a table in the shared folder.

    Unlike a local checkpoint, it outlives a lost executor, and it carries no partitioning along, so
    that a later join deals out both of its sides and skewed keys can be split.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, *LETTERS)


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once for each application, where they don't share the driver's path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="plotline-")) / "plotline.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def _in_task(batches: Iterator[pa.RecordBatch], work: Callable[[list], object]) -> Iterator[pa.RecordBatch]:
    rows = [x for batch in batches for x in batch.column(0).to_pylist()]
    yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(work(rows))], pa.binary())], ["result"])


def fit_in_task(sample: DataFrame, work: Callable[[list], object]) -> object:
    """``work`` over the values of a bounded one-column sample, in one task, where numpy keeps to one core.

    The sample is shuffled to that task, so that what it is chosen from is read in parallel.
    """
    found = sample.repartition(1).mapInArrow(partial(_in_task, work=work), "result binary").first()
    return pickle.loads(found.result) if found else work([])  # an empty table may have no task at all


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column(0):
            part = np.frombuffer(x.as_buffer(), np.float64)
            total = part.copy() if total is None else np.add(total, part, out=total)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])


def summed(parts: DataFrame) -> np.ndarray | None:
    """The sum of equally long float64 arrays, one binary value in each row; None for no rows.

    They are added up in the tasks over three levels, so that neither a task nor the driver meets them all.
    """
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for width in (n, math.isqrt(n), 1):
        parts = parts.repartition(max(1, width)).mapInArrow(_add, "part binary")
    found = parts.first()
    return np.frombuffer(found.part, np.float64) if found else None


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
