"""Results that are computed once and read many times."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the session names none, a temporary folder takes its place on a ``local`` master; a cluster has no
    folder that is known to be shared, and that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "plotline-shared")
    return f"{root.rstrip('/')}/plotline-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a written table: computed once for all its readers, without lineage, and safe from lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
