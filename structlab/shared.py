"""Folders that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, or a local one where that is unset, as in tests."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}" if root else tempfile.mkdtemp(prefix=f"structlab-{name}-")


def checkpoints(spark: SparkSession) -> None:
    """Have a folder for checkpoints."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoints"))


_SETTLED: list[str] = []


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: its rows are computed once, and a lost executor costs no earlier work.

    The tables go when the driver's process ends.
    """
    path = shared_dir(df.sparkSession, "settled")
    if not _SETTLED:
        atexit.register(drop_settled)
    _SETTLED.append(path)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def dropped(spark: SparkSession, tables: list[DataFrame]) -> None:
    """Delete tables that ``settled`` wrote and nothing reads any more, and have Spark delete the shuffle files of finished plans.

    Spark deletes them once the JVM has collected their plans, which Python's objects hold until py4j's worker, asleep for up to a second, lets them go.
    """
    paths = [t.settled_at for t in tables]
    tables.clear()
    for path in paths:
        _SETTLED.remove(path)
        delete(path)
    gc.collect()
    time.sleep(1.2)
    spark.sparkContext._jvm.System.gc()


def delete(path: str) -> None:
    """Through the file system that owns the path."""
    jvm = SparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)


def drop_settled() -> None:
    """Delete the tables that ``settled`` wrote."""
    with contextlib.suppress(Exception):  # at the end of a process the JVM may be gone
        for path in _SETTLED:
            delete(path)
    _SETTLED.clear()
