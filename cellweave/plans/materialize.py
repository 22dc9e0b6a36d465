"""Cutting lineage with tables written to the folder that all executors share.

A table survives the loss of any executor, is columnar and compressed (unlike an RDD checkpoint) and is
read back with column pruning. The folder is the cluster's ``spark.checkpoint.dir``; only where that is
unset, as in tests, a folder of this machine is taken.

Tables lie under one folder of the application. It is deleted when the session is stopped, or, if the driver
ends without that, when its JVM does. An operator releases a table earlier once all that read it was written.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: The table behind each DataFrame that materialize returned and that is still held.
_tables: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _delete(sc: SparkContext, path: str) -> None:
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def _delete_at_end(sc: SparkContext, path: str) -> None:
    """Delete a folder before the context stops, or when its JVM ends."""
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(target)
    ends = sc.__dict__.setdefault("_cellweave_ends", [])
    ends.append(path)
    if len(ends) == 1:
        stop = sc.stop

        def stop_clean() -> None:
            for p in ends:
                with contextlib.suppress(Exception):
                    _delete(sc, p)
            del sc.stop
            stop()

        sc.stop = stop_clean


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, or else a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="cellweave-")
        spark.conf.set("spark.checkpoint.dir", path)
        _delete_at_end(spark.sparkContext, path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the application's own part of the shared folder, which goes when the session ends."""
    sc = spark.sparkContext
    own = f"{shared_dir(spark)}/cellweave/{sc.applicationId}"
    if own not in sc.__dict__.get("_cellweave_ends", ()):
        fs_path = sc._jvm.org.apache.hadoop.fs.Path(own)
        fs_path.getFileSystem(sc._jsc.hadoopConfiguration()).mkdirs(fs_path)  # deletion at exit needs a folder that is there
        _delete_at_end(sc, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df once as Parquet in the shared folder and return a DataFrame that reads it. Runs a job.

    Column types and order are kept. The table is deleted when the session ends, or by ``release``.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the tables that materialize wrote for these DataFrames. No plan may read them any more."""
    for df in tables:
        path = _tables.pop(df, None)
        if path is not None:
            _delete(df.sparkSession.sparkContext, path)
