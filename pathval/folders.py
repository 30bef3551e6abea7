"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_own: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables that are written on the way.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset and driver and
    executors are one process, as in tests, a temporary folder stands in; anywhere else a
    folder of one machine would be lost with it, so that is an error.
    """
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master or 'the cluster'} share")
    _own = _own or tempfile.mkdtemp(prefix="pathval-")
    return _own


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder of a table that nothing reads any more, in whatever store it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
