"""Folders and small files that every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only on a local master that has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = "file://" + tempfile.mkdtemp(prefix="orthoweave-")
    return _own[key]


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing stands at."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small text file on any file system that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
