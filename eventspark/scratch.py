"""Intermediate tables in the folder the cluster names in ``spark.checkpoint.dir``.

A written table cuts lineage and outlives the executors that produced it. The setting is read
from the session; only a local session without it gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_own_folder: str | None = None
_written: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables."""
    global _own_folder
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder every executor can reach")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _own_folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path nobody has used yet, below the shared folder; ``clear`` removes it and files beside it that begin with its name."""
    path = f"{scratch_root(spark)}/eventspark-{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Remove what this session wrote so far. Results read it, so call it once these have been written or used."""
    as_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    while _written:
        made = as_path(_written.pop() + "*")  # the name is unique; sidecars begin with it too
        files = made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in files.globStatus(made) or ():
            files.delete(status.getPath(), True)


def store(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as parquet and continue from the written table; ``compression`` is the session's by default."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
