"""The shared folder for intermediate files of queries."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MADE: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; in local mode without that setting, below a temporary folder. `release` removes it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-gridloom-")
            _MADE.append(_LOCAL[app])
        base = _LOCAL[app]
    _MADE.append(f"{base.rstrip('/')}/gridloom/{name}-{uuid.uuid4().hex[:12]}")
    return _MADE[-1]


def release() -> None:
    """Removes the folders that queries of this process made; their results can no longer be read. Runs at exit, too."""
    while _MADE:
        with suppress(OSError):  # gone already, or kept by the store
            store, path = fs.FileSystem.from_uri(_MADE.pop())
            store.delete_dir(path)
    _LOCAL.clear()


atexit.register(release)


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written once in the shared folder and read back: what several steps read is computed once and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
