"""Intermediate tables, written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one gets its own, removed when the driver ends. On a cluster it must be set."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="stylarium-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        conf = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What written() makes inside goes at the end, so results must be collected or written by then; scopes may be nested.

    Without a scope, tables belong to the owner of spark.checkpoint.dir.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df from a table, so that what reads it twice works it out once, and a lost executor does not work it out again."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
