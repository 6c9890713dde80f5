"""Intermediate tables in the folder that driver and executors share, and how long they live."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of applications that are known to exist, and the innermost folders of scratch().
_MADE: set[str] = set()
_INNER: list[str | None] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where all run on one machine may it be unset (tests): a folder of that machine is then
    made and set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="steadfold-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def work_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables. It goes when the application ends: frames that read from it
    are good until then, or until the scratch() that they were made in."""
    if _INNER and _INNER[-1]:
        return _INNER[-1]
    path = f"{shared_folder(spark)}/steadfold/{spark.sparkContext.applicationId}"
    if path not in _MADE:
        target, system = _system(spark, path)
        system.mkdirs(target)
        system.deleteOnExit(target)
        _MADE.add(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Whatever is staged inside is deleted at the end: for a job that writes its results before that."""
    path = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    _INNER.append(path)
    try:
        yield path
    finally:
        _INNER.pop()
        target, system = _system(spark, path)
        system.delete(target, True)


@contextmanager
def lasting() -> Iterator[None]:
    """What is staged inside outlives any scratch() around it: for what is remembered from one job to the next."""
    _INNER.append(None)
    try:
        yield
    finally:
        _INNER.pop()


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read from there: what it comes from is not computed again, nor lost with an executor."""
    path = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
