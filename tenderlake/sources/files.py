"""Folders of any file system that Spark reaches, seen from the driver: names only, never contents."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(context._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, sorted; nothing if there is no such folder."""
    target, system = _at(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(target)) if system.exists(target) else []


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, in place of one that is there."""
    target, system = _at(spark, path)
    system.create(target, True).close()


def remove(spark: SparkSession, path: str) -> None:
    target, system = _at(spark, path)
    system.delete(target, True)
