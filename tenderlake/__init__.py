"""Spark-native engine for registers of public procurement notices."""

from __future__ import annotations

import contextlib
import contextvars
import io
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. It is set here only where the session names none
    and all of it runs on this machine; on a cluster a folder of one machine would lose rows."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: The tables that each open step has written, the innermost step last; each thread has its own steps.
_steps: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("steps", default=())


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: lost executors cost no
    recomputation, the lineage is cut, and Spark sees the true size when it picks a join."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for own in _steps.get()[-1:]:
        own.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def step(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A step of which only the result stays: what it gives writes a table like `written`, and at the
    end all other tables written within are deleted. What is kept belongs to the step around it."""
    own: list[str] = []
    outer = _steps.get()
    token = _steps.set((*outer, own))

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        path = own.pop()
        for around in outer[-1:]:
            around.append(path)
        return out

    try:
        yield keep
    finally:
        _steps.reset(token)
        context = spark.sparkContext
        for path in map(context._jvm.org.apache.hadoop.fs.Path, own):
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the session's Python workers, once per context: a ZIP of it
    goes through the shared folder."""
    context = spark.sparkContext
    if getattr(context, "_tenderlake_shipped", False):
        return
    here, body = Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(body, "w") as box:
        for source in sorted(here.rglob("*.py")):
            box.write(source, source.relative_to(here.parent).as_posix())
    target = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/package-{uuid.uuid4().hex}/tenderlake.zip")
    out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(body.getvalue()))
    out.close()
    context.addPyFile(target.toString())
    context._tenderlake_shipped = True
