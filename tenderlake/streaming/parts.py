"""A keyed table in parts by hash of the key, of which a batch writes anew only those that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files

#: Parts of a table; as many as keep one of them a few hundred megabytes.
PARTS = 64


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def touched(rows: DataFrame) -> list[int]:
    """The numbers in the column part, at most as many as the table has parts."""
    return sorted(r.part for r in rows.select("part").distinct().collect())


def last_batch(spark: SparkSession, table_dir: str) -> int:
    """The number of the last batch that was written whole, -1 before the first."""
    return max(map(int, files.names(spark, f"{table_dir}/_batches")), default=-1)


def _versions(spark: SparkSession, table_dir: str, upto: int) -> dict[int, list[int]]:
    """The versions of each part, by the batches that wrote them, up to one of them."""
    found = {}
    for name in files.names(spark, table_dir):
        if name.startswith("part="):
            versions = sorted(int(v[2:]) for v in files.names(spark, f"{table_dir}/{name}") if v.startswith("v="))
            if held := [v for v in versions if v <= upto]:
                found[int(name[5:])] = held
    return found


def stored(spark: SparkSession, table_dir: str, schema: T.StructType, upto: int, only: list[int] | None = None) -> DataFrame:
    """The rows of the parts, or of only some, as the batches up to a number left them."""
    paths = [f"{table_dir}/part={p}/v={v[-1]}" for p, v in _versions(spark, table_dir, upto).items() if only is None or p in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def replace(rows: DataFrame, number: int, table_dir: str, parts: list[int]) -> None:
    """Put rows (with their part) in the place of the parts named.

    Each gets a new version under the batch's number, by dynamic overwrite, so a batch that is run
    again from the versions before it writes the same. A file names the batch once all its parts are
    there; until then readers see the versions before. Of versions the last two stay. A part must not
    come out without rows: its version before would stand."""
    spark = rows.sparkSession
    if parts:
        rows.withColumn("v", F.lit(number)).write.partitionBy("part", "v").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(table_dir)
    files.touch(spark, f"{table_dir}/_batches/{number}")
    for part, versions in _versions(spark, table_dir, number).items():
        for old in versions[:-2] if part in parts else ():
            files.remove(spark, f"{table_dir}/part={part}/v={old}")
