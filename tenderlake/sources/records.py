"""Records that may be damaged: one pass parts them from the good ones, and only they are read again
(S1, U16)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RAW = T.StructType([T.StructField("source", T.StringType()), T.StructField("raw", T.StringType())])


def _row(schema: str) -> T.StructType:
    return T.StructType([T.StructField("source", T.StringType()), T.StructField("row", T.StructType.fromDDL(schema))])


def ingest(lines: DataFrame, schema: str, table_dir: str, run: int = 0) -> dict[str, int]:
    """Parse lines (source, raw: a JSON record each) and write the good rows and, apart, the damaged
    lines of a run; how many there are of each.

    A line is damaged if it is no JSON object or a field doesn't fit the schema; an absent field is
    NULL. It is one pass: both parts leave the same job, and the counts are observed on the way. A run
    that is written again takes its own place."""
    damage = "_damaged"
    parsed = F.from_json("raw", f"{schema}, {damage} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": damage})
    rows = lines.select("source", "raw", parsed.alias("row"))
    bad = F.col("row").isNull() | F.col(f"row.{damage}").isNotNull() | F.col("raw").isNull() | (F.trim("raw") == "")
    rows = rows.select("source", F.when(bad, F.col("raw")).alias("raw"), F.when(~bad, F.col("row").dropFields(damage)).alias("row"), bad.alias("bad"))
    counts = Observation(f"records-{uuid.uuid4().hex}")
    rows = rows.observe(counts, F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("damaged"))
    rows.write.partitionBy("bad").mode("overwrite").parquet(f"{table_dir}/run={run}")
    return dict(counts.get)


def _part(spark: SparkSession, table_dir: str, run: int, bad: bool, schema: T.StructType) -> DataFrame:
    # Read by filter: a run may have no rows of a part, and then no folder of it.
    whole = T.StructType([*schema.fields, T.StructField("bad", T.BooleanType())])
    return spark.read.schema(whole).parquet(f"{table_dir}/run={run}").where(F.col("bad") == bad).drop("bad")


def good(spark: SparkSession, table_dir: str, schema: str, run: int) -> DataFrame:
    """The good rows of a run: source and the record's fields."""
    return _part(spark, table_dir, run, False, _row(schema)).select("source", "row.*")


def quarantine(spark: SparkSession, table_dir: str, run: int) -> DataFrame:
    """The damaged lines that a run left: source, raw."""
    return _part(spark, table_dir, run, True, _RAW)


def retry(spark: SparkSession, table_dir: str, schema: str, run: int, repair: Callable[[Column], Column]) -> dict[str, int]:
    """Read the damaged lines of a run again, repaired, as the next run; nothing else is read."""
    lines = quarantine(spark, table_dir, run).select("source", repair(F.col("raw")).alias("raw"))
    return ingest(lines, schema, table_dir, run + 1)


def source_log(spark: SparkSession, table_dir: str, run: int = 0) -> DataFrame:
    """U16: a row for each source of a run: good and damaged lines, and what became of it: whole, partial
    or skipped. A source that can't be read costs its own rows, never the run."""
    kind = T.StructType([T.StructField("source", T.StringType()), T.StructField("bad", T.BooleanType())])
    per = spark.read.schema(kind).parquet(f"{table_dir}/run={run}").groupBy("source").agg(F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("damaged"))
    return per.withColumn("state", F.when(F.col("damaged") == 0, "whole").when(F.col("good") == 0, "skipped").otherwise("partial"))
