"""Operators' actions as a stream that a table of decisions follows (K6, K7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import step, written
from ..operators.register import latest_decisions
from .parts import PARTS, last_batch, part_of, replace, stored, touched

ACTION = "key string, action string, tier string, on string"
DECISION = T.StructType([T.StructField(name, T.StringType()) for name in ("key", "deletedOn", "hiddenOn", "switchedOn", "tier")])


def decisions(spark: SparkSession, table_dir: str) -> DataFrame:
    """What the actions come to, as of the last whole batch: the input of `register.apply_operator`."""
    return stored(spark, table_dir, DECISION, last_batch(spark, table_dir))


def _put(batch: DataFrame, number: int, table_dir: str, parts: int) -> None:
    spark = batch.sparkSession
    with step(spark):
        fresh = written(batch.select(*DECISION.fieldNames()).withColumn("part", part_of(F.col("key"), parts)), "decisions")
        own = touched(fresh)
        prior = stored(spark, table_dir, DECISION, number - 1, own).withColumn("part", part_of(F.col("key"), parts))
        rows = prior.join(fresh.select("key"), "key", "left_anti").select(*fresh.columns).unionByName(fresh)
        replace(rows.repartition("part"), number, table_dir, own)


def start(spark: SparkSession, source: str, table_dir: str, checkpoint: str, parts: int = PARTS, files_a_batch: int | None = None) -> StreamingQuery:
    """Follow a folder of JSON actions (ACTION).

    The state is that of the batch query, the latest action of each kind per key, as a streaming
    aggregation: a maximum, so late actions and any order of arrival come to the same, and no watermark
    is needed to drop what would still count. Each batch hands on the keys that changed, whose rows
    take the place of those in the table."""
    reader = spark.readStream.schema(ACTION)
    reader = reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader
    put = lambda batch, number: _put(batch, number, table_dir, parts)
    changed = latest_decisions(reader.json(source)).writeStream.outputMode("update").foreachBatch(put)
    return changed.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
