"""An extension: the register kept up to date by a stream of rows (U13), in parts by hash of the key, of
which a batch reads and writes only those that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import step, written
from ..operators.register import REGISTER, archive, is_junk, merge_copies, stamp, with_key
from .parts import PARTS, last_batch, part_of, replace, stored, touched


def merge_batch(prior: DataFrame | None, fresh: DataFrame, as_of: str, deal: str = "key", slices: int = 1) -> DataFrame:
    """The register after a batch: prior rows first, then the batch's by the time they were last worked
    on, equal times by all they hold, folded per key; rows without a key are left out."""
    rows = fresh.withColumns({"shard": F.lit(1), "at": stamp(), "pos": F.xxhash64(F.to_json(F.struct("*")))})
    if prior is not None:
        before = prior.select(*fresh.columns).withColumns({"shard": F.lit(0), "at": F.lit(""), "pos": F.lit(0).cast("bigint")})
        rows = before.unionByName(rows)
    return archive(merge_copies(rows if "key" in rows.columns else with_key(rows), ["shard", "at", "pos"], deal, slices), as_of)


def _kind(schema: str) -> T.StructType:
    return T.StructType([T.StructField("key", T.StringType()), *T.StructType.fromDDL(schema).fields])


def current(spark: SparkSession, table_dir: str, schema: str = REGISTER) -> DataFrame:
    """The register as its last whole batch left it, junk left out."""
    return stored(spark, table_dir, _kind(schema), last_batch(spark, table_dir)).where(~is_junk())


def upsert(batch: DataFrame, number: int, table_dir: str, as_of: str, parts: int = PARTS, schema: str = REGISTER) -> list[int]:
    """Merge a batch into the parts that its keys touch; their numbers. Prior rows are read of these parts
    only, as the batches before left them, so a batch that is run again writes the same. Junk stays in
    its part and is left out when read, so no part comes out empty. A part is dealt to tasks in slices,
    so that what one task holds doesn't grow with the number of rows a part has, but falls with the
    session's shuffle partitions; small slices are put together again by Spark."""
    spark = batch.sparkSession
    with step(spark):
        rows = written(with_key(batch).where("key != ''").withColumn("part", part_of(F.col("key"), parts)), "batch")
        own = touched(rows)
        prior = stored(spark, table_dir, _kind(schema), number - 1, own).withColumn("part", part_of(F.col("key"), parts))
        slices = -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // max(len(own), 1))
        replace(merge_batch(prior, rows, as_of, "part", slices).withColumn("part", part_of(F.col("key"), parts)), number, table_dir, own)
    return own


def start(spark: SparkSession, source: str, table_dir: str, checkpoint: str, as_of: str, schema: str = REGISTER, parts: int = PARTS) -> StreamingQuery:
    """Follow a folder of JSON rows, each batch an upsert under its number."""
    rows = spark.readStream.schema(schema).json(source)
    merge = lambda batch, number: upsert(batch, number, table_dir, as_of, parts, schema)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
