"""Work queues: what to repair first, who does what, what the budget admits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import written
from ..functions.text import any_of, file_score, or_empty

MAX_TRIES = 3
#: Calls that a whole job may need; it starts only if so many are left.
JOB_COST = 6


def _true(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def suspect_refusal() -> Column:
    """a NO that no second opinion looked at."""
    return (F.col("tier") == "NO") & ~_true("deleted") & ~_true("secondOpinion")


def unproven_dates() -> Column:
    return ~_true("deleted") & ~_true("datesVerified") & (or_empty(F.col("deadline")) != "")


def suspect_date() -> Column:
    """a deadline without a line of evidence, or with one that says it was guessed."""
    guessed = any_of(F.lower(F.array_join("dateWarnings", " ")), ("soonest future date", "no line says this is the closing date", "confirm it before you rely on it"))
    bare = or_empty(F.try_element_at("dateEvidence", F.lit("closing"))) == ""
    return ~_true("deleted") & (or_empty(F.col("deadline")) != "") & (bare | F.coalesce(guessed, F.lit(False)))


def repairable(most_tries: int = MAX_TRIES) -> Column:
    """a row that another reading could complete."""
    open_ = ~_true("archived") & ~_true("deleted") & ~_true("hidden")
    doubtful = F.coalesce(suspect_refusal(), F.lit(False)) | suspect_date()
    incomplete = (or_empty(F.col("verified")) != "VERIFIED") & (F.coalesce("repairTries", F.lit(0)) < most_tries) & ((or_empty(F.col("link")) != "") | F.coalesce(F.size("files") > 0, F.lit(False)))
    return open_ & (doubtful | incomplete)


def repair_score() -> Column:
    """Worst but most fixable first."""
    notes = F.lower(or_empty(F.array_join("verifyNotes", " ")))
    says = lambda w: F.contains(notes, F.lit(w))
    points = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    return (
        points(suspect_refusal(), 200) + points(unproven_dates(), 150) + points(suspect_date(), 180)
        + points(says("not adjudicated") | (F.col("tier") == "REVIEW"), 40) + points(says("no closing date"), 25) + points(says("no title"), 10) + points(says("unreadable"), 15)
        + 2 * F.least(F.coalesce("fileCount", F.lit(0)), F.lit(6)) - 12 * F.coalesce("repairTries", F.lit(0))
    )


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with the place of each row in a total order, from 0. The order is laid out by ranges and
    places are counted within them, so no task sorts the whole table. The ranges are written once: what
    counts them and what numbers their rows read the same parts."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    laid = written(laid, "ranked").withColumns({"__part": part.cast("int"), "__at": F.col("__id") - F.shiftleft(part, 33)})
    counts = laid.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # One row of counts for each range.
    return laid.join(F.broadcast(before.select("__part", "__before")), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__id", "__at", "__before")


def repair_queue(register: DataFrame, tie: str = "key") -> DataFrame:
    """O1: the repairable rows in the order in which to work them, with score and rank."""
    return ranked(register.where(repairable()).withColumn("score", repair_score()), [F.col("score").desc(), F.col(tie).asc()])


def shard(df: DataFrame, shards: int, rank: str = "rank") -> DataFrame:
    """Rows dealt to workers by their place in the order."""
    return df.withColumn("shard", F.pmod(F.col(rank), F.lit(shards)))


def rotated(df: DataFrame, start: int, n: int, pos: str = "pos") -> DataFrame:
    """Places in the order of a rotation that resumes at start, of n."""
    return df.withColumn("turn", F.pmod(F.col(pos) - F.lit(start), F.lit(n)))


def sampled(df: DataFrame, n: int, posts: int, pos: str = "pos") -> DataFrame:
    """Every so-manieth row, `posts` at most."""
    step = max(1, n // posts)
    return df.where((F.col(pos) % step == 0) & (F.col(pos) < step * posts))


def running_total(df: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """df with the sum of value over the rows of a group before each, in order; at equal places in no fixed
    order. The table is laid out by ranges of (group, order), written once; a group that spans ranges
    adds up what the ranges before hold of it, so no task holds a whole group."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = written(df.repartitionByRange(n, group, order).withColumn("__part", F.spark_partition_id()), "running")
    earlier = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(df.schema[value].dataType)
    sums = laid.groupBy(F.col(group).alias("__group"), F.col("__part").alias("__range")).agg(F.sum(value).alias("__sum"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(earlier(Window.partitionBy("__group").orderBy("__range"))), zero))
    own = F.coalesce(F.sum(value).over(earlier(Window.partitionBy(group, "__part").orderBy(order))), zero)
    joined = laid.withColumn("__own", own).join(sums, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__range")))
    return joined.withColumn(name, F.col("__before") + F.col("__own")).select(*df.columns, name)


def admitted(jobs: DataFrame, group: str, order: str, cost: str, cap: int, job_cost: int = JOB_COST) -> DataFrame:
    """Jobs with what was spent before each, and whether it may start: a job starts only while a
    whole one fits what is left; the first refusal ends the run."""
    out = running_total(jobs, group, order, cost, "spent_before")
    return out.withColumn("starts", F.lit(cap) - F.col("spent_before") >= job_cost)


def pick_attachments(files: DataFrame, key: str = "key", url: str = "url", pos: str = "pos", most: int = 12) -> DataFrame:
    """The files of each notice that promise most, the first first among equals."""
    scored = files.withColumn("score", file_score(F.col(url)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), pos))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most)


def last_n(df: DataFrame, group: str, at: str, tie: str, n: int) -> DataFrame:
    """The last n rows of each group by time."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col(at).desc(), F.col(tie).desc()))
    return df.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")
