"""Roll-ups over workers' statuses, spend and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import leading_int, or_empty

COUNTERS = (
    "found", "queued", "aiCalls", "aiBudget", "completed", "repaired", "notSolicitation", "skippedExpired", "skippedDuplicate",
    "noDateFound", "abandoned", "stillUnfinished", "samCalls",
)
#: Price of a million tokens in and out, by a word in the model's name; in this order.
RATES = (("haiku", "1.00", "5.00"), ("sonnet", "3.00", "15.00"), ("opus", "15.00", "75.00"))


def rate(model: Column, side: int, override: dict[str, tuple[str, str]] | None = None) -> Column:
    """The rate of a model: by its exact name, else by the first word found in it, else the first."""
    low = F.lower(or_empty(model))
    out = None
    for name, pair in (override or {}).items():
        cond = model == name
        out = F.when(cond, F.lit(pair[side]).cast("decimal(12,4)")) if out is None else out.when(cond, F.lit(pair[side]).cast("decimal(12,4)"))
    for word, *pair in RATES:
        cond = F.contains(low, F.lit(word))
        out = F.when(cond, F.lit(pair[side]).cast("decimal(12,4)")) if out is None else out.when(cond, F.lit(pair[side]).cast("decimal(12,4)"))
    return out.otherwise(F.lit(RATES[0][1 + side]).cast("decimal(12,4)"))


def cost(model: Column, tokens_in: Column, tokens_out: Column, override: dict | None = None) -> Column:
    """A10: dollars of so many tokens, in decimals."""
    million = F.lit("1000000").cast("decimal(12,0)")
    part = lambda n, side: n.cast("decimal(20,0)") * rate(model, side, override) / million
    return part(tokens_in, 0) + part(tokens_out, 1)


def status_rollup(statuses: DataFrame, counters: tuple[str, ...] = COUNTERS) -> DataFrame:
    """One row: counters summed however they were written, first start, last heartbeat, the
    first non-empty word of each kind by worker."""
    first = lambda c, ok=None: F.min_by(c, F.when((or_empty(F.col(c)) != "") & (ok if ok is not None else F.lit(True)), F.col("shard"))).alias(c)
    words = [first(c) for c in ("lastError", "docCaps", "model", "keyVar", "down") if c in statuses.columns]
    if "samDiag" in statuses.columns:
        words.append(F.coalesce(first("samDiag", ~F.contains("samDiag", F.lit("not queried"))), F.lit("not queried")).alias("samDiag"))
    return statuses.agg(
        F.count(F.lit(1)).alias("bots"), F.min("startedAt").alias("startedAt"), F.max("heartbeat").alias("heartbeat"),
        *[F.sum(leading_int(F.col(c).cast("string"))).alias(c) for c in counters if c in statuses.columns], *words,
    )


def set_union(df: DataFrame, column: str) -> DataFrame:
    """A5: the distinct elements of an array column, one per row."""
    return df.select(F.explode(column).alias(column)).distinct()


def map_last(df: DataFrame, column: str, order: str = "shard") -> DataFrame:
    """(key, value) of a map column over all rows; of a key that several hold, the last counts."""
    return df.select(order, F.explode(column).alias("key", "value")).groupBy("key").agg(F.max_by("value", order).alias("value"))


def map_sum(df: DataFrame, column: str) -> DataFrame:
    """(key, value) of a map column over all rows, summed."""
    return df.select(F.explode(column).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("value"))


def spend_by_model(usage: DataFrame, override: dict | None = None) -> DataFrame:
    """Tokens, calls and dollars by model."""
    g = usage.groupBy("model").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("calls").alias("calls"))
    return g.withColumn("usd", F.round(cost(F.col("model"), F.col("tokens_in"), F.col("tokens_out"), override), 4))


def spend_total(by_model: DataFrame, deposit: str = "40") -> DataFrame:
    """Totals, and what is left of the deposit."""
    t = by_model.agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("calls").alias("calls"), F.sum(cost(F.col("model"), F.col("tokens_in"), F.col("tokens_out"))).alias("spent"))
    left = F.greatest(F.lit(0).cast("decimal(12,4)"), F.lit(deposit).cast("decimal(12,4)") - F.round("spent", 4))
    return t.select("tokens_in", "tokens_out", "calls", F.round("spent", 4).alias("spent_usd"), F.round(left, 4).alias("left_usd"))


def evaluate_readers(df: DataFrame) -> DataFrame:
    """How often a reader found a deadline, how, and how often the phrase rule says otherwise.
    Reads deadline, how, rule and printed (array of dates)."""
    found = or_empty(F.col("deadline")) != ""
    return df.agg(
        F.count(F.lit(1)).alias("notices"), F.count_if(found).alias("resolved"), F.round(100 * F.count_if(found) / F.greatest(F.count(F.lit(1)), F.lit(1)), 1).alias("resolved_pct"),
        F.count_if(~found & (F.size("printed") > 0)).alias("dates_but_none"), F.count_if(found & (or_empty(F.col("rule")) != "") & (F.col("rule") != F.col("deadline"))).alias("rule_differs"),
        F.count_if(F.col("how") == "quoted").alias("by_quote"), F.count_if(F.col("how") == "phrase").alias("by_phrase"),
    )


def access_probe(df: DataFrame) -> DataFrame:
    """Answers of sites by identity and kind of code."""
    kind = F.when(F.col("code").between(200, 299), "ok").when(F.col("code").isin(401, 403, 429), "forbidden").otherwise("other")
    return df.withColumn("kind", kind).groupBy("identity").pivot("kind", ["ok", "forbidden", "other"]).count().na.fill(0)


def count_by(df: DataFrame, column: str) -> DataFrame:
    """A15."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
