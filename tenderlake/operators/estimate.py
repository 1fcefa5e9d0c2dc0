"""Value ranges: which rows get one, and which answers are accepted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import money, or_empty

LEAST_BASIS, LEAST_CONFIDENCE = 25, 0.35
GIVEN_TEXT, READ_TEXT = 12000, 9000


def wants_estimate() -> Column:
    """a verified, open row that one can bid on and that states no value."""
    verified = (F.col("verified") == "VERIFIED") & F.col("tier").isin("BID", "MID")
    return F.coalesce(verified & ~F.coalesce(F.col("archived"), F.lit(False)) & ~or_empty(F.col("value")).rlike(r"\d"), F.lit(False))


def accepted(low: Column, likely: Column, high: Column, basis: Column, confidence: Column, least_confidence: float = LEAST_CONFIDENCE) -> Column:
    """an answer as a coherent range (low, likely, high, display, basis, confidence), NULL if it
    gives no reasons, no positive value or too little confidence."""
    clear = lambda c: F.greatest(F.coalesce(c.try_cast("double"), F.lit(0.0)), F.lit(0.0))
    values = F.array_sort(F.filter(F.array(clear(low), clear(likely), clear(high)), lambda x: x > 0))
    first, last = F.get(values, 0), F.get(values, F.size(values) - 1)
    mid = F.when((clear(likely) > 0) & clear(likely).between(first, last), clear(likely)).otherwise(F.get(values, F.floor(F.size(values) / 2).cast("int")))
    sure = F.least(F.lit(1.0), clear(confidence))
    display = F.when(last > first, F.concat(money(first), F.lit(" – "), money(last))).otherwise(money(mid))
    good = (F.length(F.trim(or_empty(basis))) >= LEAST_BASIS) & (F.size(values) > 0) & (sure >= least_confidence)
    out = F.struct(first.alias("low"), mid.alias("likely"), last.alias("high"), display.alias("display"), F.substring(F.trim(basis), 1, 700).alias("basis"), F.round(sure, 2).alias("confidence"))
    return F.when(good, out)


def estimator_body(text: Column) -> Column:
    """What an estimator reads of a text."""
    return F.substring(F.regexp_replace(F.substring(or_empty(text), 1, GIVEN_TEXT), r"[ \t\n\x0B\f\r]+", " "), 1, READ_TEXT)
