"""Inputs composed from typed columns, in SQL that Spark and the oracle's engine both read, so that
what is planted in a text is known from the columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")
AS_OF = "2016-06-30"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Where the session is one machine, whose small files give a task or two, its rows are dealt
    to the cores, as what is composed from them costs far more to work on than to move; a cluster
    reads its splits as they are."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return table.repartition(spark.sparkContext.defaultParallelism) if spark.sparkContext.master.startswith("local[") else table


def compose(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of composed SQL; tables stand in it as {name}."""
    used = {t for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in used})


def oracle(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


_MONTHS = "'January,February,March,April,May,June,July,August,September,October,November,December'"


def _iso(d: str) -> str:
    """A date of the tables, twenty years on (so leap days stay), in ISO form."""
    return f"(cast(year({d}) + 20 as string) || '-' || lpad(cast(month({d}) as string), 2, '0') || '-' || lpad(cast(day({d}) as string), 2, '0'))"


#: Orders with their date in several forms.
DATED = f"""
SELECT o_orderkey AS id, o_custkey AS cust, o_totalprice AS price, o_orderstatus AS st, cast(o_orderkey % 6 as int) AS form,
       {_iso("cast(o_orderdate as date)")} AS iso, {_iso("(cast(o_orderdate as date) + 90)")} AS later, {_iso("(cast(o_orderdate as date) + 10)")} AS visit,
       year(o_orderdate) + 20 AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, split_part({_MONTHS}, ',', cast(month(o_orderdate) as int)) AS mon
FROM {{orders}}
"""

#: One notice text per order; how its deadline is written depends on the form.
NOTICES = f"""
SELECT *, CASE form
  WHEN 0 THEN 'Closing date: ' || cast(d as string) || ' ' || mon || ' ' || cast(y as string) || '. Delivery by ' || later || '.'
  WHEN 1 THEN 'Bids due ' || cast(m as string) || '/' || cast(d as string) || '/' || cast(y as string) || ' at noon.'
  WHEN 2 THEN 'A site visit is on ' || visit || '. Bids are due ' || mon || ' ' || cast(d as string) || ', ' || cast(y as string) || ' at 1500 hrs.'
  WHEN 3 THEN 'Offers due date: ' || cast(d as string) || '-' || substr(mon, 1, 3) || '-' || substr(cast(y as string), 3, 2) || '.'
  WHEN 4 THEN 'Prices shall remain valid until ' || later || ' only.'
  ELSE 'No day is printed in this notice.' END AS text
FROM ({DATED}) AS dated
"""

#: What a reader claims about each notice: mostly true, some dates made up, some quotes.
CLAIMS = f"""
SELECT *, CASE WHEN id % 7 = 3 THEN '2031-01-01' WHEN id % 7 = 4 AND form = 0 THEN later WHEN form IN (4, 5) THEN '' ELSE iso END AS closing,
       CASE WHEN id % 5 = 0 THEN '' WHEN id % 5 = 1 THEN 'The offers close on a day that nobody knows.' ELSE text END AS closing_quote,
       CASE WHEN form = 2 THEN visit ELSE '' END AS posted, '' AS posted_quote, '' AS qa_due, '' AS qa_quote
FROM ({NOTICES}) AS notices
"""

#: Register rows, a first copy of every order and a second of those with an even key.
COPIES = f"""
SELECT id, shard, 'https://example.usembassy.gov/n/' || cast(id as string) AS link,
       CASE WHEN shard = 1 THEN 'RFQ ' ELSE '' END || '19AB' || lpad(cast(id as string), 7, '0') || 'Q' AS sol,
       'Notice ' || cast(id as string) AS title,
       CASE (id + shard) % 5 WHEN 0 THEN 'BID' WHEN 1 THEN 'MID' WHEN 2 THEN 'NO' WHEN 3 THEN 'REVIEW' ELSE 'BID' END AS tier,
       CASE WHEN (id + 2 * shard) % 4 = 0 THEN '' ELSE iso END AS deadline,
       (id + shard) % 6 = 0 AS archived,
       CASE WHEN (id + shard) % 6 = 0 THEN 'Cancelled' ELSE 'Active' END AS status,
       '2016-05-' || lpad(cast(1 + (id * 7 + shard * 3) % 28 as string), 2, '0') AS updated,
       CASE WHEN (id + shard) % 3 = 0 THEN '2016-05-' || lpad(cast(1 + (id * 5 + shard * 11) % 28 as string), 2, '0') || ' 10:00 UTC' ELSE '' END AS lastDeepScan,
       CASE WHEN (id + shard) % 2 = 0 THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS verified,
       (id + shard) % 3 <> 1 AS proven, cast(id % 4 + shard as int) AS n_files, cast((id + shard) % 3 as int) AS n_restrictions,
       CASE WHEN shard = 0 THEN 'SITE' ELSE 'SAM' END AS source, cast((id + shard) % 4 as int) AS tries,
       CASE WHEN (id + shard) % 5 = 0 THEN 'about 5' ELSE '' END AS value
FROM (SELECT id, iso, 0 AS shard FROM ({DATED}) AS a UNION ALL SELECT id, iso, 1 AS shard FROM ({DATED}) AS b WHERE id % 2 = 0) AS both_copies
"""
