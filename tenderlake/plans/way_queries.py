"""Notices on their way and operators' actions as logs of events, in one batch and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared_dir
from ..operators import ways
from ..streaming import decision_stream, way_stream
from .composed import AS_OF, DATED, compose, oracle
from .register_queries import ORACLES as REGISTER_ORACLES
from .register_queries import operator_rows, overlaid

OVERLAID = REGISTER_ORACLES["operator_overlay"]

#: For each order the answers to its steps: some twice, some too early, readers in trouble up to four times.
EVENTS = f"""
SELECT cast(id as string) AS key, 1450000000000 + cast(CASE WHEN n = 3 AND id % 6 = 5 THEN 50 ELSE n * 100 END + id % 10 as bigint) AS said_at, step, cast(CASE WHEN id % 8 = 0 THEN 20 ELSE 500 END as int) AS chars,
       id % 9 = 0 AS known, id % 10 <> 0 AS is_solicitation, CASE WHEN (n = 1 AND id % 11 = 0) OR (n = 2 AND id % 12 = 5) THEN 'closed' ELSE 'open' END AS status,
       CASE WHEN n = 1 AND id % 3 = 0 THEN iso WHEN n = 2 AND id % 3 = 1 THEN later WHEN n = 8 THEN iso ELSE '' END AS closing,
       CASE WHEN n < 3 THEN '' WHEN (id + n * n) % 5 < 3 THEN 'REVIEW' WHEN (id + n) % 4 = 0 THEN 'NO' WHEN (id + n) % 4 = 1 THEN 'MID' ELSE 'BID' END AS tier,
       CASE WHEN (id + n * n) % 5 = 0 THEN 'AI unavailable' WHEN (id + n * n) % 5 = 1 THEN 'the provider is cooling' ELSE 'low confidence' END AS reason, id % 7 <> 0 AS upheld
FROM ({DATED}) AS orders CROSS JOIN (VALUES (0, 'arrive'), (1, 'triage'), (2, 'dates'), (3, 'adjudicate'), (4, 'adjudicate'), (5, 'adjudicate'), (6, 'adjudicate'), (7, 'opinion'), (8, 'triage')) AS steps(n, step)
WHERE NOT (n = 7 AND id % 13 = 0)
"""
_SHOWN = ("key", "outcome", "tries", "closing", "tier", "said_at")


def notice_ways(spark: SparkSession, d: str) -> DataFrame:
    return ways.follow(compose(spark, d, EVENTS), AS_OF).select(*_SHOWN, "awaits")


#: What each order brings as a unit: some without a number, a usable title or any file; hashes recur.
UNITS = f"""
SELECT cast(id as string) AS key, 'u' || cast(id % 5000 as string) AS hash, CASE WHEN id % 3 = 0 THEN '' ELSE '19AB' || lpad(cast(id as string), 7, '0') || 'Q' END AS sol_hint,
       'https://example.usembassy.gov/n/' || cast(id as string) AS link, 'P' || cast(cust % 7 as string) AS post, 'C' AS country, 'USGOV' AS platform, '' AS agency, id % 2 = 0 AS domestic, 'Site' AS source,
       CASE WHEN id % 4 = 0 THEN 'Home' ELSE 'Menu' || chr(10) || 'Notice ' || cast(id as string) || ' of this year' END AS text, cast(id % 20 as int) AS n_files FROM ({DATED}) AS dated
"""


def _units(spark: SparkSession, d: str) -> DataFrame:
    files = F.when(F.col("n_files") > 0, F.transform(F.sequence(F.lit(1), F.col("n_files")), lambda i: F.concat("link", F.lit("/"), i.cast("string"))))
    return compose(spark, d, UNITS).withColumn("attachments", files)


def settled_ways(spark: SparkSession, d: str) -> DataFrame:
    """The register rows that the ended ways make."""
    rows = ways.register_rows(ways.follow(compose(spark, d, EVENTS), AS_OF), _units(spark, d), AS_OF)
    sizes = {"n_files": F.size("files").cast("bigint"), "n_all": F.col("fileCount").cast("bigint"), "n_notes": F.size("verifyNotes").cast("bigint")}
    return rows.select("key", "outcome", "sol", "title", "tier", "deadline", "status", "archived", "archivedOn", "noDate", F.col("needs").isNotNull().alias("needs"), "fp", "post", *[c.alias(n) for n, c in sizes.items()])


def finished_ways(spark: SparkSession, d: str) -> DataFrame:
    """The hashes that the done-ledger gets."""
    return ways.finished(ways.follow(compose(spark, d, EVENTS), AS_OF), _units(spark, d))


def landed(rows: DataFrame, name: str, n: int = 3) -> str:
    """A folder with the rows as JSON files, dealt by hash, so they arrive in no order of time."""
    folder = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.repartition(n, F.xxhash64(*rows.columns)).write.json(folder)
    return folder


def notice_ways_stream(spark: SparkSession, d: str) -> DataFrame:
    """The ways that have ended, by a stream that takes one file at a time."""
    folder = landed(compose(spark, d, EVENTS), "events")
    # An answer a day later, about nothing, moves the watermark past all of them.
    spark.range(1).select(F.lit("").alias("key"), F.lit(1_450_086_400_000).alias("said_at")).write.mode("append").json(folder)
    out = f"{shared_dir(spark)}/ways-{uuid.uuid4().hex}"
    events = spark.readStream.schema(ways.EVENT).option("maxFilesPerTrigger", 1).json(folder)
    with way_stream.state_store(spark):
        changes = way_stream.follow_stream(events, AS_OF).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state")
        changes.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(way_stream.CHANGE).parquet(out).where("what = 'ended'").select(*_SHOWN)


def operator_stream(spark: SparkSession, d: str) -> DataFrame:
    """The operators' log as a stream, a file at a time and in no order, laid over the register."""
    rows, log = operator_rows(spark, d)
    place = f"{shared_dir(spark)}/decisions-{uuid.uuid4().hex}"
    decision_stream.start(spark, landed(log, "actions"), place, f"{place}-state", parts=4, files_a_batch=1).awaitTermination()
    return overlaid(rows, decision_stream.decisions(spark, place))


_WAYS = f"""
WITH e AS (SELECT * FROM ({EVENTS})),
a AS (SELECT key, min(said_at) AS said_at, bool_or(chars < 180) AS thin, bool_or(known) AS dup FROM e WHERE step = 'arrive' GROUP BY key),
b AS (SELECT a.key, min(e.said_at) AS said_at FROM a JOIN e ON e.key = a.key AND step = 'triage' AND e.said_at >= a.said_at AND NOT thin AND NOT dup GROUP BY a.key),
t AS (SELECT b.*, CASE WHEN NOT is_solicitation THEN 'not_solicitation' WHEN status = 'closed' OR (closing <> '' AND closing < '{AS_OF}') THEN 'expired' END AS ends, nullif(closing, '') AS closing
      FROM b JOIN e ON e.key = b.key AND e.said_at = b.said_at AND step = 'triage'),
c AS (SELECT t.key, min(e.said_at) AS said_at FROM t JOIN e ON e.key = t.key AND step = 'dates' AND e.said_at >= t.said_at AND ends IS NULL AND t.closing IS NULL GROUP BY t.key),
u AS (SELECT c.*, CASE WHEN status = 'closed' OR (closing <> '' AND closing < '{AS_OF}') THEN 'expired' WHEN closing = '' THEN 'no_date' END AS ends, nullif(closing, '') AS closing
      FROM c JOIN e ON e.key = c.key AND e.said_at = c.said_at AND step = 'dates'),
r AS (SELECT key, said_at, closing FROM t WHERE ends IS NULL AND closing IS NOT NULL UNION ALL SELECT key, said_at, closing FROM u WHERE ends IS NULL),
j AS (SELECT r.key, r.closing, e.said_at, tier, tier = 'REVIEW' AND (starts_with(lower(reason), 'ai') OR regexp_matches(lower(reason), 'provider|quota|cooling')) AS trouble,
             row_number() OVER (PARTITION BY r.key ORDER BY e.said_at) AS k FROM r JOIN e ON e.key = r.key AND step = 'adjudicate' AND e.said_at >= r.said_at),
f AS (SELECT key, min(k) AS k FROM j WHERE NOT trouble GROUP BY key),
g AS (SELECT j.*, f.k AS first FROM j LEFT JOIN f ON f.key = j.key WHERE j.k <= least(coalesce(f.k, 3), 3)),
v AS (SELECT key, any_value(closing) AS closing, max(said_at) AS said_at, count(*) FILTER (WHERE trouble) AS tries, max(tier) FILTER (WHERE NOT trouble) AS tier FROM g GROUP BY key),
o AS (SELECT v.key, min(e.said_at) AS said_at FROM v JOIN e ON e.key = v.key AND step = 'opinion' AND e.said_at >= v.said_at AND v.tier = 'NO' GROUP BY v.key),
w AS (SELECT v.*, o.said_at AS opinion, e.upheld, e.tier AS other FROM v LEFT JOIN o ON o.key = v.key LEFT JOIN e ON e.key = o.key AND e.said_at = o.said_at AND step = 'opinion'),
x AS (
  SELECT key, CASE WHEN thin THEN 'thin' ELSE 'duplicate' END AS outcome, 0 AS tries, NULL AS closing, NULL AS tier, said_at, NULL AS awaits FROM a WHERE thin OR dup
  UNION ALL SELECT key, ends, 0, closing, NULL, said_at, NULL FROM t WHERE ends IS NOT NULL
  UNION ALL SELECT key, ends, 0, closing, NULL, said_at, NULL FROM u WHERE ends IS NOT NULL
  UNION ALL SELECT key, CASE WHEN tries = 3 THEN 'given_up' WHEN tier = 'NO' AND opinion IS NULL THEN NULL WHEN tier IS NOT NULL THEN 'complete' END, tries, closing,
    CASE WHEN opinion IS NOT NULL AND NOT upheld THEN CASE WHEN other IN ('BID', 'MID', 'REVIEW') THEN other ELSE 'MID' END ELSE tier END, coalesce(opinion, said_at),
    CASE WHEN tries = 3 THEN NULL WHEN tier IS NULL THEN 'adjudicate' WHEN tier = 'NO' AND opinion IS NULL THEN 'opinion' END FROM w)
"""
ORACLES = {
    "notice_ways": oracle(f"{_WAYS} SELECT key, outcome, tries::INT AS tries, closing, tier, said_at, awaits FROM x"),
    "notice_ways_stream": oracle(f"{_WAYS} SELECT key, outcome, tries::INT AS tries, closing, tier, said_at FROM x WHERE outcome IS NOT NULL"),
    "operator_stream": OVERLAID,
    "settled_ways": oracle(f"""{_WAYS}, made AS (
  SELECT x.key, outcome, sol_hint AS sol, CASE WHEN text <> 'Home' THEN substr(text, 6) WHEN sol_hint <> '' THEN sol_hint WHEN outcome = 'expired' THEN '(an expired notice)' WHEN outcome = 'no_date' THEN '(a notice without a date)' ELSE '(untitled)' END AS title,
    CASE outcome WHEN 'expired' THEN '' WHEN 'no_date' THEN 'REVIEW' ELSE tier END AS tier, CASE WHEN outcome <> 'no_date' THEN closing END AS deadline,
    CASE outcome WHEN 'expired' THEN 'Expired' WHEN 'no_date' THEN 'Check' ELSE 'Active' END AS status, outcome = 'expired' AS archived, CASE WHEN outcome = 'expired' THEN '{AS_OF}' END AS "archivedOn",
    outcome = 'no_date' AS "noDate", outcome = 'no_date' AS needs, link, post, least(n_files, 15)::BIGINT AS n_files, n_files::BIGINT AS n_all, CASE WHEN outcome = 'complete' THEN 0 ELSE 2 END::BIGINT AS n_notes
  FROM x JOIN ({UNITS}) u ON u.key = x.key WHERE outcome IN ('expired', 'no_date', 'complete'))
SELECT * EXCLUDE (link), substr(sha256(sol || '|' || title || '|' || coalesce(deadline, '') || '|' || status || '||' || link), 1, 16) AS fp FROM made"""),
    "finished_ways": oracle(f"""{_WAYS} SELECT DISTINCT hash FROM x JOIN ({UNITS}) u ON u.key = x.key WHERE outcome IN ('duplicate', 'not_solicitation', 'expired', 'no_date', 'complete')"""),
}

QUERIES = {f.__name__: f for f in (notice_ways, notice_ways_stream, operator_stream, settled_ways, finished_ways)}
