"""Queries over work queues: attachments, shards, rotation, repair, budget, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import queue, register
from .composed import COPIES, compose, oracle, read
from .register_queries import as_register

_NAMES = ("scope_of_work.pdf", "logo.png", "photo-annex.jpg", "pricing.xlsx", "readme.txt", "site map.pdf", "terms.docx")


def attachment_topk(spark, d: str) -> DataFrame:
    """The two most promising files of each order: its lines as files."""
    li = read(spark, d, "lineitem")
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("l_partkey") % 7 + 1).cast("int"))
    pos = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    files = li.select(F.col("l_orderkey").alias("key"), F.concat(F.lit("https://x/"), name).alias("url"), pos.alias("pos"))
    return queue.pick_attachments(files, most=2).select("key", "url", F.col("score").cast("bigint").alias("score"), F.col("rank").cast("bigint").alias("rank"))


def shard_assignment(spark, d: str) -> DataFrame:
    o = queue.ranked(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()])
    return queue.shard(o, 4).select("o_orderkey", F.col("rank").cast("bigint").alias("rank"), F.col("shard").cast("bigint").alias("shard"))


def rotation_order(spark, d: str) -> DataFrame:
    return queue.rotated(read(spark, d, "nation"), 7, 25, "n_nationkey").select("n_nationkey", F.col("turn").cast("bigint").alias("turn"))


def sampled_roots(spark, d: str) -> DataFrame:
    return queue.sampled(read(spark, d, "supplier").select("s_suppkey"), 100, 12, "s_suppkey")


def repair_queue(spark, d: str) -> DataFrame:
    rows = register.with_key(as_register(compose(spark, d, COPIES).where("shard = 0")).drop("shard")).withColumn("datesVerified", F.col("id") % 3 == 0)
    return queue.shard(queue.repair_queue(rows), 3).select("key", F.col("score").cast("bigint").alias("score"), F.col("rank").cast("bigint").alias("rank"), F.col("shard").cast("bigint").alias("shard"))


def budget_admission(spark, d: str) -> DataFrame:
    jobs = read(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 7 + 1).alias("cost"))
    return queue.admitted(jobs, "user_id", "event_id", "cost", 100).groupBy("user_id").agg(F.count_if("starts").alias("started"), F.sum(F.when(F.col("starts"), F.col("cost"))).alias("spent"))


def decisions_last_n(spark, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "event_id", F.date_trunc("hour", "ts").alias("at"))
    return queue.last_n(e, "user_id", "at", "event_id", 24).select("user_id", "event_id")


def unfinished_jobs(spark, d: str) -> DataFrame:
    rows = as_register(compose(spark, d, COPIES)).drop("shard")
    return rows.groupBy("tier").agg(F.count_if(queue.repairable()).alias("unfinished"), F.count(F.lit(1)).alias("n"))


def documents_by_kind(spark, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    name = F.element_at(F.array(*[F.lit(n) for n in (*_NAMES, "index.html", "page.aspx?a=b", "data")]), (F.col("l_partkey") % 10 + 1).cast("int"))
    kind = F.when(F.col("l_suppkey") % 3 == 0, "application/pdf").when(F.col("l_suppkey") % 3 == 1, "text/html; charset=utf-8").otherwise("")
    return li.groupBy(name.alias("name"), kind.alias("type"), text.is_document(name, kind).alias("document")).agg(F.count(F.lit(1)).alias("n"))


_SUSPECT_NO = "tier = 'NO'"
_SUSPECT_DATE = "(deadline <> '' AND NOT proven)"
_REPAIRABLE = f"(NOT archived AND ({_SUSPECT_NO} OR {_SUSPECT_DATE} OR (verified <> 'VERIFIED' AND tries < 3)))"

ORACLES = {
    "attachment_topk": f"""
WITH f AS (SELECT l_orderkey AS key, l_linenumber, l_partkey, l_suppkey, [{", ".join(f"'{n}'" for n in _NAMES)}][l_partkey % 7 + 1] AS name, [13, -28, -18, 12, 0, -17, 13][l_partkey % 7 + 1] AS score FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, l_linenumber, l_partkey, l_suppkey) AS rank FROM f)
SELECT key, 'https://x/' || name AS url, score::BIGINT AS score, rank FROM r WHERE rank <= 2""",
    "shard_assignment": "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank, (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) % 4 AS shard FROM orders",
    "rotation_order": "SELECT n_nationkey, ((n_nationkey - 7 + 25) % 25)::BIGINT AS turn FROM nation",
    "sampled_roots": "SELECT s_suppkey FROM supplier WHERE s_suppkey % 8 = 0 AND s_suppkey < 96",
    "repair_queue": oracle(f"""
WITH r AS (SELECT '19AB' || lpad(cast(id as varchar), 7, '0') || 'Q' AS key, CASE WHEN {_SUSPECT_NO} THEN 200 ELSE 0 END + CASE WHEN id % 3 <> 0 AND deadline <> '' THEN 150 ELSE 0 END + CASE WHEN {_SUSPECT_DATE} THEN 180 ELSE 0 END
  + CASE WHEN verified <> 'VERIFIED' OR tier = 'REVIEW' THEN 40 ELSE 0 END - 12 * tries AS score FROM ({COPIES}) WHERE shard = 0 AND {_REPAIRABLE})
SELECT key, score::BIGINT AS score, row_number() OVER (ORDER BY score DESC, key) - 1 AS rank, (row_number() OVER (ORDER BY score DESC, key) - 1) % 3 AS shard FROM r"""),
    "budget_admission": """
WITH j AS (SELECT user_id, event_id % 7 + 1 AS cost, coalesce(sum(event_id % 7 + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events)
SELECT user_id, count(*) FILTER (WHERE 100 - before >= 6) AS started, sum(cost) FILTER (WHERE 100 - before >= 6)::BIGINT AS spent FROM j GROUP BY user_id""",
    "decisions_last_n": """
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('hour', ts) DESC, event_id DESC) AS rank FROM events) WHERE rank <= 24""",
    "unfinished_jobs": oracle(f"SELECT tier, count(*) FILTER (WHERE {_REPAIRABLE}) AS unfinished, count(*) AS n FROM ({COPIES}) GROUP BY tier"),
    "documents_by_kind": f"""
WITH f AS (SELECT [{", ".join(f"'{n}'" for n in (*_NAMES, "index.html", "page.aspx?a=b", "data"))}][l_partkey % 10 + 1] AS name, l_partkey % 10 AS p, CASE l_suppkey % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/html; charset=utf-8' ELSE '' END AS type, l_suppkey % 3 AS s FROM lineitem)
SELECT name, type, p NOT IN (7, 8) AND s <> 1 AND (p IN (0, 3, 4, 5, 6) OR s = 0) AS document, count(*) AS n FROM f GROUP BY ALL""",
}

QUERIES = {f.__name__: f for f in (attachment_topk, shard_assignment, rotation_order, sampled_roots, repair_queue, budget_admission, decisions_last_n, unfinished_jobs, documents_by_kind)}
