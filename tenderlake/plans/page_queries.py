"""Queries over the ways to a notice: links followed, listings, searches, caps, texts for readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import estimate, units, verdicts
from .composed import DATED, compose, oracle, read
from .text_queries import _HOST, _LINKS, HINTS


def chased_links(spark, d: str) -> DataFrame:
    """Parts as pages: each links to three others, some of them documents on another host, some named
    as tenders."""
    base = read(spark, d, "part").select("p_partkey")
    n = base.count()
    page = lambda c: F.concat(F.lit("https://h"), (c % 7).cast("string"), F.lit(".example.com/p/"), c.cast("string"))
    to = F.col("to")
    href = F.when(to % 5 == 0, F.concat(F.lit("https://files.example.org/"), to, F.lit(".PDF?v=1"))).otherwise(F.concat(page(to), F.lit("#top")))
    links = base.select("p_partkey", F.explode(F.array(*[(F.col("p_partkey") * k + 7) % n for k in (1, 8, 2)])).alias("to"))
    links = links.select(page(F.col("p_partkey")).alias("url"), href.alias("href"), F.when(to % 5 == 1, "The Tender").otherwise("more").alias("anchor"))
    return units.chase(links).groupBy("hop", "document").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("n_urls"))


def portal_redirects(spark, d: str) -> DataFrame:
    """Each host as a root from which its pages were reached; every third page names a notice."""
    link = F.concat(F.lit('<a href="HTTPS://www.SAM.gov/opp/00ab'), F.lpad(F.col("page_id").cast("string"), 6, "0"), F.lit('/view">here</a>'))
    pages = read(spark, d, "pages").select("page_id", "url", F.when(F.col("page_id") % 3 == 0, F.concat("html", link)).otherwise(F.col("html")).alias("html"))
    reached = pages.select(text.host(F.col("url")).alias("root"), "url", (F.col("page_id") % 4).alias("hop"))
    return units.redirects(reached, pages)


def listed_links(spark, d: str) -> DataFrame:
    links = units.links(read(spark, d, "pages").select("url", "html"))
    return units.listed_notices(links, HINTS, 5).select("url", "href", "title", F.col("rank").cast("bigint").alias("rank"))


def search_turns(spark, d: str) -> DataFrame:
    """Orders as landed notices, searched in turn by the first shard, the second, and at a wrong hour."""
    kind = F.element_at(F.array(*[F.lit(k) for k in "okrs"]), (F.col("id") % 4 + 1).cast("int"))
    notices = compose(spark, d, DATED).select("id", kind.alias("ptype"), F.when(F.col("id") % 3 == 0, "US").otherwise("IN").alias("country_code"))
    turns = [units.search_turn(notices, hour, shard, "id").select(F.lit(hour).alias("hour"), F.lit(shard).alias("shard"), "id") for hour, shard in ((14, 0), (14, 1), (3, 0))]
    return turns[0].unionByName(turns[1]).unionByName(turns[2]).groupBy("hour", "shard", "id").agg(F.count(F.lit(1)).alias("times"))


def capped_items(spark, d: str) -> DataFrame:
    """Lines of an order as its pages, cut to the second stage's number."""
    li = read(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"))
    out = units.within_cap(li, "l_orderkey", "pos", "pages", 1)
    return out.select("l_orderkey", "pos.l_linenumber", "pos.l_partkey", "pos.l_suppkey", F.col("rank").cast("bigint").alias("rank"))


def reader_bodies(spark, d: str) -> DataFrame:
    """What readers and estimators are given of each document."""
    t = verdicts.reader_texts(F.col("text"))
    digest = lambda c: F.sha2(c, 256)
    docs = read(spark, d, "documents").select("doc_id", t.alias("t"), estimate.estimator_body(F.col("text")).alias("e"))
    return docs.select("doc_id", digest(F.col("t.body")).alias("body"), digest(F.col("t.evidence")).alias("evidence"), digest(F.col("t.shown")).alias("shown"), "t.readable", digest(F.col("e")).alias("estimator"))


def loose_file_counts(spark, d: str) -> DataFrame:
    """Files of a few references, counted per reference without gathering their texts."""
    li = read(spark, d, "lineitem")
    ref = F.col("l_suppkey") % 50 + 1000
    body = F.when(F.col("l_linenumber") == 2, "short").otherwise(F.concat(F.lit("Terms for RFQ-"), ref, F.lit(" "), F.repeat(F.lit("word "), 30)))
    files = li.select(F.concat(F.lit("https://x.example/f/RFQ-"), ref, F.lit("_"), F.col("l_linenumber"), F.lit(".pdf")).alias("url"), body.alias("text"), F.lit("").alias("note"), F.col("l_linenumber").alias("pos"))
    out = units.file_counts(units.file_rows(files))
    return out.select("key", F.coalesce("sol", F.lit("")).alias("sol"), F.col("ok").cast("bigint").alias("ok"), F.col("fail").cast("bigint").alias("fail"), F.col("n_text").cast("bigint").alias("n_text"))


_STRIPPED = f"""regexp_replace(regexp_replace(regexp_replace(text, '(?im)^(?:\\s*{text.CHROME_LINE}\\s*)$', '', 'g'), '{text.CHROME_PHRASE}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"""
_SQUEEZED = r"regexp_replace({}, '[ \t\n\v\f\r]+', ' ', 'g')"
_SOCIAL = ", ".join(f"'{w}'" for w in units.LISTING_SOCIAL)

ORACLES = {
    "chased_links": """
WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS a, (p_partkey * k + 7) % (SELECT count(*) FROM part) AS b FROM part, (VALUES (1), (8), (2)) t(k)),
h AS (SELECT 'p' || a AS a, CASE WHEN b % 5 = 0 THEN 'd' ELSE 'p' END || b AS b FROM e WHERE b % 5 = 0 OR (b % 5 = 1 AND a % 7 = b % 7)),
r(root, node, hop) AS (SELECT DISTINCT a, a, 0 FROM h UNION SELECT root, b, hop + 1 FROM r JOIN h ON node = a WHERE hop < 3),
s AS (SELECT root, node, min(hop) AS hop FROM r GROUP BY root, node)
SELECT hop, node LIKE 'd%' AS document, count(*) AS n, count(DISTINCT node) AS n_urls FROM s GROUP BY ALL""",
    "portal_redirects": f"""
WITH p AS (SELECT page_id, url, {_HOST.format("url")} AS root, page_id % 4 AS hop FROM pages), n AS (SELECT url, '00ab' || lpad(page_id::VARCHAR, 6, '0') AS notice_id FROM pages WHERE page_id % 3 = 0)
SELECT root, notice_id FROM (SELECT root, notice_id, row_number() OVER (PARTITION BY root ORDER BY hop, p.url, notice_id) AS r FROM p JOIN n ON p.url = n.url) WHERE r = 1""",
    "listed_links": f"""
WITH l AS ({_LINKS}), f AS (SELECT url, regexp_replace(href, '#.*$', '') AS href, pos, anchor FROM l WHERE len(list_filter([{", ".join(f"'{w}'" for w in HINTS)}], lambda w: contains(lower(href || ' ' || anchor), w))) > 0
  AND len(list_filter([{_SOCIAL}], lambda w: contains(lower(href || ' ' || anchor), w))) = 0),
g AS (SELECT url, href, min(pos) AS pos, arg_min(anchor, pos) AS anchor FROM f GROUP BY url, href)
SELECT url, href, substr(trim(anchor), 1, 180) AS title, rank FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) AS rank FROM g) WHERE rank <= 5""",
    "search_turns": oracle(f"""
WITH o AS (SELECT id FROM ({DATED}) WHERE id % 4 < 3), t AS (SELECT * FROM (SELECT id FROM o ORDER BY id LIMIT 60) UNION ALL SELECT * FROM (SELECT id FROM o WHERE id % 3 = 0 ORDER BY id LIMIT 60))
SELECT 14 AS hour, 0 AS shard, id, count(*) AS times FROM t GROUP BY id"""),
    "capped_items": """
SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem) WHERE rank <= 4""",
    "reader_bodies": f"""
WITH t AS (SELECT doc_id, {_SQUEEZED.format(_STRIPPED)} AS w, substr({_SQUEEZED.format("substr(text, 1, 12000)")}, 1, 9000) AS e FROM documents)
SELECT doc_id, sha256(substr(w, 1, 18000)) AS body, sha256(substr(w, 1, 1500)) AS evidence, sha256(substr(w, 1, 600)) AS shown, length(w) >= 180 AS readable, sha256(e) AS estimator FROM t""",
    "loose_file_counts": """
WITH f AS (SELECT l_suppkey % 50 + 1000 AS ref, l_linenumber <> 2 AS ok, length('https://x.example/f/RFQ-1000_' || l_linenumber || '.pdf') + 169 + 16 AS n FROM lineitem),
k AS (SELECT CASE WHEN ok THEN 'RFQ-' ELSE 'RFQ' END || ref AS key, ok, n FROM f)
SELECT key, key AS sol, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS fail, coalesce(sum(n + 2) FILTER (WHERE ok) - 2, 0)::BIGINT AS n_text FROM k GROUP BY key""",
}

QUERIES = {f.__name__: f for f in (chased_links, portal_redirects, listed_links, search_turns, capped_items, reader_bodies, loose_file_counts)}
