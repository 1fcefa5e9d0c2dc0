"""Queries over pages, documents and parts: text, links, hashes, classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity, text
from ..operators import register, units
from .composed import DATED, NOTICES, compose, oracle, read

#: Words of the tables' invented prose that stand in for signal phrases, so that scores differ.
HINTS = ("the", "and", "attion", "der", "sch", "que")


def html_to_text_len(spark, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.length(text.html_text(F.col("html"))).cast("bigint").alias("n_text"))


def page_links(spark, d: str) -> DataFrame:
    out = units.links(read(spark, d, "pages").select("page_id", "url", "html"))
    return out.select("page_id", F.col("pos").cast("bigint").alias("pos"), "href", "anchor")


def link_hosts_topk(spark, d: str) -> DataFrame:
    links = units.links(read(spark, d, "pages").select("url", "html"))
    return links.groupBy(text.host(F.col("href")).alias("host")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "host").limit(20)


def doc_unit_hash(spark, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", identity.unit_hash(F.col("text")).alias("unit_hash"))


def exact_dup_groups(spark, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", identity.unit_hash(F.col("text")).alias("unit_hash"))
    g = docs.groupBy("unit_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))
    return g.where("n > 1")


def ledger_antijoin(spark, d: str) -> DataFrame:
    """Units that the capped ledger of finished hashes doesn't hold."""
    docs = read(spark, d, "documents").select("doc_id", identity.unit_hash(F.col("text")).alias("hash"))
    ledger = register.cap_ledger(docs.where("doc_id % 3 = 0").select("hash").distinct())
    return register.without(docs, ledger, "hash").select("doc_id", "hash")


def keyword_score(spark, d: str) -> DataFrame:
    notices = compose(spark, d, NOTICES).withColumn("body", F.concat(F.lit("RFQ-"), F.col("id") + 100, F.lit(" Request for quotation. "), "text"))
    has_date = F.size(text.match_spans(F.col("text"), r"20\d\d")) > 0
    return notices.select("id", text.keyword_score(F.when(F.col("id") % 2 == 0, F.col("body")).otherwise(F.col("text")), has_date).cast("bigint").alias("score"))


def page_class(spark, d: str) -> DataFrame:
    pages = read(spark, d, "pages")
    n = F.col("page_id") % 4
    extra = (
        F.when(n == 0, " RFQ-1234 quotations are due, scope of work").when(n == 1, " RFQ-1234 and RFP-5678")
        .when(n == 2, " scope of work, quantity, delivery date").otherwise("")
    )
    body = F.concat(text.html_text(F.col("html")), extra)
    return pages.select("page_id", text.page_class(body, F.col("url")).alias("class"))


def sector_counts(spark, d: str) -> DataFrame:
    words = F.element_at(F.array(*[F.lit(x) for x in ("supply of goods", "cleaning services", "construction and renovation", "nothing")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    parts = read(spark, d, "part").select(text.sector(F.concat_ws(" ", "p_name", "p_type", words)).alias("sector"))
    return parts.groupBy("sector").agg(F.count(F.lit(1)).alias("n"))


def title_pick(spark, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.first_title(F.concat(F.lit("Skip to main content\nU.S. Embassy in X\nshort\n"), F.col("text"))).alias("title"))


def page_text_hash_classes(spark, d: str) -> DataFrame:
    """The first slice end to end: pages, text, hash, one of each, class, counts."""
    pages = read(spark, d, "pages").select("page_id", "url", text.html_text(F.col("html")).alias("text"))
    pages = pages.withColumn("hash", identity.unit_hash(F.col("text")))
    first = pages.groupBy("hash").agg(F.min(F.struct("page_id", "url", "text")).alias("p"))
    return first.groupBy(text.page_class(F.col("p.text"), F.col("p.url")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def procurement_pages(spark, d: str) -> DataFrame:
    links = units.links(read(spark, d, "pages").select("url", "html"))
    return units.procurement_pages(links, HINTS).select("url", "href", F.col("rank").cast("bigint").alias("rank"))


def bfs_three_hops(spark, d: str) -> DataFrame:
    """What is reached in three steps over links that parts make: each leads to three others."""
    base = read(spark, d, "part").select("p_partkey")
    url = lambda c: F.concat(F.lit("https://h"), (c % 7).cast("string"), F.lit(".example.com/p/"), c.cast("string"))
    n = base.count()
    links = base.select(url(F.col("p_partkey")).alias("url"), F.explode(F.array(*[(F.col("p_partkey") * k + 7) % n for k in (1, 8, 2)])).alias("to"))
    links = links.select("url", url(F.col("to")).alias("href"))
    return units.reach(links).groupBy("hop").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("n_urls"))


def blocked_minus_recovered(spark, d: str) -> DataFrame:
    """Hosts that were met over plain HTTP, but for those that any page was fetched from securely."""
    pages = read(spark, d, "pages").select("page_id", text.host(F.col("url")).alias("host"), F.col("url").startswith("https:").alias("secure"))
    first = register.first_per(pages.where(~F.col("secure")), "host", "page_id")
    return register.without(first, pages.where("secure").select("host").distinct(), "host").select("host", "page_id")


def snapshot_diff(spark, d: str) -> DataFrame:
    links = units.links(read(spark, d, "pages").select("page_id", "url", "html")).withColumn("url", text.host(F.col("url")))
    before, after = links.where("page_id % 2 = 0"), links.where("page_id % 2 = 1").select("url", "href").distinct()
    return units.snapshot_diff(before, after.withColumn("href", F.regexp_replace("href", "^https?://[^/]*", ""))).groupBy("url").agg(F.count(F.lit(1)).alias("n_new"))


def json_repair(spark, d: str) -> DataFrame:
    e = read(spark, d, "events")
    n = F.col("event_id") % 4
    raw = F.when(n == 0, F.col("props")).when(n == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(n == 2, F.concat(F.lit("Here it is: "), "props", F.lit(" as asked."))).otherwise("no object at all")
    body = text.json_body(raw)
    return e.select("event_id", F.coalesce(F.get_json_object(body, "$.k").cast("bigint"), F.lit(-1)).alias("k"), body.isNotNull().alias("parsed"))


def progress_log_parse(spark, d: str) -> DataFrame:
    e = read(spark, d, "events")
    line = F.format_string('[PROGRESS] post="%s" step="%s" post="P%s"', F.col("event_type"), F.col("event_id").cast("string"), (F.col("user_id") % 10).cast("string"))
    f = text.progress_fields(line)
    last = e.select("user_id", "event_id", f["post"].alias("post"), f["step"].alias("step"))
    return last.groupBy("user_id").agg(F.max_by("step", "event_id").alias("last_step"), F.count(F.lit(1)).alias("steps"), F.countDistinct("post").alias("visited"))


def block_kinds(spark, d: str) -> DataFrame:
    e = read(spark, d, "events")
    code = F.element_at(F.array(*[F.lit(x) for x in (401, 403, 429, 500, 200)]), (F.col("event_id") % 5 + 1).cast("int"))
    body = F.when(F.col("event_id") % 11 == 0, "Please sign in").when(F.col("event_id") % 13 == 0, "Checking your browser").otherwise("x")
    failure = text.api_failure(code, F.when(F.col("event_id") % 17 == 0, F.lit("Your credit balance is too low")).otherwise(F.lit("")))
    kinds = e.select(text.block_kind(code, F.lit(""), body).alias("kind"), failure["reason"].alias("reason"), failure["fatal"].alias("fatal"))
    return kinds.groupBy("kind", "reason", "fatal").agg(F.count(F.lit(1)).alias("n"))


def domestic_places(spark, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    n = F.col("c_custkey") % 6
    at = lambda *pairs: F.coalesce(*[F.when(n == k, F.lit(v)) for k, v in pairs])
    is_home = text.is_domestic(at((0, "India"), (1, "United States")), at((2, "USA")), at((3, "VA"), (0, "VA")), at((4, "22202-1")))
    return c.select("c_custkey", is_home.alias("domestic"))


def brief_line(spark, d: str) -> DataFrame:
    c = compose(spark, d, DATED)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Request for Quotations: ", "RFQ - ", "Tender for ", "")]), (F.col("id") % 4 + 1).cast("int"))
    title = F.concat(kind, F.lit("office  chairs "), F.col("id").cast("string"))
    items = F.when(F.col("id") % 3 == 0, F.array(F.lit("desk"), F.lit("lamp"), F.lit("mat")))
    post = F.when(F.col("id") % 2 == 0, F.lit("Lusaka"))
    return c.select("id", text.brief(post, title, F.when(F.col("id") % 5 != 0, F.col("iso")), items, F.lit(False)).alias("brief"))


def listing_split(spark, d: str) -> DataFrame:
    """One listing per customer: its orders as notices, cut apart again."""
    o = compose(spark, d, DATED)
    entry = F.concat(F.lit("Notice about things\nNumber RFQ-"), F.col("id") + 1000, F.lit(" wants goods. "), F.repeat(F.lit("words "), 40), F.lit("Closing "), "iso", F.lit("\n\n"))
    pages = o.groupBy("cust").agg(F.array_sort(F.collect_list(F.struct("id", entry.alias("e")))).alias("es"))
    pages = pages.select("cust", F.array_join(F.transform("es", lambda x: x["e"]), "").alias("text"))
    out = units.split_listing(pages)
    return out.select("cust", "sol", F.regexp_extract("block", r"Closing (\d{4}-\d{2}-\d{2})", 1).alias("closing"), F.size(text.references(F.col("block"))).cast("bigint").alias("n_refs"))


def file_units(spark, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    o = F.col("l_orderkey")
    long = F.concat(F.lit("Terms for RFQ-"), o + 1000, F.lit(" "), F.repeat(F.lit("word "), 30))
    body = F.when(o % 5 == 0, long).when(F.col("l_linenumber") == 2, "short").otherwise(F.repeat(F.lit("word "), 30))
    url = F.concat(F.lit("https://x.example/f/RFQ-"), o + 1000, F.lit("_part%20"), F.col("l_linenumber"), F.lit("_"), F.col("l_partkey"), F.lit("_"), F.col("l_suppkey"), F.lit(".pdf"))
    files = li.select(url.alias("url"), body.alias("text"), F.lit("").alias("note"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"))
    g = units.group_files(files)
    return g.select("key", F.col("ok").cast("bigint").alias("ok"), F.col("fail").cast("bigint").alias("fail"), F.size("files").cast("bigint").alias("n_files"), F.length("text").cast("bigint").alias("n_text"))


_HTML = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
_TEXT = rf"trim(regexp_replace({_HTML}, '[ \t\n\r]{{2,}}', ' ', 'g'))"
_TAG = r"""'(?is)<a\b[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>'"""
_LINKS = f"""
SELECT page_id, url, i - 1 AS pos,
       CASE WHEN h LIKE '/%' THEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') || h ELSE h END AS href,
       trim(regexp_replace(regexp_replace(anchors[i], '(?s)<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS anchor
FROM (SELECT *, trim(hrefs[i]) AS h FROM (SELECT *, unnest(generate_series(1, len(hrefs))) AS i FROM (
  SELECT page_id, url, regexp_extract_all(html, {_TAG}, 1) AS hrefs, regexp_extract_all(html, {_TAG}, 2) AS anchors FROM pages)))
"""
_HOST = "lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_HASH = r"substr(sha256(substr(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')), 1, 4000)), 1, 16)"
_UNIT = ", ".join(f"'{w}'" for w in text.UNIT_SIGNALS)
_NOISE = ", ".join(f"'{w}'" for w in text.NOISE_MARKERS)
_INDEX = ", ".join(f"'{w}'" for w in text.INDEX_WORDS)
_SIGNALS = ", ".join(f"'{w}'" for w in text.SIGNALS)
_REF = "'" + text.REFERENCE.replace("'", "''") + "'"


def _class(body: str, url: str) -> str:
    n = f"len(list_distinct(list_transform(regexp_extract_all({body}, {_REF}, 1), lambda x: replace(upper(x), ' ', ''))))"
    s = f"len(list_filter([{_UNIT}], lambda w: contains(lower({body}), w)))"
    i = f"len(list_filter([{_INDEX}], lambda w: contains(lower({url}), w))) > 0"
    noise = f"len(list_filter([{_NOISE}], lambda w: contains(lower({body}), w))) > 0"
    return f"""CASE WHEN {n} >= 2 THEN 'listing' WHEN {n} = 1 AND {s} >= 2 THEN 'solicitation'
      WHEN {n} = 0 AND {s} >= 3 AND NOT ({i}) AND NOT ({noise}) THEN 'solicitation'
      WHEN {n} = 1 AND {s} >= 1 AND NOT ({i}) THEN 'solicitation' ELSE 'noise' END"""


def _counts(words, c: str) -> str:
    return " + ".join(f"(length({c}) - length(replace({c}, '{w}', ''))) // {len(w)}" for w in words)


_CHROME = rf"regexp_full_match(s, '(?i){text.CHROME_LINE}')"

ORACLES = {
    "html_to_text_len": f"SELECT page_id, length({_TEXT}) AS n_text FROM pages",
    "page_links": f"SELECT page_id, pos, href, anchor FROM ({_LINKS})",
    "link_hosts_topk": f"SELECT {_HOST.format('href')} AS host, count(*) AS n FROM ({_LINKS}) GROUP BY 1 ORDER BY n DESC, host LIMIT 20",
    "doc_unit_hash": f"SELECT doc_id, {_HASH} AS unit_hash FROM documents",
    "exact_dup_groups": f"SELECT {_HASH} AS unit_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "ledger_antijoin": f"""
WITH h AS (SELECT doc_id, {_HASH} AS hash FROM documents), l AS (SELECT DISTINCT hash FROM h WHERE doc_id % 3 = 0 ORDER BY hash DESC LIMIT 8000)
SELECT doc_id, hash FROM h WHERE hash NOT IN (SELECT hash FROM l)""",
    "keyword_score": oracle(f"""
SELECT id, 2 * regexp_matches(body, {_REF})::INT + regexp_matches(text, '20[0-9][0-9]')::INT + len(list_filter([{_SIGNALS}], lambda w: contains(lower(body), w))) AS score
FROM (SELECT id, text, CASE WHEN id % 2 = 0 THEN 'RFQ-' || (id + 100) || ' Request for quotation. ' || text ELSE text END AS body FROM ({NOTICES}))""".replace("{orders}", "orders")),
    "page_class": f"""
SELECT page_id, {_class("body", "url")} AS class FROM (SELECT page_id, url, {_TEXT} || CASE page_id % 4 WHEN 0 THEN ' RFQ-1234 quotations are due, scope of work'
  WHEN 1 THEN ' RFQ-1234 and RFP-5678' WHEN 2 THEN ' scope of work, quantity, delivery date' ELSE '' END AS body FROM pages)""",
    "sector_counts": f"""
WITH t AS (SELECT lower(p_name || ' ' || p_type || ' ' || ['supply of goods', 'cleaning services', 'construction and renovation', 'nothing'][p_partkey % 4 + 1]) AS low FROM part),
n AS (SELECT {_counts(text.SECTOR_WORDS["CONSTRUCTION"], "low")} AS con, {_counts(text.SECTOR_WORDS["SERVICES"], "low")} AS svc, {_counts(text.SECTOR_WORDS["COTS"], "low")} AS good FROM t)
SELECT CASE WHEN con > greatest(svc, good) THEN 'CONSTRUCTION' WHEN svc > greatest(con, good) THEN 'SERVICES' WHEN good > 0 THEN 'COTS' ELSE '' END AS sector, count(*) AS n FROM n GROUP BY 1""",
    "title_pick": f"""
SELECT doc_id, coalesce(list_filter(list_transform(string_split('Skip to main content' || chr(10) || 'U.S. Embassy in X' || chr(10) || 'short' || chr(10) || text, chr(10)),
    lambda x: trim(x, ' ' || chr(9) || ':-—·|')), lambda s: length(s) BETWEEN 12 AND 140 AND lower(s) NOT LIKE 'http%' AND lower(s) NOT LIKE '[document%'
    AND NOT {_CHROME} AND NOT regexp_matches(s, '{text.CHROME_PHRASE}') AND NOT regexp_matches(s, '{text.BANNER_LINE}') AND regexp_matches(s, '[a-zA-Z]{{4}}'))[1], '') AS title FROM documents""",
    "page_text_hash_classes": f"""
WITH p AS (SELECT page_id, url, {_TEXT} AS text FROM pages), f AS (SELECT arg_min(text, page_id) AS text, arg_min(url, page_id) AS url FROM p GROUP BY {_HASH})
SELECT {_class("text", "url")} AS class, count(*) AS n FROM f GROUP BY 1""",
    "procurement_pages": f"""
WITH l AS ({_LINKS}), g AS (SELECT url, href, min(pos) AS pos FROM l WHERE {_HOST.format("href")} = {_HOST.format("url")}
  AND len(list_filter([{", ".join(f"'{w}'" for w in text.SOCIAL_HOSTS)}], lambda w: contains({_HOST.format("href")}, w))) = 0
  AND len(list_filter([{", ".join(f"'{w}'" for w in HINTS)}], lambda w: contains(lower(href || ' ' || anchor), w))) > 0 GROUP BY url, href)
SELECT url, href, rank FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) AS rank FROM g) WHERE rank <= {units.MAX_PAGES}""",
    "bfs_three_hops": """
WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS a, (p_partkey * k + 7) % (SELECT count(*) FROM part) AS b FROM part, (VALUES (1), (8), (2)) t(k)),
h AS (SELECT a, b FROM e WHERE a % 7 = b % 7),
r(root, node, hop) AS (SELECT DISTINCT a, a, 0 FROM h UNION SELECT root, b, hop + 1 FROM r JOIN h ON node = a WHERE hop < 3),
s AS (SELECT root, node, min(hop) AS hop FROM r GROUP BY root, node)
SELECT hop, count(*) AS n, count(DISTINCT node) AS n_urls FROM s GROUP BY hop""",
    "blocked_minus_recovered": f"""
WITH p AS (SELECT page_id, {_HOST.format("url")} AS host, url LIKE 'https:%' AS secure FROM pages)
SELECT host, min(page_id) AS page_id FROM p GROUP BY host HAVING NOT bool_or(secure)""",
    "snapshot_diff": f"""
WITH l AS (SELECT page_id, {_HOST.format("url")} AS url, href FROM ({_LINKS})),
a AS (SELECT DISTINCT url, href FROM l WHERE page_id % 2 = 1), c AS (SELECT url, regexp_replace(href, '^https?://[^/]*', '') AS href FROM a)
SELECT url, count(*) AS n_new FROM c WHERE NOT EXISTS (SELECT 1 FROM l WHERE page_id % 2 = 0 AND l.url = c.url AND l.href = c.href) GROUP BY url""",
    "json_repair": """
SELECT event_id, CASE WHEN event_id % 4 < 3 THEN (props::JSON ->> '$.k')::BIGINT ELSE -1 END AS k, event_id % 4 < 3 AS parsed FROM events""",
    "progress_log_parse": """
SELECT user_id, arg_max(event_id::VARCHAR, event_id) AS last_step, count(*) AS steps, count(DISTINCT user_id % 10) AS visited FROM events GROUP BY user_id""",
    "block_kinds": """
WITH e AS (SELECT event_id, [401, 403, 429, 500, 200][event_id % 5 + 1] AS code, event_id % 11 = 0 AS sign, event_id % 11 <> 0 AND event_id % 13 = 0 AS checking, event_id % 17 = 0 AS poor FROM events),
k AS (SELECT CASE WHEN code = 401 OR sign THEN 'login' WHEN code = 403 OR checking THEN 'botwall' WHEN code = 429 THEN 'ratelimit' ELSE 'unknown' END AS kind,
  CASE WHEN code = 401 THEN 'key rejected' WHEN code = 403 THEN 'refused' WHEN poor THEN 'out of credit' WHEN code = 429 THEN 'rate limited' WHEN code = 500 THEN 'outage' ELSE 'error' END AS reason FROM e)
SELECT kind, reason, reason IN ('key rejected', 'refused', 'out of credit') AS fatal, count(*) AS n FROM k GROUP BY ALL""",
    "domestic_places": "SELECT c_custkey, c_custkey % 6 IN (1, 2, 3, 4) AS domestic FROM customer",
    "brief_line": oracle(f"""
SELECT id, CASE WHEN id % 2 = 0 THEN 'Lusaka wants ' ELSE '' END || 'office chairs ' || id || CASE WHEN id % 3 = 0 THEN ' (desk; lamp)' ELSE '' END
  || CASE WHEN id % 5 <> 0 THEN ' — closes ' || iso ELSE ' — no closing date is stated anywhere in it, so it needs checking' END AS brief FROM ({DATED})"""),
    "listing_split": oracle(f"""
WITH o AS (SELECT *, count(*) OVER (PARTITION BY cust) AS n FROM ({DATED}))
SELECT cust, 'RFQ-' || (id + 1000) AS sol, iso AS closing, 1::BIGINT AS n_refs FROM o WHERE n >= 2"""),
    "file_units": """
WITH f AS (SELECT l_orderkey, 'https://x.example/f/RFQ-' || (l_orderkey + 1000) || '_part%20' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '.pdf' AS url,
  'RFQ' || ' ' || (l_orderkey + 1000) AS spoken, CASE WHEN l_orderkey % 5 = 0 THEN 'Terms for RFQ-' || (l_orderkey + 1000) || ' ' || repeat('word ', 30) WHEN l_linenumber = 2 THEN 'short' ELSE repeat('word ', 30) END AS body FROM lineitem),
k AS (SELECT *, CASE WHEN l_orderkey % 5 = 0 THEN 'RFQ-' || (l_orderkey + 1000) ELSE 'RFQ' || (l_orderkey + 1000) END AS key, length(body) >= 120 AS ok FROM f)
SELECT key, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS fail, count(*) FILTER (WHERE ok) AS n_files,
  coalesce(sum(length(url) + length(body) + 16) FILTER (WHERE ok) + 2 * (count(*) FILTER (WHERE ok) - 1), 0)::BIGINT AS n_text FROM k GROUP BY key""",
}

QUERIES = {
    f.__name__: f
    for f in (
        html_to_text_len, page_links, link_hosts_topk, doc_unit_hash, exact_dup_groups, ledger_antijoin, keyword_score, page_class, sector_counts, title_pick,
        page_text_hash_classes, procurement_pages, bfs_three_hops, blocked_minus_recovered, snapshot_diff, json_repair, progress_log_parse, block_kinds,
        domestic_places, brief_line, listing_split, file_units,
    )
}
