"""Queries over claims, excerpts, ownership and look-ups, composed from orders, pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text
from ..operators import register, rollup, units, verdicts
from .composed import AS_OF, CLAIMS, COPIES, DATED, NOTICES, compose, oracle, read
from .date_queries import _FOUND
from .register_queries import as_register

_LINK = "https://example.usembassy.gov/n/"
_EDGES = f"""
SELECT *, CASE form WHEN 0 THEN 14 WHEN 1 THEN 9 WHEN 2 THEN 19 WHEN 3 THEN 17 WHEN 4 THEN 32 ELSE 0 END AS lo,
       CASE form WHEN 0 THEN length(text) - 1 WHEN 1 THEN length(text) - 9 WHEN 2 THEN length(text) - 13 WHEN 3 THEN length(text) - 1 WHEN 4 THEN 42 ELSE 0 END AS hi
FROM ({NOTICES}) AS edges
"""


def closed_words(spark, d: str) -> DataFrame:
    n = F.col("id") % 4
    quote = F.when(n == 0, "").when(n == 1, F.upper(F.substring("text", 1, 25))).when(n == 2, "quoted from quite another place").otherwise("short")
    rows = compose(spark, d, NOTICES).withColumns({"status": F.when(F.col("id") % 3 == 0, "Closed").when(F.col("id") % 3 == 1, "open").otherwise("CLOSED early"), "status_quote": quote})
    return verdicts.closed_by_words(rows).select("id", "status", F.col("status_doubt").alias("doubt"))


def second_opinions(spark, d: str) -> DataFrame:
    rows = compose(spark, d, DATED).select(
        F.col("id").alias("unit_hash"), F.when(F.col("id") % 2 == 0, "NO").otherwise("BID").alias("tier"), F.lit("old").alias("overturned"),
        F.struct(F.lit("d").alias("doc"), F.lit("q").alias("quote")).alias("citation"), F.lit("first").alias("route"), F.lit("why").alias("review_reason"),
    )
    h = F.col("unit_hash")
    review = rows.select("unit_hash", F.when(h % 4 == 0, False).when(h % 4 == 2, True).alias("upheld"), F.when(h % 8 == 0, "bid").otherwise("never").alias("review_tier"), F.when(h % 12 == 0, "").otherwise("it is open").alias("review_why"), F.when(h % 16 == 0, "ask").otherwise("").alias("review_route"), (h % 10).alias("n")).where("n <> 4")
    return verdicts.second_opinion(rows, review).select(h.alias("id"), "tier", "overturned", F.col("citation").isNotNull().alias("cited"), "route", "review_reason")


def title_deadlines(spark, d: str) -> DataFrame:
    n = F.col("id") % 3
    title = F.when(n == 0, F.concat(F.lit("Offers due "), "iso")).when(n == 1, F.concat(F.lit("About "), "iso")).otherwise("Deadline 2031-01-01")
    return compose(spark, d, NOTICES).select("id", F.coalesce(verdicts.title_deadline(title, F.col("text")), F.lit("")).alias("due"))


def no_closing_marks(spark, d: str) -> DataFrame:
    rows = compose(spark, d, NOTICES).withColumns({"closing": F.when(F.col("form") == 0, F.col("later")).otherwise(""), "date_warnings": F.array().cast("array<string>"), "gate_closing": F.when(F.col("id") % 2 == 0, F.col("iso")).otherwise("")})
    out = verdicts.retract_no_closing(verdicts.mark_no_closing(rows, AS_OF))
    return out.select("id", "closing", "no_closing", F.coalesce("needs", F.lit("")).alias("needs"), F.coalesce(F.array_join("dates_seen", ","), F.lit("-")).alias("seen"), F.size("date_warnings").cast("bigint").alias("n_warnings"))


def date_windows_text(spark, d: str) -> DataFrame:
    n = compose(spark, d, NOTICES).withColumn("long", F.concat(F.repeat(F.lit("filler "), 100), "text", F.repeat(F.lit(" filler"), 100)))
    return n.select("id", D.date_windows(F.col("long"), D.scan_dates(F.col("long"))).alias("windows"))


def triage_excerpts(spark, d: str) -> DataFrame:
    long = F.concat(F.col("text"), F.repeat(F.lit(" filler"), 300), F.lit(" "), F.col("text"))
    return compose(spark, d, NOTICES).select("id", D.triage_excerpt(long).alias("excerpt"))


def clean_texts(spark, d: str) -> DataFrame:
    i = F.col("id").cast("int")
    body = F.concat(F.lit(" Home\nabout us\nText"), F.repeat(F.lit(" "), i % 4), F.lit("on a line"), F.repeat(F.lit("\n"), i % 6), F.lit("Commercial Opportunities Economic Opportunity end\nContact us \nlast\t\tline"))
    return compose(spark, d, DATED).select("id", text.clean(body).alias("cleaned"), text.strip_chrome(body).alias("stripped"))


def block_words(spark, d: str) -> DataFrame:
    e, n = read(spark, d, "events"), F.col("event_id")
    kind = F.when(n % 2 == 0, "unknown").otherwise("robots")
    need = F.element_at(F.array(*[F.lit(x) for x in ("a Sign-In page", "HTTP 403 from a CDN", "asked to slow down", "")]), (n % 4 + 1).cast("int"))
    day = F.element_at(F.array(*[F.lit(x) for x in ("2016-01-31", "2016-1-31", "31 January", "2016-01-31 ")]), (n % 4 + 1).cast("int"))
    return e.groupBy(text.block_kind_of_words(kind, need).alias("kind"), text.is_iso_date(day).alias("dated")).agg(F.count(F.lit(1)).alias("n"))


def assembled_rows(spark, d: str) -> DataFrame:
    c = compose(spark, d, CLAIMS).select("id", "closing", F.col("posted"), F.col("qa_due"), F.lit("5").alias("est_value"), F.when(F.col("id") % 2 == 0, "A1").otherwise("").alias("sol"), F.lit("H2").alias("sol_hint"))
    return register.to_rows(c, AS_OF).select("id", "sol", "deadline", "qa", "value", "status", "archived", "updated")


def provider_union(spark, d: str) -> DataFrame:
    s = read(spark, d, "events").groupBy(F.col("user_id").alias("shard")).agg(F.collect_list("event_type").alias("providers"))
    return rollup.set_union(s, "providers")


def attached_units(spark, d: str) -> DataFrame:
    """Orders with their items as attachments; of some the document is missing, of some it is empty."""
    li = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    url = F.concat(F.lit("u/"), F.col("l_orderkey"), F.lit("/"), F.col("l_linenumber"))
    u = li.groupBy(F.col("l_orderkey").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", url.alias("u")))), lambda x: x["u"]).alias("attachments")).withColumn("text", F.concat(F.lit("unit "), F.col("key")))
    docs = li.where("part % 3 <> 0").select(url.alias("url"), F.when(F.col("part") % 5 == 0, "").otherwise(F.concat(F.lit("part "), F.col("part"))).alias("text"))
    return units.with_attachments(u, docs, 3).select("key", "text", F.col("read_fail").cast("bigint").alias("read_fail"))


def api_places(spark, d: str) -> DataFrame:
    """API notices in all shapes: places as text, object or nested object, ids missing or repeated."""
    i = F.col("id")
    notice = F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("n"), i - i % 2))
    number = F.when((i % 5 == 0) & (i % 2 == 0), F.concat(F.lit("s"), i)).otherwise("")
    place = F.element_at(F.array(*[F.lit(x) for x in ('"India"', '{"country":{"name":"Peru","code":"PE"},"zip":"1"}', '{"countryName":"Chad","countryCode":"TD","state":{"code":"VA"}}')]), F.floor(i % 6 / 2).cast("int") + 1)
    posted = F.when(i % 7 == 0, "2016-01-01").otherwise("2016-06-20")
    raw = F.concat(F.lit('{"noticeId":"'), notice, F.lit('","solicitationNumber":"'), number, F.lit('","title":"T","postedDate":"'), posted, F.lit('","placeOfPerformance":'), place, F.lit("}"))
    out = units.api_notices(compose(spark, d, DATED).select(raw.alias("raw")), AS_OF)
    none = F.lit("")
    return out.groupBy(F.coalesce("country", none).alias("country"), F.coalesce("country_code", none).alias("code"), F.coalesce("state", none).alias("state"), F.coalesce("zip", none).alias("zip")).agg(F.count(F.lit(1)).alias("n"))


def claimed_references(spark, d: str) -> DataFrame:
    """A third of the orders has no number; read again, each finds a free one, a shared one or another's."""
    n = F.col("id") % 9
    o = compose(spark, d, DATED).select("id", F.lpad(F.col("id").cast("string"), 9, "0").alias("key"), F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("N"), F.col("id"))).alias("sol"))
    again = o.select("key", F.when(n == 0, F.concat(F.lit("free"), F.col("id"))).when(n == 3, F.concat(F.lit(" n"), F.col("id") + 1)).when(n == 6, F.concat(F.lit("shared"), F.floor(F.col("id") / 45))).otherwise("other").alias("sol"))
    out = register.adopted_references(o, again)
    return out.select("key", "sol", F.col("note").isNotNull().alias("taken"))


def known_live_units(spark, d: str) -> DataFrame:
    rows = as_register(compose(spark, d, COPIES).where("shard = 0"))
    hints = compose(spark, d, DATED).select("id", F.concat(F.lit(" 19ab"), F.lpad((F.col("id") + 1).cast("string"), 7, "0"), F.lit("q")).alias("sol_hint"))
    return register.known_live(hints, rows).select("id", "known")


def gate_counts(spark, d: str) -> DataFrame:
    n = compose(spark, d, NOTICES)
    body = F.when(F.col("id") % 2 == 0, F.col("text")).otherwise("nothing to see")
    return n.groupBy("form", text.passes_gate(body, F.size(D.find_dates(body)) > 0).alias("passes"), text.is_over_by_words(F.when(F.col("id") % 5 == 0, "This RFQ has been cancelled")).alias("over")).agg(F.count(F.lit(1)).alias("n"))


def ledger_after_run(spark, d: str) -> DataFrame:
    """The ledger of the short documents after a run that finished all but the shortest."""
    docs = read(spark, d, "documents").select("n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    return register.with_finished(docs.where("n_chars < 2000"), docs.where("n_chars >= 500"))


def notices_by_id(spark, d: str) -> DataFrame:
    o = compose(spark, d, NOTICES)
    none = F.array().cast("array<string>")
    told = o.where("id % 3 <> 0").select("id", F.when(F.col("id") % 6 == 1, "").otherwise("T").alias("title"), F.when(F.col("id") % 6 == 1, "").otherwise(F.col("text")).alias("description"), F.when(F.col("id") % 4 == 0, F.array(F.concat(F.lit("a"), F.col("id")))).otherwise(none).alias("attachments"))
    pages = o.where("id % 5 <> 0").select("id", F.concat(F.lit("page "), F.col("id")).alias("page"))
    docs = o.where("id % 8 = 0").select(F.concat(F.lit("a"), F.col("id")).alias("url"), F.lit("file").alias("text"))
    return units.notice_texts(o, told, pages, docs).select("id", "text", F.col("read_fail").cast("bigint").alias("read_fail"))


def country_codes(spark, d: str) -> DataFrame:
    n = read(spark, d, "nation")
    codes = n.where("n_nationkey <> 3").select(F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, " ").otherwise("")).alias("country"), F.substring("n_name", 1, 2).alias("code"))
    rows = read(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat("n_name", F.when(F.col("c_custkey") % 2 == 0, "  ").otherwise("")).alias("country"))
    return register.with_country_code(rows, codes.unionByName(codes)).groupBy(F.coalesce("country_code", F.lit("-")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def deep_scan_target(spark, d: str) -> DataFrame:
    rows = as_register(compose(spark, d, COPIES))
    return register.target_rows(rows, "19ab0000004q").unionByName(register.target_rows(rows, _LINK.upper() + "5")).select("sol", "link", "source")


_KEY = "lpad(cast(id as varchar), 9, '0')"

ORACLES = {
    "closed_words": oracle(f"SELECT id, CASE WHEN id % 3 <> 1 AND id % 4 = 1 THEN 'closed' ELSE 'open' END AS status, id % 3 <> 1 AND id % 4 <> 1 AS doubt FROM ({NOTICES})"),
    "second_opinions": oracle(f"""
WITH r AS (SELECT id, id % 2 = 0 AND id % 4 = 0 AND id % 10 <> 4 AS lifted FROM ({DATED}))
SELECT id, CASE WHEN NOT lifted THEN CASE WHEN id % 2 = 0 THEN 'NO' ELSE 'BID' END WHEN id % 8 = 0 THEN 'BID' ELSE 'MID' END AS tier,
  CASE WHEN NOT lifted THEN 'old' WHEN id % 12 = 0 THEN 'a second check found no clause that excludes' ELSE 'it is open' END AS overturned, NOT lifted AS cited,
  CASE WHEN lifted AND id % 16 = 0 THEN 'ask' ELSE 'first' END AS route, CASE WHEN lifted THEN '' ELSE 'why' END AS review_reason FROM r"""),
    "title_deadlines": oracle(f"SELECT id, CASE WHEN id % 3 = 0 AND list_contains({_FOUND}, iso) THEN iso ELSE '' END AS due FROM ({NOTICES})"),
    "no_closing_marks": oracle(f"""
SELECT id, CASE WHEN id % 2 = 0 THEN iso WHEN form = 0 THEN later ELSE '' END AS closing, form <> 0 AND id % 2 = 1 AS no_closing, CASE WHEN form <> 0 AND id % 2 = 1 THEN 'a deadline' ELSE '' END AS needs,
  CASE WHEN form <> 0 AND id % 2 = 1 THEN array_to_string(list_sort({_FOUND}), ',') ELSE '-' END AS seen, (form = 0 AND id % 2 = 0 OR form <> 0 AND id % 2 = 1)::BIGINT AS n_warnings FROM ({NOTICES})"""),
    "date_windows_text": oracle(f"SELECT id, CASE WHEN form = 5 THEN '' ELSE substr(repeat('filler ', 100) || text || repeat(' filler', 100), 700 + lo - 260 + 1, hi - lo + 520) END AS windows FROM ({_EDGES})"),
    "date_windows_len": oracle(f"SELECT id, CASE WHEN form = 5 THEN 0 ELSE hi - lo + 520 END::BIGINT AS n_window FROM ({_EDGES})"),
    "triage_excerpts": oracle(f"""
WITH t AS (SELECT id, form, lo, text || repeat(' filler', 300) || ' ' || text AS t, length(text) + 301 AS s FROM ({_EDGES}))
SELECT id, substr(t, 1, 1800) || CASE WHEN form = 5 THEN '' ELSE chr(10) || '...' || chr(10) || substr(t, 1801 + s + lo - 260) END AS excerpt FROM t"""),
    "clean_texts": oracle(f"""
WITH b AS (SELECT id, ' Home' || chr(10) || 'about us' || chr(10) || 'Text' || repeat(' ', (id % 4)::INT) || 'on a line' || repeat(chr(10), (id % 6)::INT)
  || 'Commercial Opportunities Economic Opportunity end' || chr(10) || 'Contact us ' || chr(10) || 'last' || chr(9) || chr(9) || 'line' AS b FROM ({DATED}))
SELECT id, trim(regexp_replace(regexp_replace(b, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g')) AS cleaned,
  regexp_replace(regexp_replace(regexp_replace(b, '(?im)^(?:\\s*{text.CHROME_LINE}\\s*)$', '', 'g'), '{text.CHROME_PHRASE}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS stripped FROM b"""),
    "block_words": """
SELECT CASE WHEN event_id % 2 = 1 THEN 'robots' WHEN event_id % 4 = 0 THEN 'login' ELSE 'ratelimit' END AS kind, event_id % 4 = 0 AS dated, count(*) AS n FROM events GROUP BY ALL""",
    "assembled_rows": oracle(f"""
SELECT id, CASE WHEN id % 2 = 0 THEN 'A1' ELSE 'H2' END AS sol, closing AS deadline, qa_due AS qa, '5' AS value, CASE WHEN closing <> '' AND closing < '{AS_OF}' THEN 'Expired' ELSE 'Active' END AS status,
  closing <> '' AND closing < '{AS_OF}' AS archived, '{AS_OF}' AS updated FROM ({CLAIMS})"""),
    "provider_union": "SELECT DISTINCT event_type AS providers FROM events",
    "attached_units": """
WITH g AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part FROM lineitem GROUP BY ALL), li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM g),
a AS (SELECT *, part % 3 <> 0 AND part % 5 <> 0 AS ok FROM li WHERE r <= 3)
SELECT l_orderkey AS key, 'unit ' || l_orderkey || coalesce(chr(10) || chr(10) || string_agg('[ATTACHMENT: u/' || l_orderkey || '/' || l_linenumber || ']' || chr(10) || 'part ' || part, chr(10) || chr(10) ORDER BY l_linenumber) FILTER (WHERE ok), chr(10) || chr(10)) AS text,
  count(*) FILTER (WHERE NOT ok) AS read_fail FROM a GROUP BY l_orderkey""",
    "api_places": oracle(f"""
WITH r AS (SELECT id, id % 6 - id % 2 AS p, CASE WHEN id % 5 <> 0 THEN 'n' || (id - id % 2) WHEN id % 2 = 0 THEN 's' || id END AS key FROM ({DATED}) WHERE id % 7 <> 0),
k AS (SELECT DISTINCT key, p FROM r WHERE key IS NOT NULL UNION ALL SELECT key, p FROM r WHERE key IS NULL)
SELECT CASE p WHEN 0 THEN 'India' WHEN 2 THEN 'Peru' ELSE 'Chad' END AS country, CASE p WHEN 0 THEN '' WHEN 2 THEN 'PE' ELSE 'TD' END AS code, CASE WHEN p = 4 THEN 'VA' ELSE '' END AS state,
  CASE WHEN p = 2 THEN '1' ELSE '' END AS zip, count(*) AS n FROM k GROUP BY ALL"""),
    "claimed_references": oracle(f"""
WITH o AS (SELECT id, {_KEY} AS key, id % 9 AS n, min(CASE WHEN id % 9 = 6 THEN {_KEY} END) OVER (PARTITION BY id // 45) AS first FROM ({DATED})),
ids AS (SELECT id FROM ({DATED})),
t AS (SELECT o.*, n = 3 AND i.id IS NOT NULL AS others FROM o LEFT JOIN ids i ON i.id = o.id + 1)
SELECT key, CASE WHEN id % 3 <> 0 THEN 'N' || id WHEN n = 0 THEN 'FREE' || id WHEN n = 3 THEN CASE WHEN others THEN '' ELSE 'N' || (id + 1) END WHEN key = first THEN 'SHARED' || (id // 45) ELSE '' END AS sol,
  id % 3 = 0 AND (n = 3 AND others OR n = 6 AND key <> first) AS taken FROM t"""),
    "known_live_units": oracle(f"SELECT a.id, b.id IS NOT NULL AS known FROM ({DATED}) a LEFT JOIN (SELECT id FROM ({COPIES}) WHERE shard = 0 AND verified = 'VERIFIED' AND NOT archived) b ON b.id = a.id + 1"),
    "gate_counts": oracle(f"SELECT form, id % 2 = 0 AND form <> 5 AS passes, id % 5 = 0 AS over, count(*) AS n FROM ({NOTICES}) GROUP BY ALL"),
    "ledger_after_run": "SELECT DISTINCT sha256(coalesce(text, '')) AS hash FROM documents WHERE n_chars < 2000 OR n_chars >= 500",
    "notices_by_id": oracle(f"""
SELECT id, CASE WHEN id % 3 <> 0 AND id % 6 <> 1 THEN 'T' || chr(10) || chr(10) || text WHEN id % 5 <> 0 THEN 'page ' || id ELSE '' END
  || CASE WHEN id % 3 = 0 OR id % 4 <> 0 THEN '' WHEN id % 8 = 0 THEN chr(10) || chr(10) || '[ATTACHMENT: a' || id || ']' || chr(10) || 'file' ELSE chr(10) || chr(10) END AS text, (id % 3 <> 0 AND id % 4 = 0 AND id % 8 <> 0)::BIGINT AS read_fail FROM ({NOTICES})"""),
    "country_codes": "SELECT CASE WHEN n_nationkey = 3 THEN '-' ELSE substr(n_name, 1, 2) END AS code, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "deep_scan_target": oracle(f"SELECT sol, link, source FROM ({COPIES}) WHERE sol = '19AB0000004Q' UNION ALL SELECT sol, link, source FROM ({COPIES}) WHERE link = '{_LINK}5'"),
}

QUERIES = {
    f.__name__: f
    for f in (
        closed_words, second_opinions, title_deadlines, no_closing_marks, date_windows_text, triage_excerpts, clean_texts, block_words, assembled_rows, provider_union, attached_units,
        api_places, claimed_references, known_live_units, gate_counts, ledger_after_run, notices_by_id, country_codes, deep_scan_target,
    )
}
