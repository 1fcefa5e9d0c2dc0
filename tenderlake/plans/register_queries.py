"""Queries over register rows composed from orders: identity, merge, archive, operators, counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared_dir
from ..functions import dates as D
from ..functions import identity
from ..functions.text import host
from ..operators import estimate, register, rollup
from ..streaming import register_stream
from .composed import AS_OF, COPIES, DATED, compose, oracle, read


def as_register(rows: DataFrame) -> DataFrame:
    """Composed rows with all columns of the register."""
    none = F.lit(None)
    given = {
        "files": F.concat(F.array(F.lit("x")), F.transform(F.sequence(F.lit(1), F.col("n_files") + 1), lambda i: F.concat_ws("-", F.lit("f"), F.col("shard").cast("string"), i.cast("string")))),
        "restrictions": F.transform(F.when(F.col("n_restrictions") > 0, F.sequence(F.lit(1), F.col("n_restrictions"))).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.cast("string").alias("t"), F.lit("real").alias("k"), F.lit("").alias("note"))),
        "dateEvidence": F.when(F.col("proven"), F.create_map(F.lit("closing"), F.lit("a line"))).otherwise(F.create_map().cast("map<string,string>")),
        "repairTries": F.col("tries"),
        "verifyNotes": F.when(F.col("verified") == "VERIFIED", F.array().cast("array<string>")).otherwise(F.array(F.lit("not adjudicated"))),
    }
    rows = rows.withColumns(given)
    fields = T.StructType.fromDDL(register.REGISTER).fields
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else none).cast(f.dataType).alias(f.name) for f in fields], *[c for c in ("id", "shard") if c in rows.columns])


def register_merge(spark, d: str) -> DataFrame:
    """The flagship: copies of notices from two workers, merged per canonical key, junk dropped,
    archived."""
    rows = as_register(compose(spark, d, COPIES))
    merged = register.merge_copies(register.with_key(rows.drop("id")), ["shard"])
    return _shown(register.archive(register.backfill(merged.where(~register.is_junk())), AS_OF))


def _shown(out: DataFrame) -> DataFrame:
    return out.select("key", "tier", F.coalesce("deadline", F.lit("")).alias("deadline"), "status", "archived", "source", "verified", F.col("fileCount").cast("bigint").alias("n_files"), F.coalesce("repairTries", F.lit(0)).cast("bigint").alias("tries"), F.coalesce("value", F.lit("")).alias("value"), F.coalesce("lastDeepScan", F.lit("")).alias("scanned"))


def register_upserts(spark, d: str) -> DataFrame:
    """The same copies as batches of a stored register: the first worker's rows, the second's in two batches
    that touch parts of it, the last of them run twice."""
    rows = as_register(compose(spark, d, COPIES))
    place = f"{shared_dir(spark)}/register-{uuid.uuid4().hex}"
    second = F.col("shard") == 1
    for number, some in enumerate((~second, second & (F.col("id") % 4 == 0), second & (F.col("id") % 4 != 0))):
        register_stream.upsert(rows.where(some).drop("id", "shard"), number, place, "", parts=8)
    register_stream.upsert(rows.where(some).drop("id", "shard"), number, place, "", parts=8)
    return _shown(register.archive(register.backfill(register_stream.current(spark, place)), AS_OF))


def register_tally(spark, d: str) -> DataFrame:
    rows = as_register(compose(spark, d, COPIES)).withColumns({"deleted": F.col("id") % 17 == 0, "hidden": F.col("id") % 13 == 0})
    return register.tally(register.archive(rows, AS_OF))


def operator_rows(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Register rows, some known by their link only, and a log of operators' actions on them."""
    rows = as_register(compose(spark, d, COPIES).where("shard = 0")).withColumn("sol", F.when(F.col("id") % 4 != 0, F.col("sol")).otherwise(""))
    key = F.when(F.col("id") % 4 != 0, F.concat(F.lit("19AB"), F.lpad(F.col("id").cast("string"), 7, "0"), F.lit("Q"))).otherwise(F.concat(F.lit("https://example.usembassy.gov/n/"), F.col("id").cast("string")))
    pick = lambda n, action, tier="": F.when(F.col("id") % n == 0, F.struct(key.alias("key"), F.lit(action).alias("action"), F.lit(tier).alias("tier"), F.lit(f"2016-01-{n:02d}").alias("on")))
    actions = F.array_compact(F.array(pick(7, "delete"), pick(14, "restore"), pick(5, "hide"), pick(11, "switch", "bid"), pick(22, "clear")))
    return rows, rows.select(F.explode(actions).alias("a")).select("a.*")


def overlaid(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    out = register.apply_operator(rows, decisions)
    return out.select("id", "tier", "archived", "deleted", "hidden", "switched", F.col("unhiddenBecause").isNotNull().alias("unhidden"))


def operator_overlay(spark, d: str) -> DataFrame:
    rows, log = operator_rows(spark, d)
    return overlaid(rows, register.latest_decisions(log))


def change_detection(spark, d: str) -> DataFrame:
    rows = compose(spark, d, COPIES).where("shard = 0").select(F.col("id").cast("string").alias("key"), "id", "title", "deadline", "status", "tier")
    fp = lambda title: identity.fingerprint(F.col("key"), title, F.col("deadline"), F.col("status"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    prior = rows.where("id % 5 <> 0").select("key", fp(F.col("title")).alias("fp"), F.lit("2016-01-01").alias("firstSeen"), F.lit(None).cast("string").alias("changed"))
    title = F.when(F.col("id") % 7 == 0, F.concat("title", F.lit(" (amended)"))).otherwise(F.col("title"))
    fresh = rows.where("id % 3 <> 0").select("key", fp(title).alias("fp"), F.lit(None).cast("string").alias("firstSeen"), F.lit(None).cast("string").alias("changed"))
    return register.detect_changes(prior, fresh, AS_OF).groupBy("state", "firstSeen").agg(F.count(F.lit(1)).alias("n"), F.count("changed").alias("n_dated"))


def row_fingerprints(spark, d: str) -> DataFrame:
    rows = compose(spark, d, COPIES)
    return rows.select("id", "shard", identity.fingerprint(F.col("sol"), F.col("title"), F.col("deadline"), F.col("status"), F.lit(None).cast("string"), F.col("link")).alias("fp"))


def richness_score(spark, d: str) -> DataFrame:
    rows = as_register(compose(spark, d, COPIES))
    return rows.select("id", "shard", register.richness().cast("bigint").alias("richness"), register.stamp().alias("stamp"))


def sol_normalise(spark, d: str) -> DataFrame:
    c = compose(spark, d, DATED)
    sol = F.element_at(F.array(*[F.concat(F.lit(p), F.col("id").cast("string"), F.lit(s)) for p, s in (("RFQ-", ""), ("#19AB", "-Q/1"), ("Supply of ", " laptops for the office in town"), ("no. ", "x"), ("sol: ", ""))]), (F.col("id") % 5 + 1).cast("int"))
    sol = F.when(F.col("id") % 31 == 0, "Janitorial services").otherwise(sol)
    return c.select("id", identity.reference_base(sol).alias("base"), identity.clean_reference(sol).alias("clean"))


def canonical_key_groups(spark, d: str) -> DataFrame:
    """Weak references qualified by who issued them: each customer's nation is the post."""
    o = compose(spark, d, DATED)
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("cust"), "c_nationkey")
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    kind = F.when(F.col("id") % 2 == 0, "RFQ-").otherwise("RFP-")
    sol = F.when(F.col("id") % 5 == 0, "").when(F.col("id") % 5 == 1, F.concat(F.lit("19AB"), F.lpad((F.col("id") % 1000).cast("string"), 6, "0"))).otherwise(F.concat(kind, (F.col("id") % 50).cast("string")))
    rows = o.join(c, "cust").join(F.broadcast(n), "c_nationkey").select(sol.alias("sol"), F.concat(F.lit("l/"), (F.col("id") % 100).cast("string")).alias("link"), F.when(F.col("id") % 3 != 0, F.col("n_name")).alias("post"), F.concat(F.lit("C "), "n_name").alias("country"))
    key = identity.canonical_key(F.col("sol"), F.col("link"), F.col("post"), F.col("country"), F.lit("USGOV"))
    return rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


def previous_rows(spark, d: str) -> DataFrame:
    """Rows that found their number replace the row known by its link."""
    rows = as_register(compose(spark, d, COPIES).where("shard = 0")).drop("shard")
    # Every order is known by its link; those with an even key come again, with number and link.
    again = rows.withColumn("__again", F.explode(F.when(F.col("id") % 2 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    new = F.col("__again")
    both = again.withColumns({"sol": F.when(new, F.col("sol")).otherwise(""), "notes": F.when(~new, "keep"), "prevKey": F.when(new, F.col("link"))})
    both = register.with_key(both.drop("__again"))
    return register.carry_previous(both).select("id", "key", F.coalesce("notes", F.lit("")).alias("notes"))


def junk_filter(spark, d: str) -> DataFrame:
    rows = as_register(compose(spark, d, COPIES).where("shard = 0")).drop("shard")
    n = F.col("id") % 8
    rows = rows.withColumns({
        "sol": F.when(n < 6, "").otherwise(F.col("sol")),
        "link": F.when(n == 0, "https://x.usembassy.gov/procurement/").when(n == 1, "https://shop.example/a").when(n == 5, "").otherwise(F.col("link")),
        "title": F.when(n == 2, "Skip to main content").when(n == 3, "(untitled page)").otherwise(F.col("title")),
        "needs": F.when(F.col("id") % 9 == 0, "a deadline"),
    })
    return rows.select("id", register.is_junk().alias("junk"))


def repaired_rows(spark, d: str) -> DataFrame:
    rows = register.with_key(as_register(compose(spark, d, COPIES).where("shard = 0")).drop("shard"))
    again = rows.select("key", F.when(F.col("id") % 4 == 0, "success").when(F.col("id") % 4 == 1, "dead").otherwise("fail").alias("result"), F.when(F.col("id") % 4 == 0, "2017-01-01").otherwise("").alias("deadline")).where("result <> 'fail' OR key LIKE '%2Q'")
    out = register.repaired(rows, again, AS_OF)
    return out.select("id", "deadline", "tier", "archived", F.col("repairTries").cast("bigint").alias("tries"), F.size("verifyNotes").cast("bigint").alias("n_notes"))


def status_rollup(spark, d: str) -> DataFrame:
    """Workers' statuses from events: each user is a worker, its counters written in several ways."""
    e = read(spark, d, "events")
    g = e.groupBy(F.col("user_id").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.max(F.get_json_object("props", "$.k").cast("int")).alias("k"))
    written = F.when(F.col("shard") % 4 == 0, F.concat(F.col("n").cast("string"), F.lit("/10 this run"))).when(F.col("shard") % 4 == 1, F.col("n").cast("string")).when(F.col("shard") % 4 == 2, "nope")
    s = g.select("shard", written.alias("found"), F.col("k").cast("string").alias("samCalls"), F.lpad(F.col("first").cast("string"), 8, "0").alias("startedAt"), F.lpad(F.col("last").cast("string"), 8, "0").alias("heartbeat"), F.when(F.col("shard") % 10 == 9, F.concat(F.lit("error of "), F.col("shard").cast("string"))).alias("lastError"), F.when(F.col("shard") % 3 == 0, "not queried").otherwise(F.concat(F.lit("ok "), F.col("shard").cast("string"))).alias("samDiag"))
    return rollup.status_rollup(s)


def coverage_last_wins(spark, d: str) -> DataFrame:
    e = read(spark, d, "events")
    g = e.groupBy(F.col("user_id").alias("shard"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = g.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("coverage"))
    last = rollup.map_last(m, "coverage").withColumnRenamed("value", "last_n")
    return last.join(rollup.map_sum(m, "coverage").withColumnRenamed("value", "total"), "key")


def coverage_by_country(spark, d: str) -> DataFrame:
    c = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rollup.count_by(c.withColumnRenamed("n_name", "country"), "country")


def _usage(spark, d: str) -> DataFrame:
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("model-haiku-1", "model-sonnet-2", "OPUS-3", "other")]), (F.col("event_id") % 4 + 1).cast("int")), F.lit("-"), F.col("event_type"))
    return read(spark, d, "events").select(name.alias("model"), (F.col("user_id") * 1000 + F.col("event_id") % 7).alias("tokens_in"), (F.col("event_id") % 500).alias("tokens_out"), F.lit(1).cast("bigint").alias("calls"))


def spend_by_model(spark, d: str) -> DataFrame:
    return rollup.spend_by_model(_usage(spark, d)).withColumn("usd", F.col("usd").cast("double"))


def spend_ledger(spark, d: str) -> DataFrame:
    t = rollup.spend_total(rollup.spend_by_model(_usage(spark, d)), "40000")
    return t.select("tokens_in", "tokens_out", "calls", F.col("spent_usd").cast("double").alias("spent_usd"), F.col("left_usd").cast("double").alias("left_usd"))


def access_probe(spark, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("event_type").alias("identity"), F.element_at(F.array(*[F.lit(x) for x in (200, 403, 404, 301, 429)]), (F.col("event_id") % 5 + 1).cast("int")).alias("code"))
    return rollup.access_probe(e)


def estimate_sanity(spark, d: str) -> DataFrame:
    p = read(spark, d, "part")
    price = F.col("p_retailprice")
    basis = F.when(F.col("p_partkey") % 7 == 0, "short").otherwise("twelve units at the list price of the part")
    conf = (F.col("p_partkey") % 10) / 10
    e = estimate.accepted(price * F.when(F.col("p_partkey") % 3 == 0, 2000).otherwise(12), price * 15, F.when(F.col("p_partkey") % 5 != 0, price * 18), basis, conf)
    return p.select("p_partkey", e["low"].alias("low"), e["likely"].alias("likely"), e["high"].alias("high"), e["display"].alias("display")).where("low IS NOT NULL")


def wants_estimate(spark, d: str) -> DataFrame:
    rows = as_register(compose(spark, d, COPIES).where("shard = 0")).drop("shard")
    return rows.groupBy(estimate.wants_estimate().alias("wants")).agg(F.count(F.lit(1)).alias("n"))


def expired_by_day(spark, d: str) -> DataFrame:
    rows = compose(spark, d, DATED)
    return rows.groupBy(D.expired(F.col("iso"), F.lit(AS_OF)).alias("expired")).agg(F.count(F.lit(1)).alias("n"), F.max("iso").alias("last"))


def blocked_sites(spark, d: str) -> DataFrame:
    p = read(spark, d, "pages").select("page_id", host(F.col("url")).alias("host"))
    return register.first_per(p, "host", "page_id")


_RICH = "(CASE WHEN verified = 'VERIFIED' THEN 100 ELSE 0 END + CASE WHEN deadline <> '' THEN 20 ELSE 0 END + CASE WHEN tier IN ('BID', 'MID', 'NO') THEN 15 ELSE 0 END + least(2 + n_files, 10) + n_restrictions)"
_ARCH = f"(archived OR lower(status) IN ({', '.join(repr(s) for s in register.DEAD_STATUS)}) OR (deadline <> '' AND deadline < '{AS_OF}'))"
_KEY = "'19AB' || lpad(cast(id as varchar), 7, '0') || 'Q'"

ORACLES = {
    "register_merge": oracle(f"""
WITH c AS (SELECT *, greatest(lastDeepScan, updated) AS stamp, {_RICH} AS rich FROM ({COPIES})),
a AS (SELECT * FROM c WHERE shard = 0), b AS (SELECT * FROM c WHERE shard = 1),
w AS (SELECT a.id, b.id IS NOT NULL AS two,
  CASE WHEN b.id IS NULL THEN true WHEN a.archived AND NOT b.archived AND a.stamp >= b.stamp THEN true WHEN b.archived AND NOT a.archived AND b.stamp >= a.stamp THEN false
       WHEN a.proven <> b.proven THEN a.proven WHEN a.rich <> b.rich THEN a.rich > b.rich ELSE a.stamp >= b.stamp END AS first FROM a LEFT JOIN b ON a.id = b.id),
k AS (SELECT w.id, two, CASE WHEN first THEN a ELSE b END AS k, CASE WHEN first THEN b ELSE a END AS o, a, b FROM w JOIN a ON a.id = w.id LEFT JOIN b ON b.id = w.id),
m AS (SELECT id, k.tier AS tier, CASE WHEN two AND k.deadline = '' AND NOT k.archived AND k.tier <> 'NO' THEN o.deadline ELSE k.deadline END AS deadline, k.status AS status, k.archived AS archived,
  CASE WHEN two THEN 'Site+SAM' ELSE k.source END AS source, k.verified AS verified, 1 + (a.n_files + 1) + CASE WHEN two THEN b.n_files + 1 ELSE 0 END AS n_files,
  CASE WHEN two THEN greatest(a.tries, b.tries) ELSE a.tries END AS tries, CASE WHEN two AND k.value = '' THEN o.value ELSE k.value END AS value,
  CASE WHEN two THEN greatest(a.lastDeepScan, b.lastDeepScan) ELSE a.lastDeepScan END AS scanned FROM k)
SELECT {_KEY} AS key, tier, deadline, CASE WHEN deadline <> '' AND deadline < '{AS_OF}' AND status = 'Active' THEN 'Expired' ELSE status END AS status, {_ARCH} AS archived, source, verified,
  n_files::BIGINT AS n_files, tries::BIGINT AS tries, value, scanned FROM m"""),
    "register_tally": oracle(f"""
WITH r AS (SELECT *, id % 17 = 0 AS deleted, id % 17 <> 0 AND id % 13 = 0 AS hidden, {_ARCH} AS over FROM ({COPIES})), t AS (SELECT *, NOT (deleted OR hidden OR over) AS active FROM r)
SELECT count(*) FILTER (WHERE active) AS active, count(*) FILTER (WHERE over AND NOT deleted AND NOT hidden) AS archived, count(*) FILTER (WHERE deleted) AS deleted, count(*) FILTER (WHERE hidden) AS hidden,
  count(*) FILTER (WHERE active AND tier = 'BID') AS bid, count(*) FILTER (WHERE active AND tier = 'MID') AS mid, count(*) FILTER (WHERE active AND tier = 'NO') AS no,
  count(*) FILTER (WHERE active AND tier = 'REVIEW') AS review, count(*) FILTER (WHERE active AND verified = 'VERIFIED') AS verified, count(*) FILTER (WHERE active AND verified <> 'VERIFIED') AS unverified FROM t"""),
    "operator_overlay": oracle(f"""
WITH r AS (SELECT id, tier, archived, id % 7 = 0 AND id % 14 <> 0 AS gone, id % 5 = 0 AS hid, id % 11 = 0 AND id % 22 <> 0 AS sw FROM ({COPIES}) WHERE shard = 0),
o AS (SELECT *, archived OR gone AS arch FROM r)
SELECT id, CASE WHEN sw THEN 'BID' ELSE tier END AS tier, arch AS archived, gone AS deleted, hid AND NOT (arch AND NOT gone) AS hidden, sw AS switched, hid AND arch AND NOT gone AS unhidden FROM o"""),
    "change_detection": oracle(f"""
WITH r AS (SELECT id, id % 5 <> 0 AS old, id % 3 <> 0 AS came FROM ({COPIES}) WHERE shard = 0),
s AS (SELECT CASE WHEN NOT came THEN 'kept' WHEN NOT old THEN 'new' WHEN id % 7 = 0 THEN 'changed' ELSE 'same' END AS state, CASE WHEN old THEN '2016-01-01' ELSE '{AS_OF}' END AS firstSeen FROM r WHERE old OR came)
SELECT state, firstSeen, count(*) AS n, count(*) FILTER (WHERE state = 'changed') AS n_dated FROM s GROUP BY ALL"""),
    "row_fingerprints": oracle(f"SELECT id, shard, substr(sha256(sol || '|' || title || '|' || deadline || '|' || status || '||' || link), 1, 16) AS fp FROM ({COPIES})"),
    "richness_score": oracle(f"SELECT id, shard, {_RICH}::BIGINT AS richness, greatest(lastDeepScan, updated) AS stamp FROM ({COPIES})"),
    "sol_normalise": oracle(f"""
WITH s AS (SELECT id, CASE WHEN id % 31 = 0 THEN 'Janitorial services' ELSE ['RFQ-' || id, '#19AB' || id || '-Q/1', 'Supply of ' || id || ' laptops for the office in town', 'no. ' || id || 'x', 'sol: ' || id][id % 5 + 1] END AS sol FROM ({DATED}))
SELECT id, regexp_replace(regexp_replace(upper(sol), '^(RFQ|RFP|ITB|IFB|SOL|NO\\.?|#)[\\s:#-]*', ''), '[^A-Z0-9]', '', 'g') AS base,
  CASE WHEN length(sol) > 30 OR NOT regexp_matches(replace(sol, ' ', ''), '(?i)^[A-Z0-9][A-Z0-9\\-/_.#]{{4,}}$') OR NOT regexp_matches(sol, '[0-9]') THEN '' ELSE sol END AS clean FROM s"""),
    "canonical_key_groups": oracle(f"""
WITH r AS (SELECT id, CASE WHEN id % 3 <> 0 THEN n_name END AS post, n_name FROM ({DATED}) o JOIN customer ON c_custkey = cust JOIN nation ON n_nationkey = c_nationkey)
SELECT CASE WHEN id % 5 = 0 THEN 'l/' || (id % 100) WHEN id % 5 = 1 THEN '19AB' || lpad((id % 1000)::VARCHAR, 6, '0')
  ELSE replace(coalesce(post, 'C' || n_name), '_', '') || ':' || CASE WHEN id % 2 = 0 THEN 'RFQ' ELSE 'RFP' END || ':' || (id % 50) END AS key, count(*) AS n FROM r GROUP BY 1"""),
    "previous_rows": oracle(f"""
SELECT id, CASE WHEN id % 2 = 0 THEN {_KEY} ELSE 'https://example.usembassy.gov/n/' || id END AS key, 'keep' AS notes FROM ({DATED})"""),
    "junk_filter": oracle(f"""
WITH r AS (SELECT id, id % 8 AS n, deadline, id % 9 = 0 AS kept FROM ({COPIES}) WHERE shard = 0)
SELECT id, NOT kept AND (n IN (0, 1) OR (n = 2 AND deadline = '') OR (n = 3 AND deadline = '')) AS junk FROM r"""),
    "repaired_rows": oracle(f"""
WITH r AS (SELECT *, CASE WHEN id % 4 = 0 THEN 'success' WHEN id % 4 = 1 THEN 'dead' WHEN id % 10 = 2 THEN 'fail' END AS res FROM ({COPIES}) WHERE shard = 0)
SELECT id, CASE res WHEN 'success' THEN '2017-01-01' WHEN 'dead' THEN '' ELSE deadline END AS deadline, CASE WHEN res = 'dead' THEN 'NO' ELSE tier END AS tier, archived OR coalesce(res = 'dead', false) AS archived,
  CASE res WHEN 'fail' THEN tries + 1 WHEN 'success' THEN 0 ELSE tries END::BIGINT AS tries, (CASE WHEN verified = 'VERIFIED' THEN 0 ELSE 1 END + CASE WHEN res = 'fail' AND tries + 1 >= 3 THEN 1 ELSE 0 END)::BIGINT AS n_notes FROM r"""),
    "status_rollup": """
WITH g AS (SELECT user_id AS shard, count(*) AS n, min(event_id) AS first, max(event_id) AS last, max((props::JSON ->> '$.k')::INT) AS k FROM events GROUP BY 1)
SELECT count(*) AS bots, lpad(min(first)::VARCHAR, 8, '0') AS startedAt, lpad(max(last)::VARCHAR, 8, '0') AS heartbeat, sum(CASE WHEN shard % 4 IN (0, 1) THEN n ELSE 0 END)::BIGINT AS found,
  sum(k)::BIGINT AS samCalls, min_by('error of ' || shard, shard) FILTER (WHERE shard % 10 = 9) AS lastError, min_by('ok ' || shard, shard) FILTER (WHERE shard % 3 <> 0) AS samDiag FROM g""",
    "coverage_last_wins": """
WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT event_type AS key, max_by(n, user_id) AS last_n, sum(n)::BIGINT AS total FROM g GROUP BY 1""",
    "coverage_by_country": "SELECT n_name AS country, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "spend_by_model": """
WITH u AS (SELECT ['model-haiku-1', 'model-sonnet-2', 'OPUS-3', 'other'][event_id % 4 + 1] || '-' || event_type AS model, event_id % 4 AS m, user_id * 1000 + event_id % 7 AS i, event_id % 500 AS o FROM events)
SELECT model, sum(i)::BIGINT AS tokens_in, sum(o)::BIGINT AS tokens_out, count(*) AS calls,
  round((sum(i) * [1, 3, 15, 1][any_value(m) + 1] + sum(o) * [5, 15, 75, 5][any_value(m) + 1])::DECIMAL(30, 6) / 1000000, 4)::DOUBLE AS usd FROM u GROUP BY model""",
    "spend_ledger": """
WITH u AS (SELECT event_id % 4 AS m, user_id * 1000 + event_id % 7 AS i, event_id % 500 AS o FROM events), s AS (SELECT sum(i * [1, 3, 15, 1][m + 1] + o * [5, 15, 75, 5][m + 1])::DECIMAL(30, 6) / 1000000 AS usd, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o, count(*) AS c FROM u)
SELECT i AS tokens_in, o AS tokens_out, c AS calls, round(usd, 4)::DOUBLE AS spent_usd, round(greatest(0, 40000 - round(usd, 4)), 4)::DOUBLE AS left_usd FROM s""",
    "access_probe": """
SELECT event_type AS identity, count(*) FILTER (WHERE event_id % 5 = 0) AS ok, count(*) FILTER (WHERE event_id % 5 IN (1, 4)) AS forbidden, count(*) FILTER (WHERE event_id % 5 IN (2, 3)) AS other FROM events GROUP BY 1""",
    "wants_estimate": oracle(f"SELECT verified = 'VERIFIED' AND tier IN ('BID', 'MID') AND NOT archived AND NOT regexp_matches(value, '[0-9]') AS wants, count(*) AS n FROM ({COPIES}) WHERE shard = 0 GROUP BY 1"),
    "estimate_sanity": """
WITH v AS (SELECT p_partkey, p_retailprice * CASE WHEN p_partkey % 3 = 0 THEN 2000 ELSE 12 END AS a, p_retailprice * 15 AS b, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice * 18 ELSE 0 END AS c FROM part WHERE p_partkey % 7 <> 0 AND (p_partkey % 10) / 10.0 >= 0.35),
r AS (SELECT p_partkey, least(a, b, CASE WHEN c > 0 THEN c ELSE a END) AS low, b AS likely, greatest(a, b, c) AS high FROM v),
m AS (SELECT *, list_transform([low, high], lambda x: CASE WHEN x >= 1000000 THEN '$' || printf('%.2f', round_even(x / 1000000, 2)) || 'M' WHEN x >= 1000 THEN '$' || round_even(x / 1000, 0)::BIGINT || 'K' ELSE '$' || round_even(x, 0)::BIGINT END) AS d FROM r)
SELECT p_partkey, low, likely, high, CASE WHEN high > low THEN d[1] || ' – ' || d[2] ELSE d[1] END AS display FROM m""",
    "expired_by_day": oracle(f"SELECT iso < '{AS_OF}' AS expired, count(*) AS n, max(iso) AS last FROM ({DATED}) GROUP BY 1"),
    "blocked_sites": "SELECT min(page_id) AS page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages GROUP BY 2",
}

ORACLES["register_upserts"] = ORACLES["register_merge"]

QUERIES = {
    f.__name__: f
    for f in (
        register_merge, register_upserts, register_tally, operator_overlay, change_detection, row_fingerprints, richness_score, sol_normalise, canonical_key_groups, previous_rows, junk_filter, repaired_rows,
        status_rollup, coverage_last_wins, coverage_by_country, spend_by_model, spend_ledger, access_probe, estimate_sanity, wants_estimate, expired_by_day, blocked_sites,
    )
}
