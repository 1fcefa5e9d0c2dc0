"""Queries over notices whose dates are composed from orders: scan, cue, proof, grounding, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import proof
from ..operators import rollup, verdicts
from .composed import AS_OF, CLAIMS, NOTICES, compose, oracle


def find_dates_composed(spark, d: str) -> DataFrame:
    return compose(spark, d, NOTICES).select("id", F.array_join(D.find_dates(F.col("text")), ",").alias("dates"))


def ambiguous_numeric_dates(spark, d: str) -> DataFrame:
    n = compose(spark, d, NOTICES)
    return n.select("id", F.array_join(D.ambiguous_dates(F.col("text")), ",").alias("readings"))


def nearest_cue_date(spark, d: str) -> DataFrame:
    n = compose(spark, d, NOTICES)
    return n.select("id", F.coalesce(D.nearest_after_cue(F.col("text"), D.scan_dates(F.col("text"))), F.lit("")).alias("due"))


def anchored_dates(spark, d: str) -> DataFrame:
    n = compose(spark, d, NOTICES).withColumn("hits", D.scan_dates(F.col("text")))
    return n.select("id", D.anchored(F.col("iso"), F.col("text"), F.col("hits")).alias("due_stands_by_cue"), D.date_evidence(F.col("later"), F.col("text"), F.col("hits")).isNotNull().alias("later_printed"))


def date_windows_len(spark, d: str) -> DataFrame:
    n = compose(spark, d, NOTICES).withColumn("long", F.concat(F.repeat(F.lit("filler "), 100), "text", F.repeat(F.lit(" filler"), 100)))
    return n.select("id", F.length(D.date_windows(F.col("long"), D.scan_dates(F.col("long")))).cast("bigint").alias("n_window"))


def quoted_date_proof(spark, d: str) -> DataFrame:
    c = compose(spark, d, CLAIMS)
    real = proof.quote_contained(F.col("closing_quote"), F.col("text"))
    why = proof.quoted_date(F.col("closing"), F.col("closing_quote"), real, D.find_dates(F.col("closing_quote")), D.find_dates(F.col("text")))
    return c.select("id", why.alias("why"))


#: Quotes cut from notices: case or white space changed, one character altered at any place, too short, or
#: nowhere in it.
QUOTED = f"""
SELECT *, CASE id % 6 WHEN 0 THEN upper(substr(text, 5, 30)) WHEN 1 THEN replace(substr(text, 5, 30), ' ', '  ') WHEN 2 THEN substr(text, 1, 12)
  WHEN 3 THEN 'these words stand nowhere in it' ELSE substr(text, 3, cast(id % 37 as int)) || '#' || substr(text, cast(4 + id % 37 as int), cast(40 - id % 37 as int)) END AS quote
FROM ({NOTICES}) AS notices
"""


def citation_contains(spark, d: str) -> DataFrame:
    return proof.with_citation_proof(compose(spark, d, QUOTED), "quote", "text", "proven").select("id", "proven")


def ground_dates_outcomes(spark, d: str) -> DataFrame:
    g = verdicts.ground_dates(compose(spark, d, CLAIMS))
    return g.select(
        "id", "closing", "posted", F.coalesce(F.try_element_at("date_proof", F.lit("closing")), F.lit("")).alias("proof"),
        F.array_join("dropped", ",").alias("dropped"), F.size("date_warnings").cast("bigint").alias("n_warnings"),
    )


def verification_state(spark, d: str) -> DataFrame:
    c = compose(spark, d, CLAIMS)
    tier = F.element_at(F.array(*[F.lit(t) for t in ("BID", "NO", "REVIEW")]), (F.col("id") % 3 + 1).cast("int"))
    title = F.when(F.col("id") % 11 != 0, F.lit("A title"))
    state = verdicts.verification((F.col("id") % 9 == 0).cast("int"), F.col("closing"), F.col("closing_quote"), F.array().cast("array<string>"), title, tier, F.col("id") % 2 == 0)
    return c.select("id", state["verified"].alias("verified"), F.size(state["reasons"]).cast("bigint").alias("n_reasons"))


_QUOTES = (
    "This award is a total small business set-aside under the rules that apply",
    "Quotations are due by the end of the month and no later than noon of that day",
    "The mission requires the services of a local qualified supplier; the firm must be licensed",
    "Economic Opportunity",
    "Offers are restricted to firms that are nationals of and registered in the country",
    "The supplier brings all tools and parts that the work needs to the site",
)


def tier_gates(spark, d: str) -> DataFrame:
    c = compose(spark, d, NOTICES)
    quote = F.element_at(F.array(*[F.lit(q) for q in _QUOTES]), (F.col("id") % 6 + 1).cast("int"))
    rows = c.select(
        "id", F.when(F.col("id") % 4 == 0, "BID").otherwise("NO").alias("tier"), ((F.col("id") % 10) / 10).alias("confidence"), F.lit("").alias("route"), F.lit("").alias("review_reason"),
        F.struct(F.lit("doc").alias("doc"), quote.alias("quote")).alias("citation"), (F.col("id") % 7 != 0).alias("quote_real"),
    )
    g = verdicts.tier_gates(rows)
    return g.select("id", "tier", "review_reason", F.coalesce("overturned", F.lit("")).alias("overturned"), F.col("citation").isNotNull().alias("cited"))


def rule_vs_reader_eval(spark, d: str) -> DataFrame:
    g = verdicts.ground_dates(compose(spark, d, CLAIMS).withColumn("hits", D.scan_dates(F.col("text"))), hits="hits")
    hits = F.col("hits")
    return rollup.evaluate_readers(g.select(F.col("closing").alias("deadline"), F.try_element_at("date_proof", F.lit("closing")).alias("how"), D.nearest_after_cue(F.col("text"), hits).alias("rule"), F.transform(hits, lambda h: h["iso"]).alias("printed")))


def unit_outcomes(spark, d: str) -> DataFrame:
    c = compose(spark, d, CLAIMS).withColumns({
        "text": F.when(F.col("id") % 8 == 0, F.lit("thin")).otherwise(F.rpad("text", 200, "x")), "known": F.col("id") % 9 == 0, "is_solicitation": F.col("id") % 10 != 0,
        "status": F.when(F.col("id") % 11 == 0, "closed").otherwise("open"), "adjudicated": F.col("id") % 13 != 0,
    })
    return verdicts.outcome(c, AS_OF).groupBy("outcome", "makes_row", "settled").agg(F.count(F.lit(1)).alias("n"))


def coerced_answers(spark, d: str) -> DataFrame:
    """Answers as they come: fenced, wordy, malformed in every field."""
    c = compose(spark, d, NOTICES)
    n = F.col("id") % 6
    raw = (
        F.when(n == 0, F.format_string('{"tier":"bid","sector":"cots","confidence":0.%d,"line_items":["a","b"],"citation":{"doc":"d","quote":"q"}}', F.col("id") % 10))
        .when(n == 1, F.lit('```json\n{"tier":"NO","confidence":"high","closing":{"a":1}}\n```'))
        .when(n == 2, F.lit('Sure: {"tier":"other","confidence":7,"restrictions":{"text":"x"}} done'))
        .when(n == 3, F.lit('{"tier":"MID","restrictions":[{"text":"t","kind":"boiler","note":"n"},{"text":"register in SAM.gov","kind":"real","note":""}],"route":""}'))
        .when(n == 4, F.lit("no answer")).otherwise(F.lit(None))
    )
    out = verdicts.strip_registration(verdicts.coerce(c.select("id", raw.alias("raw"))))
    return out.select("id", "tier", "sector", "confidence", F.size("line_items").cast("bigint").alias("n_items"), F.size("restrictions").cast("bigint").alias("n_restrictions"), F.col("citation").isNotNull().alias("cited"), "malformed")


_TWO = "(form = 1 AND d <= 12 AND m <> d)"
_SWAP = "(cast(y as string) || '-' || lpad(cast(d as string), 2, '0') || '-' || lpad(cast(m as string), 2, '0'))"
_FOUND = f"""CASE form WHEN 0 THEN [iso, later] WHEN 1 THEN CASE WHEN {_TWO} THEN list_sort([iso, {_SWAP}]) ELSE [iso] END WHEN 2 THEN [visit, iso] WHEN 3 THEN [iso] WHEN 4 THEN [later] ELSE [] END"""
_DUE = f"CASE WHEN form IN (0, 2, 3) OR (form = 1 AND NOT {_TWO}) THEN iso ELSE '' END"
#: The claims with what is proven of each, from the columns alone.
_PROVEN = f"""
SELECT *, list_contains({_FOUND}, closing) AS printed, closing_quote = text AND length(trim(text)) >= 15 AS real_quote,
       closing = iso AND form IN (0, 1, 2, 3) AS by_cue FROM ({CLAIMS})
"""

ORACLES = {
    "find_dates_composed": oracle(f"SELECT id, array_to_string({_FOUND}, ',') AS dates FROM ({NOTICES})"),
    "ambiguous_numeric_dates": oracle(f"SELECT id, CASE WHEN {_TWO} THEN array_to_string(list_sort([iso, {_SWAP}]), ',') ELSE '' END AS readings FROM ({NOTICES})"),
    "nearest_cue_date": oracle(f"SELECT id, {_DUE} AS due FROM ({NOTICES})"),
    "anchored_dates": oracle(f"SELECT id, form IN (0, 1, 2, 3) AS due_stands_by_cue, list_contains({_FOUND}, later) AS later_printed FROM ({NOTICES})"),
    "quoted_date_proof": oracle(f"""
SELECT id, CASE WHEN closing = '' THEN 'no date' WHEN closing_quote = '' THEN 'no quote' WHEN closing_quote <> text THEN 'quote not in document'
  WHEN NOT printed THEN 'date not in quote' ELSE '' END AS why FROM ({_PROVEN})"""),
    "citation_contains": oracle(f"""
WITH n AS (SELECT id, lower(trim(regexp_replace(quote, '[ ]+', ' ', 'g'))) AS q, lower(trim(regexp_replace(text, '[ ]+', ' ', 'g'))) AS s FROM ({QUOTED}))
SELECT id, length(q) >= 15 AND (contains(s, q) OR len(list_filter(range(0, length(q) - greatest(25, floor(0.6::DOUBLE * length(q))::BIGINT) + 1),
  lambda i: contains(s, substr(q, i + 1, greatest(25, floor(0.6::DOUBLE * length(q))::BIGINT))))) > 0) AS proven FROM n"""),
    "ground_dates_outcomes": oracle(f"""
SELECT id, CASE WHEN closing = '' THEN '' WHEN real_quote AND printed THEN closing WHEN by_cue THEN closing WHEN near THEN closing ELSE '' END AS closing, posted,
  CASE WHEN closing = '' THEN '' WHEN real_quote AND printed THEN 'quoted' WHEN by_cue OR near THEN 'phrase' ELSE '' END AS proof,
  CASE WHEN closing = '' OR (real_quote AND printed) OR by_cue OR near THEN '' ELSE 'closing' END AS dropped,
  (CASE WHEN closing = '' OR (real_quote AND printed) THEN 0 WHEN (by_cue OR near) AND closing_quote = '' THEN 0 ELSE 1 END
   + CASE WHEN posted <> '' AND closing <> '' AND ((real_quote AND printed) OR by_cue OR near) AND closing < posted THEN 1 ELSE 0 END)::BIGINT AS n_warnings
FROM (SELECT *, form = 0 AND closing = later AS near FROM ({_PROVEN}))"""),
    "verification_state": oracle(f"""
WITH r AS (SELECT id, (id % 9 = 0)::INT + CASE WHEN closing = '' THEN 1 WHEN closing_quote = '' THEN 1 ELSE 0 END + (id % 11 = 0)::INT + (id % 3 = 2)::INT + (id % 3 = 1 AND id % 2 <> 0)::INT AS n FROM ({CLAIMS}))
SELECT id, CASE WHEN n = 0 THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS verified, n::BIGINT AS n_reasons FROM r"""),
    "tier_gates": oracle(f"""
WITH r AS (SELECT id, id % 4 <> 0 AS no, id % 7 <> 0 AS quoted, id % 6 AS q, (id % 10) / 10.0::DOUBLE AS c FROM ({NOTICES})),
g AS (SELECT *, no AND NOT quoted AS fake, no AND quoted AND q IN (1, 2, 3, 5) AS weak, CASE q WHEN 1 THEN 'deadline' WHEN 2 THEN 'local firm' WHEN 3 THEN 'too short' WHEN 5 THEN 'no restriction' END AS why FROM r),
t AS (SELECT *, CASE WHEN NOT no THEN 'BID' WHEN fake THEN 'REVIEW' WHEN weak AND q = 2 THEN 'MID' WHEN weak THEN 'REVIEW' ELSE 'NO' END AS tier,
  CASE WHEN fake THEN 'no-bid rejected: cited clause not found' WHEN weak THEN 'no-bid rejected: ' || why ELSE '' END AS reason FROM g)
SELECT id, CASE WHEN tier <> 'REVIEW' AND c < 0.5 THEN 'REVIEW' ELSE tier END AS tier,
  CASE WHEN reason = '' AND tier <> 'REVIEW' AND c < 0.5 THEN 'low confidence (' || printf('%.2f', c) || ')' ELSE reason END AS review_reason,
  CASE WHEN weak THEN why ELSE '' END AS overturned, NOT (fake OR weak) AS cited FROM t"""),
    "rule_vs_reader_eval": oracle(f"""
WITH g AS (SELECT *, closing <> '' AND ((real_quote AND printed) OR by_cue OR (form = 0 AND closing = later)) AS ok, {_DUE} AS rule, len({_FOUND}) AS n FROM ({_PROVEN}))
SELECT count(*) AS notices, count(*) FILTER (WHERE ok) AS resolved, round(100.0 * count(*) FILTER (WHERE ok) / greatest(count(*), 1), 1)::DOUBLE AS resolved_pct,
  count(*) FILTER (WHERE NOT ok AND n > 0) AS dates_but_none, count(*) FILTER (WHERE ok AND rule <> '' AND rule <> closing) AS rule_differs,
  count(*) FILTER (WHERE ok AND real_quote AND printed) AS by_quote, count(*) FILTER (WHERE ok AND NOT (real_quote AND printed)) AS by_phrase FROM g"""),
    "unit_outcomes": oracle(f"""
WITH o AS (SELECT CASE WHEN id % 8 = 0 THEN 'thin' WHEN id % 9 = 0 THEN 'duplicate' WHEN id % 10 = 0 THEN 'not_solicitation' WHEN id % 11 = 0 THEN 'expired' WHEN closing <> '' AND closing < '{AS_OF}' THEN 'expired'
  WHEN closing = '' THEN 'no_date' WHEN id % 13 = 0 THEN 'abandoned' ELSE 'complete' END AS outcome FROM ({CLAIMS}))
SELECT outcome, outcome IN ('expired', 'no_date', 'complete') AS makes_row, outcome NOT IN ('abandoned', 'no_date') AS settled, count(*) AS n FROM o GROUP BY outcome"""),
    "coerced_answers": oracle(f"""
SELECT id, CASE id % 6 WHEN 0 THEN 'BID' WHEN 1 THEN 'NO' WHEN 3 THEN 'BID' ELSE 'REVIEW' END AS tier, CASE id % 6 WHEN 0 THEN 'COTS' ELSE '' END AS sector,
  CASE id % 6 WHEN 0 THEN (id % 10) / 10.0 WHEN 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence, CASE id % 6 WHEN 0 THEN 2 ELSE 0 END::BIGINT AS n_items,
  CASE id % 6 WHEN 3 THEN 1 ELSE 0 END::BIGINT AS n_restrictions, id % 6 = 0 AS cited, id % 6 >= 4 AS malformed FROM ({NOTICES})"""),
}

QUERIES = {
    f.__name__: f
    for f in (
        find_dates_composed, ambiguous_numeric_dates, nearest_cue_date, anchored_dates, date_windows_len, quoted_date_proof, citation_contains, ground_dates_outcomes,
        verification_state, tier_gates, rule_vs_reader_eval, unit_outcomes, coerced_answers,
    )
}
