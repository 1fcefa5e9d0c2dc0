"""Secret scanning over an incremental ledger of content-addressed blobs."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import table, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret. pattern: what is matched, leftmost and without overlap; then matches whose
    group is shorter than min_length are dropped. Raising version makes every blob unseen again."""

    kind: str
    pattern: str
    min_length: int
    group: int = 0
    version: int = 1


#: The base kinds, in the order in which spans at one start are listed. A run of hex digits or of an
#: access key is matched whole, so the least length can stand in the pattern.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
#: Kinds beyond the base: private key headers and tokens with a fixed public prefix.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 1),
    Rule("prefixed", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
)
RULES = BASE_RULES + MORE_RULES


_SPANS = "array<struct<start:int,end:int,rule:string>>"


def _steps(text: Column, rule: Rule) -> Column:
    """The matches of a rule in text as (gap before it, its length, length of its group), in code
    points; null where there is none. Matches and the gaps between them alternate."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    pairs = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), matches.alias("hit"), values.alias("value"))
    lengths = F.transform(pairs, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["value"]).alias("value")))
    return F.when(text.rlike(rule.pattern), lengths)


def _name(rule: Rule) -> str:
    return f"{rule.kind}:{rule.version}"


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows (blob, rules: names of the rule versions tried, spans: array of (start, end, rule))
    of blobs (blob, text, missing: names of the rules to try). A blob that stands twice gives two.

    A task reads each text once and keeps the lengths of gaps and matches; only those of blobs with
    a match go on, where a running sum over the matches of a blob turns lengths into offsets, in
    time linear in the matches however many a text holds."""
    tried = [F.when(F.array_contains("missing", _name(r)), _steps(F.col("text"), r)).alias(f"r{i}") for i, r in enumerate(rules)]
    read = blobs.select("blob", F.col("missing").alias("rules"), *tried).withColumn("scan", F.monotonically_increasing_id())
    read = written(read, "secret-scan")
    none = F.forall(F.array(*[F.col(f"r{i}").isNull() for i in range(len(rules))]), lambda x: x)
    clean = read.where(none).select("blob", "rules", F.array().cast(_SPANS).alias("spans"))
    hits = None
    for i, r in enumerate(rules):
        own = read.where(F.col(f"r{i}").isNotNull()).select("scan", F.lit(_name(r)).alias("rule"), F.lit(r.min_length).alias("least"), F.posexplode(f"r{i}").alias("pos", "step"))
        hits = own if hits is None else hits.unionByName(own)
    up_to = Window.partitionBy("scan", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = hits.select("scan", "rule", "least", "pos", "step.*").where("hit IS NOT NULL")
    hits = hits.withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(up_to).cast("int")).where("value >= least")
    found = hits.groupBy("scan").agg(F.collect_list(F.struct((F.col("end") - F.col("hit")).alias("start"), "end", "rule")).alias("spans"))
    rest = read.where(~none).select("scan", "blob", "rules").join(found, "scan", "left")
    return clean.unionByName(rest.select("blob", "rules", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans")))


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(paths, new): paths has doc_id and the blob (SHA-256) of each row of docs; new has the ledger
    rows (blob, rules, spans) of the pairs of a blob and a rule version that ledger doesn't hold yet.

    Each blob is scanned once, in one copy, and only with the rules whose version it hasn't seen: a
    new blob with all, an old one with those added or raised since. Copies of a blob, be they rows
    repeated or rows without an id, become one within each task before they are dealt by blob, so a
    large group of copies costs a row a task. A null text is the empty blob.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    blob = F.unhex(F.sha2(body, 256))
    paths = written(docs.select("doc_id", blob.alias("blob")), "secret-paths")
    every = F.array(*[F.lit(_name(r)) for r in rules])
    todo = paths.select("blob").distinct().withColumn("missing", every)
    if ledger is not None:
        seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = todo.join(seen, "blob", "left").withColumn("missing", F.when(F.col("seen").isNull(), every).otherwise(F.array_except(every, "seen"))).drop("seen")
        todo = written(todo.where(F.size("missing") > 0), "secret-todo")
    texts = docs.select(blob.alias("blob"), body.alias("text")).dropDuplicates(["blob"])
    return paths, written(scan(texts.join(todo, "blob").select("blob", "text", "missing"), rules), "secret-ledger")


def join_findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (start, end, rule) of each row of paths (doc_id, blob): what the ledger holds of
    its blob for these rule versions, by start, then in the order of rules."""
    order = F.array(*[F.lit(_name(r)) for r in rules])
    hits = ledger.where(F.size("spans") > 0).select("blob", F.filter("spans", lambda s: F.array_contains(order, s["rule"])).alias("spans"))
    hits = hits.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans")).where(F.size("spans") > 0)
    ranked = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["rule"]).alias("rank"), s["end"].alias("end"), s["rule"].alias("rule"))))
    hits = hits.select("blob", F.transform(ranked, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rule"].alias("rule"))).alias("spans"))
    return paths.join(written(hits, "secret-hits"), "blob", "left").select("doc_id", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.split_part(s["rule"], F.lit(":"), F.lit(1)), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): a row for each row of docs with doc_id and spans (start, end, rule), by
    start, then in the order of rules; and the ledger to hand to the next run. Findings of a blob reach
    every row that holds it, whatever its id; those of other rules or versions don't count. A null
    doc_id stays null. An empty table gives no rows."""
    paths, new = update_ledger(docs, ledger, rules, text)
    whole = new if ledger is None else ledger.unionByName(new)
    return join_findings(paths, whole, rules), whole


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    found, _ = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = [_name(r) for r in BASE_RULES]
    base = F.filter("spans", lambda s: s["rule"].isin(*names))
    n_of = lambda name: F.size(F.filter("spans", lambda s: s["rule"] == name)).cast("long")
    return found.select(
        "doc_id", *[n_of(_name(r)).alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
    )


#: Rules of an earlier day: hex runs in a version since raised, and no tokens with a prefix.
EARLIER = tuple(replace(r, version=0) if r.kind == "hex" else r for r in RULES if r.kind != "prefixed")


def secret_rescan(spark, sf_dir: str) -> DataFrame:
    """The second day of a ledger: the first day saw the documents of up to 1000 characters with earlier
    rules, the second sees all with the rules of today. n_new: rule versions that the second day
    tried on the document's blob."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    _, ledger = find_secrets(docs.where(F.length("text") <= 1000), rules=EARLIER)
    rows = docs.withColumn("doc_id", F.struct("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob")))
    paths, new = update_ledger(rows, ledger)
    found = join_findings(paths, ledger.unionByName(new))
    tried = new.select(F.col("blob").alias("new_blob"), F.size("rules").cast("long").alias("n_new"))
    joined = found.join(tried, F.col("doc_id.blob") == F.col("new_blob"), "left")
    return joined.select(F.col("doc_id.doc_id").alias("doc_id"), _listed(F.col("spans")).alias("spans"), F.coalesce("n_new", F.lit(0).cast("long")).alias("n_new"))


def _rule_sql(order: int, rule: Rule) -> str:
    pattern = "'" + rule.pattern.replace("'", "''") + "'"
    value = f"regexp_extract_all(text, {pattern}, {rule.group})"
    gaps = f"string_split_regex(text, {pattern})"
    return f"""
  SELECT doc_id, {order} AS ord, '{rule.kind}' AS kind, values[i] AS value,
         list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS s,
         length(hits[i]) AS n
  FROM (SELECT *, unnest(generate_series(1, len(hits))) AS i FROM
        (SELECT doc_id, {gaps} AS gaps, regexp_extract_all(text, {pattern}) AS hits, {value} AS values FROM d))
  WHERE length(values[i]) >= {rule.min_length}"""


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_rule_sql(i, r) for i, r in enumerate(RULES))}
), per AS (
  SELECT doc_id, count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access,
         count(*) FILTER (WHERE ord = 2) AS n_hex,
         string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, ord) FILTER (WHERE ord < {len(BASE_RULES)}) AS base,
         string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, ord) AS spans
  FROM found GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per ON d.doc_id = per.doc_id
"""

RESCAN_ORACLE = f"""
WITH s AS ({ORACLE}), old AS (SELECT DISTINCT text FROM documents WHERE length(text) <= 1000)
SELECT s.doc_id, s.spans, CASE WHEN old.text IS NULL THEN {len(RULES)} ELSE {len({_name(r) for r in RULES} - {_name(r) for r in EARLIER})} END::BIGINT AS n_new
FROM s JOIN documents d ON d.doc_id = s.doc_id LEFT JOIN old ON old.text = coalesce(d.text, '')
"""
