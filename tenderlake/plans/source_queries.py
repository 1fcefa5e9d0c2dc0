"""Queries over what has landed: files of several encodings, ZIP members, damaged records, snapshots,
candidates, published tables."""

from __future__ import annotations

import io
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared_dir
from ..functions import text
from ..operators import history, units
from ..sources import readers, records, sinks
from .composed import read
from .text_queries import _LINKS, HINTS

#: Documents of a ZIP file.
BOX = 20
#: Versions of pages that are made up from each.
VERSIONS = 6


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def landed_files(spark, d: str) -> DataFrame:
    """URLs of pages, landed as a file for each of forty buckets: half of them in UTF-8, half in UTF-16 without
    a mark, and some with a suffix that isn't asked for."""
    pages = read(spark, d, "pages").select((F.col("page_id") % 40).alias("bucket"), "page_id", "url").repartition("bucket").sortWithinPartitions("bucket", "page_id")
    place = _place(spark, "landed")
    pages.where("bucket % 4 < 2").select("bucket", "url").write.partitionBy("bucket").text(f"{place}/plain")
    pages.where("bucket % 4 >= 2").select("bucket", "url").write.partitionBy("bucket").option("encoding", "UTF-16LE").option("quote", "").csv(f"{place}/wide")
    pages.where("bucket = 0").select("bucket", "url").write.partitionBy("bucket").json(f"{place}/other")
    out = readers.read_documents(readers.landed(spark, place, (".txt", ".csv")))
    return out.select(F.regexp_extract("url", r"bucket=(\d+)", 1).cast("bigint").alias("bucket"), F.sha2("text", 256).alias("text"), "note", "truncated")


def _boxed(group: pa.Table) -> pa.Table:
    """A ZIP file of some documents, each in an encoding of its own, every fifth in a ZIP inside."""
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as box:
        for i, t in sorted(zip(group.column("doc_id").to_pylist(), group.column("text").to_pylist(), strict=True)):
            name, raw = f"{i}.txt", (t or "").encode(("utf-8", "utf-8-sig", "utf-16")[i % 3])
            if i % 5 == 0:
                inner = io.BytesIO()
                with zipfile.ZipFile(inner, "w") as within:
                    within.writestr(name, raw)
                name, raw = f"{i}.zip", inner.getvalue()
            box.writestr(name, raw)
    return pa.table({"url": [f"box-{group.column('box')[0].as_py()}.zip"], "content": pa.array([body.getvalue()], pa.binary()), "content_type": ["application/zip"]})


def zipped_members(spark, d: str) -> DataFrame:
    """Documents put into ZIP files, read back member by member."""
    docs = read(spark, d, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / BOX).alias("box"))
    boxes = docs.groupBy("box").applyInArrow(_boxed, "url string, content binary, content_type string")
    out = readers.read_documents(boxes)
    return out.select("url", "member", F.sha2("text", 256).alias("text"), "truncated")


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _office(group: pa.Table) -> pa.Table:
    """The suppliers of a nation as three files: paragraphs and a table, two sheets, rich text."""
    nation = group.column("s_nationkey")[0].as_py()
    rows = sorted(zip(group.column("s_suppkey").to_pylist(), group.column("s_name").to_pylist(), strict=True))
    paragraphs = "".join(f"<w:p><w:r><w:t>{name}</w:t></w:r></w:p>" for _, name in rows)
    cells = lambda *values: "".join(f"<w:tc><w:p><w:r><w:t>{v}</w:t></w:r></w:p></w:tc>" for v in values)
    table = "".join(f"<w:tr>{cells(key, name)}</w:tr>" for key, name in rows)
    sheet = lambda key: "".join(f'<row><c t="s"><v>{i}</v></c><c><v>{k if key else -k}</v></c></row>' for i, (k, _) in enumerate(rows))
    members = {
        "docx": {"word/document.xml": f"<w:document {_W}><w:body>{paragraphs}<w:tbl>{table}</w:tbl></w:body></w:document>"},
        "xlsx": {
            "xl/workbook.xml": f'<workbook {_M}><sheets><sheet name="Keys"/><sheet name="Less"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {_M}>{''.join(f'<si><t>{name}</t></si>' for _, name in rows)}</sst>",
            "xl/worksheets/sheet1.xml": f"<worksheet {_M}><sheetData>{sheet(True)}</sheetData></worksheet>", "xl/worksheets/sheet2.xml": f"<worksheet {_M}><sheetData>{sheet(False)}</sheetData></worksheet>",
        },
    }
    out = {"rtf": ("{\\rtf1\\ansi {\\b Suppliers} " + " ".join(name for _, name in rows) + "}").encode()}
    for kind, files in members.items():
        body = io.BytesIO()
        with zipfile.ZipFile(body, "w") as box:
            for name, text_ in files.items():
                box.writestr(name, text_)
        out[kind] = body.getvalue()
    # Every second one without a telling name: its bytes tell its kind.
    return pa.table({"url": [f"{nation}.{kind}" if nation % 2 else f"{nation}-{kind}" for kind in out], "content": pa.array(list(out.values()), pa.binary()), "content_type": pa.array([None] * len(out), pa.string())})


def office_files(spark, d: str) -> DataFrame:
    """Suppliers as text documents, workbooks and rich text, read back."""
    suppliers = read(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name")
    files = suppliers.groupBy("s_nationkey").applyInArrow(_office, "url string, content binary, content_type string")
    return readers.read_documents(files).select("url", F.sha2("text", 256).alias("text"), "note")


def robots_rules(spark, d: str) -> DataFrame:
    """Pages under robots.txt files of their hosts: some close a part, some all to others, some are missing."""
    pages = read(spark, d, "pages").select("page_id", "url")
    hosts = pages.select(text.host(F.col("url")).alias("host")).distinct()
    closed = F.when(F.col("host").startswith("m."), F.lit("User-agent: *\nDisallow: /en/\n")).when(F.col("host").startswith("www."), F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow:\n")).otherwise(F.lit("User-agent: *\nDisallow: /\n"))
    robots = hosts.where(~F.col("host").endswith(".org")).select("host", closed.alias("body"))
    return readers.robots_allowed(pages, robots).select("page_id", "allowed")


def json_documents(spark, d: str) -> DataFrame:
    """Customers as a JSON document for each nation, some of them cut short, and a document that isn't there."""
    place, key = _place(spark, "json"), F.col("c_custkey")
    row = F.struct(key.alias("key"), F.when(key % 7 == 0, F.lit("many")).otherwise((key % 5).cast("string")).alias("n"))
    documents = read(spark, d, "customer").groupBy("c_nationkey").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("body"))
    cut = F.when(F.col("c_nationkey") % 6 == 1, F.substring("body", 1, 30)).otherwise(F.col("body"))
    documents.select("c_nationkey", cut.alias("body")).write.partitionBy("c_nationkey").text(place)
    schema = "key bigint, n string"
    found = readers.json_table(spark, place, schema).select("key", "n", F.col("_corrupt_record").isNotNull().alias("damaged"))
    missing = readers.json_table(spark, f"{place}-not-there", schema).select("key", "n", F.lit(True).alias("damaged"))
    return found.unionByName(missing).groupBy("damaged", "n").agg(F.count(F.lit(1)).alias("rows"), F.sum("key").alias("keys"))


#: Records of twenty sources; one source wholly cut short, others here and there, some numbers as words.
_LINES = """
SELECT 'shard-' || cast(event_id % 20 as string) AS source, CASE WHEN event_id % 20 = 7 OR event_id % 13 = 5 THEN substr(props, 1, 4)
  WHEN event_id % 11 = 3 THEN '{{"k": "' || cast(event_id % 100 as string) || '"}}' WHEN event_id % 17 = 4 THEN '' ELSE props END AS raw, event_id, props FROM {events}
"""


def damaged_records(spark, d: str) -> DataFrame:
    """Per source: good and damaged records, those that a second reading of the damaged ones won back, the
    sum of what was read, and what became of the source in the first run."""
    place, schema = _place(spark, "records"), "k int"
    lines = spark.sql(_LINES, events=read(spark, d, "events"))
    records.ingest(lines, schema, place)
    records.retry(spark, place, schema, 0, lambda raw: F.regexp_replace(raw, r'"(\d+)"', "$1"))
    first, second = (records.good(spark, place, schema, run).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k")) for run in (0, 1))
    second = second.select("source", F.col("n").alias("won_back"), F.col("k").alias("more"))
    log = records.source_log(spark, place).join(first, "source", "left").join(second, "source", "left")
    zero = F.lit(0).cast("long")
    return log.select("source", "good", "damaged", F.coalesce("won_back", zero).alias("won_back"), (F.coalesce("k", zero) + F.coalesce("more", zero)).alias("total"), "state")


def link_history(spark, d: str) -> DataFrame:
    """Links of pages in several snapshots, in some of which a link or the whole page is missing."""
    links = units.links(read(spark, d, "pages").select("page_id", "url", "html"))
    at = F.explode(F.sequence(F.lit(0), F.lit(VERSIONS - 1))).alias("at")
    snapshots = read(spark, d, "pages").select("page_id", at).where((F.col("page_id") + F.col("at")) % 7 != 0)
    shown = links.select("page_id", "pos", "href", at).where(((F.col("page_id") + F.col("at")) % 7 != 0) & ((F.col("pos") * 7 + F.col("page_id") + F.col("at") * F.col("at")) % 5 < 3))
    return history.presence(shown, snapshots, "page_id").withColumn("stay", F.col("stay").cast("bigint"))


def page_versions(spark, d: str) -> DataFrame:
    at = F.explode(F.sequence(F.lit(0), F.lit(2 * VERSIONS))).alias("at")
    pages = read(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("h"), at)
    change = F.floor(F.col("at") * (1 + F.col("page_id") % 3) / 4) % 3
    texts = pages.select("page_id", "at", F.sha2(F.concat("h", F.lit("-"), change.cast("string")), 256).alias("text_hash")).where((F.col("page_id") + F.col("at")) % 9 != 4)
    return history.versions(texts, "page_id").select("page_id", "version", F.substring("text_hash", 1, 16).alias("text_hash"), "since", "last_seen", "n_seen", "replaced_at")


def candidate_links(spark, d: str) -> DataFrame:
    """Links of pages, every fourth of them a document, parted into documents and pages worth reading."""
    links = units.links(read(spark, d, "pages").select("page_id", "url", "html"))
    href = F.when(F.col("pos") % 4 == 0, F.concat("href", F.lit(".PDF?v=1"))).otherwise(F.concat("href", F.lit("#top")))
    return units.candidates(links.withColumns({"url": F.col("page_id").cast("string"), "href": href}), HINTS).withColumn("rank", F.col("rank").cast("bigint"))


def page_lines(spark, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.sha2(text.html_lines(F.col("html")), 256).alias("lines"))


def published_tables(spark, d: str) -> DataFrame:
    """Tables written by the sink and read back as the rows of one bundle."""
    place = _place(spark, "published")
    given = {"nation": read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "customer": read(spark, d, "customer").select("c_custkey", "c_nationkey")}
    sinks.write_tables(given, place)
    return sinks.bundle({name: spark.read.parquet(f"{place}/{name}") for name in given})


_ENDS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_CLEAN = rf"regexp_replace(regexp_replace(regexp_replace({{}}, '\n{{{{3,}}}}', chr(10) || chr(10), 'g'), '[ \t\x{{{{a0}}}}]{{{{2,}}}}', ' ', 'g'), '^{_ENDS.replace('{', '{{').replace('}', '}}')}|{_ENDS.replace('{', '{{').replace('}', '}}')}$', '', 'g')"
_CONTENT = "html"
for _tag in ("script", "style", "nav", "footer", "header", "noscript"):
    _CONTENT = rf"regexp_replace({_CONTENT}, '(?is)<{_tag}\b.*?</{_tag}\s*>', chr(10), 'g')"

ORACLES = {
    "landed_files": f"""
SELECT page_id % 40 AS bucket, sha256({_CLEAN.format("string_agg(url, chr(10) ORDER BY page_id)")}) AS text, '' AS note, false AS truncated FROM pages GROUP BY 1""",
    "zipped_members": f"""
SELECT 'box-' || (doc_id // {BOX}) || '.zip' AS url, CASE WHEN doc_id % 5 = 0 THEN doc_id || '.zip/' ELSE '' END || doc_id || '.txt' AS member,
  sha256({_CLEAN.format("replace(coalesce(text, ''), chr(0), ' ')")}) AS text, false AS truncated FROM documents""",
    "office_files": r"""
WITH f AS (SELECT s_nationkey AS n, string_agg(s_name, chr(10) ORDER BY s_suppkey) || chr(10) || string_agg(s_suppkey || ' | ' || s_name, chr(10) ORDER BY s_suppkey) AS docx,
  '[SHEET: Keys]' || chr(10) || string_agg(s_name || ' | ' || s_suppkey, chr(10) ORDER BY s_suppkey) || chr(10) || '[SHEET: Less]' || chr(10) || string_agg(s_name || ' | ' || -s_suppkey, chr(10) ORDER BY s_suppkey) AS xlsx,
  'Suppliers ' || string_agg(s_name, ' ' ORDER BY s_suppkey) AS rtf FROM supplier GROUP BY 1),
k AS (SELECT n, unnest([docx, xlsx, rtf]) AS text, unnest(['docx', 'xlsx', 'rtf']) AS kind FROM f)
SELECT n || CASE WHEN n % 2 = 1 THEN '.' ELSE '-' END || kind AS url, sha256(trim(regexp_replace(text, '[ ]{2,}', ' ', 'g'))) AS text, '' AS note FROM k""",
    "robots_rules": """
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, CASE WHEN host LIKE '%.org' OR host LIKE 'www.%' THEN true WHEN host LIKE 'm.%' THEN path NOT LIKE '/en/%' ELSE false END AS allowed FROM p""",
    "json_documents": """
SELECT false AS damaged, CASE WHEN c_custkey % 7 = 0 THEN 'many' ELSE (c_custkey % 5)::VARCHAR END AS n, count(*) AS rows, sum(c_custkey)::BIGINT AS keys FROM customer WHERE c_nationkey % 6 <> 1 GROUP BY ALL
UNION ALL SELECT true, NULL, count(DISTINCT c_nationkey), NULL FROM customer WHERE c_nationkey % 6 = 1""",
    "damaged_records": """
WITH l AS (SELECT event_id % 20 AS s, event_id % 20 = 7 OR event_id % 13 = 5 AS cut, event_id % 11 = 3 AS word, event_id % 17 = 4 AS none, event_id % 100 AS w, (props->>'$.k')::BIGINT AS k FROM events),
p AS (SELECT s, NOT cut AND NOT word AND NOT none AS ok, NOT cut AND word AS back, w, k FROM l)
SELECT 'shard-' || s AS source, count(*) FILTER (WHERE ok) AS good, count(*) FILTER (WHERE NOT ok) AS damaged, count(*) FILTER (WHERE back) AS won_back,
  (coalesce(sum(k) FILTER (WHERE ok), 0) + coalesce(sum(w) FILTER (WHERE back), 0))::BIGINT AS total,
  CASE WHEN bool_and(ok) THEN 'whole' WHEN bool_or(ok) THEN 'partial' ELSE 'skipped' END AS state FROM p GROUP BY s""",
    "link_history": f"""
WITH s AS (SELECT page_id, at_ FROM pages, range({VERSIONS}) r(at_) WHERE (page_id + at_) % 7 <> 0),
n AS (SELECT *, lead(at_) OVER (PARTITION BY page_id ORDER BY at_) AS next_at, lag(at_) OVER (PARTITION BY page_id ORDER BY at_) AS prev_at FROM s),
i AS (SELECT DISTINCT l.page_id, href, n.at_, next_at, prev_at FROM ({_LINKS}) l JOIN n ON n.page_id = l.page_id WHERE (pos * 7 + l.page_id + at_ * at_) % 5 < 3),
b AS (SELECT *, lag(at_) OVER w IS DISTINCT FROM prev_at OR lag(at_) OVER w IS NULL AS new FROM i WINDOW w AS (PARTITION BY page_id, href ORDER BY at_)),
g AS (SELECT *, sum(new::INT) OVER (PARTITION BY page_id, href ORDER BY at_) AS stay FROM b)
SELECT page_id, href, stay::BIGINT AS stay, min(at_)::INT AS first_seen, max(at_)::INT AS last_seen, count(*) AS n_seen, nullif(arg_max(coalesce(next_at, -1), at_), -1)::INT AS gone_at FROM g GROUP BY page_id, href, stay""",
    "page_versions": f"""
WITH t AS (SELECT page_id, at_, sha256(sha256(html) || '-' || ((at_ * (1 + page_id % 3)) // 4) % 3) AS h FROM pages, range({2 * VERSIONS + 1}) r(at_) WHERE (page_id + at_) % 9 <> 4),
v AS (SELECT *, sum(new::INT) OVER (PARTITION BY page_id ORDER BY at_) AS version FROM (SELECT *, lag(h) OVER (PARTITION BY page_id ORDER BY at_) IS DISTINCT FROM h AS new FROM t)),
r AS (SELECT page_id, version, any_value(h) AS h, min(at_) AS since, max(at_) AS last_seen, count(*) AS n_seen FROM v GROUP BY page_id, version)
SELECT page_id, version::BIGINT AS version, substr(h, 1, 16) AS text_hash, since::INT AS since, last_seen::INT AS last_seen, n_seen, (lead(since) OVER (PARTITION BY page_id ORDER BY version))::INT AS replaced_at FROM r""",
    "candidate_links": f"""
WITH l AS (SELECT page_id::VARCHAR AS url, pos, pos % 4 = 0 AS paper, CASE WHEN pos % 4 = 0 THEN href || '.PDF?v=1' ELSE href || '#top' END AS href, anchor FROM ({_LINKS})),
k AS (SELECT url, CASE WHEN paper AND NOT contains(href, '#') THEN 'document' WHEN len(list_filter([{", ".join(f"'{w}'" for w in HINTS)}], lambda w: contains(lower(href || ' ' || anchor), w))) > 0 THEN 'page' END AS kind,
  regexp_replace(href, '#.*$', '') AS href, pos FROM l),
g AS (SELECT url, kind, href, min(pos) AS pos FROM k WHERE kind IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY url, kind ORDER BY pos) AS rank FROM g)
SELECT url, kind, href, rank FROM r WHERE rank <= CASE kind WHEN 'document' THEN {units.MAX_DOCUMENTS} ELSE {units.MAX_HTML} END""",
    "page_lines": f"SELECT page_id, sha256(trim(regexp_replace(regexp_replace({_CONTENT}, '(?s)<[^>]+>', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'))) AS lines FROM pages",
    "published_tables": """
SELECT 'nation' AS "table", '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json FROM nation
UNION ALL SELECT 'customer', '{"c_custkey":' || c_custkey || ',"c_nationkey":' || c_nationkey || '}' FROM customer""",
}

QUERIES = {f.__name__: f for f in (landed_files, zipped_members, office_files, robots_rules, json_documents, damaged_records, link_history, page_versions, candidate_links, page_lines, published_tables)}
