"""Line de-duplication: lines whose normalised form occurs in many documents are dropped everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, ascii_lower, fresh, table, written

MIN_DOCUMENTS = 10
MIN_LENGTH = 1


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _document(docs: DataFrame, body: Column) -> Column:
    """What names the document of a row: its id; without one its text."""
    return F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.sha2(body, 256)) if "doc_id" in docs.columns else F.sha2(body, 256)


def _hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def _keys(rows: DataFrame, min_length: int) -> DataFrame:
    return rows.where(F.length("key") >= min_length)


def drop_common_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCUMENTS, min_length: int = MIN_LENGTH) -> DataFrame:
    """docs with every column, the text replaced by its kept lines, and two more columns at the end:
    n_lines (lines before dropping) and n_dropped, led by underscores if docs has such columns.

    A line goes if at least min_docs documents hold it. Rows of one doc_id are one document, however
    many there are and whatever their texts; rows without an id are one if their texts are equal. A
    null or empty text is one empty line: its key has no code points, so it is never dropped for
    min_length >= 1, and the text stays as it is. A text whose lines all go becomes the empty string.
    An empty table gives an empty table; every other column, whatever its name or nulls, passes
    through unchanged.

    Rows are counted first, on the map side, so a line that a third of all documents hold costs one
    partial row a task. Only places of lines that enough rows hold go on; of these the distinct
    documents are counted in two stages, a row per line and document first. Spark broadcasts the
    lines only if they are few; else both sides are dealt by hash and a hot line is split by the skew
    join. A text is put together again from the positions that stay, in time linear in its lines.
    """
    n_lines, n_dropped, d1, d2, gone = fresh(docs, "n_lines", "n_dropped", "d1", "d2", "gone")
    # A row is found again by a 128-bit hash of its id and text, so null and repeated ids do no harm.
    ids = [c for c in docs.columns if c == "doc_id"]
    body = F.coalesce(F.col(text), F.lit(""))
    first, second = F.xxhash64(*ids, body), F.xxhash64(F.lit(2), *ids, body)
    held = _keys(docs.select(F.explode(F.array_distinct(F.transform(F.split(body, "\n", -1), _key))).alias("key")), min_length)
    often = written(held.select(*_hashed(F.col("key"))).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("h1", "h2"), "frequent-keys")
    lines = docs.select(first.alias("d1"), second.alias("d2"), F.xxhash64(_document(docs, body)).alias("document"), F.posexplode(F.split(body, "\n", -1)).alias("pos", "line"))
    lines = _keys(lines.select("d1", "d2", "document", "pos", _key(F.col("line")).alias("key")), min_length).select("d1", "d2", "document", "pos", *_hashed(F.col("key")))
    places = written(lines.join(often, ["h1", "h2"], "left_semi"), "frequent-places")
    # Only places of lines go on that enough documents hold.
    frequent = places.select("h1", "h2", "document").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    found = places.join(written(frequent.select("h1", "h2"), "frequent-lines"), ["h1", "h2"], "left_semi").groupBy(F.col("d1").alias(d1), F.col("d2").alias(d2)).agg(F.collect_set("pos").alias(gone))
    parts = F.split(body, "\n", -1)
    # A struct in an array of one holds the lines and the positions for the function that joins them.
    held = F.transform(F.array(F.struct(parts.alias("parts"))), lambda s: F.struct(s["parts"].alias("parts"), F.array_except(F.sequence(F.lit(0), F.size(s["parts"]) - 1), F.col(gone)).alias("stay")))
    kept = F.transform(held, lambda s: F.array_join(F.transform(s["stay"], lambda i: F.get(s["parts"], i)), "\n"))[0]
    joined = docs.withColumns({d1: first, d2: second}).join(found, [d1, d2], "left")
    return joined.select(
        *[(F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept).alias(text) if c == text else F.col(c)) for c in docs.columns],
        F.size(parts).cast("long").alias(n_lines),
        F.coalesce(F.size(F.when(F.col(gone).isNotNull(), F.col(gone))), F.lit(0)).cast("long").alias(n_dropped),
    )


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_BLANK_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, {_BLANK_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= {MIN_LENGTH} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS}
), marked AS (
  SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
