"""Spelling variants: words one edit apart, found by bands of letter-parity masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import step
from .shared import ascii_lower, table, written

RUN = r"[A-Za-zÀ-ÿ]+"
#: A run loses a code point if this divides its hash.
DROP_EVERY = 97
MIN_LENGTH, MIN_COUNT = 5, 3
#: A form is at least so many times as frequent as the word.
TIMES = 2
#: Bands of a mask, and bits of a band.
BANDS, BITS = 3, 21


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of the runs of letters of all texts, lower-cased in A-Z; a run whose CRC-32 of
    "<doc_id>:<run>" is divisible by DROP_EVERY loses one code point, at hash % length. Only words of at
    least MIN_LENGTH code points and MIN_COUNT occurrences stay. A null doc_id is an empty one in the
    hash. Counts combine on the map side, so a frequent word costs a row a task."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    runs = runs.select("run", h.alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    word = F.when(F.col("h") % DROP_EVERY == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)


def parity_mask(word: Column) -> Column:
    """For each letter, a bit that tells whether the word holds it an odd number of times: code points
    are dealt in turn to BANDS bands of BITS bits. An inserted or deleted letter flips one bit, a
    replaced one two at most (none if both share a bit)."""
    bit = lambda c: (F.ascii(c) % BANDS) * BITS + F.floor(F.ascii(c) / BANDS).cast("int") % BITS
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda mask, c: F.when(c == "", mask).otherwise(mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(c)))))


def _band(mask: Column, band: Column | int) -> Column:
    return F.call_function("shiftright", mask, F.lit(band * BITS) if isinstance(band, int) else band * BITS).bitwiseAND(F.lit((1 << BITS) - 1))


def _keyed(words: DataFrame, spare: tuple[int, ...]) -> DataFrame:
    """A row for each length that the shorter word of a pair may have (that of the word less one of
    spare), each half of it and each band. The first half is as many code points at the start of the
    word, the second what is left of the length at its end: one edit leaves one of them alone."""
    sizes = F.array(*[F.length("word") - n for n in spare])
    rows = words.select("word", "n", "mask", F.explode(sizes).alias("size"), F.floor(F.col("size") / 2).cast("int").alias("first"))
    halves = F.array(F.substring("word", F.lit(1), F.col("first")), F.substring("word", F.length("word") - F.col("size") + F.col("first") + 1, F.col("size") - F.col("first")))
    rows = rows.select("word", "n", "mask", "size", F.posexplode(halves).alias("half", "part"))
    rows = rows.select("word", "n", "mask", "size", "half", "part", F.explode(F.array(*map(F.lit, range(BANDS)))).alias("band"))
    return rows.select("word", "n", "mask", "half", "band", F.xxhash64("band", "half", "size", _band(F.col("mask"), F.col("band")), "part").alias("key"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n) for each two words (word, n) that differ by one inserted, deleted or replaced
    code point, once, a no longer than b.

    Of three bands one is alike in both masks, as an edit flips two bits at most. Words meet where a
    band and the length of the shorter word are equal; as common band values would gather too many,
    a meeting place is dealt further by the half of the word that the edit leaves alone, which keeps
    every pair. Of the places where a pair meets the first one counts. Then masks that differ in more
    than two bits are dropped and the rest is verified, all within the join: no candidate is
    written."""
    words = written(words.select("word", "n", parity_mask(F.col("word")).alias("mask")), "spelling-masks")
    a = _keyed(words, (0,)).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("mask").alias("a_mask"), F.col("band").alias("a_band"), F.col("half").alias("a_half"))
    b = _keyed(words, (0, 1)).select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("mask").alias("b_mask"), F.col("band").alias("b_band"), F.col("half").alias("b_half"))
    x, y, changed = F.col("a"), F.col("b"), F.col("a_mask").bitwiseXOR(F.col("b_mask"))
    band, half = F.col("a_band"), F.col("a_half")
    few = (F.bit_count(changed) <= 2) & (_band(changed, band) == 0)
    earlier_band = ((band > 0) & (_band(changed, 0) == 0)) | ((band > 1) & (_band(changed, 1) == 0))
    same_place = (band == F.col("b_band")) & (half == F.col("b_half")) & ((F.length(y) > F.length(x)) | (x < y))
    earlier_half = (half == 1) & F.startswith(y, F.substring(x, F.lit(1), F.floor(F.length(x) / 2).cast("int")))
    condition = (a["key"] == b["key"]) & few & ~earlier_band & same_place & ~earlier_half & (F.levenshtein(x, y, 1) == 1)
    return a.join(b, condition).select("a", "a_n", "b", "b_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form (word, form): forms are followed to the last, twice as
    far in each round. A form is TIMES as frequent as its word, so there are no rings, and the rounds
    are as many as the logarithm of the logarithm of the largest count."""
    spark = forms.sparkSession
    roots = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        with step(spark) as keep:
            further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
            joined = roots.join(further, "root", "left")
            roots = keep(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")), "spelling-roots")
        if roots.where("on").isEmpty():
            return roots.select("word", "root")
        roots = roots.select("word", "root")


def spelling_variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n for each row of words (word, n), one row a word.

    form is the near word of largest n, of those the first in code-point order, if it is at least
    TIMES as frequent, else null; root is reached by following forms to the last, the word itself if
    it has none; n_near counts near words. Words with code points beyond U+FFFF are no runs of
    word_counts, but are compared by code points as well. An empty table gives an empty table."""
    with step(words.sparkSession) as keep:
        words = written(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
        pairs = near_pairs(words)
        sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
        near = pairs.select(F.explode(sides).alias("side")).select("side.*").groupBy("word")
        near = written(near.agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")), "spelling-near")
        found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.order")).alias("near_n"))
        frequent = F.col("near_n") >= TIMES * F.col("n")
        found = written(found.select("word", "n", "n_near", F.when(frequent, F.col("near")).alias("form"), F.when(frequent, F.col("near_n")).alias("form_n")), "spelling-forms")
        roots = _roots(found.where("form IS NOT NULL"))
        out = found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return keep(out, "spelling-variants")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents").select("doc_id", "text")))


_LETTERS = "[A-Za-zÀ-ÿ]+"
ORACLE = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY b) AS t FROM range(256) r(b)
), runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '{_LETTERS}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
  ) GROUP BY doc_id, run
), bytes AS (
  SELECT doc_id, run, c, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x:
    CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 + (unicode(x) >> 6))::BIGINT, (128 + (unicode(x) & 63))::BIGINT] END)) AS b FROM runs
), hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda h, x: xor(h >> 8, t[1 + (xor(h, x) & 255)])), 4294967295) AS h FROM bytes, crc
), named AS (
  SELECT CASE WHEN h % {DROP_EVERY} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed
), words AS MATERIALIZED (
  SELECT word, sum(c)::BIGINT AS n FROM named WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(c) >= {MIN_COUNT}
), less AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS r(i)
), near AS MATERIALIZED (
  SELECT DISTINCT x.word, x.n, y.word AS other, y.n AS other_n FROM less x JOIN less y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM less x JOIN words y ON x.rest = y.word
  UNION SELECT y.word, y.n, x.word, x.n FROM less x JOIN words y ON x.rest = y.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, struct_pack(o := -other_n, w := other)) AS other, max(other_n) AS other_n FROM near GROUP BY word
), forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= {TIMES} * n THEN other END AS form, CASE WHEN other_n >= {TIMES} * n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
), walk AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.root WHERE f.form IS NOT NULL
), ends AS (
  SELECT walk.word, walk.root FROM walk JOIN forms f ON f.word = walk.root WHERE f.form IS NULL
)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON e.word = f.word
"""
