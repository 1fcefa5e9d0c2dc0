"""Quality rules: plain counts, and tokeniser fertility within bands per language or script."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import table, written
from .spans import IS_BLANK, ORDER, Cache, batches, gather, mix64, span_hashes, text_slices, word_spans
from .tokens import vocabulary_path

#: A sentencepiece vocabulary with byte fallback, and a byte-level one of many languages.
VOCABULARY, SECOND_VOCABULARY = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
MIN_WORDS = 50
#: Per cent of words that repeated 3-word windows may cover.
MAX_REPEAT = 50
#: Rejection bands by script: least and most letters per token of the first vocabulary, most share of
#: byte-fallback tokens, least token entropy in bits, least letters per token of the second. Digits'
#: tokens don't count, those of marks do: so texts strewn with marks leave the band as random letters
#: do. They hold where a text's language has none of its own, and are set below prose of 33 languages (the
#: least: Yoruba 1.03 and 1.13, Latvian 1.56), so random letters of a script may pass where prose of some
#: language is as hard to tokenise. Greek prose has 1.65 letters
#: per token of the second vocabulary, random Greek up to 1.17; Arabic 1.54 and 1.29, Hebrew 1.50 and
#: 1.27, Hangul 1.09 and 0.91, Thai 1.09 and 0.96, Vietnamese 2.10 and 1.25, Cyrillic 2.07 and 1.45. Random Han and
#: kana have a byte share above 0.39, prose below 0.2.
BANDS = {
    "latin": (1.5, 6.5, 0.10, 4.5, 1.55),
    "cyrillic": (1.45, 6.5, 0.15, 4.5, 1.6),
    "greek": (0.7, 6.5, 0.60, 3.5, 1.35),
    "cjk": (0.30, 3.0, 0.38, 3.5, 0.35),
    "hangul": (0.40, 3.0, 0.38, 3.5, 0.95),
    "hebrew": (0.5, 6.5, 0.60, 3.5, 1.35),
    "arabic": (0.5, 6.5, 0.60, 3.5, 1.35),
    "indic or thai": (0.5, 6.5, 0.60, 3.5, 0.65),
    "other": (0.25, 8.0, 0.95, 3.0, 0.2),
    "latin additional": (0.95, 6.5, 0.15, 4.5, 1.05),
}
#: Languages with bands of their own: those of which LEAST rows pass the base rule in one script. SAMPLE
#: bounds the rows that language_medians measures of each; None: all of them. Of more pairs than
#: LANGUAGES it gives the most frequent; against_languages has no such bound.
SAMPLE, LEAST, LANGUAGES = None, 30, 1000
#: Letters per token are counted to so many decimals, so that medians come from counts of bounded number.
DECIMALS = 4
#: A text of a language may fall short of the median letters per token of its language, by either
#: vocabulary, by the share SPREAD and by SMALL over the root of its words: short texts vary more.
SPREAD, SMALL = 0.10, 0.6
#: The lead bytes of UTF-8 whose code points are letters of each script, the last two being told apart
#: from others in _script.
_LEADS = {"cyrillic": (0xD0, 0xD4), "greek": (0xCE, 0xD0), "cjk": (0xE3, 0xEA), "hangul": (0xEA, 0xEE), "hebrew": (0xD6, 0xD8), "arabic": (0xD8, 0xDC), "indic or thai": (0xE0, 0xE1)}
#: Latin letters by first byte 0xE1 (Latin Extended Additional, as in Vietnamese), per cent of the
#: others, from which a text has the band of its own.
ADDITIONAL = 2
#: UTF-8 read as Latin-1 or Windows-1252: a letter from U+00C2 to U+00DF before what a continuation
#: byte becomes, or the first two characters of a broken quotation mark or dash.
_MOJIBAKE = re.compile(
    rb"\xc3[\x82-\x9f](?:\xc2[\x80-\xbf]|\xe2\x80[\x93-\xba]|\xe2\x82\xac|\xe2\x84\xa2|\xc5[\x92\x93\xa0\xa1\xb8\xbd\xbe]|\xc6\x92|\xcb[\x86\x9c])|\xc3\xa2(?:\xe2\x82\xac|\xc2\x80)"
)
#: Most such pairs per 1000 characters of words.
MAX_MOJIBAKE = 5
_SCRIPTS = list(BANDS)
#: Pieces of one digit each, which any number is made of: they say nothing of the letters' fertility.
_DIGITS = set("0123456789")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: First bytes of letters: ASCII letters and all further blocks but Latin-1 marks, general punctuation,
#: symbols, private use and what lies beyond the basic plane.
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3:0xEE] = True
_LETTER[0xE2] = False


class WordTokens:
    """Words' tokens by two public vocabularies; equal words once. The first is a sentencepiece model
    whose pieces never cross blanks; of the second, byte-level, what counts is the number of tokens
    that aren't digits."""

    def __init__(self, path: str, second: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.is_digit = np.array([self.model.id_to_piece(i) in _DIGITS for i in range(len(self.is_byte))])
        with open(second, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.second = tiktoken.Encoding("second", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.digits = {rank for piece, rank in ranks.items() if piece.strip().isdigit()}
        self.cache = Cache()

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(which, starts, lengths, second): of each distinct word, where its ids lie in
        self.cache.flat, and its tokens of the second vocabulary; which: each word's distinct one."""

        def fill(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            texts = [data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace") for i in which]
            rows = []
            for text, ids in zip(texts, self.model.encode(texts, num_threads=1), strict=True):
                rows.append(np.array([sum(i not in self.digits for i in self.second.encode_ordinary(" " + text)), *ids], np.int32))
            return np.array([len(x) for x in rows], np.int64), np.concatenate(rows)

        which, begin, length = self.cache.rows(span_hashes(data, starts, ends), fill)
        return which, begin + 1, length - 1, self.cache.flat[begin]


_loaded: dict[tuple[str, str], WordTokens] = {}


def _script(lead: np.ndarray) -> int:
    """The script of most lead bytes of letters: by the first byte of UTF-8, which names the block."""
    counts = np.bincount(lead, minlength=256)
    per = {name: counts[a:b].sum() for name, (a, b) in _LEADS.items()}
    per["latin"] = counts[65:91].sum() + counts[97:123].sum() + counts[0xC3:0xCA].sum()
    per["other"] = counts[0xCA:0xCE].sum() + counts[0xD4:0xD6].sum() + counts[0xDC:0xE0].sum() + counts[0xE1] + counts[0xEE:0xF5].sum()
    latin = per["latin"]
    best = max(per, key=lambda name: (per[name], name == "latin"))
    return _SCRIPTS.index("latin additional" if latin and best in ("latin", "other") and per["other"] < 2 * latin and 100 * counts[0xE1] > ADDITIONAL * latin else best)


def _repeated(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text the number of words in 3-word windows that it holds twice or more."""
    n, texts = len(hashes), len(bounds) - 1
    out = np.zeros(texts, np.int64)
    if n < 3:
        return out
    text_of = np.repeat(np.arange(texts), np.diff(bounds))
    windows = mix64(hashes[:-2] * ORDER[0] + hashes[1:-1] * ORDER[1] + hashes[2:] * ORDER[2] + text_of[:-2].astype(np.uint64) * ORDER[3])
    inside = np.flatnonzero(text_of[:-2] == text_of[2:])
    _, inverse, counts = np.unique(windows[inside], return_inverse=True, return_counts=True)
    hit = inside[counts[inverse] > 1]
    covered = np.zeros(n, bool)
    for j in range(3):
        covered[hit + j] = True
    return np.bincount(text_of[covered], minlength=texts)


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the number of lines with a word that equal an earlier line of it."""
    texts = len(offsets) - 1
    out = np.zeros(texts, np.int64)
    if not len(data):
        return out
    feeds = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    starts = starts[starts < len(data)]
    ends = np.searchsorted(feeds, starts)
    next_feed = np.append(feeds, len(data))[ends]
    text_of = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.minimum(next_feed, offsets[text_of + 1])
    ink = np.concatenate([[0], np.cumsum(~IS_BLANK[data])])
    full = ink[ends] > ink[starts]
    starts, ends, text_of = starts[full], ends[full], text_of[full]
    keys = mix64(span_hashes(data, starts, ends) + text_of.astype(np.uint64) * ORDER[4])
    _, first = np.unique(keys, return_index=True)
    again = np.ones(len(keys), bool)
    again[first] = False
    return np.bincount(text_of[again], minlength=texts)


def measure(data: np.ndarray, offsets: np.ndarray, tokenizer: WordTokens) -> dict[str, np.ndarray]:
    """The counts and fertility figures of each text."""
    texts = len(offsets) - 1
    starts, ends, bounds = word_spans(data, offsets)
    lead = (data & 0xC0) != 0x80  # the first byte of a code point
    points = np.concatenate([[0], np.cumsum(lead & ~IS_BLANK[data])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    per_text = lambda sums: sums[offsets[1:]] - sums[offsets[:-1]]
    out = {
        "n_words": np.diff(bounds), "word_chars": per_text(points), "n_symbols": per_text(symbols), "n_letters": per_text(letters),
        "n_dup_lines": _duplicate_lines(data, offsets), "n_repeat_words": _repeated(span_hashes(data, starts, ends), bounds),
    }
    n_tokens, n_bytes, n_digits, n_second = (np.zeros(texts, np.int64) for _ in range(4))
    entropy, script, n_mojibake = np.zeros(texts), np.zeros(texts, np.int64), np.zeros(texts, np.int64)
    if len(starts):
        which, begin, length, second = tokenizer.words(data, starts, ends)
        sums = np.concatenate([[0], np.cumsum(second[which], dtype=np.int64)])
        n_second = sums[bounds[1:]] - sums[bounds[:-1]]
        ids = gather(tokenizer.cache.flat, begin[which], length[which])
        at = np.concatenate([[0], np.cumsum(length[which])])[bounds]
        n_tokens = np.diff(at)
        bytes_ = np.concatenate([[0], np.cumsum(tokenizer.is_byte[ids])])
        n_bytes = bytes_[at[1:]] - bytes_[at[:-1]]
        digits = np.concatenate([[0], np.cumsum(tokenizer.is_digit[ids])])
        n_digits = digits[at[1:]] - digits[at[:-1]]
        for d in range(texts):
            own = ids[at[d] : at[d + 1]]
            if len(own):
                p = np.unique(own, return_counts=True)[1] / len(own)
                entropy[d] = -(p * np.log2(p)).sum()
                text = data[offsets[d] : offsets[d + 1]]
                script[d] = _script(text)
                n_mojibake[d] = sum(1 for _ in _MOJIBAKE.finditer(text))
    return out | {"n_tokens": n_tokens, "n_byte_tokens": n_bytes, "token_entropy": entropy, "script": script, "n_mojibake": n_mojibake, "n_digit_tokens": n_digits, "n_second": n_second}


def _per_token(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Letters per token that is no digit, by each vocabulary."""
    return m["n_letters"] / np.maximum(m["n_tokens"] - m["n_digit_tokens"], 1), m["n_letters"] / np.maximum(m["n_second"], 1)


def verdict(m: dict[str, np.ndarray], bands: dict = BANDS, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT, medians: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) of measured texts. medians: for each text the median letters per token of its
    language by either vocabulary, which take the place of the script's least; NaN where there are none."""
    base = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat * m["n_words"])
    band = np.array([bands[s] for s in _SCRIPTS])[m["script"]]
    per, second = _per_token(m)
    share = m["n_byte_tokens"] / np.maximum(m["n_tokens"], 1)
    least = band[:, [0, 4]]
    if medians is not None:
        slack = 1 - SPREAD - SMALL / np.sqrt(np.maximum(m["n_words"], 1))
        least = np.where(np.isnan(medians), least, medians * slack[:, None])
    inside = (per >= least[:, 0]) & (per <= band[:, 1]) & (share <= band[:, 2]) & (m["token_entropy"] >= band[:, 3]) & (second >= least[:, 1])
    inside &= 1000 * m["n_mojibake"] <= MAX_MOJIBAKE * m["word_chars"]
    return base, ~base & inside


_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens", "n_digit_tokens", "n_letters", "n_second")
SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in _COLUMNS) + ", base_failed boolean, kept boolean, chars_per_token double, byte_share double, token_entropy double, script string"


def _measured(batch: pa.RecordBatch, path: tuple[str, str]) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    if path not in _loaded:
        _loaded[path] = WordTokens(*path)
    for first, end, data, offsets in text_slices(batch, "text"):
        yield first, end, measure(data, offsets, _loaded[path])


def language_medians(docs: DataFrame, text: str = "text", lang: str = "lang", vocabulary: str | None = None, second: str | None = None) -> dict[tuple[str, str], tuple[float, float]]:
    """For each (language, script) with enough texts, their median letters per token by either vocabulary.

    Of a script the rows that pass the base rule must be LEAST. The driver gets two numbers for each
    of at most LANGUAGES pairs. Rows without a language or a text play no part; as medians, they move
    little with a minority of poor texts."""
    path = vocabulary or vocabulary_path(VOCABULARY), second or vocabulary_path(SECOND_VOCABULARY)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.lit(None).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    if SAMPLE is not None:
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text")))
        rows = rows.withColumn("rank", rank).where(F.col("rank") <= SAMPLE).drop("rank")
    groups = _medians(_figures(rows, path))
    return {(r["lang"], r["script"]): (r["a"], r["b"]) for r in groups.orderBy(F.desc("n"), "lang", "script").limit(LANGUAGES).collect()}


_FIGURES = "doc_id bigint, lang string, script string, no_text boolean, " + ", ".join(f"{c} bigint" for c in (*_COLUMNS, "n_mojibake")) + ", token_entropy double"


def _figures(docs: DataFrame, path: tuple[str, str]) -> DataFrame:
    """What is measured of each row of docs (doc_id, text, lang)."""

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            for first, end, m in _measured(batch, path):
                own = [batch.column(i).slice(first, end - first) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array([_SCRIPTS[i] for i in m["script"]]), batch.column(1).slice(first, end - first).is_null(), *[pa.array(m[c].astype(np.int64)) for c in (*_COLUMNS, "n_mojibake")], pa.array(m["token_entropy"])],
                    names=["doc_id", "lang", "script", "no_text", *_COLUMNS, "n_mojibake", "token_entropy"],
                )

    return docs.select("doc_id", "text", "lang").mapInArrow(work, _FIGURES)


def _medians(figures: DataFrame) -> DataFrame:
    """lang, script, n and the median letters per token by either vocabulary (a, b), of all rows that have a
    language and a text and pass the base rule. Rows are counted by language, script and figure first, so
    a group holds a bounded number of figures, however many rows it has."""
    fails = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    one = lambda name, tokens: F.struct(F.lit(name).alias("by"), F.round(F.col("n_letters") / F.greatest(tokens, F.lit(1)), DECIMALS).alias("value"))
    both = F.array(one("a", F.col("n_tokens") - F.col("n_digit_tokens")), one("b", F.col("n_second")))
    told = figures.where(F.col("lang").isNotNull() & ~F.col("no_text") & ~fails).select("lang", "script", F.inline(both))
    counts = told.groupBy("lang", "script", "by", "value").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("lang", "script", "by").agg(F.percentile("value", F.lit(0.5), F.col("n")).alias("median"), F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    median = lambda name: F.max(F.when(F.col("by") == name, F.col("median"))).alias(name)
    return per.groupBy("lang", "script").agg(F.max("n").alias("n"), median("a"), median("b"))


def against_languages(docs: DataFrame, text: str = "text", lang: str = "lang", vocabulary: str | None = None, second: str | None = None, bands: dict = BANDS) -> DataFrame:
    """`quality` with the medians of all languages of docs itself. Every row is measured once; the figures
    are written, and the medians, of all rows, are joined to them by language and script."""
    path = vocabulary or vocabulary_path(VOCABULARY), second or vocabulary_path(SECOND_VOCABULARY)
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    figures = written(_figures(named, path), "quality-figures")
    medians = written(_medians(figures), "quality-medians").select("lang", "script", "a", "b")

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            m = {c: column(c).to_numpy(zero_copy_only=False) for c in (*_COLUMNS, "n_mojibake", "token_entropy")}
            m["script"] = np.array([_SCRIPTS.index(x) for x in column("script").to_pylist()], np.int64)
            own = np.stack([np.array([np.nan if x is None else x for x in column(c).to_pylist()], float) for c in ("a", "b")], axis=1)
            yield _judged(column("doc_id"), m, bands, own)

    return figures.join(medians, ["lang", "script"], "left").mapInArrow(work, SCHEMA)


def _judged(ids: pa.Array, m: dict[str, np.ndarray], bands: dict, medians: np.ndarray) -> pa.RecordBatch:
    base, kept = verdict(m, bands, medians=medians)
    n = np.maximum(m["n_tokens"], 1)
    return pa.RecordBatch.from_arrays(
        [ids, *[pa.array(m[c].astype(np.int64)) for c in _COLUMNS], pa.array(base), pa.array(kept),
         pa.array(m["word_chars"] / n), pa.array(m["n_byte_tokens"] / n), pa.array(m["token_entropy"]), pa.array([_SCRIPTS[i] for i in m["script"]], pa.string())],
        names=["doc_id", *_COLUMNS, "base_failed", "kept", "chars_per_token", "byte_share", "token_entropy", "script"],
    )


def quality(docs: DataFrame, text: str = "text", vocabulary: str | None = None, second: str | None = None, bands: dict = BANDS, lang: str | None = None, medians: dict | None = None) -> DataFrame:
    """The counts, figures and verdict of each row of docs (SCHEMA); no shuffle.

    The verdict lies in letters per token that is no digit, of two vocabularies, the share of byte
    tokens, token entropy and mojibake; chars_per_token, over all tokens, is given for information. With
    lang and medians (see language_medians) a text is held against its language, if it is written in
    a script that its language has medians for; else against its script, that of most of its letters.
    Null and empty texts have no words and fail the base rule. A null doc_id stays null; repeated
    rows are measured each; an empty table gives an empty table; other columns aren't read.
    vocabulary, second: the model files, by default the installed ones.
    """
    path = vocabulary or vocabulary_path(VOCABULARY), second or vocabulary_path(SECOND_VOCABULARY)
    known = medians or {}

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            named = batch.column(2).to_pylist()
            for first, end, m in _measured(batch, path):
                own = np.array([known.get((name, _SCRIPTS[i]), (np.nan, np.nan)) for name, i in zip(named[first:end], m["script"], strict=True)]).reshape(-1, 2)
                yield _judged(batch.column(0).slice(first, end - first), m, bands, own)

    name = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"), name.alias("lang")).mapInArrow(work, SCHEMA)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return against_languages(docs)
