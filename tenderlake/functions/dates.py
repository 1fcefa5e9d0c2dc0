"""The date engine: every printed date with its place and whether it can be read two ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, match_spans, or_empty, running_sums, squeeze, strip_chrome

# Fixed values -------------------------------------------------------------------------------------
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
NUMERIC = r"\b(\d{1,2})[-/.](\d{1,2})[-/.](20\d{2})\b"
#: Pattern, and which of its groups are year, month and day.
TEXTUAL = (
    (r"\b(20\d{2})[-/](\d{1,2})[-/](\d{1,2})\b", (1, 2, 3)),
    (r"\b(\d{1,2})\s+([A-Za-z]{3,9})\.?,?\s+(20\d{2})\b", (3, 2, 1)),
    (r"\b([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(20\d{2})\b", (3, 1, 2)),
    (r"\b(\d{1,2})[-\s]([A-Za-z]{3,9})\.?[-\s](\d{2})\b", (3, 2, 1)),
    (r"\b(20\d{2})\.(\d{1,2})\.(\d{1,2})\b", (1, 2, 3)),
)
DEADLINE_CUES = (
    "closing date", "close date", "closes on", "closing time", "closing on", "due date", "due by", "due on", "due no later",
    "offers are due", "quotations are due", "quotes are due", "proposals are due", "bids are due", "offers due",
    "quotations due", "quotes due", "bids due", "submission deadline", "deadline for", "deadline is", "deadline:",
    "must be received", "must be submitted", "must reach", "must arrive", "no later than", "not later than",
    "on or before", "by close of business", "will not be accepted after", "will be accepted until",
    "no quotations will be accepted", "no offers will be accepted", "no bids will be accepted",
    "no proposals will be accepted", "accepted after", "received after", "submitted after", "response date",
    "response due", "last date", "latest date", "closes at", "cob ", "cot ",
)
#: Cues that are never a deadline: validity and expiry.
BANNED_CUES = ("expiration", "expires", "valid until", "open until")
QUESTION_CUES = ("questions are due", "q&a", "questions due", "clarification", "inquiries")
POSTED_CUES = ("posted", "issue date", "issued on", "date of issue", "published", "release date")
TITLE_DEADLINE_WORDS = ("by ", "due", "deadline", "closing", "closes", "close ", "before", "until", "no later")
# --------------------------------------------------------------------------------------------------

_HIT = "struct<start:int,end:int,iso:string,ambiguous:boolean>"


def build_date(year: Column, month: Column, day: Column) -> Column:
    """An ISO date of year 2000 to 2100, or NULL if there is no such day.

    Which days there are is told by numbers: a cast that fails costs far more than one that doesn't."""
    numbers = F.struct(*(c.try_cast("int").alias(k) for k, c in zip("ymd", (year, month, day), strict=True)))

    def iso(n: Column) -> Column:
        days = F.day(F.last_day(F.make_date(n["y"], n["m"], F.lit(1))))
        two = lambda c: F.lpad(c.cast("string"), 2, "0")
        possible = n["y"].between(2000, 2100) & n["m"].between(1, 12) & (n["d"] >= 1)
        return F.when(possible, F.when((n["d"] <= 28) | (n["d"] <= days), F.concat(n["y"].cast("string"), F.lit("-"), two(n["m"]), F.lit("-"), two(n["d"]))))

    return let(numbers, iso)


def month_number(name: Column) -> Column:
    """By the first three letters; NULL for other words. Digits stand for themselves. A word isn't
    tried as a number first, as a cast that fails costs far more than one that doesn't."""
    by_name = F.try_element_at(F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)]), F.lower(F.substring(name, 1, 3)))
    return F.when(name.rlike("[A-Za-z]"), by_name).otherwise(name.try_cast("int"))


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group)


#: What stands after a month's name before its date: that is found faster than the name, which any word may be.
_AFTER_NAME = r"\s\d{1,2},?\s+20\d{2}\b"


def _spans(text: Column, pattern: str) -> Column:
    """The places of a pattern; a text that holds none costs one search."""
    return match_spans(text, pattern, gate=_AFTER_NAME if pattern.startswith(r"\b([A-Za-z]") else None)


def _textual(text: Column, pattern: str, order: tuple[int, int, int]) -> Column:
    def hit(m: Column) -> Column:
        year, month, day = (_part(m["value"], pattern, g) for g in order)
        year = F.substring(F.concat(F.lit("20"), year), -4, 4)  # of two digits or four
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), build_date(year, month_number(month), day).alias("iso"), F.lit(False).alias("ambiguous"))

    return F.transform(_spans(text, pattern), hit)


def _numeric(text: Column) -> Column:
    def hits(m: Column) -> Column:
        a, b, y = (_part(m["value"], NUMERIC, g) for g in (1, 2, 3))
        one = lambda iso, two: F.struct(m["start"].alias("start"), m["end"].alias("end"), iso.alias("iso"), F.lit(two).alias("ambiguous"))

        def readings(r: Column) -> Column:
            both = F.array(one(r["day_first"], True), one(r["month_first"], True))
            return F.when(r["day_first"] != r["month_first"], both).otherwise(F.array(one(F.coalesce(r["day_first"], r["month_first"]), False)))

        return let(F.struct(build_date(y, b, a).alias("day_first"), build_date(y, a, b).alias("month_first")), readings)

    return F.flatten(F.transform(_spans(text, NUMERIC), hits))


def scan_dates(text: Column) -> Column:
    """D3: (start, end, iso, ambiguous) of every date, by place. A numeric date whose first two
    numbers can both be months gives both readings, marked ambiguous."""

    def scan(t: Column) -> Column:
        found = F.concat(_numeric(t), *[_textual(t, p, order) for p, order in TEXTUAL])
        # Hits that start at one place end at one too, so their fields sort them by place and date.
        listed = F.array_sort(F.filter(found, lambda h: h["iso"].isNotNull()))
        # Most texts hold no year: they cost one search.
        return F.when(t.rlike(r"\d[-/.,\s]"), listed).otherwise(F.array().cast(f"array<{_HIT}>"))

    return let(or_empty(text), scan)


def find_dates(text: Column) -> Column:
    """The ISO dates in order of place."""
    return F.transform(scan_dates(text), lambda h: h["iso"])


def ambiguous_dates(text: Column) -> Column:
    """The distinct ISO dates that come from a form with two readings."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(scan_dates(text), lambda h: h["ambiguous"]), lambda h: h["iso"])))


def date_evidence(iso: Column, text: Column, hits: Column) -> Column:
    """The words round the first place of a date, NULL if it isn't printed."""
    def words(first: Column) -> Column:
        low = F.greatest(first["start"] - 110, F.lit(0))
        return F.when(first.isNotNull(), squeeze(F.substring(text, low + 1, first["end"] + 70 - low)))

    return let(F.get(F.filter(hits, lambda h: h["iso"] == iso), 0), words)


def cue_places(text: Column, cues: tuple[str, ...]) -> Column:
    """Every place of every cue as (start, end, rank), by cue in list order (its rank), then by place;
    places may overlap."""
    listed = F.array(*[F.struct(F.lit(c).alias("word"), F.lit(i).alias("rank")) for i, c in enumerate(cues)])

    def found(low: Column) -> Column:
        def places(cue: Column) -> Column:
            word, rank = cue["word"], cue["rank"]
            # The text is cut before each place of the cue; no cue overlaps itself, so no place is missed.
            # A cut at the very start leaves no piece before it.
            parts = F.split(low, F.concat(F.lit(r"(?=\Q"), word, F.lit(r"\E)")), F.lit(-1))
            ends = let(parts, lambda ps: running_sums(F.transform(F.slice(ps, F.lit(1), F.size(ps) - 1), F.length)))
            ends = F.when(F.startswith(low, word), F.array_union(F.array(F.lit(0)), ends)).otherwise(ends)
            return F.transform(ends, lambda s: F.struct(s.alias("start"), (s + F.length(word)).alias("end"), rank.alias("rank")))

        return F.flatten(F.transform(F.filter(listed, lambda c: F.contains(low, c["word"])), places))

    # Put in lower case once, not once for each cue.
    return let(F.lower(or_empty(text)), found)


def nearest_after_cue(text: Column, hits: Column, cues: tuple[str, ...] = DEADLINE_CUES, reach: int = 180) -> Column:
    """Of the unambiguous dates that start at most `reach` characters after the end of a cue, the
    nearest to one; of ties the earliest; NULL if there is none.

    Ends of cues and dates are put in one order, and one pass keeps the last cue before each date, so
    the work is that of sorting them, however many there are of both."""
    none = F.lit(None)
    start = F.struct(none.cast("int").alias("cue"), none.cast("int").alias("gap"), none.cast("string").alias("iso"))

    def meet(acc: Column, e: Column) -> Column:
        gap = e["at"] - acc["cue"]
        nearer = (gap <= reach) & (acc["gap"].isNull() | (gap < acc["gap"]))
        dated = F.when(nearer, F.struct(acc["cue"].alias("cue"), gap.alias("gap"), e["iso"].alias("iso"))).otherwise(acc)
        return F.when(e["date"], dated).otherwise(F.struct(e["at"].alias("cue"), acc["gap"].alias("gap"), acc["iso"].alias("iso")))

    def nearest(clear: Column) -> Column:
        # At one place a cue comes before a date, and dates by what they say.
        ends = F.transform(cue_places(text, cues), lambda s: F.struct(s["end"].alias("at"), F.lit(False).alias("date"), F.lit("").alias("iso")))
        dated = F.transform(clear, lambda h: F.struct(h["start"].alias("at"), F.lit(True).alias("date"), h["iso"].alias("iso")))
        return F.aggregate(F.array_sort(F.concat(ends, dated)), start, meet, lambda acc: acc["iso"])

    return let(F.filter(hits, lambda h: ~h["ambiguous"]), lambda clear: F.when(F.size(clear) > 0, nearest(clear)))


def _anchoring_cue(iso: Column, text: Column, hits: Column, cues: tuple[str, ...], window: int) -> Column:
    """The first cue, by list order and then by place, that has the date whole within 60 characters
    before and `window` after its start, as (rank, start); NULL if none has.

    Cues (60 characters early) and the places of the date are put in one order and passed from the
    last: of the places at or after a cue only the one that ends first counts."""
    kind = "struct<rank:int,start:int>"
    begin = F.struct(F.lit(1 << 30).alias("end"), F.lit(None).cast(kind).alias("best"))

    def meet(acc: Column, e: Column) -> Column:
        cue = F.struct(e["rank"].alias("rank"), e["other"].alias("start"))
        best = F.when(acc["end"] <= e["other"] + window, F.least(acc["best"], cue)).otherwise(acc["best"])
        place = F.struct(F.least(acc["end"], e["other"]).alias("end"), acc["best"].alias("best"))
        return F.when(e["rank"] < 0, place).otherwise(F.struct(acc["end"].alias("end"), best.alias("best")))

    def first(mine: Column) -> Column:
        early = F.transform(cue_places(text, cues), lambda s: F.struct((s["start"] - 60).alias("at"), s["rank"].alias("rank"), s["start"].alias("other")))
        dated = F.transform(mine, lambda h: F.struct(h["start"].alias("at"), F.lit(-1).alias("rank"), h["end"].alias("other")))
        # From the last; at one place a date, of rank -1, must come first: it is put half a place on.
        later = lambda e: F.struct((e["at"] * -2 - F.when(e["rank"] < 0, 1).otherwise(0)).alias("at"), e["rank"].alias("rank"), e["other"].alias("other"))
        return F.aggregate(F.array_sort(F.transform(F.concat(early, dated), later)), begin, meet, lambda acc: acc["best"])

    return let(F.filter(hits, lambda h: h["iso"] == iso), lambda mine: F.when(F.size(mine) > 0, first(mine)))


def anchored(iso: Column, text: Column, hits: Column, cues: tuple[str, ...] = DEADLINE_CUES, window: int = 200) -> Column:
    """Whether a date lies whole within 60 characters before or `window` after the start of a cue."""
    return _anchoring_cue(iso, text, hits, cues, window).isNotNull()


def anchored_evidence(iso: Column, text: Column, hits: Column, cues: tuple[str, ...] = DEADLINE_CUES, window: int = 200) -> Column:
    """The words round the first cue that anchors a date, NULL if none does."""
    def words(spot: Column) -> Column:
        low = F.greatest(spot["start"] - 60, F.lit(0))
        return F.when(spot.isNotNull(), squeeze(F.substring(text, low + 1, spot["start"] + window - low)))

    return let(_anchoring_cue(iso, text, hits, cues, window), words)


def date_windows(text: Column, hits: Column, span: int = 260, cap: int = 7000) -> Column:
    """The parts of a text round its dates, those close to each other as one, up to cap characters."""
    kind = "array<struct<lo:int,hi:int>>"
    # A part that isn't cut short by the text's ends holds 2 * span characters; more parts than fill
    # the cap need not be gathered.
    most = cap // (2 * span) + 4

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], s["hi"]).alias("hi"))))
        joins = (F.size(acc) > 0) & (s["lo"] <= F.get(acc, F.size(acc) - 1)["hi"] + 40)
        return F.when(F.size(acc) >= most, acc).when(joins, joined).otherwise(F.concat(acc, F.array(s)))

    def cut(t: Column) -> Column:
        spans = F.array_sort(F.transform(hits, lambda h: F.struct(F.greatest(h["start"] - span, F.lit(0)).alias("lo"), F.least(h["end"] + span, F.length(t)).alias("hi"))))

        def take(acc: Column, s: Column) -> Column:
            n = F.least(s["hi"] - s["lo"], cap - acc["used"])
            chunk = F.when(n > 0, F.array(F.substring(t, s["lo"] + 1, n))).otherwise(F.array().cast("array<string>"))
            return F.struct((acc["used"] + F.greatest(n, F.lit(0))).alias("used"), F.concat(acc["out"], chunk).alias("out"))

        start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"))
        return F.array_join(F.aggregate(F.aggregate(spans, F.array().cast(kind), merge), start, take, lambda acc: acc["out"]), "\n...\n")

    return let(or_empty(text), cut)


def triage_excerpt(text: Column, head: int = 1800, cap: int = 5600) -> Column:
    """The head of a text without navigation, and what is round the dates of the rest."""
    def cut(t: Column) -> Column:
        windows = let(F.substring(t, head + 1, 1 << 30), lambda rest: date_windows(rest, scan_dates(rest), cap=cap))
        joined = lambda w: F.concat(F.substring(t, 1, head), F.when(w != "", F.concat(F.lit("\n...\n"), w)).otherwise(""))
        return let(F.when(F.length(t) > head, windows).otherwise(""), joined)

    return let(strip_chrome(text), cut)


def expired(deadline: Column, as_of: Column) -> Column:
    """Due today is still open."""
    return F.coalesce(deadline < as_of, F.lit(False))
