"""Text scalars as Column expressions: all of them stay in the JVM.

Survey ids: P1-P10, P18-P24, P26-P32, P34, S22, F14, F16, X4.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------------------------------
#: Lines that are site navigation.
CHROME_LINE = (
    r"(?:home|menu|search|close|skip to (?:main )?content|jump into the main content"
    r"|economic opportunit(?:y|ies)|commercial opportunit(?:y|ies)|doing business in[^\n]*"
    r"|business ready|u\.?s\.?\s*citizen services|visas?|education\s*&\s*culture"
    r"|news\s*&\s*events|embassy\s*&\s*consulates?|about(?: us)?|contact(?: us)?"
    r"|jobs?|careers?|privacy policy|accessibility|follow us|share this page"
    r"|social media|newsletter|subscribe|sitemap|related content|previous|next"
    r"|read more|learn more|back to top|all news|events|press releases?)"
)
CHROME_PHRASE = (
    r"(?i)\b(economic opportunit(?:y|ies)\s+commercial opportunit(?:y|ies)"
    r"|commercial opportunit(?:y|ies)\s+economic opportunit(?:y|ies))\b"
)
BANNER_LINE = r"(?i)^(?:u\.?s\.?\s*)?(?:embassy|consulate|mission)\b[^\n]{0,40}$"
SOCIAL_HOSTS = ("x.com", "twitter.com", "facebook.com", "instagram.com", "youtube.com", "linkedin.com", "flickr.com", "t.me", "wa.me", "google.com")
REFERENCE = (
    r"\b(19[A-Z]{2}\d{2}[A-Z0-9]{4,}|PR\d{6,}|[A-Z]{2,}-\d{2,}-[A-Z0-9-]+|"
    r"RFQ[-\s]?\d{3,}|RFP[-\s]?\d{3,}|ITB[-\s]?\d{3,}|SOL[-\s]?\d+)\b"
)
#: The same matches: a reference begins with 1 or a capital, so words in lower case aren't tried.
_REFERENCE = r"(?=[1A-Z])" + REFERENCE
SIGNALS = (
    "request for quotation", "request for proposal", "invitation for bid", "solicitation", "rfq", "rfp", "ifb", "itb",
    "offers are due", "quotation", "closing date", "deadline", "submit your", "scope of work", "statement of work",
    "f.o.b", "fob ", "tender", "expression of interest",
)
NOISE_MARKERS = ("skip to main content", "bilateral investment and trade", "latest report", "privacy policy", "cookie", "newsletter", "visa information", "consular services")
UNIT_SIGNALS = (
    "closing date", "due date", "offers are due", "quotations are due", "deadline", "scope of work", "statement of work",
    "period of performance", "delivery date", "submit", "f.o.b", "incoterm", "line item", "quantity",
)
INDEX_WORDS = ("/business", "/procurement", "/tenders", "/opportunit", "/notice", "/solicitation", "/jobs")
SECTOR_WORDS = {
    "CONSTRUCTION": ("construction", "sf-1442", "renovation", "civil works", "build", "refurbish", "remodel", "masonry", "roofing"),
    "SERVICES": ("services", "maintenance", "cleaning", "security guard", "staffing", "consultancy", "training", "insurance", "catering"),
    "COTS": ("supply", "delivery", "goods", "equipment", "furniture", "procurement of", "commodity", "f.o.b", "spare parts"),
}
WORTH_READING = (
    r"(?i)(rfq|rfp|itb|ifb|sow|statement.of.work|scope|spec|requirement|terms|conditions"
    r"|solicitation|tender|bid|quotation|attachment|annex|schedule|sf-?1449|sf-?18"
    r"|amendment|addendum|instruction|evaluation|pricing|bom)"
)
LOW_VALUE = r"(?i)(logo|banner|header|footer|map|photo|image|privacy|accessib)"
#: Words that a notice may be over by; for analytics only.
DEAD_WORDS = (
    r"(?i)\b(this (?:solicitation|rfq|rfp|itb|tender|notice) (?:has been |is |was )?(?:cancell?ed|withdrawn|rescinded|terminated)"
    r"|notice of award|award(?:ed)? to\b|contract (?:has been )?awarded"
    r"|no longer (?:open|accepting|available)|closed to (?:new )?(?:offers|bids|submissions)"
    r"|submissions? (?:are )?closed|this opportunity (?:has )?closed|superseded by|replaced by (?:solicitation|rfq))\b"
)
US_STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK "
    "OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC PR GU VI"
).split()
READABLE_EXTENSIONS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".xlsm", ".rtf", ".txt", ".csv", ".tsv", ".zip", ".odt", ".ods")
READABLE_TYPES = ("pdf", "wordprocessingml", "msword", "spreadsheetml", "ms-excel", "rtf", "zip", "opendocument", "csv", "octet-stream")
BRIEF_OPENERS = (
    "request for quotations", "request for proposals", "request for quotation", "request for proposal", "invitation to bid",
    "solicitation for", "solicitation", "tender for", "tender", "rfq", "rfp", "itb",
)
# --------------------------------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(c: Column) -> Column:
    """Missing is NULL here; at the boundary an empty string is missing too."""
    return F.nullif(F.trim(c), F.lit(""))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def any_of(c: Column, words: tuple[str, ...]) -> Column:
    """Whether c holds one of the words."""
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))


def count_of(c: Column, words: tuple[str, ...]) -> Column:
    """How many of the words c holds."""
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w)))


def html_text(html: Column) -> Column:
    """Readable text of a page: scripts, styles and tags go, white space is collapsed."""
    t = F.regexp_replace(html, r"(?is)<script.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style.*?</style>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(t, r"[ \t\n\r]{2,}", " "))


def html_lines(html: Column) -> Column:
    """The text nodes of a page's content on lines of their own, navigation and frames dropped."""
    t = html
    for tag in ("script", "style", "nav", "footer", "header", "noscript"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?</{tag}\s*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", "\n")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def host(url: Column) -> Column:
    """The authority of a URL in lower case, empty if there is none."""
    return F.lower(or_empty(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)))


def is_offsite(url: Column) -> Column:
    """Whether the host holds the name of a social site."""
    return any_of(host(url), SOCIAL_HOSTS)


def squeeze(c: Column) -> Column:
    """White space as single blanks."""
    return F.trim(F.regexp_replace(or_empty(c), r"[\s ]+", " "))


def normalise(c: Column) -> Column:
    """P5: squeezed, in lower case."""
    return F.lower(squeeze(c))


def clean(c: Column) -> Column:
    """NULs as blanks, runs of blanks as one, at most one empty line."""
    t = F.regexp_replace(or_empty(c), r"\x00", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"[ \t ]{2,}", " "))


def strip_chrome(c: Column) -> Column:
    """Without lines and phrases of site navigation."""
    t = F.regexp_replace(or_empty(c), rf"(?im)^(?:\s*{CHROME_LINE}\s*)$", "")
    t = F.regexp_replace(t, CHROME_PHRASE, " ")
    return F.regexp_replace(t, r"\n{3,}", "\n\n")


def is_chrome_line(c: Column) -> Column:
    """Whether a line is empty, navigation, or a post's banner."""
    s = F.trim(or_empty(c))
    return (s == "") | s.rlike(rf"(?i)^{CHROME_LINE}$") | s.rlike(CHROME_PHRASE) | s.rlike(BANNER_LINE)


def first_title(c: Column, limit: int = 140) -> Column:
    """The first line that can be a title, or empty."""
    lines = F.transform(F.split(or_empty(c), r"\r\n|\n|\r"), lambda x: F.btrim(x, F.lit(" \t:-—·|")))
    good = F.filter(
        lines,
        lambda s: F.length(s).between(12, limit) & ~F.lower(s).startswith("http") & ~F.lower(s).startswith("[document") & ~is_chrome_line(s) & s.rlike("[a-zA-Z]{4}"),
    )
    return or_empty(F.get(good, 0))


def reference(c: Column) -> Column:
    """P10: the first reference number of a text, or empty."""
    return F.replace(F.upper(F.regexp_extract(or_empty(c), _REFERENCE, 1)), F.lit(" "), F.lit(""))


def references(c: Column) -> Column:
    """P11 without offsets: the distinct reference numbers in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(or_empty(c), F.lit(_REFERENCE), F.lit(1)), lambda x: F.replace(F.upper(x), F.lit(" "), F.lit(""))))


def running_sums(c: Column, step: int = 64) -> Column:
    """The running sums of an array of lengths. Long arrays are summed within pieces of `step` and the
    pieces then raised by what stands before them, so that no array grows one by one to full length."""
    ints = F.array().cast("array<int>")

    def sums(xs: Column) -> Column:
        last = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0))
        return F.aggregate(xs, ints, lambda acc, x: F.concat(acc, F.array((last(acc) + x).cast("int"))))

    def long(xs: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / step).cast("int")), lambda k: sums(F.slice(xs, k * step + 1, F.lit(step))))
        return let(pieces, lambda ps: let(sums(F.transform(ps, lambda q: F.element_at(q, -1))), lambda ends: F.flatten(F.transform(ps, lambda q, k: let(F.when(k > 0, F.get(ends, k - 1)).otherwise(0), lambda low: F.transform(q, lambda x: x + low))))))

    return let(c, lambda xs: F.when(F.size(xs) <= step, sums(xs)).otherwise(long(xs)))


def match_spans(c: Column, pattern: str, group: int = 0, gate: str | None = None) -> Column:
    """Every match of a pattern as (start, end, value), by offset: what lies between matches and the
    matches alternate, so their running lengths are the offsets. Start counts from 0.

    gate: a pattern found faster, without which there is no match."""
    text = or_empty(c)
    kind = "array<struct<start:int,end:int,value:string>>"
    gap = F.split(text, pattern, -1).alias("gap")
    hit_of = "value" if group == 0 else "hit"

    def placed(steps: Column) -> Column:
        ends = running_sums(F.transform(steps, lambda x: F.length(x["gap"]) + F.length(x[hit_of])))
        return let(ends, lambda at: F.transform(steps, lambda x, i: F.struct((F.get(at, i) - F.length(x[hit_of])).alias("start"), F.get(at, i).alias("end"), x["value"].alias("value"))))

    def spans(hits: Column) -> Column:
        # The last gap has no match after it.
        zipped = F.arrays_zip(gap, hits.alias("value")) if group == 0 else F.arrays_zip(gap, hits.alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
        found = let(F.filter(zipped, lambda x: x[hit_of].isNotNull()), placed)
        if group:
            return found
        # A single match needs no sums.
        value = F.get(hits, 0)
        one = let(F.length(F.get(F.split(text, pattern, 2), 0)), lambda at: F.array(F.struct(at.alias("start"), (at + F.length(value)).alias("end"), value.alias("value"))))
        return F.when(F.size(hits) == 1, one).otherwise(found)

    return F.when(text.rlike(gate or pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)).otherwise(F.array().cast(kind))


def reference_marks(c: Column) -> Column:
    """(start, value) of the first place of each distinct reference number, in order."""
    marks = F.transform(match_spans(c, _REFERENCE, 1), lambda m: F.struct(F.replace(F.upper(m["value"]), F.lit(" "), F.lit("")).alias("value"), m["start"].alias("start")))
    # By value, then by place: the first of each value is the one that follows another value.
    first = let(F.array_sort(marks), lambda ms: F.filter(ms, lambda m, i: (i == 0) | (F.get(ms, i - 1)["value"] != m["value"])))
    return F.array_sort(F.transform(first, lambda m: F.struct(m["start"].alias("start"), m["value"].alias("value"))))


def passes_gate(c: Column, has_date: Column, least: int = 1) -> Column:
    """Whether a text is worth a reader: a keyword score of `least` or more."""
    return keyword_score(c, has_date) >= least


def is_over_by_words(c: Column) -> Column:
    """F16: whether a text says that its notice is over; for analytics only, it decides nothing."""
    return F.coalesce(c.rlike(DEAD_WORDS), F.lit(False))


def keyword_score(c: Column, has_date: Column) -> Column:
    """2 for a reference number, 1 for any date, 1 for each signal phrase."""
    low = F.lower(or_empty(c))
    return 2 * (reference(c) != "").cast("int") + has_date.cast("int") + count_of(low, SIGNALS)


def page_class(text: Column, url: Column) -> Column:
    """P20: solicitation, listing or noise."""
    low = F.lower(or_empty(text))
    n = F.size(references(text))
    signals = count_of(low, UNIT_SIGNALS)
    index = any_of(F.lower(or_empty(url)), INDEX_WORDS)
    notice = (
        ((n == 1) & (signals >= 2))
        | ((n == 0) & (signals >= 3) & ~index & ~any_of(low, NOISE_MARKERS))
        | ((n == 1) & (signals >= 1) & ~index)
    )
    return F.when(n >= 2, "listing").when(notice, "solicitation").otherwise("noise")


def occurrences(c: Column, word: str) -> Column:
    """How often a word stands in c, without overlap."""
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("int")


def sector(c: Column) -> Column:
    """A sector by counted words, or empty."""
    low = F.lower(or_empty(c))
    con, svc, good = (sum((occurrences(low, w) for w in SECTOR_WORDS[k]), F.lit(0)) for k in ("CONSTRUCTION", "SERVICES", "COTS"))
    return F.when(con > F.greatest(svc, good), "CONSTRUCTION").when(svc > F.greatest(con, good), "SERVICES").when(good > 0, "COTS").otherwise("")


def brief(post: Column, title: Column, deadline: Column, items: Column, no_date: Column) -> Column:
    """One line on what a notice wants, from what is known."""
    who, what = F.trim(or_empty(post)), squeeze(title)
    opener = rf"(?i)^(?:{'|'.join(BRIEF_OPENERS)})"
    rest = F.trim(F.regexp_replace(F.regexp_replace(what, opener, ""), r"^[\s\-:–—,.]+", ""))
    what = F.when(rest != "", rest).otherwise(what)
    head = F.when((who != "") & (what != ""), F.concat(who, F.lit(" wants "), F.substring(what, 1, 120))).when(who != "", who).when(what != "", F.substring(what, 1, 120))
    head = F.coalesce(head, F.lit("A procurement notice"))
    first = F.filter(F.slice(F.coalesce(items, F.array().cast("array<string>")), 1, 2), lambda x: F.trim(x) != "")
    named = (F.size(first) > 0) & ~F.contains(F.lower(F.array_join(first, " ")), F.lower(what))
    some = F.when(named, F.concat(F.lit(" ("), F.array_join(F.transform(first, lambda x: F.substring(x, 1, 40)), "; "), F.lit(")"))).otherwise("")
    closes = F.when(
        no_date | deadline.isNull() | (deadline == ""), " — no closing date is stated anywhere in it, so it needs checking"
    ).otherwise(F.concat(F.lit(" — closes "), deadline))
    return F.substring(F.concat(head, some, closes), 1, 300)


def money(c: Column) -> Column:
    """$1.25M, $21K or $950; halves go to the even digit."""
    thousands = F.bround(c / 1000).cast("bigint").cast("string")
    return (
        F.when(c >= 1_000_000, F.concat(F.lit("$"), F.format_string("%.2f", F.bround(c / 1_000_000, 2)), F.lit("M")))
        .when(c >= 1_000, F.concat(F.lit("$"), thousands, F.lit("K")))
        .otherwise(F.concat(F.lit("$"), F.bround(c).cast("bigint").cast("string")))
    )


def json_body(c: Column) -> Column:
    """The JSON object in an answer: without code fences, else from the first { to the last };
    NULL if neither parses."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    inner = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    parses = lambda x: F.try_parse_json(x).isNotNull()
    return F.when(parses(F.nullif(t, F.lit(""))), t).when(parses(F.nullif(inner, F.lit(""))), inner)


def file_score(url: Column) -> Column:
    """How much a file's name promises."""
    name = F.substring(F.element_at(F.split(url, "/"), -1), 1, 120)
    low = F.lower(name)
    return (
        F.when(name.rlike(WORTH_READING), 10).otherwise(0)
        + F.when(name.rlike(LOW_VALUE), -20).otherwise(0)
        + F.when(low.rlike(r"\.(pdf|docx|doc)$"), 3).when(low.rlike(r"\.(xlsx|xls|zip)$"), 2).when(low.rlike(r"\.(jpg|jpeg|png|gif)$"), -8).otherwise(0)
    )


def file_words(url: Column) -> Column:
    """The decoded name of a file with separators as blanks."""
    name = F.element_at(F.split(url, "/"), -1)
    return F.regexp_replace(F.coalesce(F.try_url_decode(name), name), "[^A-Za-z0-9]+", " ")


def block_kind(code: Column, server: Column, body: Column) -> Column:
    """Why a site refused: login, botwall, ratelimit or unknown."""
    t = F.lower(F.substring(or_empty(body), 1, 4000))
    return (
        F.when((code == 401) | any_of(t, ("sign in", "log in to continue", "password")), "login")
        .when((code == 403) | any_of(t, ("just a moment", "checking your browser", "captcha", "attention required", "access denied")), "botwall")
        .when(code == 429, "ratelimit")
        .otherwise("unknown")
    )


def block_kind_of_words(kind: Column, need: Column) -> Column:
    """The kind of a block, read from its description where it isn't known."""
    t = F.lower(or_empty(need))
    guess = (
        F.when(any_of(t, ("sign-in", "login", "401")), "login")
        .when(any_of(t, ("403", "cdn", "refusing")), "botwall")
        .when(any_of(t, ("429", "slow down")), "ratelimit")
        .otherwise("unknown")
    )
    return F.when(kind == "unknown", guess).otherwise(kind)


def api_failure(status: Column, message: Column) -> Column:
    """(reason, fatal) of a failed call."""
    low = F.lower(or_empty(message))
    reason = (
        F.when((status == 401) | any_of(low, ("authentication", "invalid x-api-key")), "key rejected")
        .when(status == 403, "refused")
        .when(any_of(low, ("credit balance is too low", "insufficient")) | (status == 402), "out of credit")
        .when(status == 429, "rate limited")
        .when(status.isin(500, 502, 503, 529), "outage")
        .when(status == 404, "model not found")
        .when(status == 0, "network")
        .otherwise("error")
    )
    return F.struct(reason.alias("reason"), reason.isin("key rejected", "refused", "out of credit").alias("fatal"))


def is_domestic(country: Column, code: Column, state: Column, zip_code: Column) -> Column:
    """A stated country decides; else a state of the US or a ZIP code."""
    c = F.upper(F.trim(F.when(or_empty(code) != "", code).otherwise(or_empty(country))))
    return (
        F.when(c.isin("US", "USA", "UNITED STATES", "UNITED STATES OF AMERICA"), True)
        .when((c != "") & (c != "NONE"), False)
        .otherwise(F.upper(F.trim(or_empty(state))).isin(US_STATES) | F.substring(F.trim(or_empty(zip_code)), 1, 5).rlike(r"^\d{1,5}$"))
    )


def leading_int(c: Column) -> Column:
    """The number that a count begins with, else 0; `true` and `false` are 0."""
    return F.coalesce(F.regexp_extract(or_empty(c), r"^\s*(\d+)", 1).try_cast("bigint"), F.lit(0))


def is_iso_date(c: Column) -> Column:
    """P34."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))


def is_document(name: Column, content_type: Column) -> Column:
    """Whether a download goes to the document readers."""
    low = F.substring_index(F.lower(or_empty(name)), "?", 1)
    kind = F.lower(or_empty(content_type))
    page = low.rlike(r"(\.htm|\.html|\.aspx|\.php|/)$") | F.contains(kind, F.lit("html"))
    extensions = "|".join(e.replace(".", r"\.") for e in READABLE_EXTENSIONS)
    return ~page & (low.rlike(rf"({extensions})$") | any_of(kind, READABLE_TYPES))


def progress_fields(line: Column) -> Column:
    """The k="v" pairs of a progress line as a map; of repeated keys the last counts."""
    keys = F.regexp_extract_all(line, F.lit(r'(\w+)="([^"]*)"'), F.lit(1))
    values = F.regexp_extract_all(line, F.lit(r'(\w+)="([^"]*)"'), F.lit(2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), p["k"]))
    return F.map_from_entries(last)
