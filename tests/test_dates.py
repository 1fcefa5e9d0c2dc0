"""The date engine and proofs on the cases of FIXTURES.md."""

import datetime
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tenderlake.functions import dates as D
from tenderlake.functions import proof
from tenderlake.operators import verdicts

CASES = [
    # text, dates, ambiguous ones, nearest after a deadline cue
    ("due 2026-10-20 ok", ["2026-10-20"], [], None),
    ("due 20 November 2026 ok", ["2026-11-20"], [], None),
    ("due November 20, 2026 ok", ["2026-11-20"], [], None),
    ("due 04/03/2026 ok", ["2026-03-04", "2026-04-03"], ["2026-03-04", "2026-04-03"], None),
    ("Offers must be received no later than 10/12/2026 at 1600 hours local time.", ["2026-10-12", "2026-12-10"], ["2026-10-12", "2026-12-10"], None),
    ("Bids due 20/10/2026.", ["2026-10-20"], [], "2026-10-20"),
    ("Bids due 10/20/2026.", ["2026-10-20"], [], "2026-10-20"),
    ("Bids due 05/05/2026.", ["2026-05-05"], [], "2026-05-05"),
    ("Closing date: 12.10.2026.", ["2026-10-12", "2026-12-10"], ["2026-10-12", "2026-12-10"], None),
    ("Closing date: 12-Oct-26.", ["2026-10-12"], [], "2026-10-12"),
    ("Offers due date: 12-OCT-2026", [], [], None),
    ("12 marketing 2026", ["2026-03-12"], [], None),
    ("30 February 2026 and 2026-13-01", [], [], None),
    ("Closing date: see the schedule in Annex B. A pre-bid site visit will be held on 15 October 2026 at the chancery. Bids are due 28 November 2026 at 1500 hrs.", ["2026-10-15", "2026-11-28"], [], "2026-11-28"),
    ("Quotations are due 14 November 2026. Delivery shall be completed by 30 June 2027. Period of performance: 1 January 2027 to 31 December 2027.", ["2026-11-14", "2027-06-30", "2027-01-01", "2027-12-31"], [], "2026-11-14"),
    ("", [], [], None),
    (None, [], [], None),
]


def test_scan_and_nearest(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(CASES)], "i int, text string")
    text = F.col("text")
    got = {r.i: r for r in df.select("i", D.find_dates(text).alias("d"), D.ambiguous_dates(text).alias("a"), D.nearest_after_cue(text, D.scan_dates(text)).alias("n"), D.scan_dates(text).alias("h")).collect()}
    for i, (t, dates, ambiguous, nearest) in enumerate(CASES):
        assert got[i].d == dates and got[i].a == ambiguous and got[i].n == nearest, t
        for h in got[i].h:
            assert any(c.isdigit() for c in t[h.start : h.end]) and t[h.end - 1 : h.end].isdigit()


def test_validity_is_no_deadline(spark):
    t = "Sealed bids must reach us before 1500 hrs on 09 November 2026. Prices quoted shall remain valid until 30 June 2027."
    df = spark.createDataFrame([(t,)], "text string")
    r = df.select(D.nearest_after_cue(F.col("text"), D.scan_dates(F.col("text"))).alias("n")).first()
    assert r.n == "2026-11-09"


def test_windows_hold_the_date_and_little_else(spark):
    t = "filler word " * 400 + "Quotes must be received by 11/12/2026. " + "filler word " * 400
    df = spark.createDataFrame([(t,), ("no date",)], "text string")
    w = [r.w for r in df.select(D.date_windows(F.col("text"), D.scan_dates(F.col("text"))).alias("w")).collect()]
    assert "11/12/2026" in w[0] and 4 * len(w[0]) < len(t) and w[1] == ""
    far = "x " * 300
    two = f"{far}2026-01-01 {far}2026-02-02 {far}"
    r = spark.createDataFrame([(two,)], "text string").select(D.date_windows(F.col("text"), D.scan_dates(F.col("text"))).alias("w")).first()
    assert r.w.count("\n...\n") == 1


NOTICE = "Request for quotation for generators. {}\nThe posted date is 2026-09-01. Delivery is planned for 30 June 2027 to the warehouse."


@pytest.mark.parametrize("line", ["Offers must be in our hands by 1600 hrs on 12.10.2026 at the gate", "Envelopes are sealed at 15:00 on 12 October 2026 in public", "Nothing submitted past 12/10/2026 shall be entertained by us", "The window shuts 12-Oct-26 for everyone who bids", "| Submission | 2026-10-12 |", "antim tithi 12 October 2026 hai aur kuch nahin"])
def test_any_wording_stands_if_quoted(spark, line):
    row = _ground(spark, NOTICE.format(line), "2026-10-12", line)
    assert row.closing == "2026-10-12" and row.date_proof["closing"] == "quoted" and row.dropped == []


def _ground(spark, text, closing, quote, posted="", posted_quote=""):
    df = spark.createDataFrame([(text, closing, quote, posted, posted_quote, "", "")], "text string, closing string, closing_quote string, posted string, posted_quote string, qa_due string, qa_quote string")
    return verdicts.ground_dates(df).first()


def test_claims_without_proof_go(spark):
    invented = _ground(spark, "A notice without any day in it at all, only words.", "2026-10-12", "")
    assert invented.closing == "" and invented.dropped == ["closing"]
    delivery = _ground(spark, NOTICE.format("Nothing else."), "2027-06-30", "")
    assert delivery.closing == ""
    fake = _ground(spark, NOTICE.format("Bids are due 12 October 2026."), "2026-11-12", "Proposals close without fail on 12 November 2026 in the evening")
    assert fake.closing == ""
    kept = _ground(spark, NOTICE.format("Bids are due 12 October 2026."), "2026-10-12", "These words were never in the document at all, not one")
    assert kept.closing == "2026-10-12" and kept.date_proof["closing"] == "phrase" and kept.date_warnings
    late = _ground(spark, "Posted 2026-11-01. Bids are due 2026-10-12.", "2026-10-12", "Bids are due 2026-10-12.", "2026-11-01", "Posted 2026-11-01.")
    assert any("before the posted date" in w for w in late.date_warnings)


def test_quote_proof_tolerates_little(spark):
    source = "The contractor shall deliver twelve diesel generators to the mission warehouse before the end of the fiscal year."
    rows = [(source[10:70], True), (source[10:70].upper().replace(" ", "  "), True), (source[10:50] + "zzz", True), ("deliver", False), ("an invented clause that nobody wrote anywhere", False), ("", False)]
    df = spark.createDataFrame([(i, q, source) for i, (q, _) in enumerate(rows)], "i int, q string, s string")
    got = {r.i: r.ok for r in proof.with_citation_proof(df, "q", "s", "ok").collect()}
    assert got == {i: ok for i, (_, ok) in enumerate(rows)}


def longest_block(a, b):
    """The length of the longest common block, cell by cell."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0, *[row[j] + 1 if x == y else 0 for j, y in enumerate(b)]]
        best = max(best, *row)
    return best


@pytest.mark.parametrize("letters", ["ab", "abc ", "abcdefghijklmnop"])
def test_blocks_match_the_longest_one(spark, letters):
    pick = random.Random(letters)
    word = lambda n: "".join(pick.choice(letters) for _ in range(n))
    rows = [("", "x"), ("a" * 30, ""), ("a" * 30, "a" * 24), ("a" * 30, "a" * 25), ("a" * 24, "a" * 23), (None, "x"), ("x" * 40, None)]
    for _ in range(300):
        source = word(pick.randrange(1, 200))
        i = pick.randrange(len(source))
        quote = list(source[i : i + pick.randrange(10, 90)]) or ["a"]
        for _ in range(pick.randrange(4)):
            quote[pick.randrange(len(quote))] = pick.choice(["z", "", "zz"])
        rows.append((word(pick.randrange(12)) + "".join(quote) + word(pick.randrange(30)), source))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, s string")
    got = {r.i: r.ok for r in proof.with_citation_proof(df, "q", "s", "ok").collect()}
    norm = lambda t: " ".join((t or "").split(" ")).strip().lower()

    def stands(q, s):
        q, s = (re.sub(" +", " ", norm(x)) for x in (q, s))
        return len(q) >= 15 and s != "" and (q in s or longest_block(q, s) >= max(25, int(0.6 * len(q))))

    assert got == {i: stands(q, s) for i, (q, s) in enumerate(rows)} and len(set(got.values())) == 2
    matcher = {r.i: r.ok for r in proof.with_citation_proof(df, "q", "s", "ok", compat_autojunk=True).collect()}
    assert all(got[i] for i in matcher if matcher[i])


def test_proof_of_citations_runs_no_python(spark):
    df = spark.createDataFrame([("q", "s")], "q string, s string")
    assert "Python" not in proof.with_citation_proof(df, "q", "s", "ok")._jdf.queryExecution().executedPlan().toString()


def nearest(hits, spots, reach=180):
    gaps = [(h.start - e, h.start, h.iso) for h in hits if not h.ambiguous for _, e, _ in spots if 0 <= h.start - e <= reach]
    return min(gaps)[2] if gaps else None


def test_sweeps_match_all_pairs(spark):
    pick = random.Random(6)
    parts = ["bids due ", "closing date: ", "due by ", "deadline: ", "deadline for ", "2026-10-20", "3 May 2026", "04/03/2026", "5.5.2027", " and ", " word" * 9, "x" * 50, "no later than ", "Cob "]
    texts = ["".join(pick.choice(parts) + pick.choice(["", " "]) for _ in range(pick.randrange(0, 30))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, iso) for i, t in enumerate(texts) for iso in ("2026-10-20", "2027-05-05", "2030-01-01")], "i int, t string, iso string")
    t, iso = F.col("t"), F.col("iso")
    df = df.withColumns({"h": D.scan_dates(t), "c": D.cue_places(t, D.DEADLINE_CUES)})
    out = df.select("*", D.nearest_after_cue(t, F.col("h")).alias("near"), D.anchored(iso, t, F.col("h")).alias("ok"), D.anchored_evidence(iso, t, F.col("h")).alias("words")).collect()
    for r in out:
        assert [(s, e, k) for s, e, k in r.c] == [(m.start(), m.start() + len(c), k) for k, c in enumerate(D.DEADLINE_CUES) for m in re.finditer(re.escape(c), r.t.lower())]
        assert r.near == nearest(r.h, r.c)
        cue = next((s for s, _, _ in r.c for h in r.h if h.iso == r.iso and h.start >= s - 60 and h.end <= s + 200), None)
        assert r.ok == (cue is not None)
        assert r.words == (None if cue is None else re.sub(r"\s+", " ", r.t[max(cue - 60, 0) : cue + 200]).strip())
    assert {r.ok for r in out} == {True, False} and len({r.near for r in out}) > 3


def test_many_dates_in_one_text_take_linear_time(spark):
    """50,000 dates and as many cues: pairs of them would be 2.5 billion."""
    n = 50_000
    body = "".join(f"due by 2026-10-{1 + i % 28:02d} or bids due 3 x\n" for i in range(n))
    df = spark.createDataFrame([(body,)], "t string").withColumn("h", D.scan_dates(F.col("t")))
    start = time.time()
    r = df.select(F.size("h").alias("n"), D.nearest_after_cue(F.col("t"), F.col("h")).alias("near"), D.anchored(F.lit("2026-10-07"), F.col("t"), F.col("h")).alias("ok")).first()
    assert (r.n, r.near, r.ok) == (n, "2026-10-01", True)
    assert time.time() - start < 120


QUOTES = [
    ("Economic Opportunity Commercial Opportunities Request for Proposals", False),
    ("Quotations are due by September 14, 2026. No quotations will be accepted after this time.", False),
    ("The mission requires the services of a local qualified Supplier for its garden.", False),
    ("The mission requires the services of a local fuel contractor for one year.", False),
    ("This is a total small business set-aside under FAR 52.219-6 of the rules.", True),
    ("This contract is limited to 8(a) certified firms and to no others.", True),
    ("Award is restricted to HUBZone certified firms only; others are not considered.", True),
    ("It is reserved exclusively for service-disabled veteran-owned concerns this year.", True),
    ("Offers are restricted to firms that are nationals of and registered in the country.", True),
    ("The lot contains ITAR export-controlled military components of several kinds.", True),
    ("short", False),
]


def test_what_excludes(spark):
    df = spark.createDataFrame([(q, w) for q, w in QUOTES], "q string, want boolean")
    bad = df.withColumn("got", proof.citation_excludes(F.col("q"))).where("got.ok <> want").collect()
    assert bad == []


def test_offsets_in_long_texts_take_linear_time(spark):
    import re

    from tenderlake.functions import text

    n = 20_000
    body = "".join(f"line {i} RFQ-{1000 + i % 700} due 2026-10-{1 + i % 28:02d}\n" for i in range(n))
    df = spark.createDataFrame([(body,)], "t string")
    got = df.select(text.match_spans(F.col("t"), text.REFERENCE, 1).alias("m"), text.reference_marks(F.col("t")).alias("r"), F.size(D.scan_dates(F.col("t"))).alias("n")).first()
    assert [(m.start, m.end, m.value) for m in got.m] == [(m.start(), m.end(), m[1]) for m in re.finditer(text.REFERENCE, body)]
    assert [(r.start, r.value) for r in got.r] == [(body.index(f"RFQ-{1000 + i} "), f"RFQ-{1000 + i}") for i in range(700)] and got.n == n


def _plain_scan(text):
    """Every pattern by Python's own matching."""
    months = {m: i for i, m in enumerate(D.MONTHS, 1)}
    number = lambda x: int(x) if x.isdigit() else months.get(x[:3].lower(), 0)

    def iso(y, m, d):
        try:
            return datetime.date(int(y if len(y) == 4 else f"20{y}"), number(m), number(d)).isoformat()
        except ValueError:
            return None

    out = []
    for m in re.finditer(D.NUMERIC, text, re.ASCII):
        a, b, y = m.groups()
        both = [iso(y, b, a), iso(y, a, b)]
        two = None not in both and both[0] != both[1]
        out += [(m.start(), m.end(), x, two) for x in (both if two else [both[0] or both[1]])]
    for pattern, order in D.TEXTUAL:
        out += [(m.start(), m.end(), iso(*(m.group(g) for g in order)), False) for m in re.finditer(pattern, text, re.ASCII)]
    return sorted(x for x in out if x[2])


def test_dates_are_those_of_plain_matching(spark):
    pick = random.Random(5)
    bits = ["12", "3", "2026", "26", "March", "mar", "Sept.", "Decembers", "word", "filler", "-", "/", ".", ",", " ", " ", "  ", "\n", "20", "31", "x", "2026-03-12", "March 12, 2026", "5/6/2026", "7 Jul 2026", "1-Aug-26"]
    texts = ["".join(pick.choice(bits) for _ in range(pick.randrange(1, 14))) for _ in range(400)] + ["", "filler " * 50, "by March\n\n 12,\t2026", "March 12 2026March 13, 2026"]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", D.scan_dates(F.col("t")).alias("h")).collect()
    assert {r.id: [tuple(h) for h in r.h] for r in got} == {i: _plain_scan(t) for i, t in enumerate(texts)}


def test_excerpts_strip_navigation_once(spark):
    """The stripped text stands in the plan once, not once for each use."""
    frame = spark.createDataFrame([("Home\nOffers due 12 March 2026. " + "filler " * 400 + "By 5 May 2026.",)], "t string").select(D.triage_excerpt(F.col("t")).alias("x"))
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("jump into the main content") == 1
    assert frame.first().x.endswith("By 5 May 2026.") and "\n...\n" in frame.first().x


def test_texts_without_a_pattern_cost_one_search_of_it(spark):
    """Each pattern's texts are cut into matches only where it has one; a name is looked for by what follows it."""
    plan = spark.range(1).select(D.scan_dates(F.concat(F.col("id").cast("string"), F.lit(""))).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("RLIKE") >= 1 + 1 + len(D.TEXTUAL)


def test_days_and_words_that_are_no_dates_cost_no_failed_cast(spark):
    """Days are told by numbers and names by their letters; the dates are those of the calendar."""
    parts = [(y, m, d) for y in ("1999", "2000", "2023", "2024", "2100", "2101") for m in ("0", "1", "02", "9", "12", "13") for d in ("0", "1", "28", "29", "30", "31", "32")]
    got = spark.createDataFrame(parts, "y string, m string, d string").select("*", D.build_date(F.col("y"), F.col("m"), F.col("d")).alias("iso"))
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "try_to_date" not in plan and "as date" not in plan

    def plain(y, m, d):
        try:
            return datetime.date(int(y), int(m), int(d)).isoformat() if 2000 <= int(y) <= 2100 else None
        except ValueError:
            return None

    assert {tuple(r)[:3]: r.iso for r in got.collect()} == {p: plain(*p) for p in parts}
    names = [("October", 10), ("mAyor", 5), ("7", 7), ("07", 7), ("ju", None), ("", None), (None, None), ("words", None)]
    assert [tuple(r) for r in spark.createDataFrame([(n,) for n, _ in names], "n string").select("n", D.month_number(F.col("n"))).collect()] == names


def test_dates_scanned_before_are_not_scanned_again(spark):
    """Grounding takes the dates of the text that a column holds; a cue's text is put in lower case once."""
    text = "😀 112 March 2026, offers are due 12 March 2026. A visit is on 3 May 2026."
    rows = [(text, "2026-03-12", q, "2026-05-03", "", "", "") for q in ("", text, "offers are due 12 March 2026", "offers are due on another day")]
    df = spark.createDataFrame(rows, "text string, closing string, closing_quote string, posted string, posted_quote string, qa_due string, qa_quote string")
    with_hits = df.withColumn("hits", D.scan_dates(F.col("text")))
    again, once = verdicts.ground_dates(with_hits), verdicts.ground_dates(with_hits, hits="hits")
    assert once.collect() == again.collect()
    assert [r.date_proof.get("closing") for r in once.collect()] == ["phrase", "quoted", "quoted", "phrase"]
    count = lambda frame: frame._jdf.queryExecution().analyzed().toString().count(D.NUMERIC)
    assert count(once) < count(again)
    places = df.select(D.cue_places(F.col("text"), D.DEADLINE_CUES).alias("x"))
    assert places._jdf.queryExecution().analyzed().toString().count("lower(") == 1 and [tuple(p)[:2] for p in places.first().x] == [(text.index("offers are due"), text.index(" 12 March 2026."))]
