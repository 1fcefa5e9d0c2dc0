"""Ways to a notice, caps, and tables that only a step needs."""

import os
import random

from pyspark.sql import functions as F

import tenderlake
from tenderlake.operators import estimate, register, units, verdicts
from tenderlake.streaming.register_stream import merge_batch


def test_chase_follows_documents_anywhere_and_pages_that_speak_of_a_notice(spark):
    at = "https://site.example/"
    links = [
        (at, f"{at}tender#a", "read"), (at, f"{at}about", "about us"), (at, "https://files.example/x.PDF?v=2", ""), (at, "https://facebook.com/rfq.pdf", "rfq"), (at, "https://other.example/tender", "tender"),
        (f"{at}tender", at, "tender"), (f"{at}tender", f"{at}n/2", "Amendment 2"), (f"{at}n/2", f"{at}n/3", "Scope"), (f"{at}n/3", f"{at}n/4", "Annex"), ("https://files.example/x.PDF?v=2", f"{at}never", "tender"),
    ]
    out = units.chase(spark.createDataFrame(links, "url string, href string, anchor string")).where(F.col("root") == at)
    assert {(r.url, r.hop, r.document) for r in out.collect()} == {(at, 0, False), (f"{at}tender", 1, False), ("https://files.example/x.PDF?v=2", 1, True), (f"{at}n/2", 2, False), (f"{at}n/3", 3, False)}
    pages = spark.createDataFrame([(f"{at}n/3", "see http://sam.gov/opp/AAAAAAAA1/view"), (f"{at}n/2", "https://www.sam.gov/opp/bbbbbbbb2 or https://sam.gov/opp/cccccccc3"), ("https://x.example", None)], "url string, html string")
    assert [tuple(r) for r in units.redirects(out, pages).collect()] == [(at, "bbbbbbbb2")]


def test_walks_match_breadth_first_search(spark):
    """Over 150 roots, so masks have several blocks and full ones; rings, loops, documents that are pages too."""
    pick = random.Random(12)
    host = lambda i: f"https://h{i % 2}.example/"
    page = lambda i: f"{host(i)}p/{i}"
    links = [(page(i), page((i + 2 * pick.randrange(40)) % 160) + pick.choice(["", "#x", ".pdf", ".pdf#y"]), pick.choice(["tender", "more"])) for i in range(160) for _ in range(4)]
    links += [(page(i), page(0), "bid") for i in range(0, 160, 2)] + [(page(7) + ".pdf", page(9), "tender"), (page(3), "https://other.example/d.doc?z", "x")]
    df = spark.createDataFrame(links, "url string, href string, anchor string").repartition(3)
    for hops in (1, 3, 5):
        edges, want = {}, set()
        for a, href, anchor in links:
            paper = href.lower().split("?")[0].endswith((".pdf", ".doc"))
            if paper or (href.startswith(a[:19]) and anchor != "more"):
                edges.setdefault(a, set()).add((href if paper else href.split("#")[0], paper))
        for root in edges:
            seen, front = {root}, {root: False}
            want.add((root, root, 0, False))
            for hop in range(1, hops + 1):
                met = {}
                for u in (u for u, paper in front.items() if not paper):
                    for v, paper in edges.get(u, ()):
                        if v not in seen:
                            met[v] = met.get(v, False) or paper
                want |= {(root, v, hop, paper) for v, paper in met.items()}
                seen, front = seen | set(met), met
        got = [tuple(r) for r in units.chase(df, hops).select("root", "url", "hop", "document").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_walks_of_no_links(spark):
    none = spark.createDataFrame([], "url string, href string, anchor string")
    assert units.chase(none).count() == 0 and units.reach(none).count() == 0


def test_listing_keeps_first_notices_once(spark):
    links = [("l", 0, "https://a/tender/1#x", " First "), ("l", 1, "https://a/tender/1", "again"), ("l", 2, "https://twitter.com/tender", "t"), ("l", 3, "https://a/about", "About"), ("l", 4, "https://a/2", "Request: RFQ 2"), ("l", 5, "https://a/bid/3", None)]
    df = spark.createDataFrame(links, "url string, pos int, href string, anchor string")
    assert [(r.href, r.title, r["rank"]) for r in units.listed_notices(df, most=2).orderBy("rank").collect()] == [("https://a/tender/1", "First", 1), ("https://a/2", "Request: RFQ 2", 2)]


def test_search_is_the_first_shards_at_its_hour(spark):
    df = spark.createDataFrame([(0, "o", "IN"), (1, "k", "US"), (2, "a", "US"), (3, "r", None)], "pos int, ptype string, country_code string")
    ids = lambda *turn, **more: sorted(r.pos for r in units.search_turn(df, *turn, **more).collect())
    assert ids(14, 0) == [0, 1, 1, 3] and ids(14, 1) == ids(9, 0) == [] and ids(9, 0, hours=()) == [0, 1, 1, 3] and ids(14, 0, limit=1) == [0, 1]


def test_texts_for_readers_are_cut(spark):
    df = spark.createDataFrame([("a \n b" + "x" * 20000,), ("short",), (None,)], "t string")
    got = [r.t for r in df.select(verdicts.reader_texts(F.col("t")).alias("t")).collect()]
    assert [(len(t.body), len(t.evidence), len(t.shown), t.readable) for t in got] == [(18000, 1500, 600, True), (5, 5, 5, False), (0, 0, 0, False)]
    assert got[0].body.startswith("a bxx") and [len(r[0]) for r in df.select(estimate.estimator_body(F.col("t"))).collect()] == [9000, 5, 0]


def test_counts_of_files_equal_those_of_groups(spark):
    long = "word " * 60
    files = [(0, "https://x/RFQ-1234_a.pdf", long, ""), (1, "https://x/RFQ-1234_b.pdf", long, "part only"), (2, "https://x/RFQ-1234_c.pdf", "", ""), (3, "https://x/none.pdf", None, None)]
    df = spark.createDataFrame(files, "pos int, url string, text string, note string")
    groups = {r.key: (r.sol, r.ok, r.fail, len(r.text)) for r in units.group_files(df).collect()}
    assert {r.key: (r.sol, r.ok, r.fail, r.n_text) for r in units.file_counts(units.file_rows(df)).collect()} == groups and groups["RFQ1234"][1:3] == (2, 1)


def test_only_what_a_step_keeps_stays(spark):
    shared = tenderlake.shared_dir(spark)
    named = lambda n: [f for f in os.listdir(shared) if f.startswith(n)]
    with tenderlake.step(spark) as keep:
        inner = tenderlake.written(spark.range(5), "stepinner")
        with tenderlake.step(spark) as keep_inner:
            deeper = keep_inner(tenderlake.written(inner, "stepdeep").where("id > 1"), "stepkept")
        assert not named("stepdeep") and named("stepkept")
        out = keep(deeper.where("id > 2"), "stepresult")
    assert not named("stepinner") and not named("stepkept") and named("stepresult")
    assert sorted(r.id for r in out.collect()) == [3, 4]


def test_copies_in_one_batch_fold_by_time(spark):
    rows = [{"sol": "19AB1026Q0002", "link": f"https://x.usembassy.gov/{i}", "title": "desks and chairs", "value": v, "updated": u, "dateEvidence": {"a": "b"}} for i, (v, u) in enumerate([("late", "2026-05-03"), ("early", "2026-05-01"), ("mid", "2026-05-02")])]
    fields = spark.createDataFrame([], register.REGISTER).schema
    df = spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], fields)
    first = merge_batch(None, df, "2026-06-01")
    assert [(r.value, r.updated) for r in first.collect()] == [("late", "2026-05-03")]
    again = merge_batch(first, df.where("value = 'mid'"), "2026-06-01").collect()
    assert [(r.value, r.updated) for r in again] == [("late", "2026-05-03")]


def test_links_of_pages_that_share_a_url_have_one_order(spark):
    """Two pages of one URL have a link each at every place: their ranks don't depend on how rows are dealt."""
    rows = [("https://a.example/x", f"https://a.example/tender/{(7 * i + 3 * j) % 20:02d}{j}", f"tender {j}", i) for i in range(6) for j in range(4)]
    links = spark.createDataFrame(rows, "url string, href string, anchor string, pos int")
    want = [href for _, href, _, _ in sorted(rows, key=lambda r: (r[3], r[1]))]
    for dealt in (links, links.orderBy("href"), links.orderBy(F.desc("href")), links.repartition(7)):
        for out in (units.procurement_pages(dealt, most=30), units.listed_notices(dealt, most=30), units.candidates(dealt)):
            got = [r["href"] for r in out.orderBy("rank").collect()]
            assert got == want[: len(got)] and len(got) >= 15


def test_files_are_searched_once_and_sorted_without_a_comparator(spark):
    """A file's name is searched once, where its text has no reference; files of a notice come in order."""
    rows = [(2, "https://x.example/f/RFQ-1234_b.pdf", "word " * 40, ""), (1, "https://x.example/f/RFQ-1234_a.pdf", "other " * 40, ""), (3, "https://x.example/f/c.pdf", "see rfq-1234 and xRFQ-999, 19AB23CDEF and RFQ-5678 " + "word " * 40, "")]
    df = spark.createDataFrame(rows, "pos int, url string, text string, note string")
    plan = units.file_rows(df).select("key")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UrlCodec") == 1
    groups = units.group_files(df)
    assert "lambda left" not in groups._jdf.queryExecution().optimizedPlan().toString()
    assert {r.key: r.files for r in groups.collect()} == {"RFQ1234": [rows[1][1], rows[0][1]], "19AB23CDEF": [rows[2][1]]}
