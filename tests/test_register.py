"""Identity, merge, archive and junk on the cases of FIXTURES.md."""

import itertools
import datetime
import decimal
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake.functions import identity, text
from tenderlake.operators import estimate, queue, register, rollup, units



def rows(spark, *given, extra="shard int"):
    schema = T.StructType([*T.StructType.fromDDL(register.REGISTER).fields, *T.StructType.fromDDL(extra).fields])
    return spark.createDataFrame([tuple(g.get(f.name) for f in schema) for g in given], schema)


def merged(spark, *copies):
    base = {"sol": "19AB1026Q0002", "link": "l", "title": "t"}
    df = rows(spark, *[base | c | {"shard": i} for i, c in enumerate(copies)])
    out = register.merge_copies(register.with_key(df), ["shard"]).collect()
    assert len(out) == 1
    return out[0]


RICH = {"tier": "BID", "verified": "VERIFIED", "deadline": "2026-11-01", "files": list("abcdef"), "dateEvidence": {"closing": "x"}, "updated": "2026-05-01", "status": "Active"}


def test_newer_finding_that_it_is_over_wins_in_any_order(spark):
    over = {"tier": "NO", "archived": True, "status": "Expired", "updated": "2026-06-01"}
    for pair in itertools.permutations([RICH, over]):
        r = merged(spark, *pair)
        assert (r.tier, r.archived, r.status, r.deadline) == ("NO", True, "Expired", None)
    r = merged(spark, RICH | {"updated": "2026-07-01"}, over)
    assert r.tier == "BID" and not r.archived


def test_evidence_beats_riches_and_thin_rows_are_filled(spark):
    poor = {"deadline": "2026-11-02", "dateEvidence": {"closing": "y"}, "tier": "BID"}
    assert merged(spark, RICH | {"dateEvidence": {}}, poor).deadline == "2026-11-02"
    assert merged(spark, {"tier": "BID", "verified": "VERIFIED"}, {"tier": "REVIEW", "deadline": "2026-12-01", "value": "5"}).deadline == "2026-12-01"


def test_counters_files_sources_and_notes_survive(spark):
    tried = {"repairTries": 3, "lastDeepScan": "2026-05-02", "verified": "UNVERIFIED", "verifyNotes": ["re-scan 2026-05-02: gave up after 3 tries"], "source": "SAM", "files": ["b", "c"]}
    fresh = {"verified": "UNVERIFIED", "deadline": "2026-11-01", "verifyNotes": ["no title"], "source": "SITE", "files": ["a", "b"], "tier": "BID", "hidden": True}
    r = merged(spark, fresh, tried)
    assert r.repairTries == 3 and r.source == "Site+SAM" and sorted(r.files) == ["a", "b", "c"] and r.fileCount == 3
    assert any("gave up" in n for n in r.verifyNotes) and r.hidden


def test_three_copies_fold_from_left_to_right(spark):
    r = merged(spark, RICH, {"tier": "MID", "files": ["z"]}, {"tier": "NO", "archived": True, "updated": "2026-09-09"})
    assert r.archived and "z" in r.files


@pytest.mark.parametrize(("sol", "post", "key"), [("RFQ-001", "Kathmandu", "KATHMANDU:RFQ:001"), ("RFP-001", "Dhaka", "DHAKA:RFP:001"), ("RFQ-001", "Dhaka", "DHAKA:RFQ:001"), ("19CA1026Q0002", "Lusaka", "19CA1026Q0002"), ("RFQ 19CA1026Q0002", "Lusaka", "19CA1026Q0002"), ("#19CA1026Q0002", "", "19CA1026Q0002"), ("", "X", "the link")])
def test_keys(spark, sol, post, key):
    df = spark.createDataFrame([(sol, post)], "sol string, post string")
    assert df.select(identity.canonical_key(F.col("sol"), F.lit("the link"), F.col("post"), F.lit(None).cast("string"), F.lit("P")).alias("k")).first().k == key


def test_references_are_cleaned(spark):
    df = spark.createDataFrame([(s,) for s in ("Supply of laptops", "Request for quotation", "Janitorial services", "19NP5026Q0014", "RFQ-001", "PR15305534", None)], "s string")
    assert [r.c for r in df.select(identity.clean_reference(F.col("s")).alias("c")).collect()] == ["", "", "", "19NP5026Q0014", "RFQ-001", "PR15305534", ""]


@pytest.mark.parametrize("status", ["cancelled", "Withdrawn", "awarded", "closed"])
def test_archiving_goes_one_way(spark, status):
    df = rows(spark, {"status": status}, {"status": "Active", "deadline": "2026-01-01"}, {"status": "Active", "deadline": "2026-06-30"}, {"archived": True, "deadline": "2030-01-01", "status": "Active"})
    out = [(r.archived, r.status) for r in register.archive(df, "2026-06-30").collect()]
    assert out == [(True, status), (True, "Expired"), (False, "Active"), (True, "Active")]


def test_junk(spark):
    df = rows(
        spark, {"title": "Skip to main content", "link": "https://x.usembassy.gov/a", "needs": "a deadline"}, {"title": "Home", "link": "https://x.usembassy.gov/business/", "datesSeen": ["2026-01-01"]},
        {"title": "Procurement", "link": "https://x.usembassy.gov/procurement/"}, {"title": "Shop", "link": "https://shop.example/"}, {"title": "RFQ", "sol": "19AB1", "link": "https://shop.example/"},
    )
    assert [r.j for r in df.select(register.is_junk().alias("j")).collect()] == [False, False, True, True, False]


def test_operator_log(spark):
    log = spark.createDataFrame([("k", "hide", None, "1"), ("k", "switch", "mid", "2"), ("k", "unhide", None, "3"), ("m", "delete", None, "1"), ("n", "delete", None, "1"), ("n", "restore", None, "2")], "key string, action string, tier string, on string")
    got = {r.key: r for r in register.latest_decisions(log).collect()}
    assert got["k"].hiddenOn is None and got["k"].tier == "MID" and got["m"].deletedOn == "1" and got["n"].deletedOn is None


def test_counts_are_read_however_written(spark):
    df = spark.createDataFrame([(v,) for v in ("3/10 this run", "5", None, "", "nope", "true", "12 calls", "0")], "v string")
    assert [r.n for r in df.select(text.leading_int(F.col("v")).alias("n")).collect()] == [3, 5, 0, 0, 0, 0, 12, 0]
    s = spark.createDataFrame([(0, "3/10 this run", "b", "", {"x": 1}), (1, "0/10 this run", "a", "late", {"x": 2})], "shard int, found string, startedAt string, lastError string, m map<string,int>")
    r = rollup.status_rollup(s.withColumn("heartbeat", F.col("startedAt"))).first()
    assert (r.found, r.startedAt, r.lastError, r.bots) == (3, "a", "late", 2)
    assert rollup.map_last(s, "m").first().value == 2 and rollup.map_sum(s, "m").first().value == 3


def test_listing_is_cut_at_references(spark):
    page = "Business\n\nSupply of desks\nNumber RFQ-1001\n" + "words " * 40 + "\nQuotations are due 15 October 2026\n\nCleaning\nNumber RFQ-2002\n" + "words " * 40 + "\nQuotations are due 28 February 2027\n"
    got = {r.sol: r.block for r in units.split_listing(spark.createDataFrame([(page,), ("one RFQ-1001 only",)], "text string")).collect()}
    assert set(got) == {"RFQ-1001", "RFQ-2002"}
    assert "15 October 2026" in got["RFQ-1001"] and "2002" not in got["RFQ-1001"] and "Supply of desks" in got["RFQ-1001"]
    assert "28 February 2027" in got["RFQ-2002"] and "1001" not in got["RFQ-2002"] and "15 October" not in got["RFQ-2002"]


def test_files_group_by_reference_in_text_or_name(spark):
    long = "word " * 60
    files = [(0, "https://x/a.pdf", f"RFQ-1234 {long}", ""), (1, "https://x/RFQ-1234_Pricing.xlsx", long, ""), (2, "https://x/RFQ-5678%20sow.pdf", long, ""), (3, "https://x/scan.pdf", "", "no text layer")]
    got = {r.key: r for r in units.group_files(spark.createDataFrame(files, "pos int, url string, text string, note string")).collect()}
    assert got["RFQ-1234"].ok == 1 and got["RFQ1234"].ok == 1 and got["https://x/scan.pdf"].fail == 1 and got["https://x/scan.pdf"].notes[0].why == "no text layer"


def test_links_are_made_absolute(spark):
    html = '<a href="/a">A</a><a class="x" href="b/../c.pdf">B <b>bold</b></a><a href="//h/x">C</a><a href="#t">D</a><a href="mailto:x@y">E</a><a href="?q=1">F</a>'
    df = spark.createDataFrame([("https://site.example/dir/page.html?z=1", html)], "url string, html string")
    got = [(r.href, r.anchor) for r in units.links(df).orderBy("pos").collect()]
    assert got == [("https://site.example/a", "A"), ("https://site.example/dir/c.pdf", "B bold"), ("https://h/x", "C"), ("https://site.example/dir/page.html?z=1#t", "D"), ("mailto:x@y", "E"), ("https://site.example/dir/page.html?q=1", "F")]


def test_places_of_all_shapes(spark):
    raw = ['{"noticeId":"1","placeOfPerformance":"India"}', '{"noticeId":"2","placeOfPerformance":{"country":{"name":"India","code":"IN"}}}', '{"noticeId":"3","placeOfPerformance":{"country":"IN"}}', '{"noticeId":"4","placeOfPerformance":{"countryName":"India","countryCode":"IN"}}', '{"noticeId":"5","placeOfPerformance":{"state":{"code":"VA"}}}', '{"noticeId":"6","placeOfPerformance":{"zip":"22202"}}', '{"noticeId":"6","title":"again"}', '{"title":"no id"}', '{"title":"no id"}', "not json"]
    out = units.api_notices(spark.createDataFrame([(r,) for r in raw], "raw string"), "2026-01-01")
    home = {r.noticeId: r.home for r in out.withColumn("home", text.is_domestic(F.col("country"), F.col("country_code"), F.col("state"), F.col("zip"))).where("noticeId IS NOT NULL").collect()}
    assert {k: home[k] for k in "12345"} == {"1": False, "2": False, "3": False, "4": False, "5": True}
    assert out.where("noticeId IS NULL").count() == 3


def test_estimates(spark):
    df = spark.createDataFrame([(42000.0, 52000.0, 61000.0, 0.62), (61000.0, 0.0, 42000.0, 0.5), (1.0, 1.0, 1.0, 0.1), (0.0, 0.0, 0.0, 0.9), (1250000.0, 1250000.0, 1250000.0, 2.0)], "l double, m double, h double, c double")
    got = [r.e for r in df.select(estimate.accepted(F.col("l"), F.col("m"), F.col("h"), F.lit("twelve units at the usual price each"), F.col("c")).alias("e")).collect()]
    assert got[0].display == "$42K – $61K" and got[1].low == 42000 and got[2] is None and got[3] is None and got[4].display == "$1.25M" and got[4].confidence == 1


def test_repair_backlog(spark):
    open_ = {"link": "l", "verified": "UNVERIFIED", "tier": "BID"}
    backlog = [open_] * 12 + [open_ | {"tier": "REVIEW"}] * 8 + [open_ | {"repairTries": 3}] * 2 + [RICH] * 6 + [open_ | {"archived": True, "deadline": "2020-01-01"}] * 4
    df = rows(spark, *[b | {"shard": i} for i, b in enumerate(backlog)])
    q = queue.shard(queue.repair_queue(df, "shard").withColumnRenamed("shard", "id"), 3)
    out = q.collect()
    assert len(out) == 20 and sorted(r.rank for r in out) == list(range(20))
    assert {r.id for r in out if r["rank"] < 8} == set(range(12, 20))
    assert [sum(r.shard == s for r in out) for s in range(3)] == [7, 7, 6]


def many_copies(spark, n, keys):
    pick = random.Random(3)
    fields = T.StructType.fromDDL(register.REGISTER).fieldNames()
    rows = []
    for i in range(n):
        row = dict.fromkeys(fields) | {"sol": keys(i), "link": "l", "tier": pick.choice(["BID", "NO", "MID"]), "deadline": pick.choice(["", None, "2026-11-01", "2026-12-01"])}
        row |= {"archived": pick.choice([None, False, False, True]), "updated": f"2026-05-{pick.randint(1, 28):02d}", "source": pick.choice(["SITE", "SAM", None]), "files": [f"f{i % 50}"], "repairTries": pick.randint(0, 3), "value": pick.choice(["", "5"])}
        row |= {"verified": pick.choice(["VERIFIED", "UNVERIFIED"]), "verifyNotes": pick.choice([None, [], ["no title"], ["re-scan: gave up"]]), "dateEvidence": pick.choice([None, {}, {"closing": "x"}]), "citation": pick.choice([None, ("d", "q")]), "estimate": pick.choice([None, 0.0, 2.5])}
        rows.append((*[row[f] for f in fields], i))
    return spark.createDataFrame(rows, f"{register.REGISTER}, pos int").repartition(3)


def test_copies_that_run_over_batches_fold_the_same(spark):
    df = many_copies(spark, 90, lambda i: "19AB1026Q0002" if i % 3 else f"19AB1026Q1{i // 2:03d}").cache()
    whole = sorted(register.merge_copies(df, ["pos"]).collect(), key=str)
    assert len(whole) == 31 and max(len(r.files) for r in whole) >= 40
    try:
        for rows in (1, 7):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            assert sorted(register.merge_copies(df, ["pos"]).collect(), key=str) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_columns_of_copies_travel_as_one_and_come_back_as_they_were(spark):
    """Each column on its way to Python costs Spark time for each row. Rows may hold more columns, of any type."""
    kind = f"{register.REGISTER}, pos int, price decimal(38,18), at timestamp, share double, tags map<string,array<string>>, raw binary, n bigint"
    fields = T.StructType.fromDDL(register.REGISTER).fieldNames()
    odd = ["\u0000\n\"\\ é\U0001f600", decimal.Decimal("12345678901234567890.123456789012345678"), datetime.datetime(2026, 5, 1, 1, 2, 3, 456789), float("-inf"), {"": [None, ""], "b": None}, b"\x00\xff", 2**63 - 1]
    made = lambda sol, pos, **g: tuple({"sol": sol, "link": "l", "title": odd[0], "notes": odd[0], "estimate": 0.1 + 0.2, "restrictions": [(None, "k", "")], "citation": (None, None), "updated": f"2026-05-0{pos}", **g}.get(f) for f in fields) + (pos, *odd[1:])
    rows = [made("19AB1026Q0001", 1), made("19AB1026Q0002", 1, files=["a"], tier="BID"), made("19AB1026Q0002", 2, files=["b"], dateProof={"closing": None}, datesSeen=[])]
    df = spark.createDataFrame(rows, kind)
    out = register.merge_copies(df, ["pos"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    (arrow,) = [line for line in plan.splitlines() if "MapInArrow" in line]
    assert arrow.count("#") < 20  # not 60 columns in and out
    got, want = {r.sol: r for r in out.collect()}, df.drop("pos").collect()
    assert got["19AB1026Q0001"].asDict() == want[0].asDict() | {"key": "19AB1026Q0001"} and out.columns == ["key", *df.drop("pos").columns]
    assert sorted(got["19AB1026Q0002"].files) == ["a", "b"] and got["19AB1026Q0002"].tier == "BID" and got["19AB1026Q0002"].price == odd[1] and got["19AB1026Q0002"].citation is not None and got["19AB1026Q0002"].raw == b"\x00\xff"


def test_fold_is_one_pass_over_sorted_rows(spark):
    plan = register.merge_copies(many_copies(spark, 5, str), ["pos"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan and plan.count("MapInArrow") == 1 and "hashpartitioning(key" in plan


def test_one_key_may_hold_a_third_of_a_million_rows(spark):
    """The hot key is folded in order: its last, newest, archived copy wins and all tries are counted."""
    fields = T.StructType.fromDDL(register.REGISTER)
    n = 1_000_000
    at, hot = F.col("id"), F.col("id") % 3 == 0
    given = {
        "sol": F.when(hot, F.lit("19AB1026Q0002")).otherwise(F.concat(F.lit("19AB"), F.lpad(at.cast("string"), 8, "0"))), "link": F.lit("l"), "tier": F.lit("BID"),
        "updated": F.lpad(at.cast("string"), 9, "0"), "archived": at == n - 1, "files": F.array((at % 7).cast("string")), "repairTries": (at % 11).cast("int"), "title": at.cast("string"),
    }
    df = spark.range(n, numPartitions=8).select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields], F.col("id").alias("pos"))
    out = register.merge_copies(df, ["pos"])
    r = out.where("sol = '19AB1026Q0002'").collect()
    assert len(r) == 1 and (r[0].title, r[0].archived, r[0].repairTries, r[0].files[0]) == (str(n - 1), True, 10, str((n - 1) % 7))
    assert sorted(r[0].files) == list("0123456") and out.count() == 1 + n - len(range(0, n, 3))


def test_numbers_are_adopted_only_if_free(spark):
    old = spark.createDataFrame([("a", ""), ("b", None), ("c", ""), ("d", "N1"), ("e", "")], "key string, sol string")
    again = spark.createDataFrame([("a", "n1"), ("b", "free"), ("c", " FREE "), ("d", "other"), ("e", None), ("z", "gone")], "key string, sol string")
    got = {r.key: (r.sol, r.note is not None) for r in register.adopted_references(old, again).collect()}
    assert got == {"a": ("", True), "b": ("FREE", False), "c": ("", True), "d": ("N1", False), "e": ("", False)}


def test_running_totals_of_groups_that_span_ranges(spark):
    pick = random.Random(5)
    rows = [(pick.choice(["a", "a", "a", "b", None]), i, pick.randint(1, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, at int, cost int").repartition(5)
    got = {(r.g, r.at): (r.spent_before, r.starts) for r in queue.admitted(df, "g", "at", "cost", 100).collect()}
    spent, want = {}, {}
    for g, at, cost in rows:
        before = spent.get(g, 0)
        want[g, at] = (before, 100 - before >= 6)
        spent[g] = before + cost
    assert got == want
    assert queue.admitted(df.limit(0), "g", "at", "cost", 100).collect() == []


def test_steps_of_threads_leave_each_other_alone(spark):
    import os
    import threading

    import tenderlake

    shared, ready, go = tenderlake.shared_dir(spark), threading.Event(), threading.Event()
    out = {}

    def other():
        with tenderlake.step(spark) as keep:
            mine = tenderlake.written(spark.range(3), "threadmine")
            ready.set()
            go.wait(60)
            out["rows"] = keep(mine, "threadkept").count()

    thread = threading.Thread(target=other)
    thread.start()
    ready.wait(60)
    with tenderlake.step(spark):
        tenderlake.written(spark.range(2), "threadmain")
    go.set()
    thread.join()
    named = lambda n: [f for f in os.listdir(shared) if f.startswith(n)]
    assert out["rows"] == 3 and not named("threadmain") and not named("threadmine") and len(named("threadkept")) == 1
