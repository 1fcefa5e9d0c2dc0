"""Streams against the batch queries: any order of arrival, late answers, runs that broke off."""

import json
import random
import time

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tenderlake.operators import register, ways
from tenderlake.streaming import decision_stream, way_stream

BASE = 1_700_000_000_000


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))


@pytest.mark.parametrize("seed", [1, 2])
def test_decisions_are_those_of_the_batch_in_any_order(spark, tmp_path, seed):
    pick = random.Random(seed)
    log = [{"key": f"k{pick.randrange(12)}", "action": pick.choice(["delete", "restore", "hide", "unhide", "switch", "clear", "dance"]), "tier": pick.choice(["bid", "no", ""]), "on": f"2026-05-{pick.randrange(1, 29):02d}"} for _ in range(80)]
    batch = spark.createDataFrame(log, decision_stream.ACTION)
    want = sorted(map(tuple, register.latest_decisions(batch).collect()), key=str)
    pick.shuffle(log)
    source, table = tmp_path / "in", f"{tmp_path}/decisions"
    for k in range(4):  # four runs, each going on from the one before
        put(source, str(k), log[k * 20 : k * 20 + 20])
        decision_stream.start(spark, str(source), table, f"{tmp_path}/cp", parts=3).awaitTermination()
    assert sorted(map(tuple, decision_stream.decisions(spark, table).collect()), key=str) == want and len(want) > 8
    fields = spark.createDataFrame([], register.REGISTER).schema
    rows = spark.createDataFrame([tuple({"sol": f"k{i}", "tier": "MID"}.get(f.name) for f in fields) for i in range(14)], fields)
    over = lambda d: sorted(map(str, register.apply_operator(rows, d).collect()))
    assert over(decision_stream.decisions(spark, table)) == over(register.latest_decisions(batch))


def event(key, at, step, **given):
    base = dict.fromkeys(f.split()[0] for f in ways.EVENT.split(", "))
    return base | {"key": key, "said_at": BASE + at, "step": step, "chars": 500, "is_solicitation": True, "status": "open", "closing": "2026-11-01"} | given


BUSY = {"tier": "REVIEW", "reason": "AI provider cooling down"}


def follow(spark, events, as_of="2026-06-01"):
    df = spark.createDataFrame(events, ways.EVENT)
    return {r.key: r for r in ways.follow(df, as_of).collect()}


def test_ways_end_where_they_should(spark):
    arrive = lambda k, **g: event(k, 0, "arrive", **g)
    log = [
        arrive("thin", chars=20), arrive("dup", known=True), arrive("new"), event("stray", 5, "triage"),
        arrive("page"), event("page", 10, "triage", is_solicitation=False), arrive("shut"), event("shut", 10, "triage", status="closed"),
        arrive("past"), event("past", 10, "triage", closing="2026-05-31"), arrive("today"), event("today", 10, "triage", closing="2026-06-01"),
        arrive("none"), event("none", 10, "triage", closing=""), event("none", 20, "dates", closing=None),
        arrive("read"), event("read", 10, "triage", closing=""), event("read", 20, "dates"), event("read", 30, "adjudicate", tier="BID"), event("read", 40, "triage", status="closed"),
        arrive("busy"), event("busy", 10, "triage"), *[event("busy", 20 + i, "adjudicate", **BUSY) for i in range(4)],
        arrive("late"), event("late", 10, "triage"), event("late", 20, "adjudicate", **BUSY), event("late", 30, "adjudicate", tier="REVIEW", reason="low confidence"),
        arrive("wait"), event("wait", 10, "triage"), event("wait", 20, "adjudicate", **BUSY), event("wait", 30, "adjudicate", **BUSY),
        arrive("no"), event("no", 10, "triage"), event("no", 20, "adjudicate", tier="NO"),
        arrive("lifted"), event("lifted", 10, "triage"), event("lifted", 20, "adjudicate", tier="NO"), event("lifted", 30, "opinion", upheld=False, tier="BID"),
        arrive("upheld"), event("upheld", 10, "triage"), event("upheld", 20, "adjudicate", tier="NO"), event("upheld", 30, "opinion", upheld=True, tier="BID"),
        arrive("moment"), event("moment", 0, "adjudicate", tier="MID"), event("moment", 0, "triage"),
    ]
    random.Random(1).shuffle(log)
    got = follow(spark, log)
    want = {"thin": "thin", "dup": "duplicate", "page": "not_solicitation", "shut": "expired", "past": "expired", "none": "no_date", "read": "complete", "busy": "given_up", "late": "complete", "lifted": "complete", "upheld": "complete", "moment": "complete"}
    assert {k: r.outcome for k, r in got.items() if r.outcome} == want
    assert {k: r.awaits for k, r in got.items() if r.awaits} == {"new": "triage", "stray": "arrive", "today": "adjudicate", "wait": "adjudicate", "no": "opinion"}
    assert {k: got[k].tier for k in ("read", "lifted", "upheld", "late", "no")} == {"read": "BID", "lifted": "BID", "upheld": "NO", "late": "REVIEW", "no": "NO"}
    assert (got["busy"].tries, got["busy"].retry_at, got["wait"].tries, got["wait"].retry_at) == (3, None, 2, BASE + 30 + 2 * ways.WAIT)
    assert ways.follow(spark.createDataFrame([], ways.EVENT), "2026-06-01").collect() == []


@pytest.mark.parametrize("size", [10_000, 1, 2, 7])
def test_ways_over_batches_equal_the_answers_taken_one_by_one(spark, size):
    """No answer becomes a Python object; a notice's answers may run on over several batches."""
    pick, base = random.Random(3), {f.split()[0]: None for f in ways.EVENT.split(", ")}
    any_ = {
        "step": [*ways.STEPS, *ways.STEPS, "adjudicate", "adjudicate", "else", None], "chars": [500, 500, 500, 20, None], "known": [False, False, True, None], "is_solicitation": [True, True, False, None],
        "status": ["open", "open", "closed", None], "closing": ["", "2026-11-01", "2026-05-01", None], "tier": ["BID", "NO", "NO", "REVIEW", "REVIEW", "REVIEW", "odd", None],
        "reason": ["AI down", "the Quota is used up", "provider", "low", None], "upheld": [True, False, False, None],
    }
    log = [base | {n: pick.choice(v) for n, v in any_.items()} | {"key": f"k{pick.randrange(60)}", "said_at": -5000 + n // 2} for n in range(3000)]
    log += [base | {"key": k, "said_at": -9000 + n, "step": step, "chars": 500, "closing": "2026-11-01"} for k in ("k1", "k2", "k3") for n, step in enumerate(("arrive", "triage"))]
    log += [base | {"key": "busy", "said_at": n, "step": step, "chars": 500, "closing": "2026-11-01", "tier": "REVIEW", "reason": "cooling"} for n, step in enumerate(("arrive", "triage", "adjudicate", "adjudicate", "dates"))]
    log += [base | {"key": "idle", "said_at": 0}]
    df = spark.createDataFrame(log, ways.EVENT)
    want = {}
    for r in ways_in_order(df):
        want[r["key"]] = ways.advance(want.get(r["key"], ways.beginning()), r, "2026-06-01")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = ways.follow(df, "2026-06-01").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.key: {n: r[n] for n in ways.WAY_FIELDS} for r in got} == want and len(got) == len(want) == 62
    assert len({w["outcome"] for w in want.values()}) > 4 and want["busy"]["retry_at"] == 3 + 2 * ways.WAIT


def ways_in_order(df):
    rows = df.withColumns({"place": ways.moment(F.col("step")), "tie": F.xxhash64(*df.columns)})
    return [r.asDict() for r in rows.orderBy("key", "said_at", "place", "tie").collect()]


def test_ways_make_no_python_objects_of_answers():
    n = 400_000
    steps = [ways.STEPS.index("arrive") + 1, *[0] * (n - 2), ways.STEPS.index("triage") + 1]
    kind = {"key": pa.string(), "said_at": pa.int64(), "place": pa.int8(), "ends": pa.int8(), "leads": pa.int8(), "trouble": pa.bool_(), "closing": pa.string(), "tier": pa.string()}
    values = {"key": ["hot"] * n, "said_at": range(n), "place": steps, "ends": [-1] * n, "leads": [2] * (n - 1) + [4], "trouble": [False] * n, "closing": [None] * (n - 1) + ["2026-11-01"], "tier": [None] * n}
    hot = pa.RecordBatch.from_arrays([pa.array(values[c], t) for c, t in kind.items()], names=list(kind))
    start = time.process_time()
    (way,) = [r for out in ways._fold(iter([hot.slice(i, 10_000) for i in range(0, n, 10_000)]), ways.WAIT) for r in out.to_pylist()]
    assert (way["awaits"], way["closing"], way["said_at"]) == ("adjudicate", "2026-11-01", n - 1) and time.process_time() - start < 0.4


def test_stream_of_answers_equals_the_batch(spark, tmp_path):
    pick = random.Random(7)
    log = []
    for k in range(40):
        for n, step in enumerate(("arrive", "triage", "dates", "adjudicate", "adjudicate", "adjudicate", "opinion")):
            if pick.random() < 0.9:
                given = {"closing": pick.choice(["", "2026-11-01", "2026-05-01"]), "known": pick.random() < 0.1, "upheld": pick.random() < 0.5, "tier": pick.choice(["BID", "NO"])}
                log.append(event(f"k{k}", n * 60_000 + pick.randrange(40_000), step, **given | (BUSY if step == "adjudicate" and pick.random() < 0.6 else {})))
    for k, tries in (("w1", 1), ("w2", 2)):
        log += [event(k, 0, "arrive"), event(k, 10, "triage"), *[event(k, 20 + i, "adjudicate", **BUSY) for i in range(tries)]]
    want = {k: (r.outcome, r.tries, r.closing, r.tier, r.said_at) for k, r in follow(spark, log).items() if r.outcome}
    pick.shuffle(log)
    source, out = tmp_path / "in", f"{tmp_path}/out"

    def run():
        with way_stream.state_store(spark):
            events = spark.readStream.schema(ways.EVENT).json(str(source))
            changes = way_stream.follow_stream(events, "2026-06-01").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp")
            changes.trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(way_stream.CHANGE).parquet(out).collect()

    for k in range(3):  # no order of time between or within the runs
        put(source, f"a{k}", log[k::3])
        rows = run()
    assert rows == []  # the watermark hasn't passed the answers
    put(source, "b", [event("clock", 2 * 3_600_000, "dates"), event("asked", 90 * 60_000, "arrive")])
    rows = run()
    ended = [r for r in rows if r.what == "ended"]
    assert {r.key: (r.outcome, r.tries, r.closing, r.tier, r.said_at) for r in ended} == want and len(ended) == len(want) > 20
    # Readers in trouble: asked again when their time has come, unless the answer came first.
    put(source, "c", [event("clock", 5 * 3_600_000, "dates"), event("k0", 1000, "opinion")])  # the second is too late
    rows = run()
    waiting = {k: r for k, r in follow(spark, log).items() if r.retry_at}
    asked = [(r.key, r.tries, r.retry_at) for r in rows if r.what == "ask again"]
    assert sorted(asked) == sorted((k, r.tries, r.retry_at) for k, r in waiting.items()) and {"w1", "w2"} <= {a[0] for a in asked}
    assert sum(r.what == "ended" for r in rows) == len(want)


def test_ended_ways_make_rows_and_ledger_entries(spark):
    told = [("a", "expired", None, "2026-05-31"), ("b", "expired", None, None), ("c", "no_date", None, None), ("d", "complete", "NO", "2026-11-01"), ("e", "thin", None, None), ("f", "given_up", None, "2026-11-01"), ("g", "duplicate", None, None), ("h", None, None, None), ("i", "not_solicitation", None, None), ("lost", "complete", "BID", "2026-11-01")]
    done = spark.createDataFrame([(k, None, o, 0, c, t, 1, None) for k, o, t, c in told], f"key string, {ways.WAY}")
    unit = lambda k, **g: {"key": k, "hash": f"h{k}", "sol_hint": "", "link": f"https://x/{k}", "post": "P", "country": None, "platform": "USGOV", "agency": None, "domestic": False, "source": "Site", "text": None, "attachments": None} | g
    given = [unit("a", text="Home\nSupply of desks and chairs"), unit("b", sol_hint="19AB1026Q0002"), unit("c", attachments=[f"f{i}" for i in range(20)]), unit("d", hash="ha"), *map(unit, "efghi")]
    units = spark.createDataFrame(given, "key string, hash string, " + ", ".join(f"{c} {'boolean' if c == 'domestic' else 'array<string>' if c == 'attachments' else 'string'}" for c in ways.UNIT))
    rows = {r.key: r for r in ways.register_rows(done, units, "2026-06-01").collect()}
    assert {k: (r.title, r.tier, r.status, r.archived, r.archivedOn, r.deadline, r.noDate, len(r.files), r.fileCount) for k, r in rows.items()} == {
        "a": ("Supply of desks and chairs", "", "Expired", True, "2026-06-01", "2026-05-31", False, 0, 0), "b": ("19AB1026Q0002", "", "Expired", True, "2026-06-01", None, False, 0, 0),
        "c": ("(a notice without a date)", "REVIEW", "Check", False, None, None, True, 15, 20), "d": ("(untitled)", "NO", "Active", False, None, "2026-11-01", False, 0, 0),
    }
    assert rows["a"].verifyNotes[0] == "closed on 2026-05-31" and rows["b"].verifyNotes[0] == "the notice says that it is over" and rows["d"].verifyNotes == [] and len({r.fp for r in rows.values()}) == 4
    assert sorted(r.hash for r in ways.finished(done, units).collect()) == ["ha", "hb", "hc", "hg", "hi"]


def test_a_notice_has_one_timer_however_many_answers():
    """What a notice costs a batch: a read and a write of state, a timer; none for each answer."""
    calls, store, timers = [], {}, set()

    class State:
        def get(self):
            calls.append("get")
            return store.get("k")

        def update(self, value):
            calls.append("update")
            store["k"] = value

    class Handle:
        def getValueState(self, name, schema):
            return State()

        def registerTimer(self, at):
            calls.append("timer")
            timers.add(at)

        def deleteTimer(self, at):
            timers.discard(at)

    class At:
        def __init__(self, at):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: at

    follow_ = way_stream.Follow("2026-06-01", ways.WAIT)
    follow_.init(Handle())
    log = [event("k", 0, "arrive"), event("k", 10, "triage"), *[event("k", 20 + i, "dates") for i in range(50)], event("k", 90, "adjudicate", **BUSY)]
    list(follow_.handleInputRows(("k",), [e | {"place": ways.STEPS.index(e["step"]) + 1, "tie": i} for i, e in enumerate(log)], At(0)))
    assert calls == ["get", "timer", "update"] and timers == {BASE + 1}
    fire = lambda at: [(r.what, r.tries, r.retry_at) for r in follow_.handleExpiredTimer(("k",), At(at), At(at))]
    timers.clear()
    assert fire(BASE + 1000) == [] and calls[3:] == ["get", "timer", "update"] and timers == {BASE + 90 + ways.WAIT}
    assert fire(BASE + 2 * ways.WAIT) == [("ask again", 1, BASE + 90 + ways.WAIT)] and fire(BASE + 3 * ways.WAIT) == []


class Handle:
    """A processor's handle over a plain store, for one grouping key; calls are counted."""

    def __init__(self):
        self.store, self.timers, self.calls = {}, set(), []

    def _state(self, name):
        call = lambda what, f: lambda *a: (self.calls.append(f"{name}.{what}"), f(*a))[1]
        held = self.store
        fs = {"get": lambda: held.get(name), "update": lambda v: held.update({name: v}), "clear": lambda: held.pop(name, None), "appendValue": lambda v: held.setdefault(name, []).append(v)}
        return type("State", (), {k: staticmethod(call(k, f)) for k, f in fs.items()})

    def getValueState(self, name, schema):
        return self._state(name)

    def getListState(self, name, schema):
        state = self._state(name)
        some = state.get
        state.get = staticmethod(lambda: iter(some() or []))
        return state

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class At:
    def __init__(self, watermark, expiry=None):
        self.getCurrentWatermarkInMs, self.getExpiryTimeInMs = lambda: watermark, lambda: expiry


def played(made, key_of, given, batches, late):
    """What a processor of each grouping key gives for batches, with the watermarks that Spark would have."""
    kept, out, newest, before = {}, [], 0, 0
    for batch in [*batches, [], []]:
        watermark = max(before, newest - late)
        groups = {}
        for row in (r for r in batch if r["said_at"] > before):
            groups.setdefault(key_of(row["key"]), []).append(row)
        for k, rows in groups.items():
            if k not in kept:
                kept[k] = (made(), Handle())
                kept[k][0].init(kept[k][1])
            assert list(kept[k][0].handleInputRows((k,), given(rows), At(watermark))) == []
        for k, (processor, handle) in kept.items():
            for at in sorted(t for t in handle.timers if t <= watermark):
                for some in processor.handleExpiredTimer((k,), At(watermark), At(watermark, at)):
                    out += [some.asDict()] if not hasattr(some, "to_dict") else pa.RecordBatch.from_pandas(some, preserve_index=False).to_pylist()
                handle.timers.discard(at)
        newest, before = max([newest, *(r["said_at"] for r in batch)]), watermark
    fields = ("key", "what", *ways.WAY_FIELDS)
    return sorted((tuple(r[f] for f in fields) for r in out), key=str), kept


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_notices_of_a_bucket_go_as_each_alone(spark, monkeypatch, seed):
    """Any order of arrival, late answers, readers asked again before, between and after answers."""
    monkeypatch.setattr(way_stream, "_VALUES", 3)
    monkeypatch.setattr(way_stream, "_VALUE", 20)
    pick, wait = random.Random(seed), 40
    log = []
    for k in range(60):
        at = pick.randrange(1500)
        for step in ("arrive", "triage", "dates", "adjudicate", "adjudicate", "adjudicate", "opinion", "else"):
            for _ in range(pick.choice([0, 1, 1, 1, 1, 2])):
                given = {"closing": pick.choice(["", "2026-11-01", "2026-11-01", "2026-05-01"]), "known": pick.random() < 0.1, "upheld": pick.random() < 0.5, "tier": pick.choice(["BID", "NO", None])}
                log.append(event(f"k{k}", at, step, **given | (BUSY if step == "adjudicate" and pick.random() < 0.7 else {})))
                at += pick.choice([0, 5, 30, 100])
    log = sorted(log, key=lambda e: e["said_at"] + pick.randrange(200)) + [event("clock", 10_000, "dates")]
    names = [f.split()[0] for f in ways.EVENT.split(", ")]
    df = spark.createDataFrame([tuple(e[n] for n in names) for e in log], ways.EVENT)
    rows = [r.asDict() for r in df.withColumns({"place": ways.moment(F.col("step")), "tie": F.xxhash64(*df.columns)}).collect()]
    frame = {r["tie"]: r for r in way_stream.dealt(df, "2026-06-01", 4).toPandas().to_dict("records")}
    size = pick.choice([25, 60])
    batches = [rows[i : i + size] for i in range(0, len(rows), size)]
    frames = lambda some: iter([pd.DataFrame([frame[r["tie"]] for r in some[i : i + 7]]) for i in range(0, len(some), 7)])
    want, _ = played(lambda: way_stream.Follow("2026-06-01", wait), lambda k: k, iter, batches, 100)
    for buckets in (1, 4):
        got, kept = played(lambda: way_stream.FollowMany(wait), lambda k, n=buckets: sum(map(ord, k)) % n, frames, batches, 100)
        assert got == want and {w[1] for w in want} == {"ended", "ask again"} and len(want) > 25
    many = kept[next(iter(kept))][1]
    assert len(many.store.get("ended", [])) <= 4 + 60 // 20  # keys of ended ways are put together


def test_state_is_called_for_buckets_not_for_notices(spark):
    df = spark.createDataFrame([tuple(event(f"k{i}", 10 * n, step).values()) for i in range(500) for n, step in enumerate(("arrive", "triage"))], f"{ways.EVENT}")
    assert tuple(event("k", 0, "arrive")) == tuple(df.columns)
    rows, handle, many = way_stream.dealt(df, "2026-06-01", 1).toPandas(), Handle(), way_stream.FollowMany(ways.WAIT)
    many.init(handle)
    list(many.handleInputRows((0,), iter([rows]), At(0)))
    assert handle.calls == ["answers.appendValue", "timer.get", "timer.update"] and handle.timers == {BASE + 1}
    list(many.handleInputRows((0,), iter([rows]), At(0)))
    assert handle.calls[3:] == ["answers.appendValue", "timer.get"]  # what waits isn't read to put more behind it
    assert list(many.handleExpiredTimer((0,), At(BASE + 5000), At(0, BASE + 1))) == [] and len(handle.calls) < 15
    assert way_stream._unpacked(handle.store["answers"], ways.ANSWER).num_rows == 1000  # those that count, not their copies


def test_answers_dealt_to_buckets_are_the_same_answers(spark):
    pick = random.Random(4)
    log = [event(f"k{i}", i - 300_000, pick.choice([*ways.STEPS, "else", None]), **{"closing": pick.choice([None, "", "2026-11-01", "x"]), "status": pick.choice(["open", "closed", None]), "tier": pick.choice([None, "NO", "REVIEW", "odd"]), "reason": pick.choice(["AI", None]), "upheld": pick.random() < 0.3, "known": i % 9 == 0, "is_solicitation": i % 8 > 0, "chars": i % 500}) for i in range(3000)]
    df = spark.createDataFrame([tuple(e.values()) for e in log] + [("before", -5, "arrive", *[None] * 8), ("far", 10**15, "triage", *[None] * 8)], ways.EVENT)
    want = {r.tie: r.asDict() | {"asked": False} for r in ways.columns(df, "2026-06-01").collect()}
    got = {r["tie"]: r for r in way_stream._answers(way_stream.dealt(df, "2026-06-01", 8).toPandas()).to_pylist()}
    assert got == want and len(got) == 3002 and len({(r["place"], r["ends"], r["leads"], r["trouble"]) for r in got.values()}) > 14


def test_streams_by_bucket_and_by_notice_are_one(spark, tmp_path):
    log = [event(f"k{i}", 1000 * n + i, step, **(BUSY if i % 3 == 0 else {"tier": "BID"})) for i in range(30) for n, step in enumerate(("arrive", "triage", "adjudicate"))]
    log += [event("long ago", -(10**13) - BASE, "arrive"), event("far", 10**13 - BASE, "arrive"), event("far", 10**13 - BASE, "triage")]
    random.Random(5).shuffle(log)
    for k in range(2):
        put(tmp_path / "in", str(k), log[k::2] + [event("clock", 7_200_000 * 2 * k, "dates")])
    got = []
    for buckets in (0, 3):
        out = f"{tmp_path}/out{buckets}"
        with way_stream.state_store(spark):
            events = spark.readStream.schema(ways.EVENT).option("maxFilesPerTrigger", 2).json(str(tmp_path / "in"))
            changes = way_stream.follow_stream(events, "2026-06-01", buckets=buckets).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp{buckets}")
            changes.trigger(availableNow=True).start().awaitTermination()
        got.append(sorted(map(tuple, spark.read.schema(way_stream.CHANGE).parquet(out).collect()), key=str))
    assert got[0] == got[1] and {r[1] for r in got[0]} == {"ended", "ask again"} and len(got[0]) == 30
