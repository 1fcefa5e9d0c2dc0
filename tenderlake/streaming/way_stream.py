"""Notices on their way, from a stream of answers: keyed state with timers."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import ways

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_WAITING = ", ".join(f"{ways.EVENT}, place int, tie bigint".split(", ")[1:])
_NAMES = tuple(f.split()[0] for f in _WAITING.split(", "))
_AT = _NAMES.index("said_at")
#: All that is kept of a notice, in one value: where it stands, the answers that wait, when its timer goes
#: off, and the retry_at for which a reader was asked again.
_STATE = f"{ways.WAY}, waiting array<struct<{_WAITING.replace(', ', ',').replace(' ', ':')}>>, timer bigint, asked bigint"
#: What the stream gives: a row when a notice's way ends, and one when a reader is to be asked again.
CHANGE = f"key string, what string, {ways.WAY}"
#: Notices are dealt into so many buckets, each with one state.
BUCKETS = 1024
#: Answers or keys in one value of a bucket's state at most, and values of keys at which they become fewer.
_VALUE, _VALUES = 50_000, 64
#: Milliseconds before and after 1970 that pandas has timestamps for.
_FAR = 9_223_000_000_000
_NULLABLE = {pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype()}.get


class Follow(StatefulProcessor):
    """Answers wait in state until the watermark has passed them, so all of a moment or before it are
    there and count in order, however they arrive. A notice has one timer, for the first of them or for
    asking a reader in trouble again, when it has been given its time and no answer came. When it goes
    off, all that the watermark has passed is taken up in order of time: so a notice costs one read
    and one write of its state a batch, however many answers it gets."""

    def __init__(self, as_of: str, wait: int):
        self.as_of, self.wait = as_of, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE)

    def _held(self) -> tuple[dict, list[tuple], int | None, int | None]:
        held = self.state.get()
        if held is None:
            return ways.beginning(), [], None, None
        *way, waiting, timer, asked = held
        return dict(zip(ways.WAY_FIELDS, way, strict=True)), [tuple(e) for e in waiting], timer, asked

    def _hold(self, way: dict, waiting: list[tuple], timer: int | None, asked: int | None) -> None:
        """Put the state, and set the timer where none is set or only a later one."""
        times = [e[_AT] + 1 for e in waiting]
        if way["retry_at"] not in (None, asked):
            times.append(way["retry_at"])
        first = min(times, default=None)
        if first is not None and (timer is None or first < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
            timer = first
        self.state.update((*(way[n] for n in ways.WAY_FIELDS), waiting, timer, asked))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        way, waiting, timer, asked = self._held()
        if way["outcome"] is None:
            self._hold(way, waiting + [tuple(row[n] for n in _NAMES) for row in rows], timer, asked)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        way, waiting, _, asked = self._held()
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        due = sorted((dict(zip(_NAMES, e, strict=True)) for e in waiting if e[_AT] < passed), key=lambda e: (e["said_at"], e["place"], e["tie"]))
        for event in (*due, None):
            now = passed if event is None else event["said_at"]
            if way["retry_at"] not in (None, asked) and way["retry_at"] <= now:
                asked = way["retry_at"]
                yield Row(key=key[0], what="ask again", **way)
            if event is not None:
                way = ways.advance(way, event, self.as_of, self.wait)
            if way["outcome"] is not None:
                yield Row(key=key[0], what="ended", **way)
                break
        self._hold(way, [] if way["outcome"] is not None else [e for e in waiting if e[_AT] >= passed], None, asked)

    def close(self) -> None:
        pass


def dealt(events: DataFrame, as_of: str, buckets: int) -> DataFrame:
    """Answers by bucket, in as few columns as they fit: each one costs time on the way to Python. code holds
    place, ends, leads and trouble; value is the closing date or the tier, whichever the step sets;
    event_time keeps to the years that pandas knows."""
    rows = ways.columns(events, as_of)
    code = F.col("place") + (F.col("ends") + 1) * 8 + F.col("leads").cast("int") * 64 + F.col("trouble").cast("int") * 512
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    at = F.timestamp_millis(F.least(F.greatest("said_at", F.lit(-_FAR)), F.lit(_FAR)))
    return rows.select(bucket.alias("bucket"), "key", "said_at", "tie", code.cast("smallint").alias("code"), F.coalesce("closing", "tier").alias("value"), at.alias("event_time"))


def _answers(rows: pd.DataFrame) -> pa.Table:
    """Answers as `dealt` gives them, as ways.ANSWER."""
    code = rows["code"].to_numpy(np.int64)
    place, value = code & 7, pa.array(rows["value"], pa.string(), from_pandas=True)
    only = lambda *steps: pc.if_else(pa.array(np.isin(place, [ways.STEPS.index(s) + 1 for s in steps])), value, pa.scalar(None, pa.string()))
    columns = {
        "key": rows["key"], "said_at": rows["said_at"], "place": place, "tie": rows["tie"], "ends": (code >> 3 & 7) - 1, "leads": code >> 6 & 7,
        "trouble": code >> 9 > 0, "closing": only("triage", "dates"), "tier": only("adjudicate", "opinion"), "asked": np.zeros(len(code), bool),
    }
    return pa.table([pa.array(columns[f.name]).cast(f.type) for f in ways.ANSWER], ways.ANSWER)


def _packed(table: pa.Table) -> Iterator[tuple[bytes]]:
    """The rows of a table as values of a list state."""
    for batch in table.combine_chunks().to_batches(max_chunksize=_VALUE):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(batch)
        yield (out.getvalue().to_pybytes(),)


def _unpacked(values: list[tuple[bytes]], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(value).read_all() for (value,) in values)])


class FollowMany(StatefulProcessor):
    """What Follow does, for all notices of a bucket at once, and no answer is a Python object for long. What
    a batch brings is put behind the answers that wait, which aren't read for it. The bucket has one
    timer; when it goes off, the answers of its ways under way are read, and those written that
    still matter (`ways.take_up`). Of an ended way its key stays, put behind the others' too."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answers = handle.getListState("answers", "rows binary")
        self.ended = handle.getListState("ended", "keys binary")
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        firsts = []
        for some in map(_answers, rows):
            firsts.append(pc.min(some.column("said_at")).as_py() + 1)
            for value in _packed(some):
                self.answers.appendValue(value)
        first, held = min(firsts), self.timer.get()
        if held is None or first < held[0]:
            if held is not None:
                self.handle.deleteTimer(held[0])
            self.handle.registerTimer(first)
            self.timer.update((first,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        keys = list(self.ended.get())
        ended = _unpacked(keys, pa.schema([ways.ANSWER.field("key")]))
        answers = _unpacked(list(self.answers.get()), ways.ANSWER)
        if ended.num_rows:
            answers = answers.filter(pc.invert(pc.is_in(answers.column("key"), ended.column("key").combine_chunks())))
        over, again, answers, look = ways.take_up(answers, passed, self.wait)
        for what, some in (*(("ask again", a) for a in again), ("ended", over)):
            if some is not None and some.num_rows:
                yield some.to_pandas(types_mapper=_NULLABLE).assign(what=what)
        self.answers.clear()
        for value in _packed(answers):
            self.answers.appendValue(value)
        if over is not None and over.num_rows:
            new = pa.Table.from_batches([over.select(["key"])])
            if len(keys) >= _VALUES:
                self.ended.clear()
                new = pa.concat_tables([ended, new])
            for value in _packed(new):
                self.ended.appendValue(value)
        self.timer.clear()
        if look is not None:
            self.handle.registerTimer(int(look))
            self.timer.update((int(look),))

    def close(self) -> None:
        pass


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The session with a state store that has timers, for streams that are started within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def follow_stream(events: DataFrame, as_of: str, late: str = "1 hour", wait: int = ways.WAIT, buckets: int = BUCKETS) -> DataFrame:
    """The changes (CHANGE) of a stream of events (ways.EVENT). An answer may come `late` behind the newest
    one and still count in its place; what comes later is lost. The session's state store must be
    STATE_STORE.

    Notices are dealt into buckets, which share a state; their number stays as long as a checkpoint does.
    buckets=0 gives each notice a state of its own, for batches that touch few of very many notices."""
    timed = events.where("key IS NOT NULL AND said_at IS NOT NULL")
    if buckets:
        return dealt(timed, as_of, buckets).withWatermark("event_time", late).groupBy("bucket").transformWithStateInPandas(FollowMany(wait), CHANGE, "Append", "eventTime")
    names = [f.split()[0] for f in ways.EVENT.split(", ")]
    timed = timed.select(*names, ways.moment(F.col("step")).alias("place"), F.xxhash64(*names).alias("tie"), F.timestamp_millis("said_at").alias("event_time"))
    keyed = timed.withWatermark("event_time", late).groupBy("key")
    return keyed.transformWithState(Follow(as_of, wait), CHANGE, "Append", "eventTime")
