"""A notice's way through its states, as a fold over the log of answers to its steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import fingerprint
from ..functions.text import first_title, or_empty

# Fixed values -------------------------------------------------------------------------------------
MAX_TRIES, LEAST_TEXT = 3, 180
TROUBLE = ("provider", "quota", "cooling")
# --------------------------------------------------------------------------------------------------

#: Steps in the order in which a notice takes them; answers of one moment count in it too.
STEPS = ("arrive", "triage", "dates", "adjudicate", "opinion")
#: How a way ends.
OUTCOMES = ("thin", "duplicate", "not_solicitation", "expired", "no_date", "given_up", "complete")
#: An answer to a step: said_at is milliseconds of event time; what a step doesn't say is NULL.
EVENT = "key string, said_at bigint, step string, chars int, known boolean, is_solicitation boolean, status string, closing string, tier string, reason string, upheld boolean"
#: Where a notice stands: the step it waits for or its outcome, and when that came about.
WAY = "awaits string, outcome string, tries int, closing string, tier string, said_at bigint, retry_at bigint"
WAY_FIELDS = tuple(f.split()[0] for f in WAY.split(", "))
#: Milliseconds after which a reader in trouble is asked again; they double with each try.
WAIT = 3_600_000


def beginning() -> dict:
    return dict.fromkeys(WAY_FIELDS) | {"awaits": "arrive", "tries": 0}


def in_trouble(event: dict) -> bool:
    """a REVIEW for want of a reader, which is worth another try."""
    reason = (event["reason"] or "").lower()
    return event["tier"] == "REVIEW" and (reason.startswith("ai") or any(word in reason for word in TROUBLE))


def _ends(event: dict, way: dict, as_of: str) -> str | None:
    """The outcome that an answer to the awaited step settles, if any."""
    step, closing = event["step"], event["closing"] or ""
    if step == "arrive":
        return "thin" if (event["chars"] or 0) < LEAST_TEXT else "duplicate" if event["known"] else None
    if step == "triage" and event["is_solicitation"] is False:
        return "not_solicitation"
    if step in ("triage", "dates"):
        if event["status"] == "closed" or (closing and closing < as_of):
            return "expired"
        return "no_date" if step == "dates" and not closing else None
    if step == "adjudicate":
        if in_trouble(event):
            return "given_up" if way["tries"] + 1 >= MAX_TRIES else None
        return None if event["tier"] == "NO" else "complete"
    return "complete"


def advance(way: dict, event: dict, as_of: str, wait: int = WAIT) -> dict:
    """Where a notice stands after an answer. Only an answer to the awaited step counts; what comes
    twice, too early or after the end changes nothing. A date that triage proves makes the reading
    of documents for one needless; a refusal waits for a second opinion."""
    step = event["step"]
    if way["outcome"] is not None or step != way["awaits"]:
        return way
    now = way | {"said_at": event["said_at"], "retry_at": None, "outcome": _ends(event, way, as_of)}
    if step in ("triage", "dates"):
        now["closing"] = event["closing"] or None
    elif step == "adjudicate" and in_trouble(event):
        now["tries"] += 1
        now["retry_at"] = event["said_at"] + wait * 2 ** way["tries"] if now["outcome"] is None else None
    elif step == "adjudicate":
        now["tier"] = event["tier"]
    elif step == "opinion" and event["upheld"] is False:
        now["tier"] = event["tier"] if event["tier"] in ("BID", "MID", "REVIEW") else "MID"
    if now["outcome"] is not None:
        now["awaits"] = None
    elif step == "adjudicate":
        now["awaits"] = "adjudicate" if in_trouble(event) else "opinion"
    else:
        now["awaits"] = "triage" if step == "arrive" else "adjudicate" if now["closing"] else "dates"
    return now


def moment(step: Column) -> Column:
    """The place of a step among answers of one moment."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STEPS]), step), F.lit(0)).cast("int")


def columns(df: DataFrame, as_of: str) -> DataFrame:
    """Answers as what `advance` would read from each when it is awaited: the outcome that it settles, the
    step it leads to, closing and tier where it sets them, and whether the reader was in trouble."""
    names = [f.split()[0] for f in EVENT.split(", ")]
    step, closing, reason = F.col("step"), or_empty(F.col("closing")), F.lower(or_empty(F.col("reason")))
    dated = step.isin("triage", "dates")
    trouble = (step == "adjudicate") & (F.col("tier") == "REVIEW") & reduce(or_, [F.contains(reason, F.lit(w)) for w in TROUBLE], F.startswith(reason, F.lit("ai")))
    trouble = F.coalesce(trouble, F.lit(False))
    over = (F.col("status") == "closed") | ((closing != "") & (closing < as_of))
    ends = (
        F.when(step == "arrive", F.when(F.coalesce("chars", F.lit(0)) < LEAST_TEXT, "thin").when(F.col("known"), "duplicate"))
        .when((step == "triage") & ~F.col("is_solicitation"), "not_solicitation").when(dated & over, "expired").when((step == "dates") & (closing == ""), "no_date")
        .when((step == "adjudicate") & ~trouble & ~F.col("tier").eqNullSafe("NO"), "complete").when(step == "opinion", "complete")
    )
    leads = F.when(step == "arrive", "triage").when(dated, F.when(closing == "", "dates").otherwise("adjudicate")).when(trouble, "adjudicate").otherwise("opinion")
    tier = F.when((step == "adjudicate") & ~trouble, F.col("tier")).when((step == "opinion") & ~F.col("upheld"), F.when(F.col("tier").isin("BID", "MID", "REVIEW"), F.col("tier")).otherwise("MID"))
    index = lambda c, words: (F.coalesce(F.array_position(F.array(*[F.lit(w) for w in words]), c), F.lit(0)) - 1).cast("tinyint")
    return df.select(
        "key", "said_at", moment(step).cast("tinyint").alias("place"), F.xxhash64(*names).alias("tie"), index(ends, OUTCOMES).alias("ends"), moment(leads).cast("tinyint").alias("leads"),
        trouble.alias("trouble"), F.when(dated, F.nullif(closing, F.lit(""))).alias("closing"), tier.alias("tier"),
    )


def _taken(batch: pa.RecordBatch, starts: np.ndarray, first: dict, wait: int, each: Callable | None = None) -> dict[str, np.ndarray]:
    """The ways of a batch's notices, which start at starts: arrays by notice. The first goes on from
    where it stood. All notices go from one counting answer to the next at once, and no way counts more
    than a few, so a round looks up for each notice the next answer to the step that it awaits. each
    gets the ways before a round, the notices that go on in it, and their next counting answers."""
    column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
    place, said_at, ends, leads, trouble = (column(n) for n in ("place", "said_at", "ends", "leads", "trouble"))
    stop = np.append(starts[1:], len(place))
    way = {"awaits": np.ones(len(starts), np.int8), "outcome": np.full(len(starts), -1, np.int8), "tries": np.zeros(len(starts), np.int32)}
    way |= {n: np.full(len(starts), -1, np.int64) for n in ("last", "closing", "tier")}
    way |= {"retry_at": np.zeros(len(starts), np.int64), "again": np.zeros(len(starts), bool)}
    for name in ("awaits", "outcome", "tries"):
        way[name][0] = first[name]
    has = {name: batch.column(name).is_valid().to_numpy(zero_copy_only=False) for name in ("closing", "tier")}
    of_step = [np.flatnonzero(place == s) for s in range(len(STEPS) + 1)]
    at, going = starts - 1, np.flatnonzero(way["awaits"] > 0)
    while len(going):
        step, nxt = way["awaits"][going], np.full(len(going), len(place))
        for s in np.unique(step):
            mine = np.flatnonzero(step == s)
            found = np.searchsorted(of_step[s], at[going[mine]], "right")
            inside = found < len(of_step[s])
            nxt[mine[inside]] = of_step[s][found[inside]]
        on = nxt < stop[going]
        going, nxt = going[on], nxt[on]
        if each is not None:
            each(way, going, nxt)
        at[going] = way["last"][going] = nxt
        tries = way["tries"][going]
        end = np.where(trouble[nxt] & (tries + 1 >= MAX_TRIES), OUTCOMES.index("given_up"), ends[nxt])
        way["again"][going] = trouble[nxt] & (end < 0)
        way["retry_at"][going] = said_at[nxt] + wait * 2 ** tries.astype(np.int64)
        way["tries"][going] += trouble[nxt]
        way["outcome"][going], way["awaits"][going] = end, np.where(end < 0, leads[nxt], 0)
        for name in ("closing", "tier"):
            way[name][going[has[name][nxt]]] = nxt[has[name][nxt]]
        going = going[end < 0]
    return way


def _words(words: tuple[str, ...], index: np.ndarray) -> pa.Array:
    """The words at the index, NULL where it is negative."""
    return pa.array(words, pa.string()).take(pa.array(index, mask=index < 0))


def _stand(batch: pa.RecordBatch, starts: np.ndarray, first: dict, way: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Where notices of a batch stand, a row each."""

    def told(name: str, index: np.ndarray) -> pa.Array:
        # What the first notice brought along stands before the values of the batch.
        values = pa.concat_arrays([pa.array([first[name]], batch.schema.field(name).type), batch.column(name)])
        index = index + 1
        return values.take(pa.array(index, mask=(index == 0) & (np.arange(len(index)) > 0)))

    retry_at = pa.array(way["retry_at"], mask=~way["again"])
    if len(starts) and way["last"][0] < 0:  # no answer of the first counted here
        retry_at = pa.concat_arrays([pa.array([first["retry_at"]], pa.int64()), retry_at.slice(1)])
    columns = {
        "key": batch.column("key").take(pa.array(starts)), "awaits": _words(STEPS, way["awaits"].astype(np.int64) - 1), "outcome": _words(OUTCOMES, way["outcome"].astype(np.int64)),
        "tries": pa.array(way["tries"]), "closing": told("closing", way["closing"]), "tier": told("tier", way["tier"]), "said_at": told("said_at", way["last"]), "retry_at": retry_at,
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _fold(batches: Iterator[pa.RecordBatch], wait: int) -> Iterator[pa.RecordBatch]:
    open_: pa.RecordBatch | None = None  # the last notice's row: more of its answers may come
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key")
        new = np.ones(batch.num_rows, bool)
        new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
        row = open_.to_pylist()[0] if open_ is not None else None
        goes_on = row is not None and row["key"] == keys[0].as_py()
        if row is not None and not goes_on:
            yield open_
        first = row if goes_on else beginning()
        first |= {"awaits": STEPS.index(first["awaits"]) + 1 if first["awaits"] else 0, "outcome": OUTCOMES.index(first["outcome"]) if first["outcome"] else -1}
        starts = np.flatnonzero(new)
        out = _stand(batch, starts, first, _taken(batch, starts, first, wait))
        yield out.slice(0, out.num_rows - 1)
        open_ = out.slice(out.num_rows - 1)
    if open_ is not None:
        yield open_


def follow(events: DataFrame, as_of: str, wait: int = WAIT) -> DataFrame:
    """K1: where each notice stands after its events (EVENT), a row a key: awaits, outcome, tries, closing,
    tier, said_at (when the last counting answer came) and retry_at: what `advance` makes of them one by one.

    Events are dealt by key and sorted within it by time, step and content, so any order of arrival
    gives the same; a batch of events is held at a time, and of the notice that it ends in one row.
    Events without a key or time are left out."""
    rows = columns(events, as_of).where("key IS NOT NULL AND said_at IS NOT NULL")
    rows = rows.repartition("key").sortWithinPartitions("key", "said_at", "place", "tie").drop("tie")
    return rows.mapInArrow(lambda batches: _fold(batches, wait), f"key string, {WAY}")


#: An answer that waits or has counted, as `columns` has it; asked: a reader was asked again after it.
ANSWER = pa.schema({"key": pa.string(), "said_at": pa.int64(), "place": pa.int8(), "tie": pa.int64(), "ends": pa.int8(), "leads": pa.int8(), "trouble": pa.bool_(), "closing": pa.string(), "tier": pa.string(), "asked": pa.bool_()})


def take_up(answers: pa.Table, passed: int, wait: int) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch], pa.Table, int | None]:
    """The ways of many notices when event time has passed a moment, from their answers (ANSWER) in any
    order: a row of each way that has ended; rows of those whose reader is to be asked again and
    wasn't; the answers that still matter; and the moment to look again, if any. What matters of a
    way that goes on are its answers yet to come and those that counted, from which it is the same
    again."""
    column = lambda t, name: t.column(name).to_numpy(zero_copy_only=False)
    of = answers.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.lexsort((column(answers, "tie"), column(answers, "place"), column(answers, "said_at"), of))
    is_due = column(answers, "said_at")[order] < passed
    later, of_due = order[~is_due], of[order[is_due]]
    if not len(of_due):
        return None, [], answers, min(column(answers, "said_at")[later] + 1, default=None)
    (due,) = answers.take(order[is_due]).combine_chunks().to_batches()
    starts = np.flatnonzero(np.append(True, of_due[1:] != of_due[:-1]))
    first, said_at, asked = beginning() | {"awaits": 1, "outcome": -1}, column(due, "said_at"), column(due, "asked").copy()
    counted, again = np.zeros(len(of_due), bool), []

    def ask(way: dict[str, np.ndarray], going: np.ndarray, now: np.ndarray | int) -> None:
        on = going[way["again"][going] & (way["retry_at"][going] <= now)]
        on = on[~asked[way["last"][on]]]
        asked[way["last"][on]] = True
        again.append(_stand(due, starts[on], first, {n: v[on] for n, v in way.items()}))

    def each(way: dict[str, np.ndarray], going: np.ndarray, nxt: np.ndarray) -> None:
        ask(way, going, said_at[nxt])
        counted[nxt] = True

    way = _taken(due, starts, first, wait, each)
    ask(way, np.arange(len(starts)), passed)
    over = way["outcome"] >= 0
    ended = _stand(due, starts, first, way).filter(pa.array(over))
    later = later[~np.isin(of[later], of_due[starts[over]])]
    counted &= ~np.repeat(over, np.diff(starts, append=len(of_due)))
    due = due.set_column(due.schema.get_field_index("asked"), "asked", pa.array(asked)).filter(pa.array(counted))
    asks = way["again"] & ~asked[way["last"]]
    look = np.append(column(answers, "said_at")[later] + 1, way["retry_at"][asks])
    return ended, again, pa.concat_tables([pa.Table.from_batches([due]), answers.take(later)]), min(look, default=None)


#: Outcomes that make a register row, and those after which a notice isn't looked at again.
RECORDED = ("expired", "no_date", "complete")
SETTLED = ("duplicate", "not_solicitation", *RECORDED)
MOST_FILES = 15
#: What a unit brings to its row.
UNIT = ("sol_hint", "link", "post", "country", "platform", "agency", "domestic", "source", "text", "attachments")


def register_rows(ways: DataFrame, units: DataFrame, as_of: str) -> DataFrame:
    """K2: the register rows of the notices whose way has ended in one: the expired, archived as such; those
    without a date anywhere, for someone to settle; and the complete, with their tier. ways is what
    `follow` gives, units has key and UNIT. A notice without a unit makes no row; a null title is the
    first usable line of the text, else the reference, else a word for what it is."""
    ended = ways.where(F.col("outcome").isin(*RECORDED)).select("key", "outcome", F.col("tier").alias("decided"), F.col("closing").alias("read"))
    rows = ended.join(units.select("key", *UNIT), "key")
    over, undated = F.col("outcome") == "expired", F.col("outcome") == "no_date"
    named = F.when(over, "(an expired notice)").when(undated, "(a notice without a date)").otherwise("(untitled)")
    by = lambda expired, no_date, complete: F.when(over, expired).when(undated, no_date).otherwise(complete)
    none, words = F.lit(None).cast("string"), lambda *notes: F.array(*[F.lit(n) if isinstance(n, str) else n for n in notes])
    closed = F.concat(F.lit("closed on "), "read")
    rows = rows.withColumns({
        "sol": or_empty(F.col("sol_hint")), "title": F.coalesce(F.nullif(first_title(F.col("text")), F.lit("")), F.nullif("sol_hint", F.lit("")), named),
        "tier": by(F.lit(""), F.lit("REVIEW"), F.col("decided")), "deadline": by(F.col("read"), none, F.col("read")), "status": by(F.lit("Expired"), F.lit("Check"), F.lit("Active")),
        "archived": over, "archivedOn": F.when(over, F.lit(as_of)), "updated": F.lit(as_of), "noDate": undated, "needs": F.when(undated, F.lit("a closing date, from the notice itself")),
        "verified": F.lit("UNVERIFIED"),
        "verifyNotes": by(words(F.coalesce(closed, F.lit("the notice says that it is over")), "archived without reading its files"), words("no closing date anywhere", "not adjudicated"), F.array().cast("array<string>")),
        "files": F.slice(F.coalesce("attachments", F.array().cast("array<string>")), 1, MOST_FILES), "fileCount": F.coalesce(F.array_size("attachments"), F.lit(0)),
    })
    rows = rows.withColumn("fp", fingerprint(*[F.col(c) for c in ("sol", "title", "deadline", "status")], none, F.col("link")))
    made = ("sol", "title", "tier", "deadline", "status", "archived", "archivedOn", "updated", "noDate", "needs", "verified", "verifyNotes", "files", "fileCount", "fp")
    return rows.select("key", "outcome", *made, *[c for c in UNIT if c not in ("sol_hint", "text", "attachments")])


def finished(ways: DataFrame, units: DataFrame) -> DataFrame:
    """The hashes that the done-ledger gets: of units (key, hash) whose way is settled. What was thin
    or given up comes back."""
    return ways.where(F.col("outcome").isin(*SETTLED)).select("key").join(units.select("key", "hash"), "key").select("hash").distinct()
