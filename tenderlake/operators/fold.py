"""The fold of a notice's copies into one row (U1, U2, U5-U8, J5), over rows sorted by key and order."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed values -------------------------------------------------------------------------------------
#: Fields that a winner takes from the loser where it has none; the deadline only if it is alive.
ENRICHED = ("posted", "value", "setaside", "samId", "estimate", "citation")
CARRIED = ("deleted", "deletedOn", "hidden", "hiddenOn", "switched", "switchedOn", "firstSeen", "notes", "verifyNotes")
DECIDED = ("BID", "MID", "NO")
# --------------------------------------------------------------------------------------------------

#: Columns that decide between copies, and those that a merge may change.
DECIDING = ("archived", "updated", "dateEvidence", "verified", "tier", "restrictions")
CHANGED = (*ENRICHED, *CARRIED, "deadline", "repairTries", "lastDeepScan", "source", "files", "fileCount")


def _missing(value) -> bool:
    """NULL, empty, zero or false; a struct is there if it isn't NULL."""
    return not isinstance(value, dict) and not value


def _stamp(row: dict) -> str:
    return max(row["lastDeepScan"] or "", row["updated"] or "")


def _standing(row: dict) -> tuple[bool, int, str]:
    """What decides between two copies neither of which newly says that the notice is over: a deadline
    with evidence, then riches, then the time it was last worked on."""
    rich = (
        100 * (row["verified"] == "VERIFIED") + 20 * bool(row["deadline"]) + 15 * (row["tier"] in DECIDED) + min(len(row["files"] or ()), 10)
        + 5 * (row["citation"] is not None) + len(row["restrictions"] or ())
    )
    return bool(dict(row["dateEvidence"] or ()).get("closing")), rich, _stamp(row)


def outlives(copy: dict, kept: dict) -> bool:
    """Whether a later copy takes the place of what the copies before it made."""
    over, was_over = bool(copy["archived"]), bool(kept["archived"])
    if over != was_over and _stamp(copy if over else kept) >= _stamp(kept if over else copy):
        return over
    return _standing(copy) > _standing(kept)


def merge(kept: dict, copy: dict, wins: bool) -> dict:
    """The winner's fields with what only the loser has; tries, scans, files, sources and the
    notes of repairs from both."""
    winner, loser = (copy, kept) if wins else (kept, copy)
    out = dict(winner)
    over = winner["archived"] or winner["tier"] == "NO"
    for field in (*ENRICHED, *CARRIED, *(() if over else ("deadline",))):
        if _missing(winner[field]):
            out[field] = winner[field] if _missing(loser[field]) else loser[field]
    for field in ("repairTries", "lastDeepScan"):
        out[field] = max((r[field] for r in (kept, copy) if r[field]), default=winner[field])
    if len({tag for r in (kept, copy) for tag in (r["source"] or "").upper().replace("+", " ").split()}) > 1:
        out["source"] = "Site+SAM"
    if winner["verified"] != "VERIFIED":
        repairs = [note for r in (kept, copy) for note in r["verifyNotes"] or () if "gave up" in note or "re-scan" in note]
        if repairs:
            others = [note for note in out["verifyNotes"] or () if "gave up" not in note and not note.startswith("re-scan")]
            out["verifyNotes"] = [*others, repairs[-1]][:6]
    out["files"] = list(dict.fromkeys([*(winner["files"] or ()), *(loser["files"] or ())]))
    out["fileCount"] = len(out["files"])
    return out


#: The column that holds them and others as JSON, and the values that JSON leaves out.
PACKED, _NONE = "__packed", dict.fromkeys((*DECIDING, *CHANGED))


class _Kept:
    """What the copies of one key so far have made: the winner's row, by place in a batch, and the
    values of the packed columns."""

    __slots__ = ("batch", "row", "values", "copies")

    def __init__(self, batch: pa.RecordBatch, row: int, values: dict):
        self.batch, self.row, self.values, self.copies = batch, row, values, 1

    def add(self, batch: pa.RecordBatch, row: int, values: dict) -> None:
        wins = outlives(values, self.values)
        self.values = merge(self.values, values, wins)
        self.copies += 1
        if wins:
            self.batch, self.row = batch, row


def _rows_of(kept: list[_Kept]) -> Iterator[pa.RecordBatch]:
    """The merged rows: the winners', with the changed columns."""
    by_batch: dict[int, list[_Kept]] = {}
    for x in kept:
        by_batch.setdefault(id(x.batch), []).append(x)
    for own in by_batch.values():
        rows = own[0].batch.take(pa.array([x.row for x in own]))
        texts = [json.dumps(x.values) if x.copies > 1 else old for x, old in zip(own, rows.column(PACKED).to_pylist(), strict=True)]  # a single copy stays as it is
        place = rows.schema.get_field_index(PACKED)
        yield rows.set_column(place, rows.schema.field(place), pa.array(texts, rows.schema.field(place).type))


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key of rows (key, PACKED and whatever else) that come sorted by key and, within it, by order;
    copies may run on from batch to batch. A row without a twin passes as it is, without becoming a Python object. What is
    held is one batch and one merged row, however many copies a key has."""
    open_: _Kept | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key")
        new = np.ones(batch.num_rows, bool)
        new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
        new[0] = open_ is None or keys[0].as_py() != open_.batch.column("key")[open_.row].as_py()
        alone = new & np.append(new[1:], False)  # the last may have a twin in the next batch
        rows = np.flatnonzero(~alone)
        if alone.any():
            yield batch.filter(pa.array(alone))
        texts = batch.column(PACKED).take(pa.array(rows)).to_pylist()
        done = []
        if open_ is not None and new[0]:
            done.append(open_)
            open_ = None
        for i, row in enumerate(rows.tolist()):
            values = _NONE | json.loads(texts[i])
            if open_ is not None and not new[row]:
                open_.add(batch, row, values)
                continue
            if open_ is not None:
                done.append(open_)
            open_ = _Kept(batch, row, values)
        yield from _rows_of(done)
        if open_ is not None:  # only its row stays of the batch
            open_.batch, open_.row = open_.batch.take(pa.array([open_.row])), 0
    if open_ is not None:
        yield from _rows_of([open_])
