"""Packing documents into training sequences with a fixed number of open windows per partition."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table, written
from .tokens import END_ID, VOCABULARY, vocabulary_path, word_tokenizer

LENGTH = 4096
OPEN_WINDOWS = 64
#: Leftover windows of so many partitions are merged by one task.
FAN_IN = 256
SLICE_CHARS = 1_000_000

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Packer:
    """Bounded-space online packing of (length, item) into windows of a capacity.

    An item goes to the open window that it fills best. If it fits none and all windows are open,
    the fullest is emitted: an item that may be cut first fills what is left of it. emit(window)
    gets the items of a window in order.
    """

    def __init__(self, emit, capacity: int = LENGTH, windows: int = OPEN_WINDOWS):
        self.emit, self.capacity, self.windows = emit, capacity, windows
        self.rooms: list[tuple[int, int]] = []  # (room left, window number), sorted
        self.open: dict[int, list] = {}
        self.next = 0

    def put(self, length: int, item, cut=None) -> None:
        """cut(item, n): the first n of the item and the rest; None: items stay whole."""
        while True:
            at = bisect_left(self.rooms, (length, -1))
            if at < len(self.rooms):
                room, k = self.rooms.pop(at)
                self.open[k].append(item)
                if room == length:
                    self.emit(self.open.pop(k))
                else:
                    insort(self.rooms, (room - length, k))
                return
            if len(self.rooms) < self.windows:
                self.open[self.next] = []
                insort(self.rooms, (self.capacity, self.next))
                self.next += 1
                continue
            room, k = self.rooms.pop(0)
            if cut is not None:
                head, item = cut(item, room)
                self.open[k].append(head)
                length -= room
            self.emit(self.open.pop(k))

    def leftovers(self) -> list[list]:
        """The open windows, the fullest first; none stay open."""
        out = [self.open.pop(k) for _, k in self.rooms]
        self.rooms = []
        return out


def _piece(doc, ids: np.ndarray, start: int, total: int) -> tuple:
    return doc, start, ids, total


def _cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
    doc, start, ids, total = piece
    return (doc, start, ids[:n], total), (doc, start + n, ids[n:], total)


def _rows(window: list[tuple], sequence: int, left: bool) -> list[tuple]:
    out, offset = [], 0
    for doc, start, ids, total in window:
        out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset, left))
        offset += len(ids)
    return out


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "left"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _NAMES]
    types = [pa.int64()] * 7 + [pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_NAMES)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a batch in runs of bounded size."""
    ids, texts, size = [], [], 0
    for doc, text in zip(batch.column(0), batch.column(1), strict=True):
        text = text.as_py() or ""
        if texts and size + len(text) > SLICE_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(doc.as_py())
        texts.append(text)
        size += len(text)
    if texts:
        yield ids, texts


def pack(docs: DataFrame, text: str = "text", vocabulary: str | None = None, length: int = LENGTH, windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row per piece of a document (SCHEMA).

    A document is its ids and the end id; a null or empty text is the end id alone. Each partition
    of docs is packed as it is read, in bounded space: `windows` open windows. Documents longer than
    a sequence give full sequences first. When nothing fits, the fullest window is filled up with a
    cut of the document, so only windows open at the end of a partition are padded. Those are merged
    at the end: their pieces are packed anew within the partition, then across partitions by tasks
    that take FAN_IN partitions each, so no task gathers what grows with the input. Ids of sequences
    are unique; repeated rows are documents of their own; a null doc_id stays null; an empty table
    gives an empty table. The same partitions give the same pieces in every run, lost tasks included.
    """
    path = vocabulary or vocabulary_path(VOCABULARY)

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, task = word_tokenizer(path), TaskContext.get().partitionId()
        ready: list[tuple] = []
        made = 0

        def emit(window: list[tuple], left: bool = False) -> None:
            nonlocal made
            ready.extend(_rows(window, (task << 36) + made, left))
            made += 1

        packer = Packer(emit, length, windows)
        for batch in frames:
            for ids, texts in _texts(batch):
                for doc, tokens in zip(ids, tokenizer(texts), strict=True):
                    tokens = np.append(tokens, np.int32(END_ID))
                    total = len(tokens)
                    full = total - total % length
                    for start in range(0, full, length):
                        emit([(doc, start, tokens[start : start + length], total)])
                    if full < total:
                        packer.put(total - full, (doc, full, tokens[full:], total), _cut)
                if len(ready) > 4096:
                    yield _batch(ready)
                    ready.clear()
        # The end: what is open is filled up, window by window.
        rest = [piece for window in packer.leftovers() for piece in window]
        last = Packer(emit, length, 1)
        for piece in sorted(rest, key=lambda p: -len(p[2])):
            last.put(len(piece[2]), piece, _cut)
        for window in last.leftovers():
            emit(window, True)
        yield _batch(ready)

    def merge(group: pa.Table) -> pa.Table:
        rows = list(zip(*[group.column(c).to_pylist() for c in _NAMES], strict=True))
        rows.sort(key=lambda r: (-r[2], r[5], r[6]))
        out: list[tuple] = []
        first, made = (1 << 62) + (min(r[5] for r in rows) >> 36 << 36), 0

        def emit(window: list[tuple]) -> None:
            nonlocal made
            offset = 0
            for r in window:
                out.append((*r[:5], first + made, offset))
                offset += r[2]
            made += 1

        packer = Packer(emit, length, len(rows))
        for r in rows:
            packer.put(r[2], r)
        for window in packer.leftovers():
            emit(window)
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=_NAMES[:7])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    pieces = written(source.mapInArrow(work, SCHEMA + ", left boolean"), "packed")
    left = pieces.where("left").withColumn("group", F.floor(F.shiftright("sequence_id", 36) / FAN_IN))
    merged = left.groupBy("group").applyInArrow(merge, SCHEMA)
    return pieces.where("NOT left").drop("left").unionByName(merged)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
