"""Repeated passages: a sparse suffix array over anchors, scanned for maximal repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import step
from .shared import fresh, table, written

#: Bytes of a repeat, and of the gram whose least hash makes an anchor of each window of that length.
LENGTH, GRAM = 200, 50
#: Bytes that are hashed at a time; a longer text is taken in pieces that overlap.
PIECE = 1 << 20
#: Contexts of one key above which the key is split, and about so many that one task sorts.
GROUP = TASK = 4096
#: Fixed odd numbers: bases of the rolling hash, factors of its final mix.
BASE = 0x9E3779B97F4A7C15
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def _mixed(h: np.ndarray) -> np.ndarray:
    for factor in MIX:
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_UP, _DOWN = _powers(PIECE + 1024)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each gram of data, which depends on its bytes only."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=sums[1:])
    return _mixed((sums[gram:] - sums[:-gram]) * _DOWN[: n - gram + 1])


def _slide(values: np.ndarray, width: int, best: np.ufunc, fill: int) -> np.ndarray:
    """The best of each width values in a row, in linear time."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, fill, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    after = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    before = best.accumulate(blocks, axis=1).ravel()
    return best(after[:n], before[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are least in one of the windows of length bytes that hold
    them, for texts that lie end to end in data. All that tie are anchors, so equal windows have
    anchors at equal places."""
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    width = length - gram + 1
    n = len(data)
    sizes = np.diff(ends, prepend=0)
    chosen, hashes = [], []
    for first in range(0, max(n - length + 1, 0), PIECE):
        last = min(first + PIECE, n - length + 1)  # windows that start from first to before last
        piece = gram_hashes(data[first : last + length - 1], gram)
        low = _slide(piece, width, np.minimum, int(most))
        # A window that runs over the end of its text has no least gram.
        open_ = np.zeros(last - first + 1, np.int32)
        starts = np.clip(np.maximum(ends - length + 1, ends - sizes) - first, 0, last - first)
        stops = np.clip(ends - first, 0, last - first)
        np.add.at(open_, starts, 1)
        np.add.at(open_, stops, -1)
        low[np.cumsum(open_[:-1]) > 0] = 0
        around = np.zeros(len(piece) + width - 1, np.uint64)
        around[width - 1 : width - 1 + len(low)] = low
        high = _slide(around, width, np.maximum, 0)[: len(piece)]
        at = np.flatnonzero((high == piece) & (piece != 0))
        chosen.append(at + first)
        hashes.append(piece[at])
    if not chosen:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, h = np.concatenate(chosen), np.concatenate(hashes)
    at, index = np.unique(at, return_index=True)
    return at, h[index]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end, and where each value ends."""
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def _anchor_rows(frames: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """h1, h2, size (bytes of the text), at, run, n, gram, context: anchors, of which those with equal
    contexts that follow each other within a gram are one row, n anchors from at to at + run."""
    for batch in frames:
        data, ends = _flat(batch.column(2))
        sizes = np.diff(ends, prepend=0)
        begins = ends - sizes
        at, h = anchors(data, ends, length, gram)
        text = np.searchsorted(ends, at, "right")
        low = np.maximum(at - (length - gram), begins[text])
        high = np.minimum(at, ends[text] - length) + length
        body, digest = memoryview(data), xxhash.xxh3_64_intdigest
        context = np.fromiter((digest(body[i:j], k) for i, j, k in zip(low.tolist(), high.tolist(), (at - low).tolist(), strict=True)), np.uint64, len(at))
        new = np.ones(len(at), bool)
        new[1:] = (context[1:] != context[:-1]) | (h[1:] != h[:-1]) | (text[1:] != text[:-1]) | (np.diff(at) > gram)
        firsts = np.flatnonzero(new)
        lasts = np.append(firsts[1:], len(at))[: len(firsts)] - 1
        for s in range(0, len(firsts), 1 << 16):
            f, e = firsts[s : s + (1 << 16)], lasts[s : s + (1 << 16)]
            rows = pa.array(text[f])
            numbers = [sizes[text[f]].astype(np.int32), (at[f] - begins[text[f]]).astype(np.int32), (at[e] - at[f]).astype(np.int32), (e - f + 1).astype(np.int64), h[f].view(np.int64), context[f].view(np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *map(pa.array, numbers)], names=["h1", "h2", "size", "at", "run", "n", "gram", "context"])


def suffix_arrays(matrix: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(column, order, prefixes) for each column of matrix from the last: the rows in the order of (key,
    bytes from that column on), and how many bytes each shares from there with the row before it, 0
    where that has another key.

    A row of matrix is a text as its bytes plus one, with zeros around it, one at the end at least.
    Each column is sorted by its byte and the rank in the column after it. A common prefix grows by
    one where a row keeps the row before it; only other neighbours are compared byte by byte."""
    rows, columns = matrix.shape
    key = np.unique(keys, return_inverse=True)[1].astype(np.int64) << 40
    rank, before, shared = np.zeros(rows, np.int64), np.full(rows, -1), np.zeros(rows, np.int64)
    places = np.arange(rows)
    for column in range(columns - 1, -1, -1):
        byte = matrix[:, column].astype(np.int64)
        order = np.argsort(key | (byte << 24) | rank, kind="stable")
        rank[order] = places
        own, last = order[1:], order[:-1]
        alike = (key[own] == key[last]) & (byte[own] == byte[last]) & (byte[own] != 0)
        stays = alike & (before[own] == last)
        length = np.where(stays, shared[own] + 1, 0)
        other = np.flatnonzero(alike & ~stays)
        if len(other):
            x, y = matrix[own[other], column:], matrix[last[other], column:]
            length[other] = ((x != y) | (x == 0)).argmax(axis=1)
        before[own], shared[own] = last, length
        before[order[:1]], shared[order[:1]] = -1, 0
        yield column, order, shared[order]


def maximal_repeats(prefixes: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, bytes) of the intervals of a suffix array whose suffixes share at least so many
    bytes and are preceded by more than one byte: the maximal repeats, each with all its occurrences.

    prefixes holds what each suffix shares with the one before; left the byte before each, or -1
    where none is known, which differs from all. One pass with a stack of the open intervals: an
    interval is closed by a shorter common prefix, and tells the one around it what precedes it."""
    various = -2
    stack: list[list[int]] = []
    before = left.tolist()
    for i, value in enumerate([*prefixes.tolist()[1:], 0][: len(before)], 1):
        first, seen = i - 1, before[i - 1]
        while stack and stack[-1][0] > value:
            shared, first, own = stack.pop()
            seen = own if own == seen and own >= 0 else various
            if seen == various:
                yield first, i - 1, shared
        if value < least:
            continue
        if stack and stack[-1][0] == value:
            own = stack[-1][2]
            stack[-1][2] = own if own == seen and own >= 0 else various
        else:
            stack.append([value, first, seen])


def _various(prefixes: np.ndarray, left: np.ndarray, least: int) -> np.ndarray:
    """Which suffixes are in a run that shares at least so many bytes and is preceded by more than one:
    only there can an interval be a maximal repeat."""
    shared = prefixes >= least
    run = np.cumsum(~shared)
    differs = shared.copy()
    differs[1:] &= (left[1:] != left[:-1]) | (left[1:] < 0)
    return np.bincount(run, differs, run[-1] + 1)[run] > 0


def repeat_groups(contexts: list[bytes], keys: np.ndarray, places: np.ndarray, length: int) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """The maximal repeats of at least length bytes among contexts: groups (first, last, bytes) of
    occurrences, and the context and the offset in it of each occurrence.

    places says where the anchor lies in each context. Suffixes are sorted within a key and at equal
    distance from the anchor, so a window never meets itself in another context of its text."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    lead = int(places.max(initial=0))
    begins = lead - places
    columns = int((begins + sizes).max(initial=0)) + 1
    matrix = np.zeros((len(contexts), columns), np.uint16)
    matrix[np.repeat(np.arange(len(contexts)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - begins, sizes)] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.uint16) + 1
    groups, owners, offsets, done = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for column, order, prefixes in suffix_arrays(matrix, keys):
        if column > columns - length or not len(order):
            continue
        left = matrix[order, column - 1].astype(np.int64) - 1 if column else np.full(len(order), -1)
        kept = _various(prefixes, left, length)
        if kept.any():
            order = order[kept]
            # A run begins with a suffix that shares less, so runs stay apart.
            groups += [(first + done, last + done, shared) for first, last, shared in maximal_repeats(prefixes[kept], left[kept], length)]
            done += len(order)
            owners.append(order)
            offsets.append(column - begins[order])
    return groups, np.concatenate(owners), np.concatenate(offsets)


def covered(groups: list[tuple[int, int, int]], owner: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, end) of the bytes that occurrences cover, overlaps joined."""
    reach = np.zeros(len(owner), np.int64)
    for first, last, shared in sorted(groups, key=lambda g: g[2]):
        reach[first : last + 1] = shared
    at = np.flatnonzero(reach)
    at = at[np.lexsort((offset[at], owner[at]))]
    return merged(owner[at], offset[at], offset[at] + reach[at])


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans in the order of (owner, start), those that overlap or touch joined."""
    if not len(owner):
        return owner, start, end
    wide = int(end.max()) + 2
    reach = np.maximum.accumulate(owner * wide + end)
    new = np.ones(len(owner), bool)
    new[1:] = owner[1:] * wide + start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return owner[first], start[first], reach[np.append(first[1:], len(owner)) - 1] - owner[first] * wide


def _task_spans(group: pa.Table, length: int) -> pa.Table:
    """h1, h2, start, end of the repeats among the contexts of one task."""
    column = lambda name: group.column(name).to_numpy()
    owner, start, end = covered(*repeat_groups(group.column("body").to_pylist(), column("key"), column("place").astype(np.int64), length))
    from_ = column("start").astype(np.int64)[owner]
    return pa.table({"h1": column("h1")[owner], "h2": column("h2")[owner], "start": pa.array(start + from_, pa.int32()), "end": pa.array(end + from_, pa.int32())})


_SPANS = "h1 bigint, h2 bigint, start int, end int"


def _split(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """rows (key, low, high, h1, h2, start, place, body, n) of windows that start from low to high
    bytes before the anchor, those windows halved: (the two halves, one row for each distinct body;
    the spans of halves that equal another's). What all windows of a half hold is their new key."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(F.struct(F.col("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high")))
    rows = rows.select("key", "h1", "h2", "start", "place", "body", "n", F.explode(halves).alias("half")).select("*", "half.*").where("low <= high")
    first = F.greatest(F.lit(0), F.col("place") - F.col("high"))
    last = F.least(F.col("place") - F.col("low"), F.octet_length("body") - length)
    core = F.substring("body", F.col("place") - F.col("low") + 1, length - (F.col("high") - F.col("low")))
    rows = rows.where(first <= last).select(
        F.xxhash64("key", "low", "high", core).alias("key"), "low", "high", "h1", "h2", (F.col("start") + first).alias("start"), (F.col("place") - first).alias("place"),
        F.substring("body", first + 1, last - first + length).alias("body"), "n",
    )
    rows = written(rows.withColumn("same", F.xxhash64("place", "body")), "repeat-halves")
    own = ["h1", "h2", "start", "place", "body"]
    each = written(rows.groupBy("key", "low", "high", "same").agg(F.sum("n").alias("n"), F.min(F.struct(*own)).alias("one")), "repeat-classes")
    spans = rows.join(each.where("n > 1").select("key", "same"), ["key", "same"]).select("h1", "h2", "start", (F.col("start") + F.octet_length("body")).alias("end"))
    return each.select("key", "low", "high", "one.*", "n"), spans


def _compared(contexts: DataFrame, length: int) -> list[DataFrame]:
    """Spans of the repeats among contexts (as for _split). A key of more than GROUP contexts is split
    by the bytes that ever narrower ranges of its windows have in common; at the narrowest, a window,
    equal keys are equal bodies. So no task holds more than about GROUP + TASK contexts."""
    out, keep = [], ["key", "h1", "h2", "start", "place", "body"]
    while True:
        counts = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
        sizes = written(counts.where("size > 1"), "repeat-keys")
        total, most = sizes.where(F.col("size") <= GROUP).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], sizes.agg(F.max("size")).first()[0] or 0
        if total:
            tasks = -(-total // TASK)
            ready = contexts.join(sizes.where(F.col("size") <= GROUP).select("key"), "key").select(*keep, F.pmod(F.xxhash64("key"), F.lit(tasks)).alias("task"))
            out.append(written(ready.groupBy("task").applyInArrow(lambda group: _task_spans(group, length), _SPANS), "repeat-spans"))
        if most <= GROUP:
            return out
        contexts, spans = _split(contexts.join(sizes.where(F.col("size") > GROUP).select("key"), "key"), length)
        out.append(spans)


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(h1, h2, start, end): bytes that strings of length bytes cover which also start elsewhere, of a
    table of texts (h1, h2, body), a row for each document; h1 and h2 name the text. Spans may overlap.

    Each window of length bytes has an anchor, its gram of least hash, so equal windows have equal
    anchors. Anchors whose gram occurs once are done. A context is all that the windows around an
    anchor reach: documents of equal contexts are one class, wholly repeated if it has two. Where a
    gram has several contexts, one text of each class goes into a suffix array of its windows.
    """
    long_ = texts.where(F.octet_length("body") >= length)
    with step(texts.sparkSession) as keep:
        rows = long_.mapInArrow(lambda frames: _anchor_rows(frames, length, gram), "h1 bigint, h2 bigint, size int, at int, run int, n bigint, gram bigint, context bigint")
        rows = written(rows, "repeat-anchors")
        grams = rows.groupBy("gram").agg(F.sum("n").alias("total"), (F.min("context") != F.max("context")).alias("mixed")).where("total > 1").select("gram", "mixed")
        found = keep(rows.join(written(grams, "repeat-grams"), "gram"), "repeat-found")  # a hot gram is split by the join
    with step(texts.sparkSession) as keep:
        at, before = F.col("at"), length - gram
        start = F.greatest(at - before, F.lit(0))
        stop = lambda last: F.least(last, F.col("size") - length) + length
        mixed = found.where("mixed")
        classes = written(mixed.groupBy("gram", "context").agg(F.sum("n").alias("n"), F.min(F.struct("h1", "h2", "size", "at")).alias("one")), "repeat-classes")
        equal = found.where("NOT mixed").unionByName(mixed.join(classes.where("n > 1").select("gram", "context"), ["gram", "context"]))
        spans = [equal.select("h1", "h2", start.alias("start"), stop(at + F.col("run")).alias("end"))]
        wanted = classes.select("gram", "n", "one.*").select("h1", "h2", F.struct(F.col("gram").alias("key"), start.alias("start"), stop(at).alias("stop"), (at - start).alias("place"), "n").alias("one"))
        wanted = written(wanted.groupBy("h1", "h2").agg(F.collect_list("one").alias("all")), "repeat-wanted")
        contexts = long_.dropDuplicates(["h1", "h2"]).join(wanted, ["h1", "h2"]).select("h1", "h2", "body", F.explode("all").alias("one")).select("h1", "h2", "body", "one.*")
        contexts = contexts.select("key", F.lit(0).alias("low"), F.lit(before).alias("high"), "h1", "h2", "start", "place", F.substring("body", F.col("start") + 1, F.col("stop") - F.col("start")).alias("body"), "n")
        spans += _compared(written(contexts, "repeat-contexts"), length)
        out = spans[0]
        for more in spans[1:]:
            out = out.unionByName(more)
        return keep(out.distinct(), "repeat-spans")


def _without(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in frames:
        spans, kept = [], []
        for body, given in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
            body, place, rest, own = body.as_buffer(), 0, [], []
            given = np.array(sorted((s["start"], s["end"]) for s in given or []), np.int64).reshape(-1, 2)
            _, starts, ends = merged(np.zeros(len(given), np.int64), given[:, 0], given[:, 1])
            view = memoryview(body)
            for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
                rest.append(view[place:start])
                own.append({"start": start, "end": end})
                place = end
            kept.append(b"".join([*rest, view[place:]]))
            spans.append(own)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, span), pa.array(kept, pa.binary())], names=["h1", "h2", "spans", "kept"])


def texts_without_repeats(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(h1, h2, spans, kept) for each distinct text of texts (h1, h2, body): the maximal runs of removed
    bytes and the remaining bytes, put together."""
    spans = repeated_spans(texts, length, gram)
    spans = spans.groupBy("h1", "h2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = texts.dropDuplicates(["h1", "h2"]).join(spans, ["h1", "h2"], "left").select("h1", "h2", "body", "spans")
    return joined.mapInArrow(_without, "h1 bigint, h2 bigint, spans array<struct<start:int,end:int>>, kept binary")


def _named(docs: DataFrame, text: str) -> tuple:
    return F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text), F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with every column and two more at the end: spans (the maximal runs of removed bytes, end
    exclusive) and kept (the remaining bytes, which may cut a character), led by underscores if docs
    has such columns.

    A byte goes if a string of length bytes covers it that also starts anywhere else, in another row or
    the same; strings are judged on the texts as given and never cross texts. Rows are documents of
    their own, so a row that is repeated or a text that two rows hold is removed whole, if it is that
    long; shorter texts stay. A null text is an empty one. Ids play no part. An empty table gives an
    empty table, and other columns pass unchanged.
    """
    h1, h2, spans, kept = fresh(docs, "h1", "h2", "spans", "kept")
    first, second, body = _named(docs, text)
    done = texts_without_repeats(docs.select(first.alias("h1"), second.alias("h2"), body.alias("body")), length, gram)
    done = done.select(F.col("h1").alias(h1), F.col("h2").alias(h2), F.col("spans").alias(spans), F.col("kept").alias(kept))
    return docs.withColumns({h1: first, h2: second}).join(done, [h1, h2]).select(*docs.columns, spans, kept)


def op12_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    first, second, body = _named(docs, "text")
    texts = docs.select(first.alias("h1"), second.alias("h2"), body.alias("body"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    done = texts_without_repeats(texts).select("h1", "h2", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    rows = docs.select("doc_id", first.alias("h1"), second.alias("h2"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.join(done, ["h1", "h2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
