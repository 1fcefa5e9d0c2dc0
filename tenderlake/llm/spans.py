"""Vectorised work on the bytes of whole texts: words, their hashes, and a cache keyed by them.

Everything here runs inside Arrow tasks on bounded slices of a batch; Spark deals the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_random = np.random.default_rng(20240229)
#: A random odd 64-bit value for each byte, and the base of the polynomial hash with its inverse.
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_random.integers(1, 2**62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
ORDER = _random.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes with A-Z lower-cased.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of up to max_bytes of text each, or one
    longer text. Null texts are empty."""
    text = batch.column(batch.schema.get_field_index(column))
    text = text.fill_null("") if text.null_count else text
    text = text.cast(pa.large_string()) if text.type != pa.large_string() else text
    n = len(text)
    if not n:
        return
    buffers = text.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, text.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds) of the words, runs of no blank, of the texts; words i with
    bounds[d] <= i < bounds[d + 1] are those of text d."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~IS_BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal contents. values: a random value per symbol."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * ORDER[15])


class Cache:
    """Values of contents by their hash, as sorted arrays: a row of integers for each key.

    fill(indices) is asked for the rows of contents that are not known. At most `most` keys are
    kept; beyond that the cache starts anew, which costs time only."""

    def __init__(self, most: int = 1_500_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def rows(self, keys: np.ndarray, fill: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, starts, lengths): for each key the number of its distinct key, and for those where
        their integers lie in self.flat."""
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.clear()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        near = at < len(self.keys)
        known[near] = self.keys[at[near]] == distinct[near]
        if not known.all():
            lengths, flat = fill(first[~known])
            starts = len(self.flat) + np.cumsum(lengths) - lengths
            keys_ = np.concatenate([self.keys, distinct[~known]])
            order = np.argsort(keys_, kind="stable")
            self.keys = keys_[order]
            self.lengths = np.concatenate([self.lengths, lengths])[order]
            self.starts = np.concatenate([self.starts, starts])[order]
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            at = np.searchsorted(self.keys, distinct)
        return which, self.starts[at], self.lengths[at]


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces flat[start : start + length], one after the other."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    before = np.cumsum(lengths) - lengths
    return flat[np.arange(total) + np.repeat(starts - before, lengths)]


def batches(frame_batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in frame_batches:
        if batch.num_rows:
            yield batch
