"""Texts of Arrow batches as flat byte arrays, a bounded block at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a block, unless one text alone has more, and texts in it.
BLOCK_BYTES, BLOCK_ROWS = 2 << 20, 1 << 15


_kept: dict = {}


def worker_keeps(kind: object, make: Callable[[], object]) -> object:
    """What a worker keeps from one task of a kind to the next; it goes when a task of another kind begins, so that memory holds one kind's at most."""
    if kind not in _kept:
        _kept.clear()
        _kept[kind] = make()
    return _kept[kind]


@dataclass
class Block:
    """Some rows of a batch: the other columns, and the texts as bytes with offsets (one more than rows)."""

    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts batches between rows so that a block's texts have at most ``limit`` bytes, or are a single row."""
    for batch in batches:
        data, offsets = flat(batch.column(text))
        first = 0
        while first < batch.num_rows:
            stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            stop = min(stop, first + BLOCK_ROWS)
            yield Block(batch.slice(first, stop - first), data[offsets[first] : offsets[stop]], offsets[first : stop + 1] - offsets[first])
            first = stop


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Consecutive byte strings as an Arrow array, without a copy of the bytes."""
    held = np.ascontiguousarray(data)
    bounds = np.ascontiguousarray(offsets, dtype=np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(held)])


def numbered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A number for each of the consecutive byte strings, the same for equal ones and no others."""
    return strings(data, offsets).dictionary_encode().indices.to_numpy(zero_copy_only=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every bit of an unsigned integer over all bits."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... elements."""
    out = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=out[1:])
    return out


#: ASCII white space: [\x20\x09-\x0D].
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the maximal runs of non-blank bytes begin and end; no run crosses a text's end."""
    solid = np.zeros(len(data) + 2, bool)
    np.logical_not(BLANK[data], out=solid[1:-1])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
    stops = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    return starts, stops


#: Two numbers for each byte, for two hashes that know nothing of each other.
_BYTE = mixed(np.arange(512)).reshape(2, 256)
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones((2, 1), np.uint64)


def stretch_hashes(data: np.ndarray, starts: np.ndarray | slice, stops: np.ndarray | slice, kind: int = 0) -> np.ndarray:
    """Polynomial hashes, modulo 2**64, of stretches of bytes; equal stretches have equal ones wherever they stand.

    Prefix sums are divided by the power of the base at which a stretch begins, so any
    number of stretches costs one pass. A slice stands for the places it takes. There
    are two kinds, which together make 128 bits.
    """
    global _powers
    n = len(data) + 1
    if _powers.shape[1] < n:
        steps = np.full((2, n), np.uint64(_BASE))
        steps[1], steps[:, 0] = np.uint64(pow(_BASE, -1, 2**64)), 1
        _powers = np.cumprod(steps, axis=1, dtype=np.uint64)
    sums = np.zeros(n, np.uint64)
    np.cumsum(_BYTE[kind][data] * _powers[0, : n - 1], out=sums[1:])
    return (sums[stops] - sums[starts]) * _powers[1, :n][starts]
