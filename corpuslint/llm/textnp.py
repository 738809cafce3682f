"""Vectorised words and 64-bit hashes of a whole Arrow string column (numpy, no loop per word)."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_ALL = np.arange(256, dtype=np.uint8)
LOWER = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)
#: Bytes of words between ASCII white space.
NON_SPACE = ~np.isin(_ALL, [9, 10, 11, 12, 13, 32])
#: Bytes of words made of ASCII letters, digits and all characters beyond ASCII.
ALNUM = ((_ALL >= 48) & (_ALL <= 57)) | ((_ALL >= 97) & (_ALL <= 122)) | ((_ALL >= 65) & (_ALL <= 90)) | (_ALL >= 128)
BLOCK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x.astype(U)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


with np.errstate(over="ignore"):
    _POWER = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, U))


def column_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null is an empty text."""
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_binary())
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset: arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return off - off[0], data[off[0]: off[-1]]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of whole rows with at most `limit` bytes of text (one row may be longer)."""
    for b in batches:
        if not b.num_rows:
            continue
        off, _ = column_bytes(b.column(text))
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
            yield b.slice(a, z - a)
            a = z


def word_table(off: np.ndarray, data: np.ndarray, inside: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, row, 64-bit hash) of each word of all rows, in order.

    Works through the bytes in blocks cut between words, so temporary memory is
    bounded by the block (or the longest word), not by the longest text.
    """
    starts, hashes = [], []
    breaks = off[:-1]
    at = 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        if end < len(data):
            gaps = np.flatnonzero(~inside[data[at:end]])
            nexts = np.searchsorted(breaks, [at + 1, end + 1])
            cut = max(at + int(gaps[-1]) + 1 if len(gaps) else 0, int(breaks[nexts[1] - 1]) if nexts[1] > nexts[0] else 0)
            while cut <= at:  # one word fills the block: go on to its end
                more = min(len(data), end + BLOCK)
                gaps = np.flatnonzero(~inside[data[end:more]])
                nxt = np.searchsorted(breaks, end, "right")
                stop = min(end + int(gaps[0]) + 1 if len(gaps) else len(data) + 1, int(breaks[nxt]) if nxt < len(breaks) else len(data) + 1)
                if stop <= more or more == len(data):
                    cut = min(stop, len(data))
                end = more
            end = cut
        raw = data[at:end]
        if lower:
            raw = LOWER[raw]
        ok = inside[raw]
        first = ok.copy()
        first[1:] &= ~ok[:-1]
        here = breaks[np.searchsorted(breaks, at): np.searchsorted(breaks, end)] - at
        first[here] |= ok[here]
        s = np.flatnonzero(first)
        if len(s):
            seen = np.cumsum(first)
            pos = np.arange(len(raw)) - s[np.maximum(seen - 1, 0)]
            pos[pos < 0] = 0
            with np.errstate(over="ignore"):
                val = (raw.astype(U) + U(1)) * _POWER[pos & 0xFFFF]
                if len(pos) and pos.max() > 0xFFFF:
                    val *= (U(2) * (pos >> 16).astype(U) + U(1))
                val[~ok] = 0
                hashes.append(mix(np.add.reduceat(val, s)))
            starts.append(s + at)
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    s, h = np.concatenate(starts), np.concatenate(hashes)
    return s, np.searchsorted(off, s, "right") - 1, h


def word_ends(starts: np.ndarray, row: np.ndarray, off: np.ndarray, data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """End byte of each word (used for the few words that are looked at again)."""
    gap = np.flatnonzero(~inside[data])
    k = np.searchsorted(gap, starts)
    end = np.where(k < len(gap), gap[np.minimum(k, max(0, len(gap) - 1))] if len(gap) else len(data), len(data))
    return np.minimum(end, off[row + 1])


def row_bounds(row: np.ndarray, rows: int) -> np.ndarray:
    """Where the words of each row begin, and the end of the last."""
    return np.searchsorted(row, np.arange(rows + 1))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U).view(np.int64)


def release() -> None:
    """Give what a worker has freed back to the system: it lives on for the next stage, beside others and the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(values, kind)).cast(pa.list_(kind))
