"""Vectorised words of Arrow text columns.

Every text operator here sees a batch of texts as one byte buffer.  Words (or other units) are
found with array arithmetic over that buffer and named by a hash of their bytes, eight bytes of all
units at a time, so no Python object exists per word occurrence; Python touches only the *distinct*
words of a batch, and of those only the ones that its worker has not met lately (`WordTable`).

A unit's name is `hash` (64 bits); `check` is 64 more bits of its own, by which a `WordTable` sees
that two units of one hash differ.  Both come of mixing that is not linear in the bytes.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are handled at a time; one longer text is a chunk of its own.
CHUNK_BYTES = 2_000_000

_U = np.uint64
_SEED_A, _SEED_B, _MUL = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xD6E8FEB86659FD93)
_LANE = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)  # mask of the first k bytes of eight
LONG = 64  # bytes; longer units are hashed one by one
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, check) of data[s:e] of each unit."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    a, b = _SEED_A ^ size.astype(np.uint64), _SEED_B + size.astype(np.uint64) * _MUL
    which: np.ndarray | slice = slice(None)
    for at in range(0, LONG, 8):
        if at:
            which = np.flatnonzero((size > at) & (size <= LONG))
            if not len(which):
                break
        lane = eight[starts[which] + at] & _LANE[np.minimum(size[which] - at, 8)]
        a[which] = mix(a[which] ^ lane)
        b[which] = mix((b[which] ^ (lane >> _U(32) | lane << _U(32))) * _MUL) + a[which]
    name, check = mix(a ^ (b >> _U(23) | b << _U(41))), mix(b)
    for i in np.flatnonzero(size > LONG).tolist():
        both = xxhash.xxh3_128_intdigest(data[starts[i] : ends[i]])
        name[i], check[i] = both >> 64, both & 0xFFFFFFFFFFFFFFFF
    return name, check


@dataclass
class Chunk:
    """Some consecutive texts of a batch: `data` holds their bytes end to end."""

    first: int  # index of the first text in the batch
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than texts; offsets[0] == 0

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """Of each text, how many of its bytes have mask set."""
        at = self.offsets.tolist()
        return np.array([np.count_nonzero(mask[a:b]) for a, b in zip(at[:-1], at[1:])], np.int64)

    def words(self, lower: bool = False) -> "Units":
        """Runs of bytes other than space, tab, newline, VT, FF and CR."""
        ink = ~SPACE[self.data]
        n = len(ink)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(n, bool)
        before[1:] = ink[:-1]
        before &= ~edge[:n]
        after = np.zeros(n, bool)
        after[:-1] = ink[1:]
        after &= ~edge[1:]
        return self.units(np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1, lower)

    def units(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> "Units":
        doc = np.searchsorted(self.offsets, starts, side="right") - 1
        return Units(self, starts, ends, doc, *_names(_LOWER[self.data] if lower else self.data, starts, ends))


@dataclass
class Units:
    chunk: Chunk
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # index of the text within the chunk
    hash: np.ndarray  # uint64
    check: np.ndarray  # uint64

    def bytes_at(self, which: np.ndarray) -> list[bytes]:
        if len(which) < 1000:
            data = self.chunk.data
            return [data[a:b].tobytes() for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist())]
        raw = self.chunk.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist())]

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.chunk.texts)


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of a column in order, in chunks of about `most` bytes. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield Chunk(i, data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def windows3(u: Units) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, 64-bit hash) of every run of three words of one text."""
    if len(u.hash) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(u.doc[:-2] == u.doc[2:])
    h = u.hash
    return at, mix(mix(h[at] * _U(3) + h[at + 1]) * _U(5) + h[at + 2])


class WordTable:
    """What a worker knows of the words it met: a ragged array of values by word.

    `compute(words)` gives (values end to end, how many of each).  Holds at most `limit` words;
    beyond that it forgets all and begins again, so its size has a bound and results never
    depend on it.  A word is found by its hash and told from others by its check; should two words
    of one hash meet, the table begins again with names made of both.
    """

    def __init__(self, compute: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 1_500_000):
        self.compute, self.limit, self.salt = compute, limit, 0
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.checks = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.len = np.zeros(0, np.int32)
        self.flat: np.ndarray | None = None

    def of(self, u: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(values, start by distinct word, length by distinct word, distinct word of each unit)."""
        while (found := self._of(u, mix(u.hash ^ mix(u.check + _U(self.salt))) if self.salt else u.hash)) is None:
            self.salt += 1
            self._clear()
        return found

    def _of(self, u: Units, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        order = np.argsort(names)
        keys, checks = names[order], u.check[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        if (~new[1:] & (checks[1:] != checks[:-1])).any():
            return None
        first = np.flatnonzero(new)
        keys, checks, at = keys[first], checks[first], order[first]
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        if len(self.keys) + len(keys) > self.limit:
            self._clear()
        pos = np.searchsorted(self.keys, keys)
        hit = np.zeros(len(keys), bool)
        inside = pos < len(self.keys)
        hit[inside] = self.keys[pos[inside]] == keys[inside]
        if (self.checks[pos[hit]] != checks[hit]).any():
            return None
        new = np.flatnonzero(~hit)
        if len(new) or self.flat is None:
            flat, lens = self.compute(u.bytes_at(at[new]))
            lens = np.asarray(lens, np.int32)
            base = 0 if self.flat is None else len(self.flat)
            starts = base + np.concatenate(([0], np.cumsum(lens[:-1], dtype=np.int64))) if len(lens) else np.zeros(0, np.int64)
            self.flat = np.asarray(flat) if self.flat is None else np.concatenate((self.flat, flat))
            where = pos[new]
            self.keys = np.insert(self.keys, where, keys[new])
            self.checks = np.insert(self.checks, where, checks[new])
            self.start = np.insert(self.start, where, starts)
            self.len = np.insert(self.len, where, lens)
            pos = np.searchsorted(self.keys, keys)
        return self.flat, self.start[pos], self.len[pos], inverse


_cached: dict[Hashable, object] = {}


def cached(key: Hashable, make: Callable[[], object]):
    """What a worker keeps for its next tasks: one thing at a time.

    A worker serves one operator after another; what the one before kept is given back first.
    """
    if key not in _cached:
        _cached.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            pass
        _cached[key] = make()
    return _cached[key]


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[s:s+n] of each (s, n), end to end."""
    length = length.astype(np.int64)
    total = int(length.sum())
    if not total:
        return flat[:0]
    kind = np.int32 if max(total, len(flat)) < 2**31 else np.int64
    shift = (start - (np.cumsum(length) - length)).astype(kind)
    at = np.repeat(shift, length)
    at += np.arange(total, dtype=kind)
    return flat[at]
