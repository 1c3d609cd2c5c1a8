"""Vectorised helpers on Arrow string columns: words, hashes and windows of a whole batch at once.

All functions work on the UTF-8 bytes of a batch (no Python loop per word); a text is never cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: ASCII white space that separates words: space and 0x09-0x0D.
SPACE_SPLIT = np.ones(256, dtype=bool)
SPACE_SPLIT[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of lower-cased alphanumeric words: digits, a-z and everything beyond ASCII.
ALNUM_SPLIT = np.zeros(256, dtype=bool)
ALNUM_SPLIT[0x30:0x3A] = True
ALNUM_SPLIT[0x61:0x7B] = True
ALNUM_SPLIT[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift), in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text. Offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def as_offsets(offsets: np.ndarray) -> np.ndarray:
    """For an Arrow column of strings or bytes; what doesn't fit its 32-bit offsets is an error."""
    if len(offsets) and offsets[-1] > np.iinfo(np.int32).max:
        raise OverflowError(f"{offsets[-1]} bytes do not fit one Arrow column")
    return offsets.astype(np.int32)


def to_column(raw: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The inverse of column_bytes(), for pa.string() or pa.binary()."""
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(as_offsets(offsets)), pa.py_buffer(np.ascontiguousarray(raw))])


@dataclass
class Words:
    """Words of a batch: byte ranges, and bounds[d]:bounds[d+1] are the words of document d."""

    raw: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def position(self) -> np.ndarray:
        """Index of each word within its document."""
        return np.arange(len(self.starts)) - np.repeat(self.bounds[:-1], self.counts)

    def room(self) -> np.ndarray:
        """Words from each word to the end of its document, itself included."""
        return np.repeat(self.bounds[1:], self.counts) - np.arange(len(self.starts))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, eight bytes a step; only words longer than that take further steps."""
        size = self.ends - self.starts
        padded = np.zeros(len(self.raw) + 8, np.uint8)
        padded[: len(self.raw)] = self.raw
        eight = np.ndarray((len(self.raw) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
        h = size.astype(np.uint64) * _MULT
        at, rest, live = self.starts, size, slice(None)
        while len(at):
            part = eight[at] & _TAIL[np.minimum(rest, 8)]
            h[live] = mix((h[live] ^ part) * _MULT)
            more = np.flatnonzero(rest > 8)
            live = more if isinstance(live, slice) else live[more]
            at, rest = at[more] + 8, rest[more] - 8
        return h


def split_words(raw: np.ndarray, offsets: np.ndarray, split: np.ndarray) -> Words:
    """Maximal runs of bytes b with split[b], never across a document's end."""
    inside = split[raw]
    first, last = inside.copy(), inside.copy()
    if len(raw):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begins = offsets[:-1][offsets[:-1] < len(raw)]
        first[begins] |= inside[begins]
        stops = offsets[1:][offsets[1:] > 0] - 1
        last[stops] |= inside[stops]
    starts = np.flatnonzero(first)
    return Words(raw, offsets, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries (len(h) - k + 1 of them), by doubling; entry i covers h[i:i+k]."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, level, span = None, 0, _BASE, h, 1
    with np.errstate(over="ignore"):
        rest = k
        while rest:
            if rest & 1:
                piece = level[done : done + n]
                out = piece.copy() if out is None else out * np.uint64(power) + piece
                done += span
            rest >>= 1
            if rest:
                level = level[:-span] * np.uint64(power) + level[span:]
                power = power * power & (2**64 - 1)
                span *= 2
        return mix(out if out.base is None else out.copy())


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in [s, s + length) for some s in starts."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + length, n), minlength=n + 1)
    return np.cumsum(step)[:n] > 0


def keep_words(words: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of each document's kept words, joined by one space."""
    raw = words.raw.copy()
    mask = np.zeros(len(raw) + 2, np.int8)
    chosen = np.flatnonzero(kept)
    mask[words.starts[chosen]] += 1
    follows = np.zeros(len(chosen), bool)  # another kept word of the same document follows
    if len(chosen):
        doc = np.searchsorted(words.bounds, chosen, side="right") - 1
        follows[:-1] = doc[1:] == doc[:-1]
    stops = words.ends[chosen]
    raw[stops[follows]] = 0x20
    mask[stops + follows] -= 1
    taken = np.cumsum(mask, dtype=np.int8)[: len(raw)] > 0
    return raw[taken], np.concatenate(([0], np.cumsum(taken)))[words.offsets]


def portions(texts: pa.Array, size: int = 1 << 21) -> list[slice]:
    """Consecutive rows of about `size` bytes of text each, so that what is made from them stays small."""
    return offset_portions(column_bytes(texts)[1], size)


def offset_portions(offsets: np.ndarray, size: int) -> list[slice]:
    """portions() of texts with these offsets."""
    part = offsets[:-1] // size
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)] if len(part) else [0]
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Lookup:
    """Which of many hashes are in a sorted set, by a bit table before the binary search."""

    def __init__(self, members: np.ndarray):
        self.members = members
        self.shift = np.uint64(64 - max(12, len(members).bit_length() + 5))
        self.table = np.zeros(1 << int(64 - self.shift), bool)
        self.table[members >> self.shift] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in hashes, positions in members)."""
        at = np.flatnonzero(self.table[hashes >> self.shift])
        where = np.searchsorted(self.members, hashes[at])
        hit = self.members[np.minimum(where, len(self.members) - 1)] == hashes[at]
        return at[hit], where[hit]
