"""Exact tokenization of whole batches with the `tokenizers` library.

Most pieces of a corpus repeat, so each Python worker keeps a bounded hash table from a piece of text to its ids, and
a batch is worked through in numpy: its bytes are cut into pieces, each piece is looked up (by hash, then byte by byte,
so that a hash that coincides changes nothing), unseen pieces go to the library together, and the ids are gathered.

Pieces end at spaces and line breaks, and between ASCII letters or digits and ASCII punctuation: the tokenizers that
this module knows never look across these places. Where they do (runs of white space in a byte-level vocabulary,
special tokens, white space of other kinds, capital sigma) and for tokenizers it doesn't know, the whole text goes to
the library. So the ids are always those of `Tokenizer.encode(text, add_special_tokens=False)`.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from glimmer.llm.text_kernels import column_bytes, mix, offset_portions

#: Distinct pieces a worker keeps (some 100 bytes each); beyond it the table starts anew.
CACHE_PIECES = 1_500_000
#: Bytes of text worked through at a time.
PORTION = 1 << 21
#: Unseen pieces that go to the library as one text, with a special token between two.
JOINED = 400

_MULT = np.uint64(0x9E3779B97F4A7C15)
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_GAP, _WORD, _MARK, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, 0x0A]] = _GAP
_CLASS[[ord(c) for c in string.ascii_letters + string.digits]] = _WORD
_CLASS[[ord(c) for c in string.punctuation if c != "'"]] = _MARK  # an apostrophe may begin a contraction
#: Does a piece begin (end) between two bytes of these classes?
_BEGINS, _ENDS = np.zeros(16, bool), np.zeros(16, bool)
for _a in range(4):
    for _b in range(4):
        _cut = {_a, _b} == {_WORD, _MARK}
        _BEGINS[4 * _a + _b] = _b != _GAP and (_a == _GAP or _cut)
        _ENDS[4 * _a + _b] = _a != _GAP and (_b == _GAP or _cut)
#: What stands before a piece: nothing or another piece, a space, a line break.
BARE, SPACED, BROKEN = range(3)

_encoders: dict[str, Encoder] = {}


def _eight(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros beyond the end."""
    padded = np.zeros(len(raw) + 16, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 9,), dtype="<u8", buffer=padded.data, strides=(1,))


class _Pieces:
    """The pieces of some texts: byte ranges, hashes, and what stands before each."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, spaced: bool):
        kind = _CLASS[raw]
        pair = kind[:-1] * np.uint8(4) + kind[1:]
        begins, ends = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        if len(raw):
            begins[1:], ends[:-1] = _BEGINS[pair], _ENDS[pair]
            full = np.flatnonzero(offsets[1:] > offsets[:-1])
            first, last = offsets[:-1][full], offsets[1:][full] - 1
            begins[first], ends[last] = kind[first] != _GAP, kind[last] != _GAP
        self.raw, self.eight = raw, _eight(raw)
        self.starts = np.flatnonzero(begins)
        self.sizes = np.flatnonzero(ends) + 1 - self.starts
        self.bounds = np.searchsorted(self.starts, offsets)
        #: Texts with a run of gaps, or one at an end, in a vocabulary for which white space counts.
        self.odd = np.zeros(len(offsets) - 1, bool)
        self.before = np.zeros(len(self.starts), np.int64)
        if spaced and len(raw):
            gaps = np.flatnonzero(kind == _GAP)
            single = np.zeros(len(raw) + 1, bool)
            single[:-1] = begins
            single[offsets[:-1]] = False
            opens = np.zeros(len(raw), bool)
            opens[first] = True
            lone = single[gaps + 1] & ~opens[gaps]  # a piece of the same text follows, and something stands before
            self.odd[np.searchsorted(offsets, gaps[~lone], side="right") - 1] = True
            held = raw[self.starts - 1]
            self.before = np.where(held == 0x20, SPACED, np.where(held == 0x0A, BROKEN, BARE))
            at_start = np.searchsorted(self.starts, first)
            at_start = at_start[at_start < len(self.starts)]
            self.before[at_start[opens[self.starts[at_start]]]] = BARE
        self.marks = self.sizes * 4 + self.before
        self.head = self.eight[self.starts] & _TAIL[np.minimum(self.sizes, 8)]
        h = self.head ^ (self.marks.astype(np.uint64) * _MULT)
        h = mix(h * _MULT)
        live, step = np.flatnonzero(self.sizes > 8), 8
        while len(live):
            part = self.eight[self.starts[live] + step] & _TAIL[np.minimum(self.sizes[live] - step, 8)]
            h[live] = mix((h[live] ^ part) * _MULT)
            step += 8
            live = live[self.sizes[live] > step]
        self.hashes = h


class _Table:
    """Piece to ids: open addressing on 64-bit hashes, the pieces' own bytes, and their ids."""

    def __init__(self, dtype: np.dtype):
        self.shift = 10
        self.slots = np.full(1 << self.shift, -1, np.int32)
        self.n = self.n_bytes = self.n_ids = 0
        self.hashes, self.heads = np.zeros(512, np.uint64), np.zeros(512, np.uint64)
        self.marks, self.texts, self.firsts, self.counts = (np.zeros(512, np.int64) for _ in range(4))
        self.odd = np.zeros(512, bool)
        self.bytes, self.ids = np.zeros(4096, np.uint8), np.zeros(2048, dtype)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry with each hash, or -1."""
        mask = len(self.slots) - 1
        at = (hashes >> np.uint64(64 - self.shift)).astype(np.int64)
        out = self.slots[at]
        live = np.flatnonzero((out >= 0) & (self.hashes[out] != hashes))
        while len(live):
            at[live] = (at[live] + 1) & mask
            found = self.slots[at[live]]
            out[live] = found
            live = live[(found >= 0) & (self.hashes[found] != hashes[live])]
        return out

    def same(self, found: np.ndarray, pieces: _Pieces) -> np.ndarray:
        """Is each piece the very one that was found?"""
        out = (self.marks[found] == pieces.marks) & (self.heads[found] == pieces.head)
        live, step = np.flatnonzero(out & (pieces.sizes > 8)), 8
        own = np.ndarray((len(self.bytes) - 8,), dtype="<u8", buffer=self.bytes.data, strides=(1,))
        while len(live):
            tail = _TAIL[np.minimum(pieces.sizes[live] - step, 8)]
            equal = (own[self.texts[found[live]] + step] ^ pieces.eight[pieces.starts[live] + step]) & tail == 0
            out[live[~equal]] = False
            step += 8
            live = live[equal & (pieces.sizes[live] > step)]
        return out

    def _grow(self, name: str, need: int) -> None:
        held = getattr(self, name)
        if need > len(held):
            wider = np.zeros(max(need, 2 * len(held)), held.dtype)
            wider[: len(held)] = held
            setattr(self, name, wider)

    def add(self, pieces: _Pieces, some: np.ndarray, texts: list[bytes], ids: np.ndarray, counts: np.ndarray, odd: np.ndarray) -> None:
        """New entries: pieces `some`, of distinct hashes, with their bytes and ids."""
        a, b = self.n, self.n + len(some)
        joined = np.frombuffer(b"".join(texts), np.uint8)
        for name in ("hashes", "heads", "marks", "texts", "firsts", "counts", "odd"):
            self._grow(name, b)
        self._grow("bytes", self.n_bytes + len(joined) + 16)
        self._grow("ids", self.n_ids + len(ids))
        sizes = np.array([len(t) for t in texts], np.int64)
        self.hashes[a:b], self.heads[a:b], self.marks[a:b] = pieces.hashes[some], pieces.head[some], pieces.marks[some]
        self.texts[a:b] = self.n_bytes + np.cumsum(sizes) - sizes
        self.firsts[a:b] = self.n_ids + np.cumsum(counts) - counts
        self.counts[a:b], self.odd[a:b] = counts, odd
        self.bytes[self.n_bytes : self.n_bytes + len(joined)] = joined
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n, self.n_bytes, self.n_ids = b, self.n_bytes + len(joined), self.n_ids + len(ids)
        fresh = np.arange(a, b)
        if 2 * self.n > len(self.slots):
            while 2 * self.n > len(self.slots):
                self.shift += 1
                self.slots = np.full(1 << self.shift, -1, np.int32)
            fresh = np.arange(self.n)
        mask = len(self.slots) - 1
        at = (self.hashes[fresh] >> np.uint64(64 - self.shift)).astype(np.int64)
        while len(fresh):
            free = self.slots[at] < 0
            self.slots[at[free]] = fresh[free]
            left = self.slots[at] != fresh
            fresh, at = fresh[left], (at[left] + 1) & mask


class Encoder:
    """path: a `tokenizers` JSON file. Ids come as little-endian integers of `dtype`."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            shape = json.load(f)
        added = shape.get("added_tokens", [])
        self.specials = [t["content"] for t in added]
        marks = [t for t in added if t.get("special") and not (t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word"))]
        #: Keeps two pieces of one text apart for the library.
        self.divider = (marks[0]["content"], marks[0]["id"]) if marks else None
        pre, post = shape.get("pre_tokenizer") or {}, shape.get("normalizer")
        steps = pre.get("pretokenizers", [])
        #: Byte-level pieces carry the space before them; a line break is a piece of its own.
        self.spaced = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and post is None
        #: White space only separates.
        self.dropped = bool(steps) and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
        self.line_break = self._ids(["\n"])[0] if self.spaced else []
        self.table = _Table(self.dtype)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: _Pieces, some: np.ndarray) -> None:
        """Ids of unseen pieces."""
        raw, starts, sizes = pieces.raw.tobytes(), pieces.starts[some].tolist(), pieces.sizes[some].tolist()
        texts = [raw[s : s + n] for s, n in zip(starts, sizes, strict=True)]
        words = [t.decode("utf-8", "replace") for t in texts]
        odd = np.array([not t.isalnum() and any(c.isspace() or c == "Σ" for c in w) or b"\xce\xa3" in t for t, w in zip(texts, words, strict=True)], bool)
        before = pieces.before[some]
        asked = ["" if o else " " + w if b == SPACED else w for w, b, o in zip(words, before.tolist(), odd, strict=True)]
        if self.divider and not any(s in w for s in self.specials for w in asked):
            mark, mark_id = self.divider
            groups = [asked[k : k + JOINED] for k in range(0, len(asked), JOINED)]
            flat = [np.array(ids, np.int64) for ids in self._ids([mark.join(g) for g in groups])]
            ids = np.concatenate([np.append(x, mark_id) for x in flat])
            ends = np.flatnonzero(ids == mark_id)
            counts = np.diff(ends, prepend=-1) - 1
            ids = ids[ids != mark_id]
        else:
            lists = self._ids(asked)
            counts = np.array([len(x) for x in lists], np.int64)
            ids = np.concatenate([np.array(x, np.int64) for x in lists])
        if len(self.line_break) and (broken := before == BROKEN).any():
            more = len(self.line_break)
            wide = counts + more * broken
            out = np.zeros(wide.sum(), np.int64)
            first = np.cumsum(wide) - wide
            lead = np.zeros(len(out), bool)
            for k, value in enumerate(self.line_break):
                lead[first[broken] + k] = True
                out[first[broken] + k] = value
            out[~lead] = ids
            ids, counts = out, wide
        self.table.add(pieces, some, texts, ids.astype(self.dtype), counts, odd)

    def _portion(self, raw: np.ndarray, offsets: np.ndarray, direct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each text); direct: texts that the library gets whole."""
        n = len(offsets) - 1
        table = self.table
        if self.spaced or self.dropped:
            pieces = _Pieces(raw, offsets, self.spaced)
            found = table.find(pieces.hashes)
            missing = np.flatnonzero(found < 0)
            if len(missing):
                _, first = np.unique(pieces.hashes[missing], return_index=True)
                self._learn(pieces, missing[first])
                found[missing] = table.find(pieces.hashes[missing])
            wrong = ~table.same(found, pieces) | table.odd[found]
            odd = direct | pieces.odd
            odd[np.searchsorted(pieces.bounds, np.flatnonzero(wrong), side="right") - 1] = True
            counts = table.counts[found]
            before = np.concatenate(([0], np.cumsum(counts)))
            sizes = np.diff(before[pieces.bounds])
            ids = table.ids[np.repeat(table.firsts[found] - before[:-1], counts) + np.arange(before[-1])]
        else:
            odd, sizes, ids = np.ones(n, bool), np.zeros(n, np.int64), np.zeros(0, self.dtype)
        if odd.any():
            whole = np.flatnonzero(odd).tolist()
            data = raw.tobytes()
            exact = self._ids([data[offsets[d] : offsets[d + 1]].decode("utf-8", "replace") for d in whole])
            ends = np.concatenate(([0], np.cumsum(sizes)))
            parts = [ids[ends[d] : ends[d + 1]] for d in range(n)]
            for d, own in zip(whole, exact, strict=True):
                parts[d] = np.array(own, self.dtype)
            ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        if table.n > CACHE_PIECES:
            self.table = _Table(self.dtype)
        return ids, sizes

    def encode_batch(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): those of text d, end_id after them if given, are ids[offsets[d]:offsets[d + 1]]; a null text is empty."""
        dtype = self.dtype if end_id is None or end_id <= np.iinfo(self.dtype).max else np.dtype("<u4")
        raw, offsets = column_bytes(texts)
        direct = np.zeros(len(texts), bool)
        for special in self.specials:
            direct |= np.asarray(pc.fill_null(pc.match_substring(texts, special), False))
        out, counts = [np.zeros(0, dtype)], [np.zeros(0, np.int64)]
        for p in offset_portions(offsets, PORTION):
            bounds = offsets[p.start : p.stop + 1]
            ids, sizes = self._portion(raw[bounds[0] : bounds[-1]], bounds - bounds[0], direct[p])
            if end_id is not None:
                wide = np.full(len(ids) + len(sizes), end_id, dtype)
                own = np.ones(len(wide), bool)
                own[np.cumsum(sizes + 1) - 1] = False
                wide[own] = ids
                ids, sizes = wide, sizes + 1
            out.append(ids)
            counts.append(sizes)
        return np.concatenate(out), np.concatenate(([0], np.cumsum(np.concatenate(counts))))

    def encode(self, text: str) -> bytes:
        return self.encode_batch(pa.array([text], pa.string()))[0].tobytes()


def encoder(path: str) -> Encoder:
    """The worker's own encoder for this file; it stays from task to task, until release()."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def release() -> None:
    """Gives back what this worker keeps for encoding, some 200 MB: for tasks that come in workers that have encoded before."""
    if _encoders:
        _encoders.clear()
        gc.collect()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc keeps freed memory otherwise
            libc.malloc_trim(0)
