"""Exact byte-level dedup: every byte inside a string of `length` bytes that occurs more than once is removed.

Method: merging shards' Burrows-Wheeler transforms by iterative interleave refinement. A shard is the part of the
corpus that one source bucket holds; its transform lists its suffixes in order, each with the symbol before it (eight
bytes wide), and the lengths of the prefixes that neighbours share. Shards are merged by refining their interleave:
at first it has the suffixes in the order of their first bytes, a merge of ordered runs; a round takes the suffixes of
each block (equal prefixes of h bytes) in interleaved order and deals them out by the symbols before them, which gives
the interleave, and the blocks, of prefixes of h + SYMBOL bytes. No suffix is compared or sorted again; ties keep the
shards' own order. A block of one shard's suffixes is settled, as that shard's transform knows its common prefixes; it
leaves. The round in which neighbours part is their common prefix; blocks that are left when h reaches `length`, and
neighbours in a shard that share as much, are the repeated intervals.

What is refined. All suffixes of a corpus would cost hundreds of rounds over every byte, so a pre-filter shrinks the
input first, exactly. (1) Each window of `length` bytes has a minimizer: the least hash among its GRAM-byte
substrings, leftmost on ties. Equal windows have equal minimizers, so a window whose minimizer occurs once in
the corpus is not repeated; minimizers (about one in 80 bytes) are compared by the packed exchange. (2) Windows
with one minimizer form a slice of text; slices go to the merge task of their minimizer, so equal windows meet, and
slices that are equal as a whole (by a 64-bit hash within a minimizer) are one, in a shard and across shards.

Minimizers with more than HOT_SLICES different slices (a phrase with other surroundings in each of very many documents)
would gather without bound in one merge task; the count is summed before slices are sent. Their windows are compared by
64-bit hashes instead, dealt out by the hash, each at most once per shard. Nothing is collected and no pairs are made.
Texts cross the network once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from glimmer.llm.exchange import BITS, answer, bits_of, bucketed, flag_rows, in_order, occurs_elsewhere, shuffle_partitions, split_blocks, target_edges
from glimmer.llm.text_kernels import column_bytes, covered, mix, offset_portions, to_column

GRAM, SYMBOL = 40, 8
#: Bytes of slices that are refined at a time.
PORTION = 1 << 20
#: Different slices (some 300 bytes each) of one minimizer that a merge task takes.
HOT_SLICES = 20_000
#: Text of a source bucket, about: a task holds some ten times as much.
BUCKET_BYTES = 1 << 24
SHARED, SLICES, WINDOWS = 0, 1, 2

SENT = "src int, dst int, kind int, payload binary"
_SENT = pa.schema([("src", pa.int32()), ("dst", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept binary"
_RESULT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
_END = np.uint64(2**64 - 1)


def eight_bytes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one big-endian number; zeros beyond the end."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw),), dtype=">u8", buffer=padded.data, strides=(1,)).astype(np.uint64)


def byte_grams(raw: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """Hashes of all substrings of each of these lengths (multiples of eight), by one round of doublings."""
    level, span, power = mix(eight_bytes(raw)), 8, 0x9FB21C651E98DF25
    out: list[np.ndarray | None] = [None] * len(lengths)
    done = [0] * len(lengths)
    with np.errstate(over="ignore"):
        while span <= max(lengths):
            for k, size in enumerate(lengths):
                if size & span:
                    n = max(0, len(raw) - size + 1)
                    piece = level[done[k] : done[k] + n]
                    if out[k] is None:
                        out[k] = piece.copy()
                    else:
                        out[k] *= np.uint64(power)
                        out[k] += piece
                    done[k] += span
            if 2 * span <= max(lengths):
                longer = level[: max(0, len(level) - span)] * np.uint64(power)
                longer += level[span:]
                level, power = longer, power * power & (2**64 - 1)
            span *= 2
    return [mix(x) for x in out]


def minimizer_runs(grams: np.ndarray, valid: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, minimizer position) of each run of valid windows with one minimizer.

    Window i looks at grams[i:i+width]; its minimizer is the leftmost least one.
    """
    n = len(grams) - width + 1
    if n <= 0 or not valid.any():
        return (np.zeros(0, np.int64),) * 3
    least, span = grams, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[width - span : width - span + n])
    valid = valid[:n]
    fresh = valid.copy()
    fresh[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    first = np.flatnonzero(fresh)
    stop = valid.copy()
    stop[:-1] &= (least[1:] != least[:-1]) | ~valid[1:]
    last = np.flatnonzero(stop)
    views = np.lib.stride_tricks.sliding_window_view(grams, width)
    tail = np.concatenate([last[k : k + 4096] + views[last[k : k + 4096]].argmin(axis=1) for k in range(0, len(last), 4096)])
    own = np.flatnonzero(valid & (grams[:n] == least))
    stretch = np.searchsorted(first, own, side="right") - 1
    cuts = own[own < last[stretch]] + 1  # the next window of the stretch has its minimizer further right
    begins = np.union1d(first, cuts)
    home = np.searchsorted(first, begins, side="right") - 1
    ends = np.minimum(np.append(begins[1:] - 1, n - 1), last[home])
    nearest = np.append(own, n)[np.searchsorted(own, begins)]
    return begins, ends, np.where(nearest <= last[home], nearest, tail[home])


def window_hashes(raw: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the strings of `length` bytes (a multiple of eight) that start at these places."""
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    words = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=np.ascontiguousarray(raw).data, strides=(1,))
    for p in range(0, len(starts), 1 << 16):
        at = starts[p : p + (1 << 16)]
        h = np.zeros(len(at), np.uint64)
        for k in range(0, length, 8):
            h ^= words[at + k]
            h *= np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
        out[p : p + len(at)] = mix(h)
    return out


class _Shard:
    """The windows and slices of one source bucket."""

    def __init__(self, table: pa.Table, length: int):
        self.docs, self.length = in_order(table), length
        self.raw, self.offsets = column_bytes(self.docs["text"])
        found = [self._runs(self.offsets[p.start : p.stop + 1]) for p in offset_portions(self.offsets, PORTION)] or [self._runs(self.offsets)]
        # of each run: first and last window, and minimizer
        self.first, self.last, self.values = (np.concatenate(x) for x in zip(*found, strict=True))
        self.anchors, self.which, times = np.unique(self.values, return_inverse=True, return_counts=True)
        self.repeated = times > 1

    def _runs(self, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """The runs of some documents; all arrays as long as their text go with this call."""
        base = int(offsets[0])
        raw = self.raw[base : offsets[-1]]
        (grams,) = byte_grams(raw, GRAM)
        room = np.repeat((offsets[1:] - base).astype(np.int32), np.diff(offsets)) - np.arange(len(raw), dtype=np.int32)
        grams[room[: len(grams)] < GRAM] = _END
        first, last, at = minimizer_runs(grams, room[: max(0, len(raw) - self.length + 1)] >= self.length, self.length - GRAM + 1)
        # minimizers are small hashes; mixed once more they are spread evenly over the merge tasks
        return first + base, last + base, mix(grams[at])

    def keys(self, runs: np.ndarray) -> np.ndarray:
        """What equal slices have in common: a hash of the first window, of the last one, and of their distance."""
        a, b = self.first[runs], self.last[runs]
        head, tail = window_hashes(self.raw, a, self.length), window_hashes(self.raw, b, self.length)
        with np.errstate(over="ignore"):
            return mix(head + mix(tail ^ (b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))

    def slice_counts(self) -> np.ndarray:
        """By minimizer, the different slices that it has here."""
        many = np.flatnonzero(self.repeated[self.which])
        counts = np.ones(len(self.anchors), np.int64)
        own, key = self.which[many], self.keys(many)
        order = np.lexsort((key, own))
        own, key = own[order], key[order]
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (key[1:] != key[:-1]))) if len(own) else np.zeros(0, bool)
        some, times = np.unique(own[new], return_counts=True)
        counts[some] = times
        return counts

    def select(self, shared: np.ndarray, hot: np.ndarray) -> None:
        """Splits the runs with a shared minimizer into slices and hot windows, each distinct one once."""
        live = (shared | self.repeated)[self.which]
        warm = np.flatnonzero(live & ~hot[self.which])
        key = self.keys(warm)
        order = np.lexsort((key, self.values[warm]))
        warm, key = warm[order], key[order]
        v = self.values[warm]
        new = np.concatenate(([True], (v[1:] != v[:-1]) | (key[1:] != key[:-1]))) if len(warm) else np.zeros(0, bool)
        self.slice_of, self.slice_runs = np.cumsum(new) - 1, warm
        self.slices, self.slice_keys = warm[new], key[new]
        self.slice_twice = np.bincount(self.slice_of, minlength=len(self.slices)) > 1
        spans = np.flatnonzero(live & hot[self.which])
        self.hot_at = _ranges(self.first[spans], self.last[spans] + 1)
        self.hot_windows, self.hot_which, times = np.unique(self._windows(self.first[spans], self.last[spans]), return_inverse=True, return_counts=True)
        self.hot_twice = times > 1

    def _windows(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of all windows of some runs."""
        return window_hashes(self.raw, _ranges(first, last + 1), self.length)

    def slice_sizes(self) -> np.ndarray:
        """Windows of each distinct slice."""
        return self.last[self.slices] - self.first[self.slices] + 1

    def blocks(self, src: int, targets: int, hot_targets: int) -> pa.Table:
        v, sizes = self.values[self.slices], self.slice_sizes()
        edges = target_edges(v, targets).tolist()
        rows = []
        for t, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if b > a:
                text = self.raw[_ranges(self.first[self.slices[a:b]], self.last[self.slices[a:b]] + self.length)]
                rows.append((t, SLICES, b"".join([np.uint64(b - a).tobytes(), v[a:b].tobytes(), self.slice_keys[a:b].tobytes(), sizes[a:b].astype(np.int64).tobytes(), text.tobytes()])))
        hot = split_blocks(src, self.hot_windows, hot_targets)
        rows += [(t, WINDOWS, p) for t, p in zip(hot["dst"].to_pylist(), hot["payload"].to_pylist(), strict=True)]
        columns = [np.full(len(rows), src), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SENT, strict=True)], schema=_SENT)

    def repeats(self, slice_bits: np.ndarray, window_bits: np.ndarray) -> np.ndarray:
        """Starts of all repeated windows."""
        sizes = self.slice_sizes()
        starts = np.concatenate(([0], np.cumsum(sizes)))
        runs, own = self.slice_runs, self.slice_of
        counts = sizes[own]
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        flags = slice_bits[np.repeat(starts[own], counts) + inner] | np.repeat(self.slice_twice[own], counts)
        at = np.repeat(self.first[runs], counts) + inner
        return np.concatenate((at[flags], self.hot_at[(window_bits | self.hot_twice)[self.hot_which]]))


def _ranges(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after another."""
    sizes = stops - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _portions(values: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """places, sorted by value, in parts of about PORTION bytes; a value is never split."""
    if not len(places):
        return []
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    part = (np.cumsum(sizes) - sizes)[first] // PORTION
    return np.split(places, first[np.flatnonzero(part[1:] != part[:-1]) + 1])


class Transforms:
    """The transforms of several shards' slices: raw[bounds[k]:bounds[k + 1]] is a slice of shard owner[k], shards ascending.

    order: each shard's suffixes in the order of their first `length` bytes (those that end with their slice first), one
    shard after another; symbol: the SYMBOL bytes before each; common: how many bytes each shares with the one before it
    in its shard, in whole steps. A suffix reaches to the end of its slice; those shorter than the first key don't count.
    """

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, owner: np.ndarray, length: int):
        sizes = np.diff(bounds)
        places, words = np.arange(len(raw)), eight_bytes(raw)
        self.length, self.words = length, words
        self.before = places - np.repeat(bounds[:-1], sizes)  # bytes to the start of the slice
        self.left = np.repeat(bounds[1:], sizes) - places  # bytes to its end
        self.shard = np.repeat(np.unique(owner, return_inverse=True)[1].astype(np.int32), sizes)
        # the first key is what `length` has over whole symbols, or one symbol
        self.first = length - SYMBOL * (-(-length // SYMBOL) - 1)
        self.keys = words >> np.uint64(8 * (SYMBOL - self.first))
        order, common = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        edges = bounds[np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True])))] if len(owner) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            one = self._ordered(a + np.flatnonzero(self.left[a:b] >= self.first))
            order.append(one[0])
            common.append(one[1])
        self.order, self.common = np.concatenate(order), np.concatenate(common)

    def _ordered(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, common) of the suffixes of one shard, refined a symbol at a time where they still agree."""
        at = at[np.argsort(self.keys[at], kind="stable")]
        key = self.keys[at]
        common = np.where(np.concatenate(([False], key[1:] == key[:-1])), self.first, 0) if len(at) else np.zeros(0, np.int64)
        for depth in range(self.first, self.length, SYMBOL):
            same = common == depth
            if not same.any():
                break
            inside = same.copy()
            inside[:-1] |= same[1:]
            some = np.flatnonzero(inside)
            block, room = np.cumsum(~same)[some], self.left[at[some]] >= depth + SYMBOL
            symbol = np.where(room, self.words[np.minimum(at[some] + depth, len(self.words) - 1)], 0)
            turn = np.lexsort((symbol, room, block))
            at[some] = at[some][turn]
            symbol, room, block = symbol[turn], room[turn], block[turn]
            again = np.concatenate(([False], (symbol[1:] == symbol[:-1]) & room[1:] & room[:-1] & (block[1:] == block[:-1])))
            common[some[again]] = depth + SYMBOL
        return at, common


def interleave(shards: Transforms) -> np.ndarray:
    """Places of the strings of `length` bytes that several shards have, by refining the shards' interleave.

    A round takes the suffixes in interleaved order and deals them out by the symbols before them, so that blocks of
    equal prefixes get SYMBOL bytes longer to the left. A block of one shard leaves: its own transform knows it.
    """
    # the first interleave: ordered runs, merged by the first key, ties in the order of shards
    at = shards.order[np.argsort(shards.keys[shards.order], kind="stable")]
    key = shards.keys[at]
    starts = np.concatenate(([True], key[1:] != key[:-1])) if len(at) else np.zeros(0, bool)
    for left in range(shards.length - shards.first, -1, -SYMBOL):
        block = np.cumsum(starts) - 1
        parts = ~starts
        parts[1:] &= shards.shard[at[1:]] != shards.shard[at[:-1]]
        several = np.zeros(block[-1] + 1 if len(block) else 1, bool)
        several[block[parts]] = True
        live = several[block]
        at, block = at[live], block[live]
        if not left or not len(at):
            break
        moves = shards.before[at] >= SYMBOL
        at, block = at[moves] - SYMBOL, block[moves]
        symbol = shards.words[at]
        turn = np.argsort(symbol, kind="stable")
        at, block, symbol = at[turn], block[turn], symbol[turn]
        starts = np.concatenate(([True], (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1]))) if len(at) else np.zeros(0, bool)
    return at


def repeated_starts(raw: np.ndarray, bounds: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """Which places of the slices raw[bounds[k]:bounds[k + 1]] of shards owner[k] (ascending) start a string of `length` bytes that starts elsewhere too."""
    shards = Transforms(raw, bounds, owner, length)
    out = np.zeros(len(raw), bool)
    twice = np.flatnonzero(shards.common >= length)  # with the one before it in its shard
    out[shards.order[twice]] = True
    out[shards.order[twice - 1]] = True
    out[interleave(shards)] = True
    return out


def merge_shards(table: pa.Table, length: int) -> pa.Table:
    """The answers to the slices and hot windows of several shards."""
    answers = []
    hot = table.filter(pc.equal(table["kind"], WINDOWS))
    if hot.num_rows:
        raw, offsets = column_bytes(hot["payload"])
        answers.append(flag_rows(hot, occurs_elsewhere(raw.view(np.uint64)), np.diff(offsets) // 8, WINDOWS))
    warm = table.filter(pc.equal(table["kind"], SLICES))
    del table, hot
    if warm.num_rows:
        raw, offsets = column_bytes(warm["payload"])
        values, keys, sizes, places, per_block, sources = [], [], [], [], [], []
        for at, src in zip(offsets[:-1].tolist(), warm["src"].to_pylist(), strict=True):
            n = int(raw[at : at + 8].copy().view(np.uint64)[0])
            part = raw[at + 8 : at + 8 + 24 * n].copy().view(np.uint64)
            values.append(part[:n])
            keys.append(part[n : 2 * n])
            sizes.append(part[2 * n :].astype(np.int64))
            spans = sizes[-1] + length - 1
            places.append(at + 8 + 24 * n + np.cumsum(spans) - spans)
            per_block.append(n)
            sources.append(np.full(n, src, np.int32))
        v, key, size, begin, source = (np.concatenate(x) for x in (values, keys, sizes, places, sources))
        order = np.lexsort((key, v))
        new = np.concatenate(([True], (v[order][1:] != v[order][:-1]) | (key[order][1:] != key[order][:-1])))
        same = np.empty(len(v), np.int64)
        same[order] = np.cumsum(new) - 1
        whole = np.bincount(same) > 1
        one = order[new]  # of equal slices, the first
        lone = np.concatenate(([True], v[one][1:] != v[one][:-1])) & np.concatenate((v[one][1:] != v[one][:-1], [True]))
        # flags of each distinct slice, then of each slice that was sent
        starts = np.concatenate(([0], np.cumsum(size[one])))
        flags = np.repeat(whole, size[one])
        rest = np.flatnonzero(~lone)
        for mine in _portions(v[one[rest]], size[one[rest]] + length - 1, rest):
            mine = mine[np.argsort(source[one[mine]], kind="stable")]  # shard by shard
            some = one[mine]
            bounds = np.concatenate(([0], np.cumsum(size[some] + length - 1)))
            found = repeated_starts(raw[_ranges(begin[some], begin[some] + size[some] + length - 1)], bounds, source[some], length)
            flags[_ranges(starts[mine], starts[mine] + size[some])] |= found[_ranges(bounds[:-1], bounds[:-1] + size[some])]
        edges, bits = np.concatenate(([0], np.cumsum(per_block))).tolist(), []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = starts[same[a:b]]
            bits.append(flags[_ranges(own, own + size[a:b])])
        answers.append(answer(warm, bits, SLICES))
        del raw, warm
    pa.default_memory_pool().release_unused()
    return pa.concat_tables(answers)


SEEN = "src int, dst int, payload binary, counts binary"


def _sent_anchors(src: int, shard: _Shard, targets: int) -> pa.Table:
    """A block of minimizers per target, and how many slices each has here (255 stands for more)."""
    blocks = split_blocks(src, shard.anchors, targets)
    counts, edges = np.minimum(shard.slice_counts(), 255).astype(np.uint8), target_edges(shard.anchors, targets)
    parts = [counts[edges[t] : edges[t + 1]].tobytes() for t in blocks["dst"].to_pylist()]
    return blocks.append_column("counts", pa.array(parts, pa.binary()))


def _shared_anchors(table: pa.Table, hot_slices: int) -> pa.Table:
    """Two bits per minimizer: another shard has it too; all shards together have more than hot_slices slices of it."""
    table = table.take(pc.sort_indices(table["src"]))
    raw, offsets = column_bytes(table["payload"])
    hashes, slices = raw.view(np.uint64), column_bytes(table["counts"])[0].astype(np.int64)
    _, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
    # a shard with 255 slices or more of one minimizer may have any number
    many = np.bincount(which, weights=np.where(slices == 255, hot_slices + 1, slices)) > hot_slices
    flags = np.stack((times[which] > 1, many[which]), axis=1).ravel()
    return flag_rows(table, flags, 2 * (np.diff(offsets) // 8), SHARED)


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, buckets: int | None = None, hot_slices: int = HOT_SLICES) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the other bytes).

    length: a multiple of eight, at least 48. A null text is empty; texts shorter than `length` are kept whole, and a
    text is never cut. Null ids and rows that repeat an id have a row each. An empty table gives no rows; other
    columns, whatever their names, play no part. buckets: the least number of source buckets, four per shuffle
    partition unless given; large inputs have more. hot_slices: the most different slices of a minimizer that are merged.
    """
    if length % 8 or length < GRAM + 8:
        raise ValueError("length has to be a multiple of 8, at least 48")
    partitions = shuffle_partitions(docs.sparkSession)
    targets, sources = partitions // 2 + 1, buckets or 4 * partitions
    texts = bucketed(docs, id_col, text_col, sources, BUCKET_BYTES).groupBy("bucket")

    def anchors(table: pa.Table) -> pa.Table:
        return _sent_anchors(table["bucket"][0].as_py(), _Shard(table, length), targets)

    def chosen(table: pa.Table, bits: pa.Table) -> _Shard:
        shard = _Shard(table, length)
        shard.select(*bits_of(bits, SHARED, 2 * len(shard.anchors)).reshape(-1, 2).T)
        return shard

    def slices(table: pa.Table, bits: pa.Table) -> pa.Table:
        return chosen(table, bits).blocks(table["bucket"][0].as_py(), partitions, partitions // 8 + 1)

    def results(table: pa.Table, bits: pa.Table) -> pa.Table:
        shard = chosen(table, bits)
        at = shard.repeats(bits_of(bits, SLICES, int(shard.slice_sizes().sum())), bits_of(bits, WINDOWS, len(shard.hot_windows)))
        removed = covered(np.unique(at), length, len(shard.raw))
        opens = removed.copy()
        opens[1:] &= ~removed[:-1]
        edges = shard.offsets[:-1][shard.offsets[:-1] < len(removed)]
        opens[edges] |= removed[edges]
        count = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[shard.offsets])
        columns = [shard.docs["id"].combine_chunks(), np.diff(shard.offsets), count(removed), count(opens)]
        kept = to_column(shard.raw[~removed], np.concatenate(([0], np.cumsum(~removed)))[shard.offsets], pa.binary())
        return pa.Table.from_arrays([*(pa.array(c) for c in columns), kept], schema=_RESULT)

    shared = texts.applyInArrow(anchors, SEEN).groupBy("dst").applyInArrow(lambda table: _shared_anchors(table, hot_slices), BITS).repartition("src")  # read twice
    sent = texts.cogroup(shared.groupBy("src")).applyInArrow(slices, SENT)
    merged = sent.groupBy("dst").applyInArrow(lambda table: merge_shards(table, length), BITS)
    return texts.cogroup(shared.unionByName(merged).groupBy("src")).applyInArrow(results, RESULT)
