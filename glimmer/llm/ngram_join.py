"""Groups of documents by a similarity join on n-grams, with rare-first prefix filtering.

A document's set is its distinct shingles of `words` words; two documents are linked when the Jaccard similarity of their
sets reaches `percent`, and a group is what links connect.

Method.
1. Documents are dealt out to source buckets. A bucket sends each of its shingles once, as four bytes beyond those that
   name its target, with the number of its different sets that hold it, and gets back how rare the shingle is over all
   buckets: one byte, exact up to 127 sets, in eighths of a power of two beyond. Shingles that agree in these bytes
   (one in some hundreds, at most) count as one there, which is the same for all sets that hold them and so loses nothing.
2. Prefix filter: a set's shingles are ordered rare first. Two linked sets share one of their first
   n - ceil(n * percent / 100) + 1 shingles, so only these are indexed; those that one set alone holds find no partner and
   aren't sent, though they count.
3. Join on prefix n-grams: sets that share one, and whose sizes are near enough for a link, are connected through the
   least of them (as many edges as entries, never pairs), first within a bucket and then across buckets. Connected components of these edges are candidate clusters;
   a link never leaves its cluster. Sets with prefixes of their own, the bulk of a corpus, are in none.
4. In a cluster, cut into blocks of bounded size, sets are joined on prefix n-grams again, rare first in the block: a
   pair has to pass the length filter, the positional filter (shingles left after the first common one) and the suffix
   filter (how shingles fall between a few pivots), and is then verified on both full sets, once. Pairs whose two
   sets are connected already are not looked at: a family of near copies costs as much as it has members, not pairs.
   Blocks of one large cluster are compared as near_dedup does it.

Copies with equal sets are one class from the start. No partner is capped, no pair is emitted unless it is a link that connects
two groups. Sets are compared by 64-bit shingle hashes. Texts cross the network once, and again those of classes in clusters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.components import components
from glimmer.llm.exchange import BLOCKS, bucketed, checkpointed, shuffle_partitions, target_edges
from glimmer.llm.near_dedup import DOCUMENT, EDGE, PACKED, SMALL, Block, _verified, class_of, grouped_documents, met, packed_keys, packed_rows, shingle_sets
from glimmer.llm.text_kernels import mix, portions

#: Text of a source bucket, about: a task holds some ten times as much. A target gets as many bytes of shingles.
BUCKET_BYTES, TARGET_BYTES = 1 << 24, 1 << 26
#: Pivots of the suffix filter.
PIVOTS = 7
ANSWERS = "src int, dst int, codes binary"
_ANSWERS = pa.schema([("src", pa.int32()), ("dst", pa.int32()), ("codes", pa.binary())])
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PAIR = np.dtype([("at", "<u4"), ("n", "<u4")])


def rarity(counts: np.ndarray) -> np.ndarray:
    """One byte for how many sets hold a shingle; never smaller for more sets."""
    with np.errstate(divide="ignore"):
        far = 128 + np.floor(8 * np.log2(np.maximum(counts, 128) / 128))
    return np.where(counts < 128, counts, np.minimum(far, 255)).astype(np.uint8)


def needed(sizes: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's first shingles a linked set has to meet."""
    return sizes - -(-sizes * percent // 100) + 1


def short_hashes(hashes: np.ndarray, target: int, targets: int) -> np.ndarray:
    """A target's hashes by their first 32 bits of those that tell them apart; sorted if they were."""
    return ((hashes - np.uint64((target << 64) // targets)) >> np.uint64(32 - (targets.bit_length() - 1))).astype("<u4")


def entry_keys(grams: np.ndarray, names: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, names) of entries (gram, class, size of its set), two each; two classes that may be linked share one if they share a gram.

    A key is a gram with a step of size. Steps are a little wider than a link allows, and a class is on two of them.
    """
    step = np.floor(np.log(sizes) / (1.0001 * np.log(100 / percent))) if percent < 100 else sizes
    with np.errstate(over="ignore"):
        keys = [mix(grams.view(np.uint64) ^ mix((step.astype(np.int64) + k).view(np.uint64) * _STEP)) for k in (0, 1)]
    return np.concatenate(keys), np.concatenate((names, names))


class _Sets:
    """The documents of a source bucket, its different sets, and its shingles."""

    def __init__(self, table: pa.Table, words: int):
        hashes, self.facts, known = [], [], set()
        names, sizes = [], []
        for part in portions(table["text"]):
            some = table.slice(part.start, part.stop - part.start)
            h, bounds = shingle_sets(some["text"], words)
            name, size = class_of(h, bounds), np.diff(bounds)
            ids = some["id"].combine_chunks()
            valid = np.flatnonzero((size > 0) & np.asarray(ids.is_valid()))
            self.facts.append((ids.fill_null(0).to_numpy()[valid], name[valid], size[valid], some["mark"].to_numpy()[valid]))
            for d in valid.tolist():
                if int(name[d]) not in known:
                    known.add(int(name[d]))
                    hashes.append(h[bounds[d] : bounds[d + 1]])
                    names.append(name[d])
                    sizes.append(size[d])
        self.names, self.sizes = np.array(names, np.int64), np.array(sizes, np.int64)
        self.distinct, self.which, self.counts = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)

    def blocks(self, src: int, targets: int) -> pa.Table:
        """Per target its shingles, ascending; after them those that several sets hold, with how many."""
        edges = target_edges(self.distinct, targets)
        some = np.flatnonzero(np.diff(edges)).tolist()
        payload = []
        for t in some:
            part, counts = self.distinct[edges[t] : edges[t + 1]], self.counts[edges[t] : edges[t + 1]]
            more = np.flatnonzero(counts > 1)
            pairs = np.zeros(len(more), _PAIR)
            pairs["at"], pairs["n"] = more, counts[more]
            payload.append(np.array([len(part)], "<u8").tobytes() + short_hashes(part, t, targets).tobytes() + pairs.tobytes())
        return pa.Table.from_arrays([pa.array([src] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(payload, pa.binary())], names=["src", "dst", "payload"])

    def prefixes(self, codes: np.ndarray, percent: int, src: int, targets: int) -> pa.Table:
        """Packed: documents, and keys of those shingles of a class's prefix that other sets hold as well."""
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        order = np.lexsort((self.which, codes[self.which], owner))
        place = np.arange(len(order)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        which = self.which[order]
        sent = (place < needed(self.sizes, percent)[owner]) & (codes[which] > 1)
        rows = [packed_rows(DOCUMENT, [(src % targets, np.stack(facts, axis=1).astype(np.int64).tobytes())]) for facts in self.facts]
        return pa.Table.from_batches([*rows, *packed_keys(*entry_keys(self.distinct[which[sent]], self.names[owner[sent]], self.sizes[owner[sent]], percent), targets)])


def _answered(table: pa.Table) -> pa.Table:
    """The rarity of each shingle of each block."""
    raw = [np.frombuffer(b, np.uint8) for b in table["payload"].to_pylist()]
    sizes = [int(b[:8].view("<u8")[0]) for b in raw]
    hashes = np.concatenate([b[8 : 8 + 4 * n].view("<u4") for b, n in zip(raw, sizes, strict=True)])
    counts, start = np.ones(len(hashes), np.int64), 0
    for b, n in zip(raw, sizes, strict=True):
        pairs = b[8 + 4 * n :].view(_PAIR)
        counts[start + pairs["at"]] = pairs["n"]
        start += n
    _, which = np.unique(hashes, return_inverse=True)
    codes = rarity(np.bincount(which, weights=counts))[which]
    edges = np.concatenate(([0], np.cumsum(sizes))).tolist()
    return pa.Table.from_arrays([table["src"], table["dst"], pa.array([codes[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], schema=_ANSWERS)


class PrefixBlock(Block):
    """Sets of one cluster, or of a part of it, with an index of their prefixes."""

    def __init__(self, names: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, m: int, percent: int):
        self.names, self.hashes, self.bounds, self.percent = names, hashes, bounds, percent
        self.sizes = np.diff(bounds)
        self.parent = list(range(len(names)))
        self.edges = []
        self.owner = np.repeat(np.arange(len(names)), self.sizes)
        self.values, which, self.held = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.lexsort((self.values, self.held))
        self.rank = np.zeros(len(order), np.int64)  # of each value: rare first, then by hash
        self.rank[order] = np.arange(len(order))
        ranks = self.rank[which]
        order = np.lexsort((ranks, self.owner))
        self.ordered = ranks[order] + self.owner * (len(self.values) + 1)  # ascending as a whole: by set, then rare first
        place = np.arange(len(order)) - np.repeat(bounds[:-1], self.sizes)
        first = np.flatnonzero(place < needed(self.sizes, percent)[self.owner])
        lists = np.argsort(which[order][first], kind="stable")
        self.list_of, self.in_set, self.at = which[order][first][lists], self.owner[first][lists], place[first][lists]

    def scores(self) -> np.ndarray:
        """How much of each set others hold, about a Jaccard similarity with the mean set."""
        shared = np.add.reduceat(self.held[np.searchsorted(self.values, self.hashes)], self.bounds[:-1])
        return shared / (self.sizes + self.sizes.mean())

    def least_common(self, sizes: np.ndarray, n: int) -> np.ndarray:
        """Shingles in common that a link of a set of n and sets of these sizes needs."""
        return -(-self.percent * (sizes + n) // (100 + self.percent))

    def order_of(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index in values, rank) of a set's shingles, rare first; those that no set here holds come first, with rank -1."""
        at = np.minimum(np.searchsorted(self.values, items), len(self.values) - 1)
        rank = np.where(self.values[at] == items, self.rank[at], -1)
        order = np.argsort(rank, kind="stable")
        return at[order], rank[order]

    def holders(self, items: np.ndarray) -> np.ndarray:
        """Members that share a prefix shingle with a set and pass the length and positional filters."""
        at, rank = self.order_of(items)
        place = np.flatnonzero(rank[: int(needed(np.array([len(items)]), self.percent)[0])] >= 0)
        low, high = np.searchsorted(self.list_of, at[place]), np.searchsorted(self.list_of, at[place], side="right")
        n = high - low
        entry = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
        who, mine, other = self.in_set[entry], np.repeat(place, n), self.at[entry]
        who, first = np.unique(who, return_index=True)  # entries come rare first: the first one is the first in common
        sizes, left = self.sizes[who], 1 + np.minimum(len(items) - mine[first] - 1, self.sizes[who] - other[first] - 1)
        fits = 100 * np.minimum(sizes, len(items)) >= self.percent * np.maximum(sizes, len(items))
        return who[fits & (left >= self.least_common(sizes, len(items)))]

    def linked_with(self, members: np.ndarray, other: Block, q: int) -> np.ndarray:
        items = other.items(q)
        sizes = self.sizes[members]
        fits = 100 * np.minimum(sizes, len(items)) >= self.percent * np.maximum(sizes, len(items))
        members, sizes = members[fits], sizes[fits]
        if not len(members):
            return members
        # suffix filter: between two pivots, sets of unlike numbers of shingles differ in as many at least
        _, rank = self.order_of(items)
        pivots = np.unique(rank[(np.arange(1, PIVOTS + 1) * len(rank)) // (PIVOTS + 1)])
        mine = np.searchsorted(rank, pivots)
        below = np.searchsorted(self.ordered, members[:, None] * (len(self.values) + 1) + pivots) - self.bounds[members][:, None]
        theirs = np.diff(below, axis=1, prepend=0, append=sizes[:, None])
        differ = np.abs(theirs - np.diff(mine, prepend=0, append=len(items))).sum(axis=1)
        members = members[differ <= sizes + len(items) - 2 * self.least_common(sizes, len(items))]
        if not len(members):
            return members
        parts = [self.items(d) for d in members.tolist()]
        joined = np.concatenate(parts)
        at = np.minimum(np.searchsorted(items, joined), len(items) - 1)
        common = np.add.reduceat((items[at] == joined).astype(np.int64), np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1])))
        return members[100 * common >= self.percent * (self.sizes[members] + len(items) - common)]

    def connect(self) -> None:
        """Finds which members are connected, each pair looked at once at most."""
        everyone = np.arange(len(self.names))
        hub, done = -1, np.zeros(len(everyone), bool)
        if len(everyone) > SMALL:
            hub = self.best()
            done[hub] = True
            for d in self.linked_with(everyone, self, hub).tolist():
                self.unite(hub, d)
        roots = np.array([self.root(d) for d in everyone])
        names, times = np.unique(roots, return_counts=True)
        for d in everyone[roots != names[times.argmax()]].tolist():
            near = self.holders(self.items(d))
            near = np.array([e for e in near[~done[near]].tolist() if self.root(e) != self.root(d)], np.int64)
            done[d] = True
            for e in self.linked_with(near, self, d).tolist():
                self.unite(d, e)


def ngram_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, words: int = 4, block: int = 256, buckets: int | None = None) -> DataFrame:
    """One row per input row: id, mark (xxhash64 of the text), n_shingles, component_id (the smallest id of the group), kept.

    Words are split at white space and lower-cased, A-Z only. A text of fewer words has one shingle, all of them; a null
    or empty text, or one of white space, has none and is linked with nothing. A null id is linked with nothing, its
    n_shingles null unless it is 0. Rows that repeat an id and text are in one group; rows of one id with different texts
    are judged each by its own text. A text of any length is taken whole. An empty table gives no rows; other columns play no part.
    buckets: the least number of source buckets, as many as shuffle partitions unless given; large inputs have more.
    """
    spark = docs.sparkSession
    partitions = shuffle_partitions(spark)
    dealt = bucketed(docs, id_col, text_col, buckets or partitions, BUCKET_BYTES).withColumn("mark", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string"))).alias("n")).first()["n"] or 0
    targets = max(partitions, 2 * size // TARGET_BYTES)  # no more than about one shingle for four bytes of text; a target holds eight of each

    def send(table: pa.Table) -> pa.Table:
        return _Sets(table, words).blocks(table["bucket"][0].as_py(), targets)

    def prefixes(table: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.take(pc.sort_indices(answers["dst"]))
        codes = np.frombuffer(b"".join(answers["codes"].to_pylist()), np.uint8)
        sets = _Sets(table, words)
        if len(codes) != len(sets.distinct):
            raise ValueError(f"{len(codes)} answers came back for {len(sets.distinct)} shingles")
        return sets.prefixes(codes, percent, table["bucket"][0].as_py(), targets)

    by_bucket = dealt.groupBy("bucket")
    answers = by_bucket.applyInArrow(send, BLOCKS).groupBy("dst").applyInArrow(_answered, ANSWERS)
    found = checkpointed(met(by_bucket.cogroup(answers.groupBy("src")).applyInArrow(prefixes, PACKED)))
    facts = found.where(F.col("kind") == DOCUMENT).select(F.col("a").alias("id"), F.col("b").alias("class"), "n", "mark")
    clusters = components(found.where(F.col("kind") == EDGE).select("a", "b")).toDF("class", "cluster")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    return grouped_documents(texts, facts, lambda reps: _verified(texts, reps, clusters, 0, percent, block, words, PrefixBlock))


def prefix_edges(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b) of (gram, class, n): classes that share a gram, with the least of them of about their size, in a task or over all.

    ngram_groups() sends its entries from where they are made; this takes them from any table.
    """
    targets = shuffle_partitions(entries.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, name, n = (batch[c].to_numpy() for c in ("gram", "class", "n"))
            yield from packed_keys(*entry_keys(gram, name, n, percent), targets)

    return met(entries.mapInArrow(pack, PACKED)).where(F.col("kind") == EDGE).select("a", "b").distinct()
