"""Near-duplicate groups by SetSketch registers.

A document's set is its distinct shingles of `words` words, two unless given (lower-cased ASCII, words split at white space); documents are
linked when their Jaccard similarity reaches the threshold, and a group is what links connect.

Method.
1. Sketch: each shingle is a Poisson process of points in time, each on a random register; a register holds the
   earliest point, truncated to an exponentially spaced integer (base BASE). Points beyond the time by which all
   registers of a set of this size are filled can't matter and aren't made. Registers of a union are the maxima of
   the registers, and equal registers grow likelier with similarity.
2. Bands of `rows` registers give bucket keys. A pair at the threshold 0.8 misses all 65 bands of 7 with a
   probability of about 2e-7; unrelated texts all but never meet.
3. Documents with equal sets are one class. Classes that share a bucket are joined to the bucket's least class
   (a star: as many edges as members, never pairs), first within a task and then across tasks, so a bucket that a
   third of all classes share sends one key per task. Connected components of these edges are candidate clusters.
4. In a cluster a pair is first estimated from both sketches by maximum likelihood and, unless that is clearly too
   low, verified on full sets. Only as many pairs are tried as decide which classes are connected: all against the
   member that agrees best with the others, then each class that is still outside the largest group against the
   classes that hold one of its rarest shingles (a link needs one of any fifth of a set, plus one).
5. Clusters of more than `block` classes, or of more than BLOCK_SHINGLES shingles, are cut into blocks. Each block is
   worked as above; the best members of blocks elect a few hubs, `block` of them in a task, over as many levels as that
   takes; all blocks are compared with the hubs. While more than a block of classes is outside the largest group, the largest groups outside name hubs of their own. Classes that are outside then go to every block,
   `block` of them in a task; a task tries only what may connect two groups, and gives as many links as connect them.

Links are exact on 64-bit shingle hashes; no partner is capped. Texts cross the network once for the classes in
clusters (a join on the id); nothing about all documents is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.llm import vocabulary
from glimmer.llm.components import components
from glimmer.llm.exchange import checkpointed, shuffle_partitions, target_edges
from glimmer.llm.text_kernels import LOWER, SPACE_SPLIT, column_bytes, gram_hashes, mix, portions, split_words

BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: Estimates this far below the threshold aren't verified: eight standard errors of 455 registers.
MARGIN = 0.15
#: Clusters up to this size need no best member; every class is looked up.
SMALL = 24
HUBS = 4
#: Shingles of a block, about: what a task reads of a cluster of long texts.
BLOCK_SHINGLES = 1 << 20
#: Distinct sets after which a task sends what it holds of bucket keys.
HELD_SETS = 1 << 14
#: Clusters of several blocks, up to which a table with a row for each is broadcast.
FEW_CLUSTERS = 100_000
#: Bytes of bucket keys of a target, about.
TARGET_BYTES = 1 << 26
#: Further elections, sixteen times as many hubs each, before what is left is asked about in blocks; a round has to
#: halve the groups that are left, as each costs a search for components.
HUB_ROUNDS = 2
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(texts: pa.Array | pa.ChunkedArray, words: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, bounds): those of text d are hashes[bounds[d]:bounds[d + 1]]."""
    raw, offsets = column_bytes(texts)
    split = split_words(LOWER[raw], offsets, SPACE_SPLIT)
    h = split.hashes()
    grams = {k: gram_hashes(h, k) for k in range(1, words + 1)}
    out = []
    for a, b in zip(split.bounds[:-1].tolist(), split.bounds[1:].tolist(), strict=True):
        k = min(words, b - a)
        s = np.sort(grams[k][a : b - k + 1]) if k else h[:0]
        out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s)
    return (np.concatenate(out) if out else h[:0]), np.concatenate(([0], np.cumsum([len(s) for s in out]))).astype(np.int64)


def sketches(hashes: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """Registers (sets x m, 16 bits) of non-empty sets; independent of what else is in the batch."""
    n = len(bounds) - 1
    sizes = np.diff(bounds)
    earliest = np.full((n, m), np.inf)
    limit = np.where(sizes > 0, (np.log(m) + 6) / np.maximum(sizes, 1), 0.0)
    todo = np.flatnonzero(sizes > 0)
    chunk = 1 << 16
    while len(todo):
        edges = np.concatenate(([0], np.cumsum(sizes[todo])))
        first = 0
        while first < len(todo):  # some sets at a time
            last = max(first + 1, int(np.searchsorted(edges, edges[first] + chunk, side="right")) - 1)
            some = todo[first:last]
            owner = np.repeat(some, sizes[some])
            h = np.concatenate([hashes[bounds[d] : bounds[d + 1]] for d in some])
            t, r = np.zeros(len(h)), 0
            with np.errstate(over="ignore"):
                while len(h):
                    r += 1
                    u = mix(h + np.uint64(r) * _GOLD)
                    t = t - np.log(((u >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / m
                    live = t <= limit[owner]
                    h, owner, t, u = h[live], owner[live], t[live], u[live]
                    place = (mix(u ^ _TURN) % np.uint64(m)).astype(np.int64)
                    np.minimum.at(earliest.reshape(-1), owner * m + place, t)
            first = last
        todo = todo[np.isinf(earliest[todo]).any(axis=1)]
        limit[todo] *= 3
    with np.errstate(divide="ignore"):
        value = np.floor(1 - np.log(earliest / RATE) / np.log(BASE))
    return np.clip(np.where(np.isinf(earliest), 0, value), 0, TOP).astype(np.uint16)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per set and band."""
    out = np.zeros((len(registers), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(registers), np.uint64(b + 1)) * _TURN
            for k in range(rows):
                key = mix((key ^ registers[:, b * rows + k].astype(np.uint64)) * _GOLD)
            out[:, b] = key
    return out


def class_of(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x))) for x in (mix(hashes * _GOLD), mix(hashes ^ _TURN))]
        a, b = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
        return mix(a ^ mix(b * _GOLD + np.diff(bounds).astype(np.uint64))).view(np.int64)


def estimate(registers: np.ndarray, sizes: np.ndarray, one: np.ndarray, size: int) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of each set with one set, from all registers jointly."""
    wide, other = registers.astype(np.int32), one.astype(np.int32)
    more, less = (wide > other).sum(axis=1), (wide < other).sum(axis=1)
    equal = registers.shape[1] - more - less
    u = sizes / (sizes + size)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 101)[None, :] * most[:, None]
    p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)
    above, below = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    level = np.clip(1 - above - below, 1e-12, 1)
    fit = more[:, None] * np.log(above) + less[:, None] * np.log(below) + equal[:, None] * np.log(level)
    return grid[np.arange(len(grid)), fit.argmax(axis=1)]


class Block:
    """Sets of one cluster, or of a part of it."""

    def __init__(self, names: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, m: int, percent: int):
        self.names, self.hashes, self.bounds, self.percent = names, hashes, bounds, percent
        self.sizes = np.diff(bounds)
        self.registers = sketches(hashes, bounds, m)
        self.parent = list(range(len(names)))
        self.edges: list[tuple[int, int]] = []
        self.owner = np.repeat(np.arange(len(names)), self.sizes)
        self.values = None

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def unite(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[b] = a
            self.edges.append((int(self.names[x]), int(self.names[y])))

    def linked(self, members: np.ndarray, items: np.ndarray, registers: np.ndarray) -> np.ndarray:
        """Those members that are linked with the set `items`: size bound, estimate, then full sets."""
        sizes = self.sizes[members]
        fits = 100 * np.minimum(sizes, len(items)) >= self.percent * np.maximum(sizes, len(items))
        members = members[fits]
        if len(members):
            members = members[estimate(self.registers[members], self.sizes[members], registers, len(items)) >= self.percent / 100 - MARGIN]
        if not len(members):
            return members
        parts = [self.hashes[self.bounds[d] : self.bounds[d + 1]] for d in members.tolist()]
        joined = np.concatenate(parts)
        at = np.minimum(np.searchsorted(items, joined), len(items) - 1)
        common = np.add.reduceat((items[at] == joined).astype(np.int64), np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1])))
        union = self.sizes[members] + len(items) - common
        return members[100 * common >= self.percent * union]

    def items(self, d: int) -> np.ndarray:
        return self.hashes[self.bounds[d] : self.bounds[d + 1]]

    def holders(self, items: np.ndarray) -> np.ndarray:
        """Members with one of the rarest of these shingles, of which a link needs at least one."""
        if self.values is None:
            order = np.argsort(self.hashes, kind="stable")
            self.values, self.of = self.hashes[order], self.owner[order]
        low, high = np.searchsorted(self.values, items), np.searchsorted(self.values, items, side="right")
        need = len(items) * (100 - self.percent) // 100 + 1
        rare = np.argsort(high - low, kind="stable")[:need]
        found = [self.of[a:b] for a, b in zip(low[rare].tolist(), high[rare].tolist(), strict=True) if b > a]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def linked_with(self, members: np.ndarray, other: Block, q: int) -> np.ndarray:
        """Those members that are linked with the other block's class q."""
        return self.linked(members, other.items(q), other.registers[q])

    def scores(self) -> np.ndarray:
        """How many registers of others each member's registers agree with."""
        score = np.zeros(len(self.names), np.int64)
        for column in self.registers.T:
            _, which, times = np.unique(column, return_inverse=True, return_counts=True)
            score += times[which]
        return score

    def best(self) -> int:
        """The member that agrees best with the others."""
        return int(self.scores().argmax())

    def connect(self) -> None:
        """Finds which members are connected; every possible link between two groups has been tried at the end."""
        everyone = np.arange(len(self.names))
        if len(everyone) > SMALL:
            hub = self.best()
            for d in self.linked(everyone, self.items(hub), self.registers[hub]).tolist():
                self.unite(hub, d)
        roots = np.array([self.root(d) for d in everyone])
        names, times = np.unique(roots, return_counts=True)
        for d in everyone[roots != names[times.argmax()]].tolist():
            near = self.holders(self.items(d))
            near = np.array([e for e in near.tolist() if self.root(e) != self.root(d)], np.int64)
            for e in self.linked(near, self.items(d), self.registers[d]).tolist():
                self.unite(d, e)


_PACKED = pa.schema([("dst", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
PACKED = "dst int, kind int, payload binary"
_ROWS = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("mark", pa.int64())])
ROWS = "kind int, a long, b long, n long, mark long"
DOCUMENT, EDGE, KEYS, HUB = 0, 1, 2, 3


def _stars(keys: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, the least name of each, and edges from other names to it)."""
    order = np.lexsort((names, keys))
    keys, names = keys[order], names[order]
    fresh = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    least = names[fresh][np.cumsum(fresh) - 1] if len(keys) else names
    other = names != least
    pairs = np.unique(np.stack((names[other], least[other]), axis=1), axis=0)
    return keys[fresh], names[fresh], pairs[:, 0], pairs[:, 1]


def _table(kind: int, a: np.ndarray, b: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    """Rows of one kind; what isn't given is 0."""
    zeros = [np.zeros(len(a), np.int64)] * (2 - len(more))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *(pa.array(np.ascontiguousarray(x)) for x in (a, b, *more, *zeros))], schema=_ROWS)


def packed_rows(kind: int, dealt: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """Rows (dst, kind, payload) of one kind."""
    return pa.RecordBatch.from_arrays([pa.array([t for t, _ in dealt], pa.int32()), pa.array([kind] * len(dealt), pa.int32()), pa.array([x for _, x in dealt], pa.binary())], schema=_PACKED)


def packed_keys(keys: np.ndarray, names: np.ndarray, targets: int) -> Iterator[pa.RecordBatch]:
    """A task's edges between names that share a key, and each of its keys once with its least name, dealt out over all targets."""
    keys, least, a, b = _stars(keys, names)
    with np.errstate(over="ignore"):
        home = (mix(a.view(np.uint64) * _GOLD) % np.uint64(targets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    local, cuts = np.stack((a, b), axis=1)[order], np.searchsorted(home[order], np.arange(targets + 1))
    yield packed_rows(EDGE, [(t, local[cuts[t] : cuts[t + 1]].tobytes()) for t in range(targets) if cuts[t + 1] > cuts[t]])
    edges = target_edges(keys, targets)
    both = np.stack((keys.view(np.int64), least), axis=1)
    yield packed_rows(KEYS, [(t, both[edges[t] : edges[t + 1]].tobytes()) for t in range(targets) if edges[t + 1] > edges[t]])


def met(packed: DataFrame) -> DataFrame:
    """ROWS of (dst, kind, payload): the documents and edges that were sent, and edges between the least names of equal keys."""

    def meet(table: pa.Table) -> pa.Table:
        raw = {kind: np.frombuffer(b"".join(table.filter(pc.equal(table["kind"], kind))["payload"].to_pylist()), np.int64) for kind in (DOCUMENT, EDGE, KEYS)}
        facts, local, keys = raw[DOCUMENT].reshape(-1, 4), raw[EDGE].reshape(-1, 2), raw[KEYS].reshape(-1, 2)
        _, _, a, b = _stars(keys[:, 0].copy().view(np.uint64), keys[:, 1].copy())
        return pa.Table.from_batches([_table(DOCUMENT, *facts.T), _table(EDGE, np.concatenate((a, local[:, 0])), np.concatenate((b, local[:, 1])))])

    return packed.groupBy("dst").applyInArrow(meet, ROWS)


def _sent(texts: DataFrame, bands: int, rows: int, targets: int, words: int = 2) -> DataFrame:
    """(dst, kind, payload): a task's documents, edges and bucket keys, each kind dealt out over all targets."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary.release()
        held_keys: list[np.ndarray] = []
        held_names: list[np.ndarray] = []
        seen: set[int] = set()
        turn = TaskContext.get().partitionId()
        for batch in (b[p] for b in batches for p in portions(b["text"], 1 << 20)):
            hashes, bounds = shingle_sets(batch["text"], words)
            names, sizes = class_of(hashes, bounds), np.diff(bounds)
            ids = batch["id"]
            some = np.flatnonzero((sizes > 0) & ~np.asarray(ids.is_null()))
            facts = np.stack((ids.fill_null(0).to_numpy()[some], names[some], sizes[some], batch["mark"].to_numpy()[some]), axis=1).astype(np.int64)
            yield packed_rows(DOCUMENT, [(turn % targets, facts.tobytes())])
            turn += 1
            _, first = np.unique(names[some], return_index=True)
            new = [d for d in some[np.sort(first)].tolist() if int(names[d]) not in seen]
            seen.update(int(names[d]) for d in new)
            if not new:
                continue
            parts = [hashes[bounds[d] : bounds[d + 1]] for d in new]
            registers = sketches(np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts]))), bands * rows)
            held_keys.append(band_keys(registers, bands, rows).ravel())
            held_names.append(np.repeat(names[new], bands))
            if len(seen) >= HELD_SETS:
                yield from packed_keys(np.concatenate(held_keys), np.concatenate(held_names), targets)
                held_keys, held_names, seen = [], [], set()
        if held_keys:
            yield from packed_keys(np.concatenate(held_keys), np.concatenate(held_names), targets)

    return texts.mapInArrow(pack, PACKED)


def _candidates(texts: DataFrame, bands: int, rows: int, targets: int, words: int) -> DataFrame:
    """Documents (id, class, size) and star edges between classes that share a bucket."""
    return met(_sent(texts, bands, rows, targets, words))


def _block_of(table: pa.Table, m: int, percent: int, words: int, kind: type[Block] = Block) -> Block:
    """The distinct classes of a table of (class, text)."""
    hashes, bounds = shingle_sets(table["text"], words)
    wanted = table["class"].to_numpy()
    names = class_of(hashes, bounds)
    _, first = np.unique(np.where(names == wanted, names, 0), return_index=True)
    keep = [d for d in np.sort(first).tolist() if names[d] == wanted[d]]
    parts = [hashes[bounds[d] : bounds[d + 1]] for d in keep]
    return kind(names[keep], np.concatenate(parts) if parts else hashes[:0], np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64), m, percent)


def _edge_table(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(edges, np.int64).reshape(-1, 2)
    return _table(EDGE, *pairs.T)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, bands: int = 65, rows: int = 7, block: int = 256, words: int = 2) -> DataFrame:
    """One row per input row: id, mark (xxhash64 of the text), n_shingles, component_id (the smallest id of the group), kept.

    Kept is the text with the smallest id of its group, and of several such texts one.

    A null or empty text, or one of white space, has no shingles and is a group of its own; a text of one word has
    one shingle, as has one of fewer than `words` words; a text of any length is taken whole. A null id is linked with
    nothing and kept, its n_shingles null unless it is 0. Rows that repeat an id and text are in one group and all kept
    or all dropped; rows of one id with different texts are judged each by its own text. An empty table
    gives no rows; other columns play no part.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    m = bands * rows
    targets = max(shuffle_partitions(spark), -(-texts.count() * 16 * bands // TARGET_BYTES))
    found = checkpointed(_candidates(texts, bands, rows, targets, words))
    facts = found.where(F.col("kind") == DOCUMENT).select(F.col("a").alias("id"), F.col("b").alias("class"), "n", "mark")
    clusters = components(found.where(F.col("kind") == EDGE).select("a", "b")).toDF("class", "cluster")
    return grouped_documents(texts, facts, lambda reps: _verified(texts, reps, clusters, m, percent, block, words))


def grouped_documents(texts: DataFrame, facts: DataFrame, verified: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """near_duplicates()'s rows from texts (id, text, mark), facts (id, class, n, mark; of texts with shingles) and the links
    (a, b) that verified() gives for classes (class, id, mark, n: one text of each)."""
    reps = checkpointed(facts.groupBy("class").agg(F.min(F.struct("id", "mark")).alias("first"), F.max("n").alias("n")).select("class", "first.id", "first.mark", "n"))
    groups = components(verified(reps)).toDF("class", "group")
    # written between aggregating by group and joining on it, so that Spark can split a join's hot group or class
    grouping = checkpointed(reps.join(groups, "class", "left").select("class", "id", F.coalesce("group", "class").alias("group")))
    least = checkpointed(grouping.groupBy("group").agg(F.min(F.struct("id", "class")).alias("first")))
    classes = checkpointed(grouping.join(least, "group").select("class", F.col("first.id").alias("component_id"), (F.col("class") == F.col("first.class")).alias("first")))
    kept = (F.col("id") == F.col("component_id")) & F.col("first")
    grouped = facts.join(classes, "class").select("id", "mark", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
    bare = texts.where(F.col("id").isNull() | F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    count = F.when(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(0)).cast("long")
    alone = bare.select("id", "mark", F.coalesce(count, F.lit(None).cast("long")).alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return grouped.unionByName(alone)


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows of docs, with their own columns, that stay: of each group of near duplicates one.

    Rows are told apart by id and text: another text of an id that is dropped elsewhere stays. Of rows that repeat id
    and text one stays, any of them where other columns differ. Rows with a null id stay, and rows without shingles
    unless they repeat another. An empty table gives no rows; columns of any name may be there besides.
    """
    found = checkpointed(near_duplicates(docs, id_col, text_col, **options).select("id", "mark", "kept"))
    key = [docs[f"`{id_col}`"].cast("long"), F.xxhash64(docs[f"`{text_col}`"].cast("string"))]
    same = lambda other: key[0].eqNullSafe(other["id"]) & (key[1] == other["mark"])
    rest = docs.join(found.where(~F.col("kept")), same(found), "left_anti")
    again = found.where(F.col("kept") & F.col("id").isNotNull()).groupBy("id", "mark").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    if (again := checkpointed(again)).isEmpty():
        return rest
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    struct = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    one = rest.join(again, same(again), "left_semi").select(struct, place.alias("place")).where(F.col("place") == 1).select("row.*")
    return rest.join(again, same(again), "left_anti").unionByName(one)


def _spanning(part: Block, asked: Block, label: dict[int, int], all_of: bool) -> list[tuple[int, int]]:
    """Links of asked classes with members, as many as connect their groups; label: the group that a class is in so far."""
    known, where = np.unique([label[n] for n in (*part.names.tolist(), *asked.names.tolist())], return_inverse=True)
    at, own = where[: len(part.names)], where[len(part.names) :].tolist()
    root, everyone, pairs = np.arange(len(known)), np.arange(len(part.names)), []
    for q, name in enumerate(asked.names.tolist()):
        near = everyone if all_of else part.holders(asked.items(q))
        near = near[root[at[near]] != root[own[q]]]
        for d in part.linked_with(near, asked, q).tolist():
            old, new = root[at[d]], root[own[q]]
            if old != new:
                root[root == old] = new
                pairs.append((name, int(part.names[d])))
    return pairs


def _verified(texts: DataFrame, reps: DataFrame, clusters: DataFrame, m: int, percent: int, block: int, words: int = 2, kind: type[Block] = Block) -> DataFrame:
    """(a, b): links between classes, as many as connect each group. reps: (class, id, mark, n), one text of each class."""
    key = [c for c in ("id", "mark") if c in reps.columns]  # where ids have a text each, the id tells
    sized = clusters.join(reps, "class").select("cluster", "class", *key, "n")
    sizes = sized.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    blocks = F.col("parts")
    members = sized.join(sizes, "cluster").select("cluster", "class", *key, blocks.cast("int").alias("blocks"), F.pmod(F.xxhash64("class"), blocks).cast("int").alias("block"))
    # a row a class: rows may repeat id and text, and lie side by side after the join
    held = checkpointed(texts.join(members, key).dropDuplicates(key).select("cluster", "block", "blocks", "class", "text"))

    def work(table: pa.Table) -> pa.Table:
        part = _block_of(table, m, percent, words, kind)
        part.connect()
        out = [_edge_table(part.edges)]
        if table["blocks"][0].as_py() > 1:
            best = part.best()
            out.append(_table(HUB, part.names[[best]], np.array([table["cluster"][0].as_py()])))
        return pa.Table.from_batches(out)

    first = checkpointed(held.groupBy("cluster", "block").applyInArrow(work, ROWS))
    links = first.where(F.col("kind") == EDGE).select("a", "b")
    large = held.where(F.col("blocks") > 1)
    if large.isEmpty():
        return links

    def elect(table: pa.Table) -> pa.Table:
        part = _block_of(table, m, percent, words, kind)
        top = np.argsort(-part.scores(), kind="stable")[:HUBS]
        return pa.Table.from_batches([_table(HUB, part.names[top], np.full(len(top), table["cluster"][0].as_py()))])

    few = sizes.where(blocks > 1).count() <= FEW_CLUSTERS
    hubs = first.where(F.col("kind") == HUB).select(F.col("a").alias("class"), F.col("b").alias("cluster"))
    most = large.agg(F.max("blocks")).first()[0]  # nominees of one cluster: one per block
    while True:
        parts = -(-most // max(block, 4 * HUBS))
        booth = F.pmod(F.xxhash64("class", F.lit(most)), F.lit(parts)).cast("int").alias("booth")
        hubs = large.join(hubs, ["cluster", "class"], "left_semi").select("cluster", "class", "text", booth).groupBy("cluster", "booth").applyInArrow(elect, ROWS).select(F.col("a").alias("class"), F.col("b").alias("cluster"))
        if parts == 1:
            break
        hubs, most = checkpointed(hubs), HUBS * parts

    def probe(all_of: bool):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not right.num_rows:
                return pa.Table.from_batches([_edge_table([])])
            marks = left.filter(pc.is_null(left["text"]))
            label = dict(zip(marks["class"].to_pylist(), marks["group"].to_pylist(), strict=True))
            label |= dict(zip(right["class"].to_pylist(), right["group"].to_pylist(), strict=True))
            part, asked = _block_of(left.filter(pc.is_valid(left["text"])), m, percent, words, kind), _block_of(right, m, percent, words, kind)
            return pa.Table.from_batches([_edge_table(_spanning(part, asked, label, all_of))])

        return run

    def against(queries: DataFrame, at: DataFrame, all_of: bool) -> DataFrame:
        """queries (cluster, class, group, turn, turns) against all blocks of their clusters, one turn of them in a task."""
        blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        renamed = [F.col(c).alias(c) for c in ("cluster", "turn", "class", "group", "text")]  # the same columns are on the other side
        asked = large.join(queries, ["cluster", "class"]).select(*renamed[:1], blocks, *renamed[1:])
        turns = queries.groupBy("cluster").agg(F.max("turns").alias("turns"))  # a row per large cluster
        turns = F.broadcast(turns) if few else turns
        turn = F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn")
        members = large.join(turns, "cluster").select("cluster", "block", turn, "class", F.lit(None).cast("long").alias("group"), "text")
        marks = at.join(turns, "cluster").select("cluster", "block", turn, "class", "group", F.lit(None).cast("string").alias("text"))
        keys = ["cluster", "block", "turn"]
        return members.unionByName(marks).groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(probe(all_of), ROWS).select("a", "b")

    alone = large.select("cluster", "block", "class", F.col("class").alias("group"))
    one = [F.lit(0).alias("turn"), F.lit(1).alias("turns")]
    links = checkpointed(links.unionByName(against(hubs.select("cluster", "class", F.col("class").alias("group"), *one), alone, True)).distinct())
    last = None
    for turn in range(HUB_ROUNDS + 1):
        groups = components(links).toDF("class", "group")
        at = checkpointed(large.select("cluster", "block", "class").join(groups, "class", "left").select("cluster", "block", "class", F.coalesce("group", "class").alias("group")))
        counts = at.groupBy("cluster", "group").agg(F.count("*").alias("n"))
        main = counts.groupBy("cluster").agg(F.max_by("group", F.struct("n", "group")).alias("main"))
        outside = at.join(main, "cluster").where(F.col("group") != F.col("main")).select("cluster", "class", "group")
        # clusters with more classes outside than one task is asked about, and the groups these are in
        crowded = outside.groupBy("cluster", "group").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.sum("n").alias("n"), F.count("*").alias("groups")).where(F.col("n") > block)
        left = crowded.agg(F.sum("groups")).first()[0] or 0
        if turn == HUB_ROUNDS or not left or (last is not None and left > 0.5 * last):
            break
        last = left
        # hubs of the largest groups outside: the classes with most links
        degrees = links.select(F.col("a").alias("class")).unionByName(links.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("degree"))
        ranked = outside.join(crowded.select("cluster"), "cluster", "left_semi").join(degrees, "class", "left").groupBy("cluster", "group").agg(F.count("*").alias("n"), F.max_by("class", F.struct(F.coalesce("degree", F.lit(0)), "class")).alias("class"))
        place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "group"))
        elected = ranked.withColumn("place", place).where(F.col("place") <= 16 * HUBS).select("cluster", "class", "group", *one)
        links = checkpointed(links.unionByName(against(elected, at, True)).distinct())
    turns = outside.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("turns"))
    queries = checkpointed(outside.join(turns, "cluster").select("cluster", "class", "group", F.pmod(F.xxhash64("class", F.lit(1)), F.col("turns")).cast("int").alias("turn"), "turns"))
    return links.unionByName(against(queries, at, False)).distinct()
