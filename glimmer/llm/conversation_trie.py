"""Prefix trie of rebuilt conversations, by composable fingerprints.

A conversation is rebuilt from the head of a base conversation (its first turns) and its own later turns. Each
distinct sequence of first turns is a node of the trie; no rebuilt text is ever made.

Method. A turn's reference is the SHA-256 of its role and text. A sequence of turns is an element (x, q) of a monoid,
with (x, q)(y, r) = (x + q * y, q * r), in three residues; a turn is (a part of its reference, B). So
1. turns are dealt out by ranges of (conversation, turn) and every task multiplies its piece of a conversation, from
   the piece's start; pieces of a conversation that several tasks hold are then combined, not read again;
2. the fingerprint of a rebuilt prefix is the base head's product times the own suffix's, and the suffix's comes from
   two own products, as B has an inverse: arithmetic on columns, whatever the texts' lengths;
3. prefixes with one fingerprint, depth and reference of the last turn are a node. That members agree in the turns
   before follows from their parents' fingerprints being one, which is verified for each node (an error, else): by
   induction from the root all references agree.

Sums over subtrees take no walk. A node is owned by its smallest member; what a conversation owns is one run of
depths down to its end, so a subtree's distinct turns are the owned runs of its members, cut off at the top for the
owner alone. All figures of a node are then sums over its members, combined before the shuffle.

Scale. Rows are (conversation, depth), without texts; a first turn that a third of all conversations share is
aggregated map-side, joined by joins that Spark splits where a key is hot, and the ids of conversations that end in
one node are strings of at most CHUNK ids, fed in order to a running hash, never a list.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.llm.exchange import checkpointed, shuffle_partitions

#: A prime below 2**31, so that products fit a long, and a base for each residue.
PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 69_621_847, 630_360_016)
#: Range of conversation ids whose ends are one string.
CHUNK = 4096
#: Leading characters of a text that order turns which agree in turn and role.
LEAD = 32

_X = [f"x{k}" for k in range(len(BASES))]
_P = [f"p{x}" for x in _X]
_Q = [f"q{k}" for k in range(len(BASES))]
_SCAN = pa.schema([("piece", pa.int32()), ("conv", pa.int64()), ("k", pa.int64()), ("n_chars", pa.int64()), ("chars", pa.int64()), ("ref", pa.binary()), *((c, pa.int64()) for c in (*_X, *_P, *_Q))])
_SCAN_DDL = "piece int, conv long, k long, n_chars long, chars long, ref binary, " + ", ".join(f"{c} long" for c in (*_X, *_P, *_Q))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1), modulo PRIME."""
    out = np.ones(max(n, 1), np.int64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * pow(base, done, PRIME) % PRIME
        done += step
    return out


class _Run:
    """Running products of one task's sorted turns; the last conversation goes on in the next batch."""

    def __init__(self) -> None:
        self.conv, self.k, self.chars, self.x = None, 0, 0, [0] * len(BASES)

    def add(self, conv: np.ndarray, n_chars: np.ndarray, refs: np.ndarray) -> list[np.ndarray]:
        """(k, chars, x, px and q of each residue): of each conversation's turns so far, with the row's own and without it. refs: rows x 4 numbers."""
        n = len(conv)
        first = np.concatenate(([True], conv[1:] != conv[:-1]))
        start = np.flatnonzero(first)[np.cumsum(first) - 1]
        going = (start == 0) & (conv[0] == self.conv)
        at = np.arange(n) - start
        before = np.concatenate(([0], np.cumsum(n_chars)))
        chars = before[1:] - before[start] + np.where(going, self.chars, 0)
        xs, ps, qs = [], [], []
        for j, base in enumerate(BASES):
            power = powers(base, int(at.max()) + 2)
            ahead = np.where(going, pow(base, self.k, PRIME), 1)
            value = (refs[:, j] % np.uint64(PRIME)).astype(np.int64) * (power[at] * ahead % PRIME) % PRIME
            total = np.concatenate(([0], np.cumsum(value)))  # below 2**31 each: a batch doesn't overflow
            done = np.where(going, self.x[j], 0) - total[start]
            xs.append((total[1:] + done) % PRIME)
            ps.append((total[:-1] + done) % PRIME)
            qs.append(power[at + 1] * ahead % PRIME)
        k = at + 1 + np.where(going, self.k, 0)
        self.conv, self.k, self.chars, self.x = int(conv[-1]), int(k[-1]), int(chars[-1]), [int(x[-1]) for x in xs]
        return [k, chars, *xs, *ps, *qs]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run, piece = _Run(), TaskContext.get().partitionId()
    for batch in batches:
        if batch.num_rows:
            conv, n_chars = (batch[c].to_numpy(zero_copy_only=False) for c in ("conv", "n_chars"))
            refs = np.frombuffer(b"".join(batch["ref"].to_pylist()), "<u8").reshape(-1, 4)
            k, chars, *rest = run.add(conv, n_chars, refs)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), piece, np.int32)), batch["conv"], pa.array(k), batch["n_chars"], pa.array(chars), batch["ref"], *map(pa.array, rest)], schema=_SCAN)


def _times(x: Column, q: Column, y: Column) -> Column:
    """x + q * y, modulo PRIME."""
    return F.pmod(x + q * y, F.lit(PRIME))


def _own_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, k, n_chars, chars, ref, x..., px...): products of each conversation's first k own turns, for each k from 1, and of the k - 1 before."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    slim = turns.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"), F.left(text, F.lit(LEAD)).alias("lead"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("ref"), F.char_length(text).cast("long").alias("n_chars"),
    )
    key = ["conv", "turn", "role", "lead"]
    dealt = slim.repartitionByRange(shuffle_partitions(turns.sparkSession), *key).sortWithinPartitions(*key, "ref").select("conv", "ref", "n_chars")
    pieces = checkpointed(dealt.mapInArrow(_scanned, _SCAN_DDL))
    # conversations that lie in several pieces: at most one more than there are tasks, so this may be broadcast
    ends = pieces.groupBy("conv", "piece").agg(F.max_by(F.struct("k", "chars", *_X, *_Q), "k").alias("end"))
    several = ends.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("piece", "end"))).alias("ends")).where(F.size("ends") > 1)
    none = F.struct(F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("chars"), *[F.lit(0).cast("long").alias(c) for c in _X], *[F.lit(1).cast("long").alias(c) for c in _Q])

    def join(a: Column, b: Column) -> Column:
        e = b["end"]
        return F.struct((a["k"] + e["k"]).alias("k"), (a["chars"] + e["chars"]).alias("chars"), *[_times(a[x], a[q], e[x]).alias(x) for x, q in zip(_X, _Q, strict=True)], *[F.pmod(a[q] * e[q], F.lit(PRIME)).alias(q) for q in _Q])

    offsets = several.select("conv", F.posexplode("ends"), "ends").select("conv", F.col("col.piece").alias("piece"), F.aggregate(F.slice("ends", F.lit(1), F.col("pos")), none, join).alias("off"))
    off = F.coalesce("off", none)
    return pieces.join(offsets, ["conv", "piece"], "left").withColumn("off", off).select("conv", (off["k"] + F.col("k")).alias("k"), "n_chars", (off["chars"] + F.col("chars")).alias("chars"), "ref", *[_times(off[x], off[q], F.col(c)).alias(c) for x, p, q in zip(_X, _P, _Q, strict=True) for c in (x, p)])


def prefix_trie(turns: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column], most_head: int, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c is the first head(c) turns (at most most_head; all if there are fewer) of conversation base(c), then
    its own turns after its first head(c). conv_id is a node's smallest member, so (conv_id, depth) names a node;
    saved_tokens counts code points.

    Turns are ordered by turn, null first; turns that agree in it by role, the first LEAD characters of the text and a hash
    of role and text, so that rows which agree in all are repeated turns of one content. A null role or text is
    empty; a null conversation id names no conversation, and its rows play no part. A base that isn't there has no turns.
    A conversation without rebuilt turns is a member of the root alone. Texts of any length count whole. An empty
    table has no nodes, not even a root; other columns play no part.
    """
    own = checkpointed(_own_turns(turns, conv_col, turn_col, role_col, text_col))
    first = F.when(F.col("k") <= most_head, F.struct("k", "n_chars", "chars", "ref", *_X))
    lists = own.groupBy("conv").agg(F.max("k").alias("n"), F.max("chars").alias("all_chars"), F.array_sort(F.collect_list(first)).alias("firsts"))
    lists = checkpointed(lists)
    bases = lists.select(F.col("conv").alias("base"), F.col("firsts").alias("base_firsts"))
    h = head(F.col("conv")).cast("int")
    zero = F.struct(F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("n_chars"), F.lit(0).cast("long").alias("chars"), F.lit(b"").alias("ref"), *[F.lit(0).cast("long").alias(x) for x in _X])
    at = lambda items, k: F.coalesce(F.try_element_at(items, F.when(k > 0, k)), zero)
    convs = lists.withColumns({"h": h, "base": base(F.col("conv")).cast("long")}).join(bases, "base", "left")
    convs = convs.withColumn("heads", F.slice(F.coalesce("base_firsts", F.array_compact(F.array(F.lit(None).cast(lists.schema["firsts"].dataType.elementType)))), F.lit(1), F.col("h"))).withColumn("a", F.size("heads"))
    convs = convs.select("conv", "h", "a", "heads", at(F.col("heads"), F.col("a")).alias("top"), at(F.col("firsts"), F.col("h")).alias("cut"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("more"), "all_chars")
    convs = convs.withColumns({"len": F.col("a") + F.col("more"), "total": F.col("top.chars") + F.when(F.col("more") > 0, F.col("all_chars") - F.col("cut.chars")).otherwise(0)})
    convs = checkpointed(convs)

    def rows(item: Callable[[str], Column], depth: Column, before: Column, xs: list[Column], parents: list[Column]) -> list[Column]:
        return [F.col("conv"), F.col("len"), depth.cast("long").alias("depth"), item("n_chars").alias("n_chars"), before.alias("before"), item("ref").alias("ref"), *[c.alias(x) for c, x in zip(xs, _X, strict=True)], *[c.alias(p) for c, p in zip(parents, _P, strict=True)]]

    exploded = convs.select("conv", "len", "heads", F.explode("heads").alias("turn"))
    item = lambda c: F.col(f"turn.{c}")
    over = at(F.col("heads"), (item("k") - 1).cast("int"))
    heads = exploded.select(*rows(item, item("k"), item("chars") - item("n_chars"), [item(x) for x in _X], [over[x] for x in _X]))
    # own suffix, after the base's product: B**(a - h) * (own product up to k - own product up to h); up to k - 1 for the parent
    gaps = [F.array(*[F.lit(pow(pow(b, -1, PRIME), g, PRIME)).cast("long") for g in range(most_head + 1)]) for b in BASES]
    suffix = own.join(convs.select("conv", "len", "h", "a", "top", "cut"), "conv").where(F.col("k") > F.col("h"))
    shift = [F.element_at(g, F.col("h") - F.col("a") + 1) for g in gaps]
    joined = lambda names: [_times(F.col(f"top.{x}"), s, F.pmod(F.col(c) - F.col(f"cut.{x}"), F.lit(PRIME))) for x, c, s in zip(_X, names, shift, strict=True)]
    tails = suffix.select(*rows(F.col, F.col("a") + F.col("k") - F.col("h"), F.col("top.chars") + F.col("chars") - F.col("n_chars") - F.col("cut.chars"), joined(_X), joined(_P)))

    paths = checkpointed(heads.unionByName(tails))
    key = ["depth", *_X, "ref"]
    parents = F.struct(*_P)
    one = F.assert_true(F.min(parents) == F.max(parents), F.lit("fingerprints of two prefixes coincide; take other bases"))
    nodes = paths.groupBy(*key).agg(F.min("conv").alias("owner"), F.count("*").alias("n"), F.count_if(F.col("depth") == F.col("len")).alias("ends"), one.alias("checked")).where(F.col("checked").isNull())
    owned = checkpointed(paths.join(nodes.drop("checked"), key).select("conv", "len", "depth", "n_chars", "before", "owner", "n", "ends"))
    root = convs.agg(F.min("conv").alias("owner"), F.count_if(F.col("len") > 0).alias("long")).first()

    own_row = F.col("owner") == F.col("conv")
    runs = owned.groupBy("conv").agg(
        F.min(F.when(own_row, F.col("depth"))).alias("start"), F.coalesce(F.sum(F.when(own_row, F.col("n_chars"))), F.lit(0)).alias("owned_chars"),
        F.bool_or(own_row & (F.col("depth") == F.col("len")) & (F.col("n") == F.col("ends"))).alias("leaf"), F.max_by(F.when(~own_row, F.col("owner")), F.when(~own_row, F.col("depth"))).alias("above"),
    )
    is_root = F.col("conv") == F.lit(root["owner"])
    facts = convs.select("conv", "total", "len").join(runs, "conv", "left").select(
        "conv", "total", F.when(is_root, F.lit(0)).otherwise(F.coalesce("start", F.col("len") + 2)).alias("start"), F.coalesce("owned_chars", F.lit(0)).alias("owned_chars"),
        F.coalesce("leaf", is_root & F.lit(root["long"] == 0)).cast("long").alias("leaf"), F.when(~is_root, F.coalesce("above", F.lit(root["owner"]))).alias("above"),
    )
    facts = checkpointed(facts)
    top = convs.select("conv", "len", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("before"), F.lit(root["owner"]).cast("long").alias("owner"))
    members = owned.select(*top.columns).unionByName(top)
    mine = lambda value: F.max(F.when(own_row, value))
    extra = F.sum(F.when(own_row, F.col("total") - F.col("before")).otherwise(F.col("owned_chars")))
    figures = members.join(facts, "conv").groupBy("owner", "depth").agg(
        F.when(F.col("depth") > 0, mine(F.when(F.col("depth") > F.col("start"), F.col("conv")).otherwise(F.col("above")))).alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        (F.count_if(F.col("start") == F.col("depth") + 1) + F.count_if(own_row & (F.col("len") > F.col("depth")))).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        (F.sum(F.col("total") - F.col("before")) - extra).alias("saved_tokens"),
    )
    ends = _ends(members.where(F.col("depth") == F.col("len")).select("owner", "depth", "conv"))
    empty = hashlib.sha256(b"").hexdigest()
    return figures.join(ends, ["owner", "depth"], "left").select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def _ends(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) of (owner, depth, conv): the hash of a node's ids, ascending, comma-joined."""
    chunk = F.floor(F.col("conv") / CHUNK).alias("chunk")
    texts = ends.groupBy("owner", "depth", chunk).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    dealt = texts.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "chunk").select("owner", "depth", "ids")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple[int, int, str]] = []
            for owner, depth, ids in zip(*(batch[c].to_pylist() for c in ("owner", "depth", "ids")), strict=True):
                if node == (owner, depth):
                    digest.update(b",")
                else:
                    if node:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (owner, depth), hashlib.sha256()
                digest.update(ids.encode())
            yield _hash_rows(done)
        if node:
            yield _hash_rows([(*node, digest.hexdigest())])

    return dealt.mapInArrow(hashed, "owner long, depth long, ends_sha256 string")


def _hash_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    owner, depth, text = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(depth, pa.int64()), pa.array(text, pa.string())], names=["owner", "depth", "ends_sha256"])
