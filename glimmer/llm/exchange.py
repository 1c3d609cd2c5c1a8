"""Shared Spark plumbing: checkpoints, range buckets, and the packed exchange of fingerprints.

The packed exchange answers "which of my fingerprints occur elsewhere?" for texts that are dealt out to
source buckets by ranges of their id:

1. Each source bucket sends its distinct fingerprints once, sorted, as one binary block per target
   (split_blocks), so a fingerprint that a third of all rows hold reaches its target at most once per
   source bucket, never once per row.
2. Each target compares what it got and returns one bit per fingerprint (flag_shared).
3. The source bucket lines the bits up with its own sorted fingerprints (bits_of).

A block costs 8 bytes a fingerprint and the answer one bit, whatever the texts are. All three are ordinary
shuffles in one plan, so a lost executor's part is recomputed by Spark.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glimmer.llm.text_kernels import as_offsets, column_bytes

BLOCKS = "src int, dst int, payload binary"
BITS = "src int, kind int, dst int, n int, bits binary"
_BLOCKS_ARROW = pa.schema([("src", pa.int32()), ("dst", pa.int32()), ("payload", pa.binary())])
_BITS_ARROW = pa.schema([("src", pa.int32()), ("kind", pa.int32()), ("dst", pa.int32()), ("n", pa.int32()), ("bits", pa.binary())])


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is set, a local session gets one of its own, as in tests."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for tables that are read again; it goes when the driver's JVM ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder (shared by all executors), its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bucket(df: DataFrame, column: str, tie: str, buckets: int) -> Column:
    """0, 1, ..., ascending with the column's value, nulls in the last ones.

    A value that fills several buckets, or null, is dealt out over them by a hash of `tie`; only rows that agree in both
    have to share a bucket. The bounds are approximate quantiles of that one column, found by a map-side combined
    aggregate: `buckets` longs. A row finds its range by bisection, on the JVM.
    """
    steps = [k / buckets for k in range(1, buckets)]
    found = df.agg(F.count("*").alias("n"), F.count(column).alias("known"), F.percentile_approx(column, steps or [0.5], 20 * buckets).alias("q")).first()
    bounds = sorted(found["q"] or []) if steps else []
    empty = -(-buckets * (found["n"] - found["known"]) // max(1, found["n"]))  # buckets of nulls
    value, mark = F.col(column), F.xxhash64(tie, F.lit(1))
    if not bounds:
        place = F.lit(0)
    else:
        array = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
        jumps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])

        def before(inclusive: bool) -> Column:
            def step(low: Column, jump: Column) -> Column:
                bound = F.try_element_at(array, low + jump)
                return F.when((low + jump <= len(bounds)) & (bound <= value if inclusive else bound < value), low + jump).otherwise(low)

            return F.aggregate(jumps, F.lit(0), step)

        place = before(True)
        if len(set(bounds)) < len(bounds):
            place = place - F.pmod(mark, F.greatest(place - before(False), F.lit(1))).cast("int")
    return F.when(value.isNull(), F.lit(len(bounds) + 1) + F.pmod(mark, F.lit(max(1, empty))).cast("int")).otherwise(place).cast("int")


def bucketed(docs: DataFrame, id_col: str, text_col: str, buckets: int, most_bytes: int) -> DataFrame:
    """(bucket, id, text) only; other columns don't travel. At least `buckets` ranges of ids, of about `most_bytes` of text each at most."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = slim.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    return slim.select(range_bucket(slim, "id", "text", max(buckets, -(-size // most_bytes))).alias("bucket"), "id", "text")


def in_order(table: pa.Table) -> pa.Table:
    """By id, null last; rows that repeat an id by text."""
    table = table.combine_chunks()
    order = pc.sort_indices(table["id"], null_placement="at_end")
    ids = table["id"].take(order)
    if len(ids) > 1 and (ids.null_count > 1 or pc.count_distinct(ids, mode="only_valid").as_py() < len(ids) - ids.null_count):
        order = pc.sort_indices(table.select(["id", "text"]), sort_keys=[("id", "ascending"), ("text", "ascending")], null_placement="at_end")
    return table.take(order)


def target_edges(hashes: np.ndarray, targets: int) -> np.ndarray:
    """Where each target's part of sorted hashes begins; target t has the hashes from t * 2**64 / targets on."""
    lows = np.array([(t << 64) // targets for t in range(1, targets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(hashes, lows), [len(hashes)]))


def split_blocks(src: int, hashes: np.ndarray, targets: int) -> pa.Table:
    """One row per target with any of these sorted, distinct hashes."""
    edges = target_edges(hashes, targets)
    some = np.flatnonzero(np.diff(edges))
    raw = np.ascontiguousarray(hashes).view(np.uint8)
    offsets = np.concatenate((edges[some], [len(hashes)])) * 8
    payload = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(as_offsets(offsets)), pa.py_buffer(raw)])
    return pa.Table.from_arrays([pa.array(np.full(len(some), src, np.int32)), pa.array(some.astype(np.int32)), payload], schema=_BLOCKS_ARROW)


def block_hashes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(all hashes of a table of blocks, hashes per block); the blocks' order is kept."""
    raw, offsets = column_bytes(table["payload"])
    return raw.view(np.uint64), np.diff(offsets) // 8


def answer(table: pa.Table, flags: list[np.ndarray], kind: int) -> pa.Table:
    """The answer to a table of blocks: flags for each of them, as bits."""
    sizes, bits = [len(f) for f in flags], [np.packbits(f).tobytes() for f in flags]
    columns = [table["src"], pa.array(np.full(len(bits), kind, np.int32)), table["dst"], pa.array(sizes, pa.int32()), pa.array(bits, pa.binary())]
    return pa.Table.from_arrays(columns, schema=_BITS_ARROW)


def flag_rows(table: pa.Table, flags: np.ndarray, sizes: np.ndarray, kind: int) -> pa.Table:
    """answer() from all blocks' flags in a row."""
    edges = np.concatenate(([0], np.cumsum(sizes))).tolist()
    return answer(table, [flags[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], kind)


def occurs_elsewhere(hashes: np.ndarray, earlier: bool = False) -> np.ndarray:
    """Which entries have an equal one (earlier: one before them)."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    flags = np.zeros(len(hashes), bool)
    flags[order[1:][same]] = True
    if not earlier:
        flags[order[:-1][same]] = True
    return flags


def flag_shared(blocks: DataFrame, kind: int, earlier: bool) -> DataFrame:
    """One bit per fingerprint of each block: another source bucket has it too (earlier: one before this)."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table["src"]))
        hashes, sizes = block_hashes(table)
        return flag_rows(table, occurs_elsewhere(hashes, earlier), sizes, kind)

    return blocks.groupBy("dst").applyInArrow(compare, BITS)


def bits_of(table: pa.Table, kind: int, n: int) -> np.ndarray:
    """The flags that came back for n sorted, distinct fingerprints."""
    part = table.filter(pc.equal(table["kind"], kind))
    part = part.take(pc.sort_indices(part["dst"]))
    flags = [np.unpackbits(np.frombuffer(b, np.uint8), count=k) for k, b in zip(part["n"].to_pylist(), part["bits"].to_pylist(), strict=True)]
    out = np.concatenate(flags).astype(bool) if flags else np.zeros(0, bool)
    if len(out) != n:
        raise ValueError(f"{len(out)} flags came back for {n} fingerprints")
    return out


def annotate_rows(docs: DataFrame, inputs: list[str], columns: Callable[..., list[pa.Array]], schema: str) -> DataFrame:
    """(row, new columns): each input row whole, as the struct `row`, and what columns(...) gives for these string columns.

    The input's columns keep their names and can't clash with the new ones; no shuffle, order kept.
    """
    places = [docs.columns.index(c) for c in inputs]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = T.StructType.fromDDL(schema)
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            yield pa.RecordBatch.from_arrays([row, *columns(*[row.field(p).cast(pa.string()) for p in places])], names=["row", *names])

    return packed.mapInArrow(run, T.StructType([packed.schema["row"], *out.fields]))
