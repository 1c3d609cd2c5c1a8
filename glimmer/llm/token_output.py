"""Token ids as fixed-width bit-packed files.

Format. An image holds consecutive documents in ascending order of id: a header, the documents' ids and first
positions, the byte offset of each block, then the blocks. A block is BLOCK ids of `bits` bits each, the fewest that
the vocabulary needs, most significant bit first, padded to whole bytes. So the ids of any block, and by its first
position those of any document, are unpacked by numpy without reading what comes before.

A Spark file holds images as rows (part, first, n_docs, n_tokens, image), uncompressed: Spark's own writer and commit
protocol make the output whole when a task or an executor is lost, on any file system Spark can write.

Scale. One shuffle deals the texts out by ranges of their ids and sorts each range; a task encodes its range as it
goes and closes an image every IMAGE ids, so it holds one image and one batch, whatever the range's size. An image
says where it begins within its range; a range's first position in the corpus is the sum of the ranges before it, a
table with a row per shuffle partition, which is all that reading broadcasts.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmer.llm.exchange import shuffle_partitions
from glimmer.llm.text_kernels import portions
from glimmer.llm.vocabulary import encoder

MAGIC = b"BITS\x01"
_HEADER = struct.Struct("<5sBIQQ")  # magic, bits, ids a block, documents, ids
BLOCK = 4096

#: Ids after which an image is closed; a document lies in one image.
IMAGE = 1 << 20
#: Bytes of a row group: what a reader holds of a file at a time.
ROW_GROUP = 1 << 24
_NULL = np.iinfo(np.int64).min

IMAGES = "part int, first long, n_docs long, n_tokens long, image binary"
_IMAGES = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("image", pa.binary())])
DOCS = "id long, start long, n_tokens long, ids binary"
_DOCS = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Each id in `bits` bits, most significant first."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    wide = np.ascontiguousarray(ids.astype(">u4")).view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1)[:, 32 - bits :]).tobytes()


def unpack_bits(raw: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first n ids of a block."""
    if bits in (8, 16, 32):
        return raw[: n * bits // 8].view(f">u{bits // 8}").astype(np.uint32)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = np.unpackbits(raw, count=n * bits).reshape(n, bits)
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


def build_shard(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """The image of documents whose ids follow each other in `ids`."""
    starts = np.concatenate(([0], np.cumsum(counts))).astype("<i8")
    blocks = [pack_bits(ids[k : k + BLOCK], bits) for k in range(0, len(ids), BLOCK)]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype("<u8")
    return b"".join([_HEADER.pack(MAGIC, bits, BLOCK, len(doc_ids), len(ids)), doc_ids.astype("<i8").tobytes(), starts.tobytes(), offsets.tobytes(), *blocks])


class ShardReader:
    """Random access to a shard image."""

    def __init__(self, image: bytes | memoryview):
        self.raw = np.frombuffer(image, np.uint8)
        magic, self.bits, self.block, docs, self.n_tokens = _HEADER.unpack(self.raw[: _HEADER.size].tobytes())
        if magic != MAGIC:
            raise ValueError("not a bit-packed shard")
        at = _HEADER.size
        take = lambda n, kind: self.raw[at : at + 8 * n].copy().view(kind)
        self.doc_ids = take(docs, "<i8")
        at += 8 * docs
        self.starts = take(docs + 1, "<i8")
        at += 8 * (docs + 1)
        n_blocks = -(-self.n_tokens // self.block)
        self.offsets = take(n_blocks + 1, "<u8").astype(np.int64)
        self.data = at + 8 * (n_blocks + 1)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1; only their blocks are unpacked."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        out = []
        for k in range(first, last + 1):
            n = min(self.block, self.n_tokens - k * self.block)
            out.append(unpack_bits(self.raw[self.data + self.offsets[k] : self.data + self.offsets[k + 1]], self.bits, n))
        return np.concatenate(out)[start - first * self.block : stop - first * self.block]

    def document(self, index: int) -> np.ndarray:
        return self.read(int(self.starts[index]), int(self.starts[index + 1]))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, vocabulary: int | None = None, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, image_ids: int = IMAGE) -> None:
    """Encodes every text, appends end_id, and writes the images, in ascending order of id, to `path`.

    A null text is empty (its end id alone); a null id comes last and is stored as the least long. Rows that repeat an
    id are kept one by one, in the order of a hash of their texts, then of the texts, so that an id (or null) of many
    rows is dealt out as well; only rows with one id and one text share a task, which holds an image of them at a time.
    Very long texts make an image of their own. An empty table writes no image; other columns play no part.
    vocabulary: the number of ids, the end id included, as the tokenizer has it unless given; it sets the bits.
    parts: ranges of ids, one per shuffle partition unless given.
    """
    bits = max(1, (max(vocabulary or encoder(tokenizer_path).size, end_id + 1) - 1).bit_length())
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, first = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal first
            ids, sizes = np.concatenate(held), np.concatenate(counts)
            image = build_shard(np.concatenate(keys), sizes, ids, bits)
            for parts_of in (keys, counts, held):
                parts_of.clear()
            arrays = [[part], [first], [len(sizes)], [len(ids)], [image]]
            first += len(ids)
            return pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, _IMAGES, strict=True)], schema=_IMAGES)

        for batch in (b[p] for b in batches for p in portions(b["text"])):
            ids, offsets = coder.encode_batch(batch["text"], end_id)
            names = batch["id"].fill_null(_NULL).to_numpy()
            at = 0
            while at < len(names):  # as many documents as the image still takes, one at least
                room = image_ids - sum(map(len, held))
                stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + room, side="right")) - 1)
                keys.append(names[at:stop])
                counts.append(np.diff(offsets[at : stop + 1]))
                held.append(ids[offsets[at] : offsets[stop]])
                at = stop
                if sum(map(len, held)) >= image_ids or at < len(names):
                    yield close()
        if held:
            yield close()

    ranges = slim.repartitionByRange(parts or shuffle_partitions(docs.sparkSession), *order[:2]).sortWithinPartitions(*order)
    ranges.mapInArrow(build, IMAGES).write.mode("overwrite").option("compression", "none").option("parquet.block.size", ROW_GROUP).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: id, start (ids of all documents before it), n_tokens, ids (little-endian 32-bit)."""
    files = spark.read.schema(IMAGES).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row per range, at most as many as the writer's partitions
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = F.broadcast(totals.select("part", F.coalesce(before, F.lit(0)).alias("base")))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, image in zip(batch["first"].to_pylist(), batch["image"], strict=True):
                shard = ShardReader(image.as_buffer())
                if 4 * shard.n_tokens > np.iinfo(np.int32).max:
                    raise OverflowError(f"an image of {shard.n_tokens} ids does not fit one Arrow column")
                ids = shard.read(0, shard.n_tokens).astype("<u4")
                payload = pa.Array.from_buffers(pa.binary(), len(shard.doc_ids), [None, pa.py_buffer((shard.starts * 4).astype(np.int32)), pa.py_buffer(ids)])
                keys = pa.array(shard.doc_ids, mask=shard.doc_ids == _NULL)
                yield pa.RecordBatch.from_arrays([keys, pa.array(shard.starts[:-1] + first), pa.array(np.diff(shard.starts)), payload], schema=_DOCS)

    return files.join(base, "part").select((F.col("base") + F.col("first")).alias("first"), "image").mapInArrow(decode, DOCS)
