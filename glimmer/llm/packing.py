"""Cost-balanced packing of token ids into sequences.

Method. A piece of n ids costs linear * n + quadratic * n**2 (attention within the piece). Documents longer than
a sequence give full sequences first; what is left of them, and all shorter documents, are assigned in descending
order of cost, each to the lowest-cost sequence of all that have room for it. Where none has, the document is cut:
the lowest-cost sequence with any room takes what fits, and the rest is assigned as before. So that sequences end up full: those of a group have `capacity` ids each but for the
last ids of the group, which fill sequences of descending powers of two. So there is no padding at all.

Scale. A group is what one task reads, up to `group_ids` ids; groups are independent, so packing needs no
shuffle and a lost task is simply run again. Every id of a group is in memory once, at two or four bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.text_kernels import portions
from glimmer.llm.vocabulary import encoder

PIECES = "id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_PIECES = pa.schema([(n, pa.int64()) for n in ("id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> np.ndarray:
    """One row (document, start, length, sequence, offset) per piece; every id lies in exactly one piece."""
    pieces, rest = [], []
    sequence = 0
    for doc, n in enumerate(lengths):
        full = n // capacity
        for k in range(full):
            pieces.append((doc, k * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((n % capacity, doc, full * capacity))
    total = sum(n for n, _, _ in rest)
    size = np.array([capacity] * (total // capacity) + [1 << k for k in range(capacity.bit_length(), -1, -1) if total % capacity >> k & 1], np.int64)
    room, cost = size.copy(), np.zeros(len(size))
    rest.sort(key=lambda x: (-x[0], x[1]))
    for n, doc, start in rest:
        while n:
            k = int(np.where(room >= n, cost, np.inf).argmin())
            if room[k] < n:  # no sequence has room for all of it: the cheapest that has any takes what it can
                k = int(np.where(room > 0, cost, np.inf).argmin())
            take = min(n, int(room[k]))
            pieces.append((doc, start, take, sequence + k, int(size[k] - room[k])))
            room[k] -= take
            cost[k] += linear * take + quadratic * take * take
            n, start = n - take, start + take
    return np.array(pieces, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, linear: float = 1.0, quadratic: float = 1 / 2048, group_ids: int = 1 << 22) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, ids (little-endian 32-bit).

    A null text is empty and gives one piece, its end id; a null id stays null; repeated rows are packed once
    each; a text of any length is cut into as many sequences as it needs. An empty table gives no rows; other columns
    play no part. sequence_id is the task's partition in its high 32 bits and the sequence's number within it in the
    low ones; it isn't dense.
    """

    def packed(keys: list[pa.Array], ids: np.ndarray, counts: np.ndarray, first: int) -> pa.RecordBatch:
        pieces = assign(counts.tolist(), capacity, linear, quadratic)
        doc, start, length, sequence, offset = pieces[np.lexsort((pieces[:, 4], pieces[:, 3]))].T
        begin = (np.cumsum(counts) - counts)[doc] + start
        ends = np.cumsum(length)
        if 4 * ends[-1] > np.iinfo(np.int32).max:
            raise OverflowError(f"a group of {ends[-1]} ids does not fit one Arrow column")
        raw = ids[np.repeat(begin - (ends - length), length) + np.arange(ends[-1])].astype("<u4")
        payload = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(np.concatenate(([0], ends * 4)).astype(np.int32)), pa.py_buffer(raw)])
        base = (TaskContext.get().partitionId() << 32) + first
        columns = [pa.concat_arrays(keys).take(pa.array(doc)), *(pa.array(c) for c in (start, length, counts[doc], sequence + base, offset)), payload]
        return pa.RecordBatch.from_arrays(columns, schema=_PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, first = encoder(tokenizer_path), 0
        keys, ids, counts = [], [], []
        for batch in (b[p] for b in batches for p in portions(b["text"])):
            some, offsets = coder.encode_batch(batch["text"], end_id)
            keys.append(batch["id"])
            ids.append(some)
            counts.append(np.diff(offsets))
            if sum(map(len, ids)) >= group_ids:
                out = packed(keys, np.concatenate(ids), np.concatenate(counts), first)
                first += len(out["sequence_id"].unique())
                yield out
                keys, ids, counts = [], [], []
        if keys:
            yield packed(keys, np.concatenate(ids), np.concatenate(counts), first)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)
