"""Substring dedup over words, by difference-cover anchors.

A repeat is a run of `window` equal words that also starts earlier in the corpus (a smaller id, or earlier in
the same text). Every word that such a run covers is removed; runs are judged on the input.

Method. Anchors are short word windows that start at positions whose index modulo PERIOD lies in COVER. COVER
is a difference cover: each difference modulo PERIOD is a difference of two members, so two equal runs, however
they are aligned, have an anchor at the same offset below PERIOD in both. Anchors are ANCHOR = window - PERIOD + 1
words long, so that this one lies inside the run. Hence a run that repeats contains an anchor that repeats, and
only anchors (4 of 13 positions) are compared across the corpus. Then anchors extend: the full windows around a
shared anchor, and no others, are compared by the same packed exchange, which also tells which came first.

Scale. Texts cross the network once (one exchange that three consumers reuse); anchors and candidate windows
cost eight bytes per distinct one and source bucket. Nothing is collected; no pairs are made, so a passage that
a third of all rows hold costs as much per row as any other. Windows are compared by 64-bit hashes: among n
candidate windows some n**2 / 2**65 coincide by chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glimmer.llm.exchange import BLOCKS, bits_of, bucketed, flag_shared, in_order, shuffle_partitions, split_blocks
from glimmer.llm.text_kernels import SPACE_SPLIT, Words, column_bytes, covered, gram_hashes, keep_words, split_words, to_column

#: Difference covers (perfect difference sets where they exist) by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}

#: Text of a source bucket, about: a task holds some ten times as much.
BUCKET_BYTES = 1 << 25

RESULT = "id long, n_words long, n_removed long, kept_text string"
_RESULT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
ANCHORS, WINDOWS = 0, 1


class _Bucket:
    """The words, anchors and candidate windows of one source bucket, in corpus order."""

    def __init__(self, table: pa.Table, window: int, period: int):
        self.ids = in_order(table)
        raw, offsets = column_bytes(self.ids["text"])
        self.words: Words = split_words(raw, offsets, SPACE_SPLIT)
        self.window, self.period, self.size = window, period, window - period + 1
        self.hashes = self.words.hashes()
        room = self.words.room()
        grams = gram_hashes(self.hashes, self.size)
        cover = np.isin(np.arange(period), COVERS[period])
        fits = cover[self.words.position() % period] & (room >= self.size) if len(room) else np.zeros(0, bool)
        self.places = np.flatnonzero(fits)
        self.fits_window = room >= window
        self.anchors, self.which, times = np.unique(grams[self.places], return_inverse=True, return_counts=True)
        self.repeated = times > 1

    def candidates(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(window starts, distinct window hashes, index of each window's hash, first window of each hash)."""
        live = np.zeros(len(self.hashes) + 1, np.int64)
        live[self.places[(shared | self.repeated)[self.which]]] = 1
        before = np.concatenate(([0], np.cumsum(live)))
        at = np.flatnonzero(self.fits_window)
        at = at[before[at + self.period] > before[at]]
        distinct, first, which = np.unique(gram_hashes(self.hashes, self.window)[at], return_index=True, return_inverse=True)
        return at, distinct, which, first


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, buckets: int | None = None) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_text (words joined by one space).

    Nulls: a null text has no words and is kept empty; a null id comes after all other ids. Rows that repeat an
    id keep their own row each, in an order that depends on their texts alone. Texts shorter than a window are kept
    whole; a text is never cut. An empty table gives no rows; other columns, whatever their names, play no part.
    buckets: the least number of source buckets, two per shuffle partition unless given; large inputs have more.
    """
    spark = docs.sparkSession
    period = max(p for p in COVERS if p <= max(1, window * 2 // 3))
    partitions = shuffle_partitions(spark)
    targets = partitions // 2 + 1
    texts = bucketed(docs, id_col, text_col, buckets or 2 * partitions, BUCKET_BYTES)

    def anchors(table: pa.Table) -> pa.Table:
        return split_blocks(table["bucket"][0].as_py(), _Bucket(table, window, period).anchors, targets)

    def windows(table: pa.Table, bits: pa.Table) -> pa.Table:
        bucket = _Bucket(table, window, period)
        _, distinct, _, _ = bucket.candidates(bits_of(bits, ANCHORS, len(bucket.anchors)))
        return split_blocks(table["bucket"][0].as_py(), distinct, targets)

    def results(table: pa.Table, bits: pa.Table) -> pa.Table:
        bucket = _Bucket(table, window, period)
        at, distinct, which, first = bucket.candidates(bits_of(bits, ANCHORS, len(bucket.anchors)))
        again = np.ones(len(at), bool)
        again[first] = False
        again |= bits_of(bits, WINDOWS, len(distinct))[which]
        removed = covered(at[again], window, len(bucket.hashes))
        raw, offsets = keep_words(bucket.words, ~removed)
        lost = np.concatenate(([0], np.cumsum(removed)))[bucket.words.bounds]
        return pa.Table.from_arrays([bucket.ids["id"].combine_chunks(), pa.array(bucket.words.counts, pa.int64()), pa.array(np.diff(lost), pa.int64()), to_column(raw, offsets, pa.string())], schema=_RESULT)

    by_bucket = texts.groupBy("bucket")
    shared = flag_shared(by_bucket.applyInArrow(anchors, BLOCKS), ANCHORS, earlier=False).repartition("src")  # read twice
    earlier = flag_shared(by_bucket.cogroup(shared.groupBy("src")).applyInArrow(windows, BLOCKS), WINDOWS, earlier=True)
    return by_bucket.cogroup(shared.unionByName(earlier).groupBy("src")).applyInArrow(results, RESULT)
