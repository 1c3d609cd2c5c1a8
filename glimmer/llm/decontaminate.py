"""Benchmark decontamination, by a prefix-filtered containment join of shingles.

A benchmark item's windows are its runs of `window` words (a shorter item is one window). A document word inside
an occurrence of a window is hit.

Method. A window is a set of word shingles that must all be present (containment 1), so one of them is a
sufficient prefix, and the rarest makes the fewest candidates. A first pass over all documents counts the
benchmark's shingles; windows with a shingle that occurs nowhere are done. A second pass finds the places of the
prefixes that are left; these places, each with the words around it, are joined to the windows of their prefix.
The window's offset of its prefix says where it would start, starts outside the document are dropped (length and
positional bounds), and the window is compared with the words there, all of them.

Scale. Windows, their shingles, counts and prefixes are tables; none of them passes through the driver. Both passes
over the documents, whatever the size of the benchmark, send only what a table of bits lets through (BITS at most, with
shingles that are none of the benchmark's now and then, which the joins drop), counts summed per batch. A document goes
by two 64-bit hashes of its text, so that copies are worked through once in the joins; texts don't travel. Joins are
on shingles, windows and documents, inner ones whose hot keys Spark splits. Words are compared by 64-bit hashes, all of
a window's words at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.llm.exchange import checkpointed
from glimmer.llm.text_kernels import ALNUM_SPLIT, LOWER, Words, column_bytes, gram_hashes, portions, split_words

SHINGLE = 3
#: Logarithms of the fewest and most bits of a table that shingles are looked up in (half a MB, 16 MB), and bits per shingle.
BITS, BITS_EACH = (22, 27), 32
#: The table travels as so many pieces.
PIECES = 64


def read_words(texts: pa.Array | pa.ChunkedArray) -> Words:
    """Words of lower-cased texts: runs of digits, letters a-z and anything beyond ASCII."""
    raw, offsets = column_bytes(texts)
    return split_words(LOWER[raw], offsets, ALNUM_SPLIT)


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, window): each item's distinct windows, as their words' hashes, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b[p] for b in batches for p in portions(b["text"])):
            words = read_words(batch["text"])
            hashes = words.hashes()
            which, runs = [], []
            for d, (a, b) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)):
                if b > a:
                    own = np.lib.stride_tricks.sliding_window_view(hashes[a:b], min(window, b - a))
                    which += [d] * len(own)
                    runs += [row.tobytes() for row in own]
            yield pa.RecordBatch.from_arrays([batch["item"].take(pa.array(which, pa.int64())), pa.array(runs, pa.binary())], names=["item", "window"])

    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where(F.col("item").isNotNull())
    return items.mapInArrow(run, "item string, window binary").distinct()


def window_shingles(windows: DataFrame) -> DataFrame:
    """(window, size, offset, shingle) of windows (window): the hashes of all shingles of each, SHINGLE words long or as long as the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = column_bytes(batch["window"])
            hashes, sizes = raw.view(np.uint64), np.diff(offsets) // 8
            for size in np.unique(sizes).tolist():
                some = np.flatnonzero(sizes == size)
                k = min(SHINGLE, size)
                rows = hashes[(offsets[some] // 8)[:, None] + np.arange(size)]
                grams = np.stack([gram_hashes(np.ascontiguousarray(row), k) for row in rows])
                which = pa.array(np.repeat(some, grams.shape[1]))
                yield pa.RecordBatch.from_arrays([batch["window"].take(which), pa.array(np.full(grams.size, k, np.int32)), pa.array(np.tile(np.arange(grams.shape[1], dtype=np.int32), len(some))), pa.array(grams.ravel().view(np.int64))], names=["window", "words", "offset", "shingle"])

    return windows.mapInArrow(run, "window binary, words int, offset int, shingle long")


class BitTable:
    """Which hashes may be among given ones: all of them, and few others."""

    def __init__(self, shingles: DataFrame):
        """shingles: one column of distinct hashes, which are spread evenly."""
        column = F.col(shingles.columns[0])
        power = max(BITS[0], min(BITS[1], (BITS_EACH * shingles.count()).bit_length()))
        self.shift = 64 - power
        size = (1 << power) // 8 // PIECES

        def filled(table: pa.Table) -> pa.Table:
            bits = np.zeros(8 * size, bool)
            bits[table["bit"].to_numpy()] = True
            return pa.table({"piece": table["piece"].slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

        slot = F.shiftrightunsigned(column, self.shift)
        placed = shingles.select((slot / (8 * size)).cast("int").alias("piece"), (slot % (8 * size)).cast("int").alias("bit")).distinct()
        pieces = placed.groupBy("piece").applyInArrow(filled, "piece int, bits binary").toArrow()  # 16 MB at most
        raw = np.zeros((PIECES, size), np.uint8)
        for piece, bits in zip(pieces["piece"].to_pylist(), pieces["bits"].to_pylist(), strict=True):
            raw[piece] = np.frombuffer(bits, np.uint8)
        self.packed = raw.tobytes()

    def opened(self) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.packed, np.uint8)).view(bool)


def _let_through(words: Words, tables: dict[int, np.ndarray], shifts: dict[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words of a shingle, places, hashes) of the shingles that the tables let through, none across a document's end."""
    hashes, room = words.hashes(), words.room()
    for k, table in tables.items():
        grams = gram_hashes(hashes, k)
        at = np.flatnonzero(table[grams >> np.uint64(shifts[k])])
        at = at[room[at] >= k]
        yield k, at, grams[at]


def _tables(shingles: DataFrame) -> dict[int, BitTable]:
    """By the number of words of a shingle. shingles: (words, shingle), distinct."""
    return {k: BitTable(shingles.where(F.col("words") == k).select("shingle")) for (k,) in sorted(shingles.select("words").distinct().collect())}


def _counted(texts: DataFrame, shingles: DataFrame) -> DataFrame:
    """(words, shingle, n): how often each of these shingles occurs in the documents, if it does."""
    tables = _tables(shingles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, shifts = {k: t.opened() for k, t in tables.items()}, {k: t.shift for k, t in tables.items()}
        for batch in (b[p] for b in batches for p in portions(b["text"])):
            for k, _, grams in _let_through(read_words(batch["text"]), opened, shifts):
                names, times = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), k, np.int32)), pa.array(names.view(np.int64)), pa.array(times)], names=["words", "shingle", "n"])

    found = texts.select("text").mapInArrow(run, "words int, shingle long, n long").groupBy("words", "shingle").agg(F.sum("n").alias("n"))
    return found.join(shingles, ["words", "shingle"])


_SEEN = "id long, k1 long, k2 long, n_words long, words int, shingle long, place int, before int, context binary"


def _places(texts: DataFrame, prefixes: DataFrame, window: int) -> DataFrame:
    """A row (id, k1, k2, n_words) per document, and one (k1, k2, words, shingle, place, before, context) per place of a prefix.

    context: the hashes of the words around the place, `before` of them ahead of it.
    """
    tables = _tables(prefixes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, shifts = {k: t.opened() for k, t in tables.items()}, {k: t.shift for k, t in tables.items()}
        schema = pa.schema([("id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n_words", pa.int64()), ("words", pa.int32()), ("shingle", pa.int64()), ("place", pa.int32()), ("before", pa.int32()), ("context", pa.binary())])
        for batch in (b[p] for b in batches for p in portions(b["text"])):
            words = read_words(batch["text"])
            none = [pa.nulls(len(words.counts), f.type) for f in schema][4:]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["k1"], batch["k2"], pa.array(words.counts, pa.int64()), *none], schema=schema)
            hashes, position = words.hashes(), words.position()
            for k, at, grams in _let_through(words, opened, shifts):
                if not len(at):
                    continue
                doc = np.searchsorted(words.bounds, at, side="right") - 1
                low, high = np.maximum(words.bounds[doc], at - window + 1), np.minimum(words.bounds[doc + 1], at + window)
                ends = np.cumsum(high - low)
                around = hashes[np.repeat(low - (ends - (high - low)), high - low) + np.arange(ends[-1])]
                context = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.concatenate(([0], 8 * ends)).astype(np.int32)), pa.py_buffer(around)])
                which = pa.array(doc)
                rows = [pa.nulls(len(at), pa.int64()), batch["k1"].take(which), batch["k2"].take(which), pa.nulls(len(at), pa.int64()), pa.array(np.full(len(at), k, np.int32)), pa.array(grams.view(np.int64)), pa.array(position[at].astype(np.int32)), pa.array((at - low).astype(np.int32)), context]
                yield pa.RecordBatch.from_arrays(rows, schema=schema)

    return texts.select("id", "k1", "k2", "text").mapInArrow(run, _SEEN)


def text_keys(text: Column) -> list[Column]:
    """Two hashes that a text goes by."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _found(docs: DataFrame, id_col: str | None, text_col: str, benchmark: DataFrame, item_col: str, item_text_col: str, window: int) -> DataFrame:
    """(id, k1, k2, n_words, n_hit, items): a row per row of docs."""
    text = docs[f"`{text_col}`"].cast("string")
    texts = docs.select((docs[f"`{id_col}`"] if id_col else F.lit(None)).cast("long").alias("id"), *text_keys(text), text.alias("text"))
    owned = checkpointed(item_windows(benchmark, item_col, item_text_col, window))
    shingles = checkpointed(window_shingles(owned.select("window").distinct()))
    distinct = checkpointed(shingles.select("words", "shingle").distinct())
    counts = _counted(texts, distinct)
    # of each window, the shingle that is rarest in the documents; none where one occurs nowhere
    least = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "words", "shingle")).alias("p")
    prefixes = checkpointed(shingles.join(counts, ["words", "shingle"], "left").groupBy("window").agg(least).where(F.col("p.n") > 0).select("window", "p.offset", "p.words", "p.shingle"))
    seen = checkpointed(_places(texts, prefixes.select("words", "shingle").distinct(), window))
    places = seen.where(F.col("shingle").isNotNull()).select("k1", "k2", "words", "shingle", "place", "before", "context").dropDuplicates(["k1", "k2", "words", "place"])
    size = F.octet_length("window")
    start = F.col("before") - F.col("offset")
    same = (start >= 0) & (F.expr("substring(context, 8 * (before - offset) + 1, octet_length(window))") == F.col("window"))
    matches = checkpointed(places.join(prefixes, ["words", "shingle"]).where(same).select("k1", "k2", (F.col("place") - F.col("offset")).alias("start"), (size / 8).cast("int").alias("size"), "window"))
    # words that spans cover, and items, by text; a text's spans are as many as its words
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("stop"))))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], acc["reach"]))).cast("long").alias("n"), F.greatest(acc["reach"], s["stop"]).alias("reach")
    )
    hits = matches.groupBy("k1", "k2").agg(F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach")), step)["n"].alias("n_hit"))
    items = matches.select("k1", "k2", "window").distinct().join(owned, "window").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = seen.where(F.col("n_words").isNotNull()).select("id", "k1", "k2", "n_words")
    by_text = checkpointed(hits.join(items, ["k1", "k2"]))
    out = rows.join(by_text, ["k1", "k2"], "left")
    return out.select("id", "k1", "k2", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13) -> DataFrame:
    """One row per document row: id, n_words, n_hit, items (sorted ids, as strings, of items with an occurring window).

    A null or empty text has no words and no hits; an item without words or without an id has no windows; an item
    that occurs twice counts once. Rows may repeat, ids may be null; texts are read whole, however long. Empty tables
    give no rows, or no hits; other columns, whatever their names, play no part. Words are equal if their 64-bit hashes
    are: a window is taken for another one only if all its words' hashes coincide.
    """
    return _found(docs, id_col, text_col, benchmark, item_col, item_text_col, window).select("id", "n_words", "n_hit", "items")


def is_contaminated(percent: int = 5) -> Column:
    """Some word is hit, and at least this percentage of them."""
    return (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))


def without_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13) -> DataFrame:
    """The rows of docs, with their own columns, that are not contaminated; nulls and the like as in find_contamination()."""
    found = _found(docs, None, text_col, benchmark, item_col, item_text_col, window)
    gone = checkpointed(found.where(is_contaminated()).select("k1", "k2").distinct())
    k1, k2 = text_keys(docs[f"`{text_col}`"].cast("string"))
    return docs.join(gone, (k1 == gone["k1"]) & (k2 == gone["k2"]), "left_anti")
