"""Spelling variants of words, by an index of variable-length grams.

Words of a vocabulary are near if one inserted, deleted or replaced letter turns one into the other. A word's form is
its near word of the largest count, where that is `ratio` times the word's own at least; forms followed to the end
give its root.

Method.
1. Gram dictionary: grams of `shortest_gram` letters are all there. One that occurs in many words (over `long_list`
   of the vocabulary) is extended by a letter, and so on up to `longest_gram`; of its extensions those with the fewest
   occurrences are pruned, as many as together stay below that limit, and stay with the shorter gram.
2. Decomposition: at each letter the longest gram of the dictionary that begins there, without those that lie within
   an earlier one.
3. Affected grams: whether a gram is in the decomposition depends on the letters read to find it: those looked at
   below it in the dictionary, and those of earlier places whose grams could cover it. An edit outside of these leaves
   it alone. So for each word and each place of an edit it is known how many grams are affected at most, and which ones
   are not: these a near word has as well, at the same distance from the start (left of the edit) or the end (right of
   it). With words of 2 * longest_gram letters or more, the first or the last gram is always one of them.
4. List merging: a near word is on the lists of all grams that the edit leaves alone. These lists are merged by
   one key for word and place (a hash of those grams with their distances), so that no list of a frequent gram is ever
   gone through: what comes together agrees in all but the few letters around the edit.
5. Verification: of what came together, words that are the same without the letter at the place are near. Within such a
   group words differ in that one letter, so counts and the largest member, with ties, are told without making pairs.

Scale. Texts are read once, where they lie; what is shuffled are words with counts. The dictionary has at most
letters ** longest_gram entries (90 ** 3) and is broadcast. Keys are dealt out over as many targets as their bytes ask for.
Equal keys are words that agree in all but some three letters, so a group's size doesn't follow the corpus. Keys, masks
and words are compared by 64-bit hashes: a wrong group needs two that coincide at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.llm.exchange import checkpointed, shuffle_partitions
from glimmer.llm.text_kernels import as_offsets, column_bytes, mix, offset_portions, split_words

#: Latin-1 code of each UTF-8 byte: A-Z in lower case, the second byte of U+00C0-U+00FF as that letter; 0 where a word ends.
_CODE = np.zeros(256, np.uint8)
_CODE[0x41:0x5B] = np.arange(0x61, 0x7B)
_CODE[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER = np.arange(256) > 0
_GOLD, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = 0xD6E8FEB86659FD93
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)

SUB, DEL, INS = 0, 1, 2
_ROW = np.dtype([("key", "<u8"), ("mask", "<u8"), ("id", "<i8"), ("n", "<i8"), ("place", "<u4"), ("letter", "u1"), ("kind", "u1")])
_FOUND = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("near", pa.int64()), ("best", pa.int64()), ("kind", pa.int32()), ("place", pa.int32()), ("letter", pa.int32())])
FOUND = "id long, n long, near long, best long, kind int, place int, letter int"
#: Bytes of rows after which a task sends what it holds, and about what a target gets.
HELD_BYTES = 1 << 25
#: Letters decomposed at a time.
CELLS = 1 << 18


def crc32_steps() -> np.ndarray:
    """The remainder that each byte adds, from the polynomial of CRC-32."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_STEPS = crc32_steps()


def latin(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one code for each letter, offsets) of UTF-8 texts: Latin-1, A-Z in lower case, 0 for what is no letter of a word."""
    lead = raw == 0xC3
    codes = _CODE[raw]
    codes[1:][lead[:-1]] = raw[1:][lead[:-1]] + 0x40
    return codes[~lead], offsets - np.concatenate(([0], np.cumsum(lead)))[offsets]


def utf8(codes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The inverse of latin(), for texts of letters alone."""
    wide = codes >= 0x80
    at = np.arange(len(codes)) + np.cumsum(wide)
    raw = np.full(len(codes) + int(wide.sum()), 0xC3, np.uint8)
    raw[at] = np.where(wide, codes - 0x40, codes)
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(as_offsets(offsets + np.concatenate(([0], np.cumsum(wide)))[offsets])), pa.py_buffer(raw)])


def run_hashes(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 of the UTF-8 bytes of runs of codes, each going on from a state (the CRC of what stands before)."""
    crc = (state ^ np.uint32(0xFFFFFFFF)).astype(np.uint32)
    order = np.argsort(-sizes, kind="stable")
    left = np.searchsorted(-sizes[order], -np.arange(1, sizes.max(initial=0) + 1), side="right")  # runs that have a k-th letter
    for k, live in enumerate(left.tolist()):
        some = order[:live]
        letter, now = codes[starts[some] + k].astype(np.uint32), crc[some]
        wide = letter >= 0x80
        now = np.where(wide, _STEPS[(now ^ 0xC3) & 0xFF] ^ (now >> 8), now)
        crc[some] = _STEPS[(now ^ np.where(wide, letter - 0x40, letter)) & 0xFF] ^ (now >> 8)
    return crc ^ np.uint32(0xFFFFFFFF)


def _words_of(ids: pa.Array, texts: pa.Array, shortest: int, every: int) -> pa.StructArray:
    """(values, counts): distinct words of some texts."""
    codes, offsets = latin(*column_bytes(texts))
    words = split_words(codes, offsets, _LETTER)
    sizes = words.ends - words.starts
    long = np.flatnonzero(sizes >= shortest)
    starts, sizes = words.starts[long], sizes[long]
    gone = np.full(len(long), -1)
    if every and len(long):
        known = np.asarray(ids.is_valid())
        state = np.array([zlib.crc32(f"{i}:".encode()) for i in ids.to_pylist()], np.uint32)
        doc = np.searchsorted(words.bounds, long, side="right") - 1
        h = run_hashes(codes, starts, sizes, state[doc]).astype(np.int64)
        gone = np.where((h % every == 0) & known[doc], h % sizes, -1)
    edges = np.concatenate(([0], np.cumsum(sizes)))
    letters = codes[np.arange(edges[-1]) + np.repeat(starts - edges[:-1], sizes)]
    hit = gone >= 0
    stay = np.ones(len(letters), bool)
    stay[edges[:-1][hit] + gone[hit]] = False
    edges = edges - np.concatenate(([0], np.cumsum(hit)))
    enough = np.diff(edges) >= shortest
    column = pa.Array.from_buffers(pa.binary(), len(long), [None, pa.py_buffer(as_offsets(edges)), pa.py_buffer(letters[stay])])
    return column.filter(pa.array(enough)).value_counts()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, every: int = 0) -> DataFrame:
    """(word, n): words of `shortest` letters or more that occur `least` times or more in all texts.

    Words are maximal runs of A-Z, a-z and U+00C0-U+00FF, A-Z in lower case. every > 0 plants slips: where it divides h, the
    CRC-32 of `<id>:<word>`, letter h % length of that word is left out in that document. A null text has no words;
    a text with a null id is taken as it is; rows that repeat an id count each. A text or word of any length is whole.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in offset_portions(column_bytes(batch["text"])[1], 1 << 23):
                found = _words_of(batch["id"][part], batch["text"][part], shortest, every)
                raw, offsets = column_bytes(found.field(0))
                yield pa.RecordBatch.from_arrays([utf8(raw, offsets), found.field(1)], names=["word", "n"])

    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def gram_dictionary(words: DataFrame, shortest_gram: int = 2, longest_gram: int = 3, long_list: float = 1e-3) -> DataFrame:
    """(gram, parent) of the dictionary's grams of more than shortest_gram letters."""
    n = words.count()
    limit = long_list * n
    counted = None
    for q in range(shortest_gram, longest_gram + 1):
        places = F.transform(F.sequence(F.lit(1), F.length("word") - q + 1), lambda at, q=q: F.substring(F.col("word"), at, F.lit(q)))
        grams = words.where(F.length("word") >= q).select(F.explode(places).alias("gram"))
        counted = grams if counted is None else counted.unionByName(grams)
    counts = checkpointed(counted.groupBy("gram").agg(F.count("*").alias("n")))
    kept, long = None, counts.where((F.length("gram") == shortest_gram) & (F.col("n") > limit)).select(F.col("gram").alias("parent"))
    for q in range(shortest_gram + 1, longest_gram + 1):
        folded = F.sum("n").over(Window.partitionBy("parent").orderBy("n", "gram").rowsBetween(Window.unboundedPreceding, 0))
        children = counts.where(F.length("gram") == q).withColumn("parent", F.left("gram", F.lit(q - 1))).join(long, "parent", "left_semi").withColumn("folded", folded).where(F.col("folded") > limit)
        kept = children.select("gram", "parent") if kept is None else kept.unionByName(children.select("gram", "parent"))
        long = children.where(F.col("n") > limit).select(F.col("gram").alias("parent"))
    return kept


class Grams:
    """The gram dictionary as tables of numbers: which grams there are, and which have longer ones below them."""

    def __init__(self, pairs: list[tuple[str, str]], shortest: int, longest: int):
        if not 1 <= shortest <= longest <= 8:
            raise ValueError("grams have 1 to 8 letters")
        self.shortest, self.longest = shortest, longest
        number = lambda names: np.unique(np.array([int.from_bytes(g.encode("latin-1"), "big") for g in names], np.uint64))
        self.there = {q: number({g for g, _ in pairs if len(g) == q}) for q in range(shortest + 1, longest + 1)}
        self.longer = {q: number({p for _, p in pairs if len(p) == q}) for q in range(shortest, longest)}

    @staticmethod
    def among(codes: np.ndarray, members: np.ndarray) -> np.ndarray:
        if not len(members):
            return np.zeros(codes.shape, bool)
        return members[np.minimum(np.searchsorted(members, codes), len(members) - 1)] == codes

    def decompose(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For words of one length (rows), at each place where a gram can begin: the gram's number with its length, whether it is in
        the decomposition, and the first and the last place read for that (before the start, at or after the end: also that the word ends)."""
        m, size = letters.shape
        q, places = self.shortest, letters.shape[1] - self.shortest + 1
        at = np.arange(places)
        wide = np.zeros((m, size + self.longest), np.uint64)
        wide[:, :size] = letters
        code = np.zeros((m, places), np.uint64)
        for k in range(q):
            code = (code << np.uint64(8)) | wide[:, k : k + places]
        gram, length = code, np.full((m, places), q)
        read = np.tile(at + q - 1, (m, 1))
        alive = np.ones((m, places), bool)
        for q in range(self.shortest + 1, self.longest + 1):
            alive &= self.among(gram, self.longer[q - 1])
            read = np.where(alive, at + q - 1, read)
            code = (code << np.uint64(8)) | wide[:, q - 1 : q - 1 + places]
            alive &= (at + q <= size) & self.among(code, self.there[q])
            gram, length = np.where(alive, code, gram), np.where(alive, q, length)
        end = at + length
        reach = np.maximum.accumulate(end, axis=1)
        kept = np.ones((m, places), bool)
        kept[:, 1:] = end[:, 1:] > reach[:, :-1]
        first, last = at + length - self.longest, read.copy()
        for back in range(1, min(self.longest - self.shortest, places - 1) + 1):
            seen = (at[back:] - back) >= np.maximum(first[:, back:], 0)
            last[:, back:] = np.where(seen, np.maximum(last[:, back:], read[:, :-back]), last[:, back:])
        with np.errstate(over="ignore"):
            return mix(gram * _GOLD + length.astype(np.uint64)), kept, first, last

    def keys(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x size, rows x (size + 1)): of the grams that are left alone by an edit of letter k, and by a letter put in before letter k."""
        m, size = letters.shape
        gram, kept, first, last = self.decompose(letters)
        left, right = np.zeros((m, size + 2), np.uint64), np.zeros((m, size + 2), np.uint64)
        rows = np.arange(m)
        with np.errstate(over="ignore"):
            for p in range(gram.shape[1]):
                some = rows[kept[:, p]]
                left[some, last[some, p] + 1] += mix(gram[some, p] ^ (np.uint64(p + 1) * _TURN))
                some = some[first[some, p] >= 0]
                right[some, first[some, p]] += mix(gram[some, p] + np.uint64(size - p) * _TURN)
            left = np.cumsum(left, axis=1, dtype=np.uint64)
            right = mix(np.cumsum(right[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1].copy())
            return mix(left[:, :size] ^ right[:, 1 : size + 1]), mix(left[:, : size + 1] ^ right[:, : size + 1])


def edit_rows(letters: np.ndarray, ids: np.ndarray, counts: np.ndarray, grams: Grams, shortest: int) -> np.ndarray:
    """What words of one length send for each place of an edit: the key of the merged lists, and the word without the letter there."""
    m, size = letters.shape
    edited, put = grams.keys(letters)
    tag = lambda kind, k: mix(np.array([kind * (1 << 40) + k], np.uint64) * _TURN)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, _BASE, np.uint64))), dtype=np.uint64)
        total = np.concatenate((np.zeros((m, 1), np.uint64), np.cumsum(_VALUE[letters] * power[:size], axis=1, dtype=np.uint64)), axis=1)
        without = total[:, :size] + np.uint64(pow(_BASE, -1, 1 << 64)) * (total[:, size:] - total[:, 1:])
        places = np.arange(size, dtype=np.uint64)
        parts = [(SUB, edited ^ tag(SUB, size), mix(without + (places + np.uint64(1)) * _TURN), letters, None)]
        if size > shortest:  # of equal letters in a row the first one goes
            fresh = np.ones((m, size), bool)
            fresh[:, 1:] = letters[:, 1:] != letters[:, :-1]
            parts.append((DEL, edited ^ tag(DEL, size - 1), mix((without ^ _GOLD) + places * _TURN), letters, fresh))
        parts.append((INS, put ^ tag(DEL, size), mix((total[:, size:] ^ _GOLD) + np.arange(size + 1, dtype=np.uint64) * _TURN), np.zeros((m, size + 1), np.uint8), None))
    out = []
    for kind, key, mask, letter, some in parts:
        rows = np.zeros(key.shape, _ROW)
        rows["key"], rows["mask"], rows["letter"], rows["kind"] = key, mask, letter, kind
        rows["id"], rows["n"], rows["place"] = ids[:, None], counts[:, None], np.arange(key.shape[1])
        out.append(rows.ravel() if some is None else rows[some])
    return np.concatenate(out)


def _groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows by key, mask and kind, in each the largest count first, ties by letter; where each (key, mask, kind) begins)."""
    rows = rows[np.lexsort((rows["letter"], -rows["n"], rows["kind"], rows["mask"], rows["key"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["mask"][1:] != rows["mask"][:-1]) | (rows["kind"][1:] != rows["kind"][:-1])
    return rows, np.flatnonzero(new)


def near_rows(rows: np.ndarray) -> pa.Table:
    """For each row with near words at its place: how many, and the largest of them (count, kind, place, letter of the edit that gives it)."""
    rows, starts = _groups(rows)
    sizes = np.diff(np.concatenate((starts, [len(rows)])))
    kind = rows["kind"][starts]
    out = []
    # words that differ in the letter: the first is the largest for all others, the second for the first
    subs = (kind == SUB) & (sizes > 1)
    many = np.repeat(sizes[subs], sizes[subs])
    at = np.repeat(starts[subs], sizes[subs]) + _count_up(sizes[subs])
    best = np.repeat(starts[subs], sizes[subs])
    best = np.where(at == best, best + 1, best)
    out.append((rows["id"][at], rows["n"][at], many - 1, rows["n"][best], np.full(len(at), SUB), rows["place"][at], rows["letter"][best]))
    # a word, and those with a letter more at that place
    pair = np.zeros(len(starts), bool)
    pair[:-1] = (kind[:-1] == DEL) & (kind[1:] == INS) & (rows["key"][starts[:-1]] == rows["key"][starts[1:]]) & (rows["mask"][starts[:-1]] == rows["mask"][starts[1:]])
    more = np.flatnonzero(pair)
    short, long = starts[more + 1], starts[more]
    out.append((rows["id"][short], rows["n"][short], sizes[more], rows["n"][long], np.full(len(more), INS), rows["place"][short], rows["letter"][long]))
    at, short = np.repeat(long, sizes[more]) + _count_up(sizes[more]), np.repeat(short, sizes[more])
    out.append((rows["id"][at], rows["n"][at], np.ones(len(at)), rows["n"][short], np.full(len(at), DEL), rows["place"][at], np.zeros(len(at))))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
    return pa.Table.from_arrays([pa.array(c.astype(np.int64)).cast(f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)


def _count_up(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size in a row."""
    edges = np.concatenate(([0], np.cumsum(sizes)))
    return np.arange(edges[-1]) - np.repeat(edges[:-1], sizes)


def _sent(words: DataFrame, grams: Grams, shortest: int, targets: int) -> DataFrame:
    """(dst, payload): rows of all words and places, dealt out by their keys."""

    def flushed(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        home = rows["key"] % np.uint64(targets)
        order = np.argsort(home, kind="stable")
        rows, cuts = rows[order], np.searchsorted(home[order], np.arange(targets + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(cuts))
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([rows[cuts[t] : cuts[t + 1]].tobytes() for t in some.tolist()], pa.binary())], names=["dst", "payload"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            codes, offsets = latin(*column_bytes(batch["word"]))
            lengths, ids, counts = np.diff(offsets), batch["id"].to_numpy(), batch["n"].to_numpy()
            for length in np.unique(lengths).tolist():
                all_of = np.flatnonzero(lengths == length)
                step = max(1, CELLS // length)
                for k in range(0, len(all_of), step):
                    some = all_of[k : k + step]
                    rows = edit_rows(codes[offsets[some][:, None] + np.arange(length)], ids[some], counts[some], grams, shortest)
                    held.append(rows)
                    size += rows.nbytes
                    if size >= HELD_BYTES:
                        yield flushed(held)
                        held, size = [], 0
        if held:
            yield flushed(held)

    return words.mapInArrow(send, "dst int, payload binary")


def _edited() -> Column:
    """The word that the edit (kind, place, letter) makes of `word`."""
    before, letter = F.left("word", F.col("place")), F.chr("letter")
    rest = lambda skip: F.substring(F.col("word"), F.col("place") + 1 + skip, F.length("word"))
    return F.when(F.col("kind") == SUB, F.concat(before, letter, rest(1))).when(F.col("kind") == DEL, F.concat(before, rest(1))).otherwise(F.concat(before, letter, rest(0)))


def group_variants(counts: DataFrame, ratio: int = 10, shortest_gram: int = 2, longest_gram: int = 3, long_list: float = 1e-3) -> DataFrame:
    """counts: (word, n), distinct words of a-z and U+00C0-U+00FF with 2 * longest_gram letters or more (an error, else).

    Returns word, form, root, n, n_near, form_n for each. form and form_n are null without a near word of ratio * n;
    of several such words of the largest count it is the first in code-point order. n_near is 0 for a word without near words.
    root is the word itself without a form. An empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("counts have to grow from a word to its form")
    shortest = 2 * longest_gram
    spark = counts.sparkSession
    words = checkpointed(counts.select("word", F.col("n").cast("long").alias("n"), F.xxhash64("word").alias("id")))
    facts = words.agg(F.min(F.length("word")).alias("least"), F.max("n").alias("top"), F.sum(3 * F.length("word") + 1).alias("rows")).first()
    if facts["least"] is not None and facts["least"] < shortest:
        raise ValueError(f"a word of {facts['least']} letters; grams of up to {longest_gram} need {shortest}")
    grams = Grams([(r["gram"], r["parent"]) for r in gram_dictionary(words, shortest_gram, longest_gram, long_list).collect()], shortest_gram, longest_gram)
    targets = max(shuffle_partitions(spark), -(-(facts["rows"] or 0) * _ROW.itemsize // HELD_BYTES))

    def merge(table: pa.Table) -> pa.Table:
        return near_rows(np.frombuffer(b"".join(table["payload"].to_pylist()), _ROW))

    found = checkpointed(_sent(words, grams, facts["least"] or shortest, targets).groupBy("dst").applyInArrow(merge, FOUND))
    near = found.groupBy("id", "n").agg(F.sum("near").alias("n_near"))
    much = found.where(F.col("best") >= ratio * F.col("n")).join(words, ["id", "n"]).select("word", "best", _edited().alias("form"))
    forms = checkpointed(much.groupBy("word").agg(F.min(F.struct((-F.col("best")).alias("less"), "form")).alias("first")).select("word", "first.form", (-F.col("first.less")).alias("form_n")))
    roots = forms.select("word", F.col("form").alias("root"))
    steps = 0
    while ratio ** (1 << steps) <= (facts["top"] or 0):  # counts grow by `ratio` with each form: the longest chain is known
        over = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = checkpointed(roots.join(over, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        steps += 1
    out = words.join(near, ["id", "n"], "left").join(forms.join(roots, "word"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
