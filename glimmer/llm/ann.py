"""Approximate nearest neighbours by multi-index hashing of learned, rotated binary codes.

Method. On a bounded sample a rotation of the principal axes is learned that brings signs and values together
(iterative quantization); a vector's code is its signs after rotation. A code is split into substrings, each with
an index of its own. Two codes within Hamming distance r agree in at least one of m substrings up to r // m bits,
so probing each substring's index within that distance retrieves every code within r. The retrieved vectors are
ranked by their true distance in double precision. r is learned too: the distance within which nearly all true
neighbours of sample queries lie (a sample's neighbours are farther than the whole table's, so r is on the safe
side). A query that finds fewer than k rows within r is asked again of all vectors, through one substring.

Scale. The index is a table keyed by (substring, value): a vector is in it once per substring, whatever the number of
queries. A query goes to the values within reach of its own, a join on that key. Neighbouring values share a cell of
about `block` vectors, and a value with more of them (equal vectors, for instance) is dealt out over salts, so a task
serves one block; a vector that several substrings retrieve counts for the first of them alone. How far that prunes
is up to the data: where true neighbours differ in few bits of a substring, next to nothing is probed; where they
differ in a third of all bits, as isotropic vectors do, any exact probing within r visits most of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.llm.exchange import checkpointed

FOUND = "query_id long, which long, vec_id long, score double"
_FOUND = pa.schema([("query_id", pa.int64()), ("which", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) of rows with an id whose vector is neither null, empty nor zero and has only finite components."""
    vec = F.col("vec")
    slim = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return slim.where(F.col("id").isNotNull() & vec.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda x: x != 0))


class Codes:
    """The learned rotation, and the radius that covers nearly all neighbours of the sample."""

    def __init__(self, sample: np.ndarray, bits: int, substrings: int, k: int, coverage: float, rounds: int = 30):
        rng = np.random.default_rng(7)
        self.bits = min(bits, sample.shape[1])
        self.substrings = min(substrings, self.bits)
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, ::-1][:, : self.bits]
        low = centred @ axes
        turn = np.linalg.qr(rng.normal(size=(self.bits, self.bits)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
            turn = (u @ v).T
        self.matrix = axes @ turn
        self.radius = self.bits
        if len(sample) > k:
            codes = self.encode(sample)
            distances = []
            for q in range(0, len(sample), max(1, len(sample) // 200)):
                apart = ((sample - sample[q]) ** 2).sum(axis=1)
                apart[q] = np.inf
                near = np.argpartition(apart, k - 1)[:k]
                distances.append(np.bitwise_count(codes[near] ^ codes[q]))
            self.radius = int(np.quantile(np.concatenate(distances), coverage, method="higher"))

    @property
    def width(self) -> int:
        return self.bits // self.substrings

    def parts(self, codes: np.ndarray, substring: int) -> np.ndarray:
        """The codes' values in one substring; the last one has the bits that are left over."""
        last = substring == self.substrings - 1
        size = self.bits - self.width * substring if last else self.width
        return (codes >> np.uint64(substring * self.width)) & np.uint64((1 << size) - 1)

    def reach(self, radius: int) -> list[int]:
        """By substring, the differing bits up to which it has to be probed (-1: not at all), so that one of them retrieves each code within the radius."""
        share, rest = divmod(radius, self.substrings)
        return [share if s <= rest else share - 1 for s in range(self.substrings)]

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        signs = (vectors - self.mean) @ self.matrix > 0
        out = np.zeros(len(vectors), np.uint64)
        for b in range(self.bits):
            out |= signs[:, b].astype(np.uint64) << np.uint64(b)
        return out


class Cell:
    """The index of one substring over one block of vectors."""

    def __init__(self, coder: Codes, substring: int, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray):
        self.coder, self.substring, self.ids, self.vectors, self.codes = coder, substring, ids, vectors, codes
        part = coder.parts(codes, substring)
        self.order = np.argsort(part, kind="stable")
        self.values, first = np.unique(part[self.order], return_index=True)
        self.first = np.append(first, len(part))

    def within(self, code: np.uint64, radius: int, reach: list[int]) -> np.ndarray:
        """Positions of the codes within the radius that this substring retrieves and none before it does."""
        near = np.flatnonzero(np.bitwise_count(self.values ^ self.coder.parts(code, self.substring)) <= reach[self.substring])
        at = np.concatenate([np.zeros(0, np.int64), *[self.order[self.first[v] : self.first[v + 1]] for v in near.tolist()]])
        apart = self.codes[at] ^ code
        fits = np.bitwise_count(apart) <= radius
        for s in range(self.substring):
            fits &= ~(np.bitwise_count(self.coder.parts(apart, s)).astype(np.int64) <= reach[s])
        return at[fits]

    def search(self, query: np.ndarray, code: np.uint64, k: int, radius: int, reach: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest of these, ties to smaller ids."""
        at = self.within(code, radius, reach)
        apart = np.sqrt(((self.vectors[at] - query) ** 2).sum(axis=1))
        order = np.lexsort((self.ids[at], apart))[:k]
        return self.ids[at][order], apart[order]


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = 64, substrings: int = 8, coverage: float = 0.995, fit_rows: int = 20_000, block: int = 8_192) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found of the vectors, by Euclidean distance.

    Vectors that are null, zero or not finite, have no id, or differ in size from most take no part on either side.
    A query's own row, the one with its id and vector, doesn't count; another row with its id does. A query that is
    there twice has its answer twice; ties go to the smaller id; repeated rows are found once each. Fewer than k
    candidates give fewer rows; empty tables give none. Other columns, whatever their names, play no part.
    """
    rows = usable(vectors, id_col, vector_col)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(fit_rows).toArrow()
    spark = vectors.sparkSession
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes, times = np.unique(pc.list_value_length(sample["vec"]).to_numpy(), return_counts=True)
    size = int(sizes[times.argmax()])
    coder = Codes(_matrix(sample.filter(pc.equal(pc.list_value_length(sample["vec"]), size))["vec"], size), bits, substrings, k, coverage)
    rows = rows.where(F.size("vec") == size)
    #: Equal queries are asked once.
    asked = usable(queries, id_col, vector_col).where(F.size("vec") == size).groupBy("id", "vec").agg(F.count("*").alias("times"))
    n = rows.count()
    depth = min(coder.width, max(0, (max(1, n // block) - 1).bit_length()))  # bits of a value that name its cell
    shift = coder.width - depth

    def indexed(only: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = coder.encode(_matrix(batch["vec"], size))
                for s in range(coder.substrings) if only is None else [only]:
                    cells = (coder.parts(codes, s) >> np.uint64(shift)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), s, np.int32)), pa.array(cells), batch["id"], batch["vec"], pa.array(codes.view(np.int64))], names=["s", "cell", "id", "vec", "code"])

        return run

    def probes(reach: list[int], only: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Each query, for each cell that holds a value within reach."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = coder.encode(_matrix(batch["vec"], size))
                for s in range(coder.substrings) if only is None else [only]:
                    own = coder.parts(codes, s) >> np.uint64(shift)
                    most = coder.bits - coder.width * s if s == coder.substrings - 1 else coder.width
                    cells = np.arange(1 << (most - shift), dtype=np.uint64)
                    near = [np.flatnonzero(np.bitwise_count(cells ^ v).astype(np.int64) <= reach[s]) for v in own]
                    which = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in near]))
                    at = np.concatenate([np.zeros(0, np.int64), *near])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s, np.int32)), pa.array(at), batch["id"].take(which), batch["vec"].take(which), pa.array(codes.view(np.int64)).take(which)], names=["s", "cell", "id", "vec", "code"])

        return run

    shape = "s int, cell long, id long, vec array<double>, code long"

    def answers(asked: DataFrame, radius: int, only: int | None) -> DataFrame:
        """(query_id, which, vec_id, score): the k + 1 nearest of each task for each query."""
        reach = coder.reach(radius) if only is None else [coder.bits if s == only else -1 for s in range(coder.substrings)]
        index = rows.mapInArrow(indexed(only), shape)
        cells = index.groupBy("s", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("salts"))  # at most substrings * 2**width rows
        salted = index.join(F.broadcast(cells), ["s", "cell"]).withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.col("salts")).cast("int"))
        sent = asked.select("id", "vec").mapInArrow(probes(reach, only), shape).join(F.broadcast(cells.select(*[F.col(c).alias(c) for c in cells.columns])), ["s", "cell"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

        def serve(left: pa.Table, right: pa.Table) -> pa.Table:
            found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
            if left.num_rows and right.num_rows:
                held = Cell(coder, left["s"][0].as_py(), left["id"].to_numpy(), _matrix(left["vec"], size), left["code"].to_numpy().view(np.uint64))
                for q, which, point, code in zip(right["id"].to_pylist(), right["which"].to_pylist(), _matrix(right["vec"], size), right["code"].to_numpy().view(np.uint64), strict=True):
                    near, apart = held.search(point, code, k + 1, radius, reach)
                    found.append((np.full(len(near), q, np.int64), np.full(len(near), which, np.int64), near, apart))
            return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=_FOUND)

        keys = ["s", "cell", "salt"]
        return salted.groupBy(*keys).cogroup(sent.withColumn("which", F.xxhash64("vec")).groupBy(*keys)).applyInArrow(serve, FOUND)

    def ranked(found: DataFrame) -> DataFrame:
        """The k best of each query, without its own row."""
        order = Window.partitionBy("query_id", "which").orderBy("score", "vec_id")
        best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
        own = ((F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0)).cast("int")
        before = F.sum(own).over(order.rowsBetween(Window.unboundedPreceding, 0))
        best = best.withColumn("own", own).withColumn("before", before).where((F.col("own") == 0) | (F.col("before") > 1))
        return best.withColumn("rank", (F.col("place") - F.least("before", F.lit(1))).cast("int")).where(F.col("rank") <= k).select("query_id", "which", "rank", "vec_id", "score")

    best = checkpointed(ranked(answers(asked, coder.radius, None)))
    named = asked.withColumn("which", F.xxhash64("vec")).withColumnRenamed("id", "query_id")
    full = best.where(F.col("rank") == k).select("query_id", "which")
    short = checkpointed(named.join(full, ["query_id", "which"], "left_anti").select(F.col("query_id").alias("id"), "vec"))
    if not short.isEmpty():
        again = ranked(answers(short, coder.bits, 0))
        best = best.join(full, ["query_id", "which"], "left_semi").unionByName(again)
    return best.join(named.select("query_id", "which", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy")), ["query_id", "which"]).select("query_id", "rank", "vec_id", "score")
