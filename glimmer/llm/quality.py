"""Quality and toxicity classifiers by co-training.

Two views of a document: its text content (words, word beginnings, token endings, style figures such as the share of
capitals) and its page metadata (source, language, length, and pairs of these). For each target (junk, toxic) a
classifier per view is trained on labelled documents. Then, over some rounds, each view scores all documents without a
label and hands the ones it is surest of, with their pseudo-labels, to the other view, which is trained again; the
metadata view so learns sources that no labelled document has. How sure a view is comes from labelled documents that
it wasn't trained on, so one that can't tell them apart teaches nothing. At last both views' log-odds are calibrated together on
labelled documents that neither was trained on, which gives one probability; a view without signal gets next to no
weight. All documents are scored.

Scale. Only labelled rows are sampled: `fit_rows` of them at most, chosen by a hash of their ids. Which text features a
model has is decided by a distributed count over these; bounds of lengths are quantiles over all documents. All
unlabelled documents are read once, and what the views see of them (some hundred bytes each) is written; a round scores
that table, each task keeps its `picks` surest documents of a kind, and Spark the surest of all. Scoring is one pass
without a shuffle; a model is a few thousand numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.llm import vocabulary
from glimmer.llm.exchange import annotate_rows, checkpointed
from glimmer.llm.text_kernels import ALNUM_SPLIT, LOWER, SPACE_SPLIT, Lookup, Words, column_bytes, mix, portions, split_words

TARGETS = ("junk", "toxic")
#: Style of a text; part of the text view.
FIGURES = ("words", "word_bytes", "line_words", "upper", "symbols", "digits", "distinct", "longest_run")
BINS = 10
#: What stands for all bins of a text without words.
NO_WORDS = len(FIGURES) * BINS
SCORES = "p_junk double, p_toxic double"
#: Bytes of text worked through at a time.
PORTION = 1 << 20
#: Evidence (a logarithm of odds, beyond those of any document) from which a view is sure enough to teach.
SURE = 2.0

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_SYMBOL = ~(ALNUM_SPLIT | _UPPER | ~SPACE_SPLIT)
_SYMBOL[[ord(c) for c in ".,;:'\"()-"]] = False


def _tagged(hashes: np.ndarray, tag: int) -> np.ndarray:
    return mix(hashes ^ np.uint64(tag * 0x632BE59BD9B4E019 & (2**64 - 1)))


class Views:
    """Text features and style figures of a batch; edges: the bounds of the figures' bins."""

    def __init__(self, texts: pa.Array, edges: np.ndarray | None = None):
        raw, offsets = column_bytes(texts)
        self.n = len(offsets) - 1
        low = split_words(LOWER[raw], offsets, ALNUM_SPLIT)
        tokens = split_words(raw, offsets, SPACE_SPLIT)
        self.word_hashes, self.words = low.hashes(), low
        cut = lambda w, size: Words(w.raw, w.offsets, w.starts, np.minimum(w.ends, w.starts + size), w.bounds).hashes()
        ends = Words(tokens.raw, tokens.offsets, np.maximum(tokens.starts, tokens.ends - 3), tokens.ends, tokens.bounds).hashes()
        docs = lambda w: np.repeat(np.arange(self.n), w.counts)
        self.features = np.concatenate((_tagged(self.word_hashes, 1), _tagged(cut(low, 4), 2), _tagged(cut(low, 5), 3), _tagged(cut(low, 6), 4), _tagged(ends, 5)))
        self.owners = np.concatenate((*[docs(low)] * 4, docs(tokens)))
        self.figures = self._figures(raw, offsets, low, tokens)
        if edges is not None:  # places of the figures' bins in Target.style; a text without words has none but the last
            bins = np.stack([np.searchsorted(edges[k], self.figures[:, k], side="right") + BINS * k for k in range(len(FIGURES))], axis=1)
            self.bins = np.where(tokens.counts[:, None] > 0, bins, NO_WORDS).astype(np.uint8)

    def _figures(self, raw: np.ndarray, offsets: np.ndarray, low: Words, tokens: Words) -> np.ndarray:
        def count(flags: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets]).astype(float)

        size, words = np.maximum(np.diff(offsets), 1).astype(float), np.maximum(low.counts, 1).astype(float)
        names = tokens.hashes()
        distinct, run = np.ones(self.n), np.zeros(self.n)
        for d, (a, b) in enumerate(zip(tokens.bounds[:-1].tolist(), tokens.bounds[1:].tolist(), strict=True)):
            if b > a:
                some = np.sort(names[a:b])
                # against what a text of this length has: the share of new words falls with its logarithm
                distinct[d] = (1 + np.count_nonzero(some[1:] != some[:-1])) / (b - a) * np.log2(8 + b - a)
                turns = np.flatnonzero(np.concatenate(([True], names[a + 1 : b] != names[a : b - 1], [True])))
                run[d] = np.diff(turns).max()
        return np.stack((words, size / words, words / (1 + count(raw == 10)), count(_UPPER[raw]) / size, count(_SYMBOL[raw]) / size, count(_DIGIT[raw]) / size, distinct, run), axis=1)



def _name(kind: str, value: object) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}={value}".encode() if value is not None else kind.encode(), digest_size=8).digest(), "little")


def metadata(sources: pa.Array, languages: pa.Array, lengths: pa.Array, edges: np.ndarray) -> np.ndarray:
    """Six feature hashes per document: source, language, length bin, and the pairs of these. A null is a value of its own."""

    def hashes(kind: str, column: pa.Array) -> np.ndarray:
        coded = column.dictionary_encode(null_encoding="encode")
        return np.array([_name(kind, v) for v in coded.dictionary.to_pylist()] or [0], np.uint64)[coded.indices.to_numpy()] if len(column) else np.zeros(0, np.uint64)

    size = lengths.cast(pa.float64())
    bins = np.where(np.asarray(size.is_null()), -1, np.searchsorted(edges, size.fill_null(0).to_numpy(zero_copy_only=False), side="right"))
    s, g, n = hashes("source", sources), hashes("language", languages), hashes("length", pa.array(bins))
    with np.errstate(over="ignore"):
        both = lambda x, y: mix(x * np.uint64(0x9E3779B97F4A7C15) + mix(y ^ np.uint64(0x632BE59BD9B4E019)))
        return np.stack((s, g, n, both(s, g), both(s, n), both(g, n)), axis=1)


class Sparse:
    """Rows of (column, value) entries."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.row, self.column, self.value, self.shape = row, column, value, shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * w[self.column], minlength=self.shape[0])

    def turned(self, u: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=self.value * u[self.row], minlength=self.shape[1])

    def of(self, rows: np.ndarray) -> Sparse:
        """These rows (a mask) alone."""
        some = rows[self.row]
        return Sparse((np.cumsum(rows) - 1)[self.row[some]], self.column[some], self.value[some], (int(rows.sum()), self.shape[1]))


def dense(x: np.ndarray) -> Sparse:
    n, k = x.shape
    return Sparse(np.repeat(np.arange(n), k), np.tile(np.arange(k), n), x.ravel().astype(float), (n, k))


def fit_logistic(x: Sparse, y: np.ndarray, weight: np.ndarray | None = None, decay: float = 1e-4, steps: int = 120) -> np.ndarray:
    """Coefficients (the last is the constant) by accelerated full-batch descent."""
    n, k = x.shape
    weight = np.ones(n) if weight is None else weight
    weight = weight / weight.sum()
    w, previous = np.zeros(k + 1), np.zeros(k + 1)
    # a bound of the curvature, by power iteration
    v, top = np.ones(k + 1) / np.sqrt(k + 1), 1.0
    for _ in range(12):
        u = (x.dot(v[:-1]) + v[-1]) * weight
        v = np.append(x.turned(u), u.sum())
        top = float(np.linalg.norm(v))
        v = v / max(top, 1e-12)
    rate = 1 / (0.25 * top * 1.2 + decay)
    for t in range(1, steps + 1):
        ahead = w + (t - 1) / (t + 2) * (w - previous)
        p = 1 / (1 + np.exp(-np.clip(x.dot(ahead[:-1]) + ahead[-1], -30, 30)))
        error = (p - y) * weight
        slope = np.append(x.turned(error) + decay * ahead[:-1], error.sum())
        previous, w = w, ahead - rate * slope
    return w


@dataclass
class Target:
    """One target's classifiers: log-odds of the text view, of the metadata view, and how they combine."""

    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    #: What a feature counts in training: its log-odds ratio among the labelled.
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: The text view: coefficients of the features (their scale included), and of the figures' bins; constants last.
    text: np.ndarray = field(default_factory=lambda: np.zeros(1))
    style: np.ndarray = field(default_factory=lambda: np.zeros(NO_WORDS + 2))
    #: Known metadata features, sorted, and their coefficients, the constant last.
    places: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    meta: np.ndarray = field(default_factory=lambda: np.zeros(1))
    #: How log-odds of words, style and metadata combine: slopes and a constant.
    join: np.ndarray = field(default_factory=lambda: np.zeros(4))
    #: By view (text, metadata): slopes and a constant that make its log-odds evidence, beyond the share of positives.
    evidence: np.ndarray = field(default_factory=lambda: np.zeros((2, 4)))

    def known(self, facts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, place) of each metadata feature that training has met."""
        at = np.searchsorted(self.places, facts)
        hit = self.places[np.minimum(at, len(self.places) - 1)] == facts if len(self.places) else np.zeros(facts.shape, bool)
        return np.nonzero(hit)[0], at[hit]

    def by_metadata(self, facts: np.ndarray) -> np.ndarray:
        doc, place = self.known(facts)
        return np.bincount(doc, weights=self.meta[:-1][place], minlength=len(facts)) + self.meta[-1]

    def odds(self, doc: np.ndarray, feature: np.ndarray, bins: np.ndarray, facts: np.ndarray) -> np.ndarray:
        """Log-odds by words, style and metadata; feature is in document doc."""
        words = np.bincount(doc, weights=self.text[:-1][feature], minlength=len(bins)) + self.text[-1]
        return np.stack((words, self.style[:-1][bins].sum(axis=1) + self.style[-1], self.by_metadata(facts)), axis=1)


@dataclass
class Model:
    """Everything that scoring needs: bounds of the figures' bins and of the lengths, and each target's classifiers."""

    edges: np.ndarray
    lengths: np.ndarray
    targets: dict[str, Target]

    def presence(self, views: Views, target: Target) -> tuple[np.ndarray, np.ndarray]:
        """(document, feature) of each feature that a document has, by document."""
        if not len(target.features):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, which = Lookup(target.features).find(views.features)
        pairs = np.unique(views.owners[at] * len(target.features) + which)
        return pairs // len(target.features), pairs % len(target.features)

    def score(self, texts: pa.Array, sources: pa.Array, languages: pa.Array, lengths: pa.Array) -> list[np.ndarray]:
        """(p_junk, p_toxic)."""
        parts = [self._score(texts[p], sources[p], languages[p], lengths[p]) for p in portions(texts, PORTION)]
        return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(len(TARGETS))]

    def _score(self, texts: pa.Array, sources: pa.Array, languages: pa.Array, lengths: pa.Array) -> list[np.ndarray]:
        views, facts = Views(texts, self.edges), metadata(sources, languages, lengths, self.lengths)
        out = []
        for name in TARGETS:
            target = self.targets[name]
            odds = target.odds(*self.presence(views, target), views.bins, facts)
            out.append(1 / (1 + np.exp(-np.clip(odds @ target.join[:-1] + target.join[-1], -30, 30))))
        return out


@dataclass
class Rows:
    """Training rows of one target: features by document, bins of figures, metadata, and labels."""

    features: list[np.ndarray]
    bins: np.ndarray
    facts: np.ndarray
    y: np.ndarray

    def text(self, target: Target) -> Sparse:
        counts = [len(f) for f in self.features]
        column = np.concatenate([np.zeros(0, np.int64), *self.features]).astype(np.int64)
        return Sparse(np.repeat(np.arange(len(counts)), counts), column, target.scale[column], (len(counts), len(target.features)))

    def meta(self, target: Target) -> Sparse:
        doc, place = target.known(self.facts)
        return Sparse(doc, place, np.ones(len(doc)), (len(self.facts), len(target.places)))

    def style(self) -> Sparse:
        n, k = self.bins.shape
        return Sparse(np.repeat(np.arange(n), k), self.bins.astype(np.int64).ravel(), np.ones(n * k), (n, NO_WORDS + 1))

    def odds(self, target: Target) -> np.ndarray:
        counts = [len(f) for f in self.features]
        return target.odds(np.repeat(np.arange(len(counts)), counts), np.concatenate([np.zeros(0, np.int64), *self.features]).astype(np.int64), self.bins, self.facts)

    def with_more(self, features: list[np.ndarray], bins: np.ndarray, facts: np.ndarray, y: np.ndarray) -> Rows:
        return Rows([*self.features, *features], np.concatenate((self.bins, bins)), np.concatenate((self.facts, facts)), np.concatenate((self.y, y)))


def fit_text(target: Target, rows: Rows, weight: np.ndarray) -> None:
    target.text = fit_logistic(rows.text(target), rows.y, weight)
    target.text[:-1] *= target.scale
    target.style = fit_logistic(rows.style(), rows.y, weight)


def fit_metadata(target: Target, rows: Rows, weight: np.ndarray) -> None:
    target.places = np.unique(rows.facts)
    target.meta = fit_logistic(rows.meta(target), rows.y, weight)


def combined(odds: np.ndarray, y: np.ndarray, columns: tuple[int, ...]) -> np.ndarray:
    """Slopes of log-odds by words, style and metadata (of these columns) and a constant; one that speaks against its own labels counts 0."""
    live = list(columns)
    while True:
        fit = fit_logistic(dense(odds[:, live]), y, decay=1e-5, steps=1500)
        if not (fit[:-1] < 0).any():
            break
        live = [c for c, w in zip(live, fit[:-1], strict=True) if w >= 0]
    out = np.zeros(4)
    out[[*live, 3]] = fit
    return out


def calibrated(target: Target, rows: Rows) -> np.ndarray:
    """How the views combine, on rows that neither was trained on."""
    join = combined(rows.odds(target), rows.y, (0, 1, 2))
    return join if join[:3].any() else _prior(rows.y)


def weighed(target: Target, rows: Rows) -> np.ndarray:
    """Target.evidence, from rows that neither view was trained on: next to nothing for a view that can't tell them apart."""
    odds, prior = rows.odds(target), np.log((rows.y == 1).sum() / (rows.y == 0).sum())
    return np.stack([combined(odds, rows.y, columns) for columns in ((0, 1), (2,))]) - np.array([0, 0, 0, prior])


def _prior(y: np.ndarray) -> np.ndarray:
    """How nothing but a constant combines: the share of positives, but below one half, as no document stands out."""
    return np.array([0, 0, 0, min(np.log((y == 1).sum() / ((y == 0).sum() + 1)), -1e-3)])


def only_metadata(target: Target, rows: Rows, folds: int = 8, least_z: float = 2.0) -> None:
    """Where no text feature tells labelled rows of both kinds apart.

    Each part of the rows gets log-odds from a fit on the others; these are calibrated, unless the order that they
    give (Mann-Whitney) is less than least_z standard errors better than chance: then only a constant is left.
    """
    y = rows.y
    part = np.zeros(len(y), np.int64)
    for v in (0, 1):
        part[y == v] = np.arange((y == v).sum()) % folds
    target.places = np.unique(rows.facts)
    meta, odds = rows.meta(target), np.zeros(len(y))
    for k in range(folds):
        if (mine := part == k).any() and len(np.unique(y[~mine])) == 2:
            w = fit_logistic(meta.of(~mine), y[~mine])
            odds[mine] = meta.of(mine).dot(w[:-1]) + w[-1]
    _, which, times = np.unique(odds, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(times) - (times - 1) / 2)[which]
    yes, no = int((y == 1).sum()), int((y == 0).sum())
    above = ranks[y == 1].sum() - yes * (yes + 1) / 2 - yes * no / 2
    target.meta = fit_logistic(meta, y)
    if above < least_z * np.sqrt(yes * no * (yes + no + 1) / 12):
        target.join = _prior(y)
    else:
        w, c = fit_logistic(dense(odds[:, None]), y, decay=1e-5, steps=1500)
        target.join = np.array([0, 0, w, c])


_SEEN = "key long, facts binary, bins binary, f_junk binary, f_toxic binary"


def _seen(texts: DataFrame, model: Model) -> DataFrame:
    """(key, and what both views see) of every row of texts (key, text, source, lang, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary.release()
        for batch in (b[p] for b in batches for p in portions(b["text"], PORTION)):
            views = Views(batch["text"], model.edges)
            facts = metadata(batch["source"], batch["lang"], batch["length"], model.lengths)
            columns = [batch["key"], pa.array([f.tobytes() for f in facts], pa.binary()), pa.array([b.tobytes() for b in views.bins], pa.binary())]
            for name in TARGETS:
                doc, feature = model.presence(views, model.targets[name])
                ends = np.searchsorted(doc, np.arange(views.n + 1))
                columns.append(pa.array([feature[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["key", "facts", "bins", "f_junk", "f_toxic"])

    return texts.select("key", "text", "source", "lang", "length").mapInArrow(run, _SEEN)


def _unpacked(table: pa.Table | pa.RecordBatch, name: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(features of each document, bins of its figures, metadata features) for one target."""
    raw, offsets = column_bytes(table[f"f_{name}"])
    facts = column_bytes(table["facts"])[0].view(np.uint64).reshape(-1, 6)
    bins = column_bytes(table["bins"])[0].reshape(-1, len(FIGURES))
    return np.split(raw.view(np.int32), offsets[1:-1] // 4) if len(offsets) > 1 else [], bins, facts


def _surest(pool: DataFrame, model: Model, wanted: dict[int, int], taught: dict[int, np.ndarray]) -> pa.Table:
    """(kind, key, facts, bins, f_junk, f_toxic): the surest unlabelled documents of each kind, wanted[kind] of them at most.

    A kind is 4 * target + 2 * teacher + label, teachers being text and metadata; taught[kind] holds the keys that this
    teacher has taught already. A task hands on no more documents of a kind than are wanted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["key"].to_numpy()
            for t, name in enumerate(TARGETS):
                target = model.targets[name]
                features, bins, facts = _unpacked(batch, name)
                doc = np.repeat(np.arange(len(keys)), [len(f) for f in features])
                odds = target.odds(doc, np.concatenate([np.zeros(0, np.int32), *features]), bins, facts)
                for kind in (k for k in wanted if k // 4 == t):
                    evidence = target.evidence[kind // 2 % 2]
                    sure = (odds @ evidence[:-1] + evidence[-1]) * (1 if kind % 2 else -1)
                    some = np.flatnonzero((sure > SURE) & ~np.isin(keys, taught[kind]))
                    some = some[np.lexsort((keys[some], -sure[some]))[: wanted[kind]]]
                    part = batch.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int32)), pa.array(sure[some]), *part.columns], names=["kind", "sure", *part.schema.names])

    found = pool.mapInArrow(run, "kind int, sure double, " + _SEEN)
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("sure"), "key"))
    most = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
    return found.withColumn("place", place).where(F.col("place") <= most[F.col("kind")]).drop("place", "sure").toArrow()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", length_col: str = "n_chars", quality_col: str = "quality", toxic_col: str = "toxic", fit_rows: int = 10_000, features: int = 1_500, least_z: float = 3.0, rounds: int = 3, picks: int = 200) -> Model:
    """Models of both targets. Labels without a document, and documents or labels without an id, play no part in training.

    Labels of one id that contradict each other on a target don't count for it. Of documents that repeat an id, the
    labels go with the one whose text has the least hash; the others are unlabelled, as are labelled ones beyond fit_rows.
    A target whose labels are missing or all alike gets no classifier: its probability is then its label's, or 0.
    One without telling text features (few labels, for instance) is judged by metadata, or by a constant below one half.
    length_col may be missing or null: the length is then the text's, or unknown. Texts are read whole, however long.
    features: the most that a target has; only those whose shares among positive and negative documents differ by
    least_z standard errors count, so that the many neutral words of a long text can't outweigh a few telling ones.
    rounds, picks: how often, and how many documents at most, each view teaches the other.
    """

    def agreed(flag: Column) -> Column:
        value = flag.cast("int")
        return F.when(F.min(value) == F.max(value), F.min(value))

    said = labels.select(F.col(id_col).cast("long").alias("id"), F.col(quality_col).alias("quality"), F.col(toxic_col).alias("toxic")).where(F.col("id").isNotNull())
    chosen = said.groupBy("id").agg(agreed(F.col("quality") == 0).alias("junk"), agreed(F.col("toxic") == 1).alias("toxic"))
    known = F.broadcast(chosen.orderBy(F.xxhash64("id"), "id").limit(fit_rows))  # at most fit_rows short rows
    length = F.col(length_col).cast("double") if length_col in docs.columns else F.lit(None).cast("double")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(length, F.length(F.col(text_col).cast("string")).cast("double")).alias("length")).withColumn("key", F.xxhash64("id", "text"))
    columns = ["text", "source", "lang", "length", "key"]
    sample = slim.join(known, "id").groupBy("id", "junk", "toxic").agg(F.min_by(F.struct(*columns), F.struct(F.xxhash64("text"), "text", "source", "lang", "length")).alias("row"))
    sample = checkpointed(sample.select("id", "junk", "toxic", "row.*"))
    totals = sample.agg(F.count("*").alias("n"), *[F.count_if(F.col(t) == v).alias(f"{t}{v}") for t in TARGETS for v in (1, 0)]).first()
    steps = [k / BINS for k in range(1, BINS)]
    bounds = slim.agg(F.percentile_approx("length", steps, 1000).alias("q")).first()["q"]
    model = Model(np.zeros((len(FIGURES), BINS - 1)), np.array(bounds or [0.0] * (BINS - 1)), {name: Target() for name in TARGETS})

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b[p] for b in batches for p in portions(b["text"], PORTION)):
            yield pa.RecordBatch.from_arrays([pa.array([f.tobytes() for f in Views(batch["text"]).figures], pa.binary())], names=["figures"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b[p] for b in batches for p in portions(b["text"], PORTION)):
            views = Views(batch["text"], model.edges)
            order = np.lexsort((views.features, views.owners))
            f, d = views.features[order], views.owners[order]
            new = np.concatenate(([True], (f[1:] != f[:-1]) | (d[1:] != d[:-1]))) if len(f) else np.zeros(0, bool)
            f, d = f[new], d[new]
            junk, toxic = (batch[t].fill_null(-1).to_numpy()[d] for t in TARGETS)
            names, which = np.unique(f, return_inverse=True)
            cells = [np.bincount(which, weights=flags, minlength=len(names)).astype(np.int64) for flags in (junk == 1, junk == 0, toxic == 1, toxic == 0)]
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), *(pa.array(c) for c in cells)], names=["feature", "j1", "j0", "t1", "t0"])

    if totals["n"]:
        raw = sample.select("text").mapInArrow(figures, "figures binary").toArrow()
        model.edges = np.quantile(column_bytes(raw["figures"])[0].view(np.float64).reshape(-1, len(FIGURES)), steps, axis=0).T
    counts = sample.mapInArrow(counted, "feature long, j1 long, j0 long, t1 long, t0 long")
    counts = checkpointed(counts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("j1", "j0", "t1", "t0")]).where(F.greatest(F.col("j1") + F.col("j0"), F.col("t1") + F.col("t0")) >= 4))
    for name, short in zip(TARGETS, "jt", strict=True):
        yes, no = totals[f"{name}1"], totals[f"{name}0"]
        if not yes or not no:
            model.targets[name].join = np.array([0, 0, 0, 30.0 if yes else -30.0])
            continue
        a, b = F.col(f"{short}1"), F.col(f"{short}0")
        share = (a + b + 1) / (yes + no + 2)
        z = (a / yes - b / no) / F.sqrt(share * (1 - share + 1e-9) * (1 / yes + 1 / no))
        ratio = F.log((a + 0.5) / (yes + 1)) - F.log((b + 0.5) / (no + 1))
        top = counts.select("feature", F.abs(z).alias("z"), ratio.alias("ratio")).where(F.col("z") >= least_z).orderBy(F.desc("z"), "feature").limit(features).toPandas()
        names = top["feature"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(names)
        model.targets[name].features, model.targets[name].scale = names[order], top["ratio"].to_numpy()[order]

    seen = _seen(sample, model).toArrow() if totals["n"] else None
    marks = sample.select("key", *TARGETS).toPandas().drop_duplicates("key").set_index("key") if totals["n"] else None
    training: dict[str, tuple[Rows, Rows]] = {}  # rows to train on, rows kept for calibration
    for name in TARGETS:
        target = model.targets[name]
        if not totals[f"{name}1"] or not totals[f"{name}0"]:
            continue
        order = np.argsort(seen["key"].to_numpy())
        table = seen.take(pa.array(order))
        lists, bins, facts = _unpacked(table.combine_chunks(), name)
        y = marks[name].reindex(table["key"].to_numpy()).fillna(-1).to_numpy(np.int64)
        rows = lambda mask: Rows([lists[k] for k in np.flatnonzero(mask)], bins[mask], facts[mask], y[mask])  # noqa: B023, E731
        if not len(target.features):
            only_metadata(target, rows(y >= 0))
            continue
        fold = np.zeros(len(y), bool)
        for v in (0, 1):
            fold[np.flatnonzero(y == v)[::4]] = True
        if len(np.unique(y[(y >= 0) & ~fold])) < 2:
            whole = rows(y >= 0)
            fit_text(target, whole, np.ones(len(whole.y)))
            fit_metadata(target, whole, np.ones(len(whole.y)))
            target.join = np.array([1.0, 0, 0, 0])
            continue
        training[name] = rows((y >= 0) & ~fold), rows(fold)
        fit_text(target, training[name][0], np.ones(len(training[name][0].y)))
        fit_metadata(target, training[name][0], np.ones(len(training[name][0].y)))
    if training and rounds:
        unlabelled = slim.join(F.broadcast(sample.select(F.col("key").alias("labelled"))), F.col("key") == F.col("labelled"), "left_anti")
        pool = checkpointed(_seen(unlabelled, model))
        _teach(pool, model, training, rounds, picks)
    for name, (_, held) in training.items():
        model.targets[name].join = calibrated(model.targets[name], held)
    return model


def _teach(pool: DataFrame, model: Model, training: dict[str, tuple[Rows, Rows]], rounds: int, picks: int) -> None:
    """Rounds of co-training: each view is trained again on the labelled rows and on what the other one was surest of."""
    wanted, taught = {}, {}
    given = {name: rows for name, (rows, _) in training.items()}
    pupils = {(t, view): given[name] for t, name in enumerate(TARGETS) if name in given for view in (0, 1)}
    for t, name in enumerate(TARGETS):
        for teacher in (0, 1) if name in given else ():
            rate = given[name].y.mean()
            for label, share in ((1, rate), (0, 1 - rate)):
                kind = 4 * t + 2 * teacher + label
                wanted[kind], taught[kind] = max(1, round(picks * float(share))), np.zeros(0, np.int64)
    for _ in range(rounds):
        for name, (_, held) in training.items():
            model.targets[name].evidence = weighed(model.targets[name], held)
        found = _surest(pool, model, wanted, taught)
        if not found.num_rows:
            break
        for kind in wanted:
            some = found.filter(pc.equal(found["kind"], kind)).combine_chunks()
            if not some.num_rows:
                continue
            name, teacher, label = TARGETS[kind // 4], kind // 2 % 2, kind % 2
            taught[kind] = np.concatenate((taught[kind], some["key"].to_numpy()))
            pupils[kind // 4, 1 - teacher] = pupils[kind // 4, 1 - teacher].with_more(*_unpacked(some, name), np.full(some.num_rows, label))
        for (t, view), rows in pupils.items():
            weight = np.where(np.arange(len(rows.y)) < len(given[TARGETS[t]].y), 1.0, 0.5)
            (fit_text, fit_metadata)[view](model.targets[TARGETS[t]], rows, weight)


def score(docs: DataFrame, model: Model, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", length_col: str = "n_chars", reject: float = 0.5) -> DataFrame:
    """(row, p_junk, p_toxic, kept): each row of docs, whole, with both probabilities; kept when neither reaches `reject`.

    A null text is empty; a null source or language is one of its own, and one that training didn't meet says nothing;
    a missing length is the text's. Rows may repeat; texts are read whole; an empty table gives no rows; the input's own
    columns stay inside `row`.
    """

    def columns(texts: pa.Array, sources: pa.Array, languages: pa.Array, *lengths: pa.Array) -> list[pa.Array]:
        own = pc.utf8_length(texts).cast(pa.float64())
        given = pc.coalesce(lengths[0].cast(pa.float64()), own) if lengths else own
        return [pa.array(p, pa.float64()) for p in model.score(texts, sources, languages, given)]

    inputs = [text_col, source_col, lang_col, *([length_col] if length_col in docs.columns else [])]
    scored = annotate_rows(docs, inputs, columns, SCORES)
    return scored.withColumn("kept", (F.col("p_junk") < reject) & (F.col("p_toxic") < reject))
