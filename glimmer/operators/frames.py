"""Figures of frames from their pixels.

A frame is a row (video_id, frame_index, time, width, height, pixels): pixels are the bytes of its rows from the top, blue,
green and red of each pixel, or one byte of each for grey frames and masks. Kernels work on whole Arrow batches; a task
holds a batch and, where an operator needs it, one earlier frame or a model, never a video.

A frame whose size isn't positive, or whose bytes aren't as many as its size needs (null among them), is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.functions import pixels as kernels
from glimmer.operators.motion import sampled
from glimmer.operators.series import KEY

FRAME = "video_id string, frame_index long, time double, width int, height int, pixels binary"
VALUE = "video_id string, frame_index long, time double, value double"
COLOURS = 3


def usable(frames: DataFrame, channels: int = COLOURS) -> DataFrame:
    """The frames' own columns, without broken frames."""
    size = F.col("width").cast("long") * F.col("height") * channels
    return frames.where((F.col("width") > 0) & (F.col("height") > 0) & (F.octet_length("pixels") == size)).select(KEY, F.col("frame_index").cast("long").alias("frame_index"), F.col("time").cast("double").alias("time"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "pixels")


def _stacks(batch: pa.RecordBatch, channels: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their frames as one array) for each size in a batch."""
    width, height = batch["width"].to_numpy(), batch["height"].to_numpy()
    column = batch["pixels"]
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    for w, h in np.unique(np.stack((width, height), axis=1), axis=0).tolist():
        rows = np.flatnonzero((width == w) & (height == h))
        cells = h * w * channels
        stack = raw[at[0] : at[-1]].reshape(-1, cells) if len(rows) == len(width) else raw[at[rows][:, None] + np.arange(cells)]
        yield rows, stack.reshape(len(rows), h, w, *([channels] if channels > 1 else []))


def _column(stack: np.ndarray) -> pa.Array:
    """A binary column of frames."""
    n, cells = len(stack), stack[0].size if len(stack) else 0
    offsets = np.arange(n + 1, dtype=np.int64) * cells
    if offsets[-1] > np.iinfo(np.int32).max:
        raise OverflowError("a batch of frames over two gibibytes; set spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(stack))])


def _mapped(frames: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], channels: int = COLOURS) -> DataFrame:
    """Frames whose pixels a kernel has made anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for rows, stack in _stacks(batch, channels):
                    out = kernel(stack)
                    size = [pa.array(np.full(len(rows), k, np.int32)) for k in (out.shape[2], out.shape[1])]
                    yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(rows)) for c in (KEY, "frame_index", "time")), *size, _column(out)], names=[KEY, "frame_index", "time", "width", "height", "pixels"])

    return frames.mapInArrow(run, FRAME)


def resized(frames: DataFrame, width: int) -> DataFrame:
    """Colour frames brought to a width by area, the height in proportion."""
    return _mapped(usable(frames), lambda x: kernels.area_resized(x, width))


def grey(frames: DataFrame, width: int = 320) -> DataFrame:
    """Grey frames (one byte a pixel) of colour frames, brought to a width by area; a width up to 0 keeps the size."""
    return _mapped(usable(frames), lambda x: kernels.area_resized(kernels.grey(x), width))


def histograms(frames: DataFrame, size: tuple[int, int] = (160, 90), bins: int = 32) -> DataFrame:
    """(video_id, frame_index, time, hist): counts of hue, saturation and value, each over its norm, in a row.

    Frames are first brought to `size` (width, height), linearly. No shuffle; scenes.shot_scores() takes them as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for rows, stack in _stacks(batch, COLOURS):
                    found = kernels.channel_histograms(kernels.hue_saturation_value(kernels.linear_resized(stack, *size)), bins)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
                    yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(rows)) for c in (KEY, "frame_index", "time")), lists], names=[KEY, "frame_index", "time", "hist"])

    return usable(frames).mapInArrow(run, "video_id string, frame_index long, time double, hist array<double>")


def opened_fraction(masks: DataFrame) -> DataFrame:
    """(video_id, frame_index, time, value) of masks: the share of foreground pixels after opening; shadows aren't foreground."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for rows, stack in _stacks(batch, 1):
                    value = kernels.opened((stack != 0) & (stack != kernels.SHADOW)).mean(axis=(1, 2))
                    yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(rows)) for c in (KEY, "frame_index", "time")), pa.array(value)], names=[KEY, "frame_index", "time", "value"])

    return usable(masks, 1).mapInArrow(run, VALUE)


#: Rows beyond a band's own that opening has to see.
HALO = 2


def foreground(frames: DataFrame, videos: DataFrame, width: int = 320, step: int = 1, history: int = 500, threshold: float = 16.0, ratio: float = 0.7, shadows: bool = True, rate: float = -1.0, keep_times: bool = False, band_rows: int = 64) -> DataFrame:
    """(video_id, frame_index, time, value): the share of pixels that an adaptive background model calls foreground, after opening.

    The first min(200, history // 2) frames only warm the model up; of those after them every step-th one counts.
    Indexes and times begin anew behind the warm-up, unless they are kept. videos: (video_id, fps).

    A model is a state per pixel over frames in order, so a video is cut into bands of rows: a band's frames pass through
    one task in order, and its model is handed on from batch to batch. Bands overlap by what opening looks at, and
    their counts are added up. A video without frames after the warm-up gives no rows; a frame of another size starts
    the model anew; frames of one index are taken in the order of their bytes.
    """
    warm = min(200, max(0, history // 2))
    index = F.col("frame_index") - warm
    used = frames.where((index < 0) | (F.pmod(index, F.lit(max(1, step))) == 0))
    bands = resized(used, width).withColumn("band", F.explode(F.sequence(F.lit(0), F.ceil(F.col("height") / band_rows).cast("int") - 1)))
    first, last = F.greatest(F.col("band") * band_rows - HALO, F.lit(0)), F.least((F.col("band") + 1) * band_rows + HALO, F.col("height"))
    own = F.least(F.lit(band_rows), F.col("height") - F.col("band") * band_rows)
    line = F.col("width") * COLOURS
    cut = bands.select(KEY, "frame_index", "time", "width", (last - first).alias("height"), F.substring("pixels", first * line + 1, (last - first) * line).alias("pixels"), "band", (F.col("band") * band_rows - first).alias("above"), own.alias("own"))
    dealt = cut.repartition(KEY, "band").sortWithinPartitions(KEY, "band", "frame_index", "pixels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, model = None, None
        for batch in batches:
            keys = list(zip(*(batch[c].to_pylist() for c in (KEY, "band", "width", "height", "above", "own")), strict=True))
            index = batch["frame_index"].to_pylist()
            stack: dict[int, np.ndarray] = {}
            for rows, frames_of in _stacks(batch, COLOURS) if batch.num_rows else ():
                stack |= dict(zip(rows.tolist(), frames_of, strict=True))
            counts = []
            for k, key in enumerate(keys):
                _, _, w, h, above, rows_of = key
                if key != state:
                    state, model = key, kernels.Mixture(w * h, COLOURS, history, threshold, ratio, shadows, rate)
                mask = model.apply(stack[k].reshape(-1, COLOURS))
                if index[k] >= warm:
                    seen = kernels.opened((mask == kernels.FOREGROUND).reshape(1, h, w))[0, above : above + rows_of]
                    counts.append((k, int(seen.sum()), w * rows_of))
            rows = pa.array([c[0] for c in counts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch[c].take(rows) for c in (KEY, "frame_index", "time")), pa.array([c[1] for c in counts], pa.int64()), pa.array([c[2] for c in counts], pa.int64())], names=[KEY, "frame_index", "time", "n", "size"])

    counted = dealt.mapInArrow(run, "video_id string, frame_index long, time double, n long, size long")
    whole = counted.groupBy(KEY, "frame_index").agg(F.min("time").alias("time"), (F.sum("n") / F.sum("size")).alias("value"))
    if keep_times:
        return whole
    return whole.join(videos.select(KEY, "fps"), KEY).select(KEY, index.alias("frame_index"), (index / F.col("fps")).alias("time"), "value")


def _of_pairs(frames: DataFrame, step: int, segment: int, figure: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(video_id, frame_index, time, value): figure(frames before, frames) of grey frames and those step before them.

    A video is cut into segments; the last frame of one is the next one's first, so that no pair is lost and no task needs a
    whole video. A frame whose predecessor isn't there, or has another size, gives no row.
    """
    place = F.floor(F.col("frame_index") / step).cast("long")
    home = F.floor(place / segment).cast("long")
    dealt = frames.withColumn("segment", F.explode(F.when(F.pmod(place, F.lit(segment)) == segment - 1, F.array(home, home + 1)).otherwise(F.array(home))))
    dealt = dealt.repartition(KEY, "segment").sortWithinPartitions(KEY, "segment", "frame_index", "pixels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the frame before the batch
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch[c].to_pylist() for c in (KEY, "segment", "width", "height", "frame_index")), strict=True))
            stack: list = [None] * len(keys)
            for rows, frames_of in _stacks(batch, 1):
                for k, x in zip(rows.tolist(), frames_of, strict=True):
                    stack[k] = x
            if last is not None:
                keys, stack = [last[0], *keys], [last[1], *stack]
            behind = len(keys) - batch.num_rows
            pairs = [k for k in range(1, len(keys)) if keys[k][:4] == keys[k - 1][:4] and keys[k][4] - keys[k - 1][4] == step]
            value = np.zeros(len(pairs))
            for shape in {keys[k][2:4] for k in pairs}:
                some = [i for i, k in enumerate(pairs) if keys[k][2:4] == shape]
                value[some] = figure(np.stack([stack[pairs[i] - 1] for i in some]), np.stack([stack[pairs[i]] for i in some]))
            last = keys[-1], stack[-1].copy()
            rows = pa.array([k - behind for k in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch[c].take(rows) for c in (KEY, "frame_index", "time")), pa.array(value)], names=[KEY, "frame_index", "time", "value"])

    return dealt.mapInArrow(run, VALUE)


def differences(frames: DataFrame, width: int = 320, step: int = 1, segment: int = 256) -> DataFrame:
    """(video_id, frame_index, time, value): the mean absolute change of a grey frame's pixels from the frame before, of every step-th one."""

    def figure(before: np.ndarray, after: np.ndarray) -> np.ndarray:
        return np.abs(after.astype(np.int16) - before).mean(axis=(1, 2))

    return _of_pairs(grey(sampled(frames, step), width), max(1, step), segment, figure)


#: Pixels whose flow is worked out at a time.
FLOW_CELLS = 1 << 18


def flow_changes(frames: DataFrame, width: int = 320, step: int = 1, threshold: float = 0.1, segment: int = 64, **how: float) -> DataFrame:
    """(video_id, frame_index, time, value): the share of pixels whose optical flow from the frame before, of every step-th one,
    exceeds this part of the largest; 0 where nothing moves. how: settings of pixels.optical_flow()."""

    def figure(before: np.ndarray, after: np.ndarray) -> np.ndarray:
        out = []
        most = max(1, FLOW_CELLS // before[0].size)
        for k in range(0, len(before), most):
            flow = kernels.optical_flow(before[k : k + most], after[k : k + most], **how)
            size = np.hypot(flow[0], flow[1])
            top = size.max(axis=(1, 2), keepdims=True)
            out.append(np.where(top[:, 0, 0] > 0, (size > threshold * top).mean(axis=(1, 2)), 0.0))
        return np.concatenate(out)

    return _of_pairs(grey(sampled(frames, step), width), max(1, step), segment, figure)
