"""Audio figures per frame, and loud events."""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.functions import peaks
from glimmer.functions.expressions import clip, sigmoid
from glimmer.operators import series
from glimmer.operators.series import KEY, by_video, everything


#: Chunks of a video's mono samples: all but the last are of one length.
CHUNKS = "video_id string, chunk long, start long, rate int, samples array<double>"
#: Zero crossings of the interpolating sinc to each side.
CROSSINGS = 16


def filter_bank(rate: int, target: int, crossings: int = CROSSINGS) -> tuple[np.ndarray, int]:
    """(phases x taps, reach): weights of the samples from reach before a new sample's place to reach after it, for each
    place between two samples that occurs. A sinc of the lower rate's band under a Hann window; weights of a phase add up to 1."""
    down = min(1.0, target / rate)
    phases = target // gcd(rate, target)
    reach = int(np.ceil(crossings / down))
    apart = np.arange(phases)[:, None] / phases - np.arange(-reach, reach + 2)
    inside = np.abs(apart) < crossings / down
    bank = np.where(inside, np.sinc(apart * down) * (0.5 + 0.5 * np.cos(np.pi * apart * down / crossings)), 0.0)
    return bank / bank.sum(axis=1, keepdims=True), reach


def resampled(chunks: DataFrame, target: int, crossings: int = CROSSINGS) -> DataFrame:
    """chunks (video_id, chunk, start, rate, samples) at another rate: the same columns, start counted in new samples.

    New sample n lies at n * rate / target; beyond both ends there is silence. A chunk gets as many samples of its
    neighbours as the filter reaches, by their numbers, so that chunks of one video are worked on anywhere and the result is that of the
    whole. Chunks but the last have to be longer than that reach (an error, else). All new samples of
    N old ones are ceil(N * target / rate). A chunk that holds no place of a new sample gives an empty row.
    """
    key = [KEY, "chunk"]
    most = F.ceil(F.lit(float(crossings)) * F.greatest(F.lit(1.0), F.col("rate") / target)).cast("int") + 2
    size = F.size("samples")
    slim = chunks.select(KEY, "chunk", "start", "rate", "samples")
    tails = slim.select(KEY, (F.col("chunk") + 1).alias("chunk"), F.slice("samples", F.greatest(size - most + 1, F.lit(1)), most).alias("before"), (size >= most).alias("enough"))
    heads = slim.select(KEY, (F.col("chunk") - 1).alias("chunk"), F.slice("samples", F.lit(1), most).alias("after"))
    none = F.array().cast("array<double>")
    long = F.when(F.col("enough") | (F.col("chunk") == 0) | F.col("enough").isNull(), F.lit(True)).otherwise(F.raise_error(F.lit("a chunk is shorter than the filter")).cast("boolean"))
    whole = slim.join(tails, key, "left").join(heads, key, "left").where(long).select(*slim.columns, F.coalesce("before", none).alias("before"), F.coalesce("after", none).alias("after"))
    banks: dict[int, tuple[np.ndarray, int]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, out = [], []
            for start, rate, samples, before, after in zip(batch["start"].to_pylist(), batch["rate"].to_pylist(), *(batch[c] for c in ("samples", "before", "after")), strict=True):
                parts = [np.asarray(x.values, float) for x in (before, samples, after)]
                first, end = -(-start * target // rate), -(-(start + len(parts[1])) * target // rate)
                n = np.arange(first, end)
                starts.append(first)
                if rate not in banks:
                    banks[rate] = filter_bank(rate, target, crossings)
                bank, reach = banks[rate]
                wide = np.concatenate((np.zeros(reach + 2), *parts, np.zeros(reach + 2)))
                at = n * rate // target - start + len(parts[0]) + 2  # the first of the samples that are looked at
                seen = np.lib.stride_tricks.sliding_window_view(wide, bank.shape[1])[at]
                out.append((seen * bank[n * rate % target // gcd(rate, target)]).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch[KEY], batch["chunk"], pa.array(starts, pa.int64()), pa.array([target] * batch.num_rows, pa.int32()), pa.array(out, pa.list_(pa.float64()))], names=[KEY, "chunk", "start", "rate", "samples"])

    return whole.mapInArrow(run, CHUNKS)


def sample_rows(chunks: DataFrame) -> DataFrame:
    """(video_id, index, value): the samples of chunks, a row each."""
    return chunks.select(KEY, "start", F.posexplode("samples").alias("k", "value")).select(KEY, (F.col("start") + F.col("k")).alias("index"), "value")


def window_rms(samples: DataFrame, size: int, hop: int) -> DataFrame:
    """(video_id, frame, rms) of samples (video_id, index, value): each sample goes to the frames that hold it."""
    last = F.floor(F.col("index") / hop).cast("long")
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("index") - size + 1) / hop).cast("long"))
    held = samples.select(KEY, "value", F.explode(F.sequence(first, last)).alias("frame")).where(first <= last)
    return held.groupBy(KEY, "frame").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))


def features(frames: DataFrame, points: int, width: float, threshold: float | None = None) -> DataFrame:
    """frames (video_id, time, rms) as (video_id, time, loudness, energy, speech_probability).

    Loudness is the scaled level, energy its scaled square, both smoothed afterwards. Speech is a sigmoid around the
    threshold, by default the video's median loudness.
    """
    scaled = frames.select(KEY, "time", series.unit_range(F.col("rms")).alias("loudness"), series.unit_range(F.col("rms") * F.col("rms")).alias("energy"))
    smooth = scaled.select(KEY, "time", *[series.smoothed(c, points, "time").alias(c) for c in ("loudness", "energy")])
    level = clip(F.lit(float(threshold)) if threshold is not None else F.median("loudness").over(everything()))
    return smooth.withColumn("speech_probability", sigmoid(F.col("loudness"), level, width))


def on_loudness_times(loudness: DataFrame, energy: DataFrame) -> DataFrame:
    """loudness, energy (video_id, time, value), sampled differently, as (video_id, time, loudness, energy).

    Energy is interpolated at the times of loudness, 0 outside its points. Videos without points of either are left out.
    """
    loud, power = series.valid_points(loudness), series.valid_points(energy, keep_nan=False)
    both = loud.join(power.select(KEY).distinct(), KEY, "left_semi").select(KEY, "time", F.col("value").alias("loudness"))
    return series.interpolate(power, both, "energy")


def loud_score(frames: DataFrame) -> DataFrame:
    """frames (video_id, time, loudness, energy) with score: 0.6 of scaled loudness and 0.4 of scaled energy, clipped."""
    return frames.withColumn("score", clip(0.6 * series.unit_range(F.col("loudness")) + 0.4 * series.unit_range(F.col("energy"))))


def sampling_interval(frames: DataFrame) -> DataFrame:
    """(video_id, dt): the median distance of neighbouring times, 0.001 at least."""
    gap = F.col("time") - F.lag("time").over(by_video("time"))
    return frames.select(KEY, gap.alias("gap")).groupBy(KEY).agg(F.greatest(F.coalesce(F.median("gap"), F.lit(0.1)), F.lit(1e-3)).alias("dt"))


def simple_peaks(scored: DataFrame, threshold: float) -> DataFrame:
    """Rows at or over the threshold that exceed the row before and aren't below the row after; no edges."""
    left, right = F.lag("score").over(by_video("time")), F.lead("score").over(by_video("time"))
    return scored.withColumn("l", left).withColumn("r", right).where((F.col("score") >= threshold) & (F.col("score") > F.col("l")) & (F.col("score") >= F.col("r"))).drop("l", "r")


def prominent_peaks(scored: DataFrame, threshold: float, min_gap: float, prominence: float) -> DataFrame:
    """(video_id, time, score): local maxima by height, then distance (higher ones win), then prominence.

    A flat top counts once, at its middle sample (the earlier of two). Distance is in samples: the gap divided by
    the median interval. Prominence is the height over the higher of the two lowest points on either side, up to
    the next sample that is higher. A video's scores are one series, as long as the video, in one task; its work is linear-log.
    Null times and scores are left out; a video of fewer than three has no peaks.
    """

    def find(table: pa.Table) -> pa.Table:
        table = table.sort_by([("time", "ascending"), ("score", "ascending")])
        time, x = (table[c].to_numpy() for c in ("time", "score"))
        if len(x) < 3:
            return table.slice(0, 0)
        distance = max(1, int(np.floor(min_gap / max(1e-3, float(np.median(np.diff(time)))))))
        at = peaks.tops(x)
        at = peaks.apart(x, at[x[at] >= threshold], distance)
        return table.take(at[peaks.prominences(x, at) >= prominence])

    clean = scored.where(F.col("time").isNotNull() & F.col("score").isNotNull()).select(F.col(KEY).cast("string").alias(KEY), F.col("time").cast("double").alias("time"), F.col("score").cast("double").alias("score"))
    return clean.groupBy(KEY).applyInArrow(find, "video_id string, time double, score double")


def extents(scored: DataFrame, found: DataFrame, threshold: float, min_duration: float) -> DataFrame:
    """Loud events: each peak widened to the first samples below max(0.85 threshold, 0.05), or the series' ends.

    Shorter ones become a window of max(min_duration / 2, the sampling interval) to each side, from 0 on.
    """
    floor = max(threshold * 0.85, 0.05)
    low = F.when(F.col("score") < floor, F.col("time"))
    order = by_video("time")
    sides = scored.select(
        KEY, "time",
        F.coalesce(F.last(low, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.min("time").over(by_video())).alias("left"),
        F.coalesce(F.last(low, ignorenulls=True).over(by_video(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)), F.max("time").over(by_video())).alias("right"),
    )
    wide = found.select(KEY, "time", "score").join(sides, [KEY, "time"]).join(sampling_interval(scored), KEY)
    half = F.greatest(F.lit(min_duration / 2), F.col("dt"))
    short = F.col("right") - F.col("left") < min_duration
    start = F.when(short, F.greatest(F.lit(0.0), F.col("time") - half)).otherwise(F.col("left"))
    end = F.when(short, F.col("time") + half).otherwise(F.col("right"))
    return wide.select(KEY, start.alias("start"), end.alias("end"), "time", F.lit("loud_event").alias("type"), clip(F.col("score")).alias("confidence"), F.col("score").alias("peak_value"))
