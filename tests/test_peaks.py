"""Peaks and dissimilarity against plain searches."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.functions import peaks
from glimmer.operators import audio, scenes


def slow_tops(x):
    out, i = [], 1
    while i < len(x) - 1:
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            out.append((i + j) // 2)
        i = j + 1
    return out


def slow_apart(x, at, distance):
    kept = []
    for i in sorted(at, key=lambda i: (-x[i], -i)):
        if all(abs(i - k) >= distance for k in kept):
            kept.append(i)
    return sorted(kept)


def slow_prominence(x, i):
    sides = []
    for side in (x[:i][::-1], x[i + 1 :]):
        least = x[i]
        for v in side:
            if v > x[i]:
                break
            least = min(least, v)
        sides.append(least)
    return x[i] - max(sides)


@pytest.mark.parametrize("seed", range(6))
def test_kernels(seed):
    rng = np.random.default_rng(seed)
    for n in (0, 1, 2, 3, 7, 64, 65, 200):
        x = rng.integers(0, 2 + seed * 20, n).astype(float)
        at = peaks.tops(x)
        assert at.tolist() == slow_tops(x.tolist())
        for distance in (1, 2, 5, 40):
            assert peaks.apart(x, at, distance).tolist() == slow_apart(x.tolist(), at.tolist(), distance)
        assert peaks.prominences(x, at).tolist() == [slow_prominence(x.tolist(), i) for i in at.tolist()]


def test_long_series_take_linear_log_time():
    def seconds(n):
        x = np.random.default_rng(0).random(n)
        began = time.perf_counter()
        at = peaks.tops(x)
        peaks.prominences(x, peaks.apart(x, at, 50))
        return time.perf_counter() - began

    seconds(20_000)
    assert seconds(800_000) < 20 * max(seconds(200_000), 0.05)


def test_prominent_peaks_skip_nulls_and_short_series(spark):
    rows = [("a", float(k), float(v)) for k, v in enumerate([0, 3, 0, 1, 0, 2, 0])] + [("a", None, 9.0), ("a", 2.5, None), ("b", 0.0, 1.0), ("b", 1.0, 2.0)]
    found = audio.prominent_peaks(spark.createDataFrame(rows, "video_id string, time double, score double"), 0.5, 1.0, 1.5)
    assert sorted((r["video_id"], r["time"]) for r in found.collect()) == [("a", 1.0), ("a", 5.0)]


def test_dissimilarity_is_one_less_correlation(spark):
    rng = np.random.default_rng(1)
    pairs = [(rng.normal(size=40).tolist(), rng.normal(size=40).tolist()) for _ in range(20)] + [((1e6 + rng.random(30)).tolist(), (1e6 + rng.random(30)).tolist())]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a array<double>, b array<double>")
    got = [r[0] for r in rows.orderBy("k").select(scenes.dissimilarity(F.col("a"), F.col("b"))).collect()]
    assert np.allclose(got, [min(1, max(0, 1 - np.corrcoef(a, b)[0, 1])) for a, b in pairs], atol=1e-9)
    odd = spark.createDataFrame([([1.0], None), ([1.0, 2.0], [1.0]), ([2.0, 2.0], [2.0, 2.0]), ([2.0, 2.0], [3.0, 3.0]), ([], []), ([1.0, None], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in odd.select(scenes.dissimilarity(F.col("a"), F.col("b"))).collect()] == [None, None, 0.0, 1.0, 0.0, None]


def test_dissimilarity_of_long_arrays_is_linear(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(rng.random(768).tolist(), rng.random(768).tolist()) for _ in range(2000)], "a array<double>, b array<double>").cache()
    rows.count()
    began = time.perf_counter()
    rows.select(scenes.dissimilarity(F.col("a"), F.col("b")).alias("d")).agg(F.sum("d")).collect()
    rows.unpersist()
    assert time.perf_counter() - began < 20
