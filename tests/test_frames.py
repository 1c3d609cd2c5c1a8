"""Figures of pixels against plain loops over them."""

import colorsys
import math

import numpy as np
import pytest

from glimmer.functions import pixels
from glimmer.operators import frames, scenes

FRAMES = frames.FRAME


def table(spark, stacks, fps=25.0):
    """{video: stack of frames}."""
    rows = [(v, k, k / fps, x.shape[1], x.shape[0], x.tobytes()) for v, stack in stacks.items() for k, x in enumerate(stack)]
    return spark.createDataFrame(rows, FRAMES)


def noise(rng, n, h, w):
    return rng.integers(0, 256, (n, h, w, 3)).astype(np.uint8)


def area(image, width):
    h, w = image.shape
    height = int(width / w * h)
    out = np.zeros((height, width))
    for y in range(height):
        for x in range(width):
            y0, y1, x0, x1 = y * h / height, (y + 1) * h / height, x * w / width, (x + 1) * w / width
            total = 0.0
            for i in range(h):
                for j in range(w):
                    total += image[i, j] * max(0, min(i + 1, y1) - max(i, y0)) * max(0, min(j + 1, x1) - max(j, x0))
            out[y, x] = total / ((y1 - y0) * (x1 - x0))
    return out


@pytest.mark.parametrize(("h", "w", "width"), [(9, 12, 5), (6, 10, 4), (5, 4, 7), (4, 6, 6)])
def test_grey_and_area(spark, h, w, width):
    stack = noise(np.random.default_rng(h), 3, h, w)
    got = frames.grey(table(spark, {"a": stack}), width).orderBy("frame_index").collect()
    for row, frame in zip(got, stack, strict=True):
        luma = np.rint(frame @ np.array([0.114, 0.587, 0.299]))
        exact = area(luma, width) if width != w else luma
        found = np.frombuffer(row["pixels"], np.uint8).reshape(row["height"], row["width"])
        assert found.shape == exact.shape and np.abs(found - exact).max() <= 1.5


def test_broken_frames_are_left_out(spark):
    rows = [("a", 0, 0.0, 2, 1, b"123456"), ("a", 1, 0.0, 2, 1, b"12345"), ("a", 2, 0.0, 2, 1, None), ("a", 3, 0.0, 0, 0, b""), ("a", 4, None, 2, 1, b"654321"), ("a", 5, 0.1, 1, 1, b"abc")]
    df = spark.createDataFrame(rows, FRAMES)
    assert sorted(r["frame_index"] for r in frames.grey(df, 0).collect()) == [0, 4, 5]
    assert sorted(r["frame_index"] for r in frames.histograms(df, (2, 2)).collect()) == [0, 4, 5]
    assert frames.differences(df, 0).collect() == [] and frames.grey(df.limit(0)).count() == 0


def test_hue_saturation_value_is_that_of_the_formula():
    rng = np.random.default_rng(0)
    some = np.concatenate((rng.integers(0, 256, (500, 3)), [[0, 0, 0], [255, 255, 255], [255, 0, 0], [0, 255, 0], [0, 0, 255], [7, 7, 7]])).astype(np.uint8)
    got = pixels.hue_saturation_value(some[None, None])[0, 0]
    for (b, g, r), (h, s, v) in zip(some.tolist(), got.tolist(), strict=True):
        hue, sat, val = colorsys.rgb_to_hsv(r / 255, g / 255, b / 255)
        assert v == round(val * 255) and abs(s - sat * 255) <= 1
        assert s == 0 or min(abs(h - hue * 180), 180 - abs(h - hue * 180)) <= 1


def test_histograms_feed_shots(spark):
    rng = np.random.default_rng(1)
    dark, light = rng.integers(0, 60, (1, 9, 16, 3)), rng.integers(180, 256, (1, 9, 16, 3))
    stack = np.concatenate([dark] * 4 + [light] * 4).astype(np.uint8)
    hist = frames.histograms(table(spark, {"a": stack}), (16, 9))
    row = hist.where("frame_index = 0").first()["hist"]
    hsv = pixels.hue_saturation_value(stack[:1])[0].reshape(-1, 3)
    for c, top in enumerate((180, 256, 256)):
        counts = np.array([sum(b == v * 32 // top for v in hsv[:, c].tolist()) for b in range(32)], float)
        assert np.allclose(row[32 * c : 32 * c + 32], counts / np.linalg.norm(counts))
    cuts = scenes.shot_boundaries(scenes.shot_scores(hist), 0.5, 0.1)
    assert sorted(r["time"] for r in cuts.collect()) == [0.0, 4 / 25]


def test_opening_is_that_of_loops(spark):
    rng = np.random.default_rng(2)
    masks = rng.choice(np.array([0, 127, 255, 255, 255], np.uint8), (6, 7, 5))

    def slow(mask):
        on = {(y, x) for y in range(7) for x in range(5) if mask[y, x] == 255}
        cross = ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))
        inside = lambda y, x: 0 <= y < 7 and 0 <= x < 5
        worn = {(y, x) for y, x in on if all((y + a, x + b) in on or not inside(y + a, x + b) for a, b in cross)}
        return len({(y, x) for y in range(7) for x in range(5) if any((y + a, x + b) in worn for a, b in cross)}) / 35

    df = spark.createDataFrame([("m", k, k / 25, 5, 7, m.tobytes()) for k, m in enumerate(masks)], FRAMES)
    got = {r["frame_index"]: r["value"] for r in frames.opened_fraction(df).collect()}
    assert got == pytest.approx({k: slow(m) for k, m in enumerate(masks)})


class Pixel:
    """One pixel's mixture, mode by mode."""

    def __init__(self, history, threshold, ratio, shadows):
        self.modes, self.history, self.threshold, self.ratio, self.shadows, self.seen = [], history, threshold, ratio, shadows, 0

    def apply(self, x):
        self.seen += 1
        a = 1 / min(2 * self.seen, self.history)
        background, fitted, total = False, False, 0.0
        for mode in self.modes:
            mode["w"] = (1 - a) * mode["w"] - a * 0.05
            if not fitted:
                off = [m - v for m, v in zip(mode["m"], x, strict=True)]
                square = sum(o * o for o in off)
                if total < self.ratio and square < self.threshold * mode["v"]:
                    background = True
                total += mode["w"]
                if square < 9.0 * mode["v"]:
                    fitted = True
                    mode["w"] += a
                    k = a / mode["w"]
                    mode["m"] = [m - k * o for m, o in zip(mode["m"], off, strict=True)]
                    mode["v"] = min(75.0, max(4.0, mode["v"] + k * (square - mode["v"])))
        self.modes = [m for m in self.modes if m["w"] >= a * 0.05]
        whole = sum(m["w"] for m in self.modes)
        for m in self.modes:
            m["w"] /= whole
        if not fitted:
            new = {"w": a if self.modes else 1.0, "m": list(map(float, x)), "v": 15.0}
            for m in self.modes:
                m["w"] *= 1 - a
            self.modes = [*self.modes[:4], new]
        self.modes.sort(key=lambda m: -m["w"])
        if background:
            return 0
        if self.shadows:
            before = 0.0
            for m in self.modes:
                up, down = sum(p * q for p, q in zip(m["m"], x, strict=True)), sum(p * p for p in m["m"])
                if before > self.ratio or down == 0:
                    break
                part = up / down
                if 0.5 <= part <= 1 and sum((part * p - q) ** 2 for p, q in zip(m["m"], x, strict=True)) < self.threshold * m["v"] * part * part:
                    return 127
                before += m["w"]
        return 255


def flicker(rng, n, h, w):
    """A still background with a bright block that passes, a shadow, and flicker."""
    base = rng.integers(40, 200, (h, w, 3))
    out = np.clip(base + rng.integers(-3, 4, (n, h, w, 3)), 0, 255)
    for k in range(n):
        at = k % (2 * h)
        out[k, at : at + 3, 1:5] = 250
        out[k, 0, :3] = out[k, 0, :3] * 7 // 10 if k % 5 == 0 else out[k, 0, :3]
    return out.astype(np.uint8)


@pytest.mark.parametrize("shadows", [True, False])
def test_mixture_is_that_of_single_pixels(shadows):
    stack = flicker(np.random.default_rng(3), 40, 6, 7)
    model = pixels.Mixture(42, 3, 30, 16.0, 0.7, shadows)
    each = [Pixel(30, 16.0, 0.7, shadows) for _ in range(42)]
    kinds = set()
    for frame in stack:
        mask = model.apply(frame.reshape(-1, 3)).tolist()
        assert mask == [p.apply(x) for p, x in zip(each, frame.reshape(-1, 3).tolist(), strict=True)]
        kinds |= set(mask)
    assert kinds == ({0, 127, 255} if shadows else {0, 255})


@pytest.mark.parametrize("band_rows", [64, 3, 1])
def test_foreground_of_bands_and_batches_is_that_of_whole_videos(spark, band_rows):
    rng = np.random.default_rng(4)
    stacks = {"a": flicker(rng, 30, 7, 6), "b": flicker(rng, 25, 5, 6), "short": flicker(rng, 4, 5, 6)}
    videos = spark.createDataFrame([(v, 10.0) for v in stacks], "video_id string, fps double")
    want = {}
    for v, stack in stacks.items():
        h, w = stack.shape[1:3]
        model = pixels.Mixture(h * w, 3, 12, 16.0, 0.7)
        for k, frame in enumerate(stack):
            if k < 6 or (k - 6) % 2 == 0:
                mask = model.apply(frame.reshape(-1, 3)).reshape(1, h, w)
                if k >= 6:
                    want[(v, k - 6)] = ((k - 6) / 10, pixels.opened(mask == 255).mean())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = frames.foreground(table(spark, stacks), videos, width=0, step=2, history=12, band_rows=band_rows).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(r["video_id"], r["frame_index"]): (r["time"], r["value"]) for r in found}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert any(v for _, v in want.values())


def test_expansion_is_least_squares():
    rng = np.random.default_rng(5)
    image = rng.normal(size=(1, 30, 30)) * 20
    got = pixels.expansion(image, 3, 1.2)[:, 0, 12, 17]
    at = np.arange(-3, 4)
    ys, xs = np.meshgrid(at, at, indexing="ij")
    weight = np.sqrt(np.exp(-(xs**2 + ys**2) / (2 * 1.2**2))).ravel()
    basis = np.stack([np.ones(49), xs.ravel(), ys.ravel(), xs.ravel() ** 2, ys.ravel() ** 2, (xs * ys).ravel()], axis=1)
    fit = np.linalg.lstsq(basis * weight[:, None], image[0, 9:16, 14:21].ravel() * weight, rcond=None)[0]
    assert np.allclose(got, fit[1:])


@pytest.mark.parametrize("by", [(0.7, -0.4), (6.0, 3.0), (-9.0, 5.0)])
def test_flow_finds_a_shift(by):
    """A smooth picture that moves, by more than a neighbourhood as well: coarser levels find that."""
    rng = np.random.default_rng(6)
    waves = [(rng.uniform(0.05, 0.35), rng.uniform(0.05, 0.35), rng.uniform(0, 6)) for _ in range(12)]
    y, x = np.mgrid[0:96, 0:128].astype(float)
    picture = lambda dx, dy: 128 + 9 * sum(np.sin(a * (x - dx) + b * (y - dy) + c) for a, b, c in waves)
    flow = pixels.optical_flow(picture(0, 0)[None], picture(*by)[None])[:, 0, 24:-24, 24:-24]
    assert np.abs(np.median(flow[0]) - by[0]) < 0.2 and np.abs(np.median(flow[1]) - by[1]) < 0.2


@pytest.mark.parametrize("segment", [1, 3, 50])
def test_pairs_over_segments_and_batches(spark, segment):
    rng = np.random.default_rng(7)
    stacks = {"a": noise(rng, 20, 12, 14), "b": noise(rng, 3, 8, 8), "one": noise(rng, 1, 8, 8)}
    df = table(spark, stacks)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        diff = frames.differences(df, 0, step=2, segment=segment).collect()
        moved = frames.flow_changes(df, 0, segment=segment, window=5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    gray = {v: pixels.grey(x) for v, x in stacks.items()}
    want = {(v, k): np.abs(g[k].astype(int) - g[k - 2]).mean() for v, g in gray.items() for k in range(2, len(g), 2)}
    assert {(r["video_id"], r["frame_index"]): r["value"] for r in diff} == pytest.approx(want)
    want = {}
    for v, g in gray.items():
        for k in range(1, len(g)):
            flow = pixels.optical_flow(g[k - 1 : k], g[k : k + 1], window=5)
            size = np.hypot(*flow)[0]
            want[(v, k)] = (size / size.max() > 0.1).mean()
    assert {(r["video_id"], r["frame_index"]): r["value"] for r in moved} == pytest.approx(want)
    still = np.repeat(noise(rng, 1, 8, 8), 3, axis=0)
    assert [r["value"] for r in frames.flow_changes(table(spark, {"s": still}), 0).collect()] == [0.0, 0.0]
    assert not math.isnan(diff[0]["value"])


def test_queries_are_those_of_whole_videos(spark):
    from glimmer.plans import queries
    from glimmer.sources import tables

    data = "/root/testdata/sf0.001"
    shots = {}
    for r in tables.byte_frames(spark, data).collect():
        shots.setdefault(r["video_id"], {})[r["frame_index"]] = np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], 3)
    models, flows = {}, {}
    for v, by_index in shots.items():
        stack = np.stack([by_index[k] for k in range(len(by_index))])
        small = pixels.area_resized(stack, 8)
        model = pixels.Mixture(small[0].size // 3, 3, 12, 16.0, 0.7)
        for k, frame in enumerate(small):
            if k < 6 or (k - 6) % 2 == 0:
                mask = model.apply(frame.reshape(-1, 3)).reshape(1, *frame.shape[:2])
                if k >= 6:
                    models[(v, k - 6)] = pixels.opened(mask == 255).mean()
        luma = pixels.grey(stack)
        if len(luma) > 1:
            size = np.hypot(*pixels.optical_flow(luma[:-1], luma[1:], window=5))
            flows |= {(v, k + 1): (s > 0.1 * s.max()).mean() if s.max() > 0 else 0.0 for k, s in enumerate(size)}
    for query, want in ((queries.w3_background_model, models), (queries.w2_optical_flow, flows)):
        got = {(r["video_id"], r["frame_index"]): r["value"] for r in query(spark, data).collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-6
