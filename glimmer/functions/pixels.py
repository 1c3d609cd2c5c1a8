"""Kernels on stacks of frames: numpy arrays (frames, height, width[, channels]) of one size, worked as a whole."""

from __future__ import annotations

import numpy as np

# ---- fixed values of BT.601 luma in 15 bits: blue, green, red, and half of the last bit's weight
BLUE, GREEN, RED, LUMA_BITS = 3735, 19235, 9798, 15


def grey(frames: np.ndarray) -> np.ndarray:
    """Luma of BGR frames, rounded."""
    wide = frames.astype(np.int32)
    return ((wide[..., 0] * BLUE + wide[..., 1] * GREEN + wide[..., 2] * RED + (1 << (LUMA_BITS - 1))) >> LUMA_BITS).astype(np.uint8)


def area_taps(size: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(sources, weights), wanted x taps: how much of each source cell lies under each new cell; the weights of one add up to 1."""
    edges = np.arange(wanted + 1) * (size / wanted)
    first = np.floor(edges[:-1]).astype(np.int64)
    taps = int((np.ceil(edges[1:] - 1e-9).astype(np.int64) - first).max())
    at = first[:, None] + np.arange(taps)
    share = np.clip(np.minimum(at + 1, edges[1:, None]) - np.maximum(at, edges[:-1, None]), 0, None)
    return np.minimum(at, size - 1), share / (size / wanted)


def linear_taps(size: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for linear interpolation between the cells' centres, held at the edges."""
    at = (np.arange(wanted) + 0.5) * (size / wanted) - 0.5
    low = np.floor(at).astype(np.int64)
    part = at - low
    return np.clip(np.stack((low, low + 1), axis=1), 0, size - 1), np.stack((1 - part, part), axis=1)


def weighted(frames: np.ndarray, rows: tuple[np.ndarray, np.ndarray], columns: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sparse weights applied along height and width, a tap at a time, in double precision."""
    for axis, (sources, weights) in ((1, rows), (2, columns)):
        shape = [1] * frames.ndim
        shape[axis] = -1
        frames = sum(frames.take(sources[:, k], axis=axis) * weights[:, k].reshape(shape) for k in range(sources.shape[1]))
    return frames


def to_bytes(frames: np.ndarray) -> np.ndarray:
    """Rounded, halves to the even number, and clipped to a byte."""
    return np.clip(np.rint(frames), 0, 255).astype(np.uint8)


def area_resized(frames: np.ndarray, width: int) -> np.ndarray:
    """To a width, the height in proportion (rounded down, 1 at least); as they are where the width is that already or isn't positive."""
    height, now = frames.shape[1:3]
    if width <= 0 or width == now:
        return frames
    return to_bytes(weighted(frames, area_taps(height, max(1, int(width / now * height))), area_taps(now, width)))


def linear_resized(frames: np.ndarray, width: int, height: int) -> np.ndarray:
    if frames.shape[1:3] == (height, width):
        return frames
    return to_bytes(weighted(frames, linear_taps(frames.shape[1], height), linear_taps(frames.shape[2], width)))


#: Bits of the fixed-point quotients of hue and saturation.
HUE_BITS = 12


def _quotients(top: float) -> np.ndarray:
    """round(top * 2**HUE_BITS / i) for i from 1 to 255; 0 for 0."""
    return np.concatenate(([0], np.rint(top * (1 << HUE_BITS) / np.arange(1, 256)))).astype(np.int32)


_BY_VALUE, _BY_RANGE = _quotients(255), _quotients(30)


def hue_saturation_value(frames: np.ndarray) -> np.ndarray:
    """BGR as hue (half degrees, 0-179), saturation and value."""
    b, g, r = (frames[..., k].astype(np.int32) for k in range(3))
    v = np.maximum(np.maximum(b, g), r)
    spread = v - np.minimum(np.minimum(b, g), r)
    half = 1 << (HUE_BITS - 1)
    s = (spread * _BY_VALUE[v] + half) >> HUE_BITS
    turn = np.where(v == r, g - b, np.where(v == g, b - r + 2 * spread, r - g + 4 * spread))
    h = (turn * _BY_RANGE[spread] + half) >> HUE_BITS
    return np.stack((np.where(h < 0, h + 180, h), s, v), axis=-1).astype(np.uint8)


def channel_histograms(frames: np.ndarray, bins: int = 32, tops: tuple[int, ...] = (180, 256, 256)) -> np.ndarray:
    """Frames x (bins of each channel in a row), each channel's counts over their Euclidean norm."""
    n = len(frames)
    out = []
    for c, top in enumerate(tops):
        bin_of = (np.arange(256) * bins // top)[frames[..., c].reshape(n, -1)] + np.arange(n)[:, None] * bins
        counts = np.bincount(bin_of.ravel(), minlength=n * bins).reshape(n, bins).astype(float)
        norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        out.append(np.divide(counts, norm, out=np.zeros_like(counts), where=norm > 0))
    return np.concatenate(out, axis=1)


def opened(masks: np.ndarray) -> np.ndarray:
    """Erosion, then dilation, by a cell and its four neighbours (the ellipse of 3 x 3); beyond the edges nothing counts."""

    def around(x: np.ndarray, outside: bool, join: np.ufunc) -> np.ndarray:
        wide = np.pad(x, ((0, 0), (1, 1), (1, 1)), constant_values=outside)
        out = x.copy()
        for part in (wide[:, :-2, 1:-1], wide[:, 2:, 1:-1], wide[:, 1:-1, :-2], wide[:, 1:-1, 2:]):
            out = join(out, part)
        return out

    return around(around(masks, True, np.logical_and), False, np.logical_or)


FOREGROUND, SHADOW = 255, 127


class Mixture:
    """An adaptive Gaussian mixture per pixel (Zivkovic, 2004): modes by weight, each with a mean and one variance.

    A pixel is background if it is near one of the heaviest modes that together make up `ratio`. The first mode that it
    fits learns from it; where none does it founds one in the place of the lightest. All modes fade, and those that
    fade below nothing go. A foreground pixel that is a darker copy of a background mode is a shadow.
    """

    MODES = 5
    FIRST_VARIANCE, LEAST_VARIANCE, MOST_VARIANCE = 15.0, 4.0, 75.0
    NEAR, FADE, DARKEST = 9.0, 0.05, 0.5

    def __init__(self, pixels: int, channels: int, history: int = 500, threshold: float = 16.0, ratio: float = 0.7, shadows: bool = True, rate: float = -1.0):
        self.weight = np.zeros((self.MODES, pixels))
        self.variance = np.zeros((self.MODES, pixels))
        self.mean = np.zeros((self.MODES, pixels, channels))
        self.history, self.threshold, self.ratio, self.shadows, self.rate, self.seen = history, threshold, ratio, shadows, rate, 0

    def apply(self, frame: np.ndarray) -> np.ndarray:
        """The mask (0, SHADOW or FOREGROUND) of a frame, pixels x channels, from which the model then has learned."""
        x = frame.astype(float)
        self.seen += 1
        a = self.rate if self.rate >= 0 and self.seen > 1 else 1 / min(2 * self.seen, self.history)
        pixels = np.arange(len(x))
        there = self.weight > 0
        weight = np.where(there, (1 - a) * self.weight - a * self.FADE, 0.0)
        apart = self.mean - x
        squares = (apart * apart).sum(axis=2)
        fits = there & (squares < self.NEAR * self.variance)
        any_fit = fits.any(axis=0)
        fit = np.where(any_fit, fits.argmax(axis=0), self.MODES)
        tried = there & (np.arange(self.MODES)[:, None] <= fit)
        before = np.cumsum(weight, axis=0) - weight
        background = (tried & (before < self.ratio) & (squares < self.threshold * self.variance)).any(axis=0)
        some, mode = pixels[any_fit], fit[any_fit]
        weight[mode, some] += a
        step = a / weight[mode, some]
        self.mean[mode, some] -= step[:, None] * apart[mode, some]
        self.variance[mode, some] = np.clip(self.variance[mode, some] + step * (squares[mode, some] - self.variance[mode, some]), self.LEAST_VARIANCE, self.MOST_VARIANCE)
        weight[weight < a * self.FADE] = 0
        total = weight.sum(axis=0)
        weight = np.divide(weight, total, out=weight, where=total > 0)
        if a > 0 and not any_fit.all():
            new = pixels[~any_fit]
            live = (weight[:, new] > 0).sum(axis=0)
            slot = np.minimum(live, self.MODES - 1)
            weight[:, new] *= 1 - a
            weight[slot, new] = np.where(live == 0, 1.0, a)
            self.mean[slot, new], self.variance[slot, new] = x[new], self.FIRST_VARIANCE
        order = np.argsort(-weight, axis=0, kind="stable")
        self.weight = np.take_along_axis(weight, order, axis=0)
        self.variance = np.take_along_axis(self.variance, order, axis=0)
        self.mean = np.take_along_axis(self.mean, order[:, :, None], axis=0)
        mask = np.where(background, 0, FOREGROUND).astype(np.uint8)
        if self.shadows and not background.all():
            mask[pixels[~background][self._darker(x[~background], ~background)]] = SHADOW
        return mask

    def _darker(self, x: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Which pixels are a background mode of theirs, darkened by half at most."""
        weight, variance, mean = self.weight[:, where], self.variance[:, where], self.mean[:, where]
        out = np.zeros(len(x), bool)
        before = np.zeros(len(x))
        going = np.ones(len(x), bool)
        for k in range(self.MODES):
            up, down = (mean[k] * x).sum(axis=1), (mean[k] * mean[k]).sum(axis=1)
            going &= (weight[k] > 0) & (down > 0) & (before <= self.ratio)
            part = np.divide(up, down, out=np.zeros(len(x)), where=down > 0)
            off = part[:, None] * mean[k] - x
            out |= going & (part <= 1) & (part >= self.DARKEST) & ((off * off).sum(axis=1) < self.threshold * variance[k] * part * part)
            before += weight[k]
        return out


# ---- optical flow by polynomial expansion (Farnebaeck, 2003)


def _along(x: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Correlation with a kernel of odd length along an axis, the edges repeated."""
    reach = len(kernel) // 2
    wide = np.pad(x, [(reach, reach) if k == axis else (0, 0) for k in range(x.ndim)], mode="edge")
    size = x.shape[axis]
    return sum(kernel[k] * wide.take(np.arange(k, k + size), axis=axis) for k in range(len(kernel)))


def expansion(frames: np.ndarray, reach: int, sigma: float) -> np.ndarray:
    """(5, frames, height, width): x, y, xx, yy and xy of the quadratic that fits each pixel's neighbourhood best, by Gaussian weight."""
    at = np.arange(-reach, reach + 1)
    g = np.exp(-(at**2) / (2 * sigma**2))
    g /= g.sum()
    powers = [(0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1)]
    xs, ys = np.meshgrid(at, at)
    basis = np.stack([(xs**p) * (ys**q) for p, q in powers]).reshape(6, -1).astype(float)
    inverse = np.linalg.inv((basis * np.outer(g, g).ravel()) @ basis.T)
    down = {q: _along(frames, g * at**q, 1) for q in range(3)}
    moments = np.stack([_along(down[q], g * at**p, 2) for p, q in powers])
    return np.tensordot(inverse, moments, axes=1)[1:]


def _shifted(planes: np.ndarray, flow: np.ndarray) -> np.ndarray:
    """planes (k, frames, height, width) looked up where the flow leads, linearly, held at the edges."""
    n, h, w = flow.shape[1:]
    y = np.clip(np.arange(h)[:, None] + flow[1], 0, h - 1)
    x = np.clip(np.arange(w) + flow[0], 0, w - 1)
    top, left = np.minimum(y.astype(np.int64), max(h - 2, 0)), np.minimum(x.astype(np.int64), max(w - 2, 0))
    dy, dx = y - top, x - left
    below, right = np.minimum(top + 1, h - 1), np.minimum(left + 1, w - 1)
    f = np.arange(n)[:, None, None]
    return (planes[:, f, top, left] * (1 - dx) + planes[:, f, top, right] * dx) * (1 - dy) + (planes[:, f, below, left] * (1 - dx) + planes[:, f, below, right] * dx) * dy


def optical_flow(before: np.ndarray, after: np.ndarray, scale: float = 0.5, levels: int = 5, window: int = 15, rounds: int = 3, reach: int = 5, sigma: float = 1.2, least_size: int = 32) -> np.ndarray:
    """(2, frames, height, width): how far each pixel of `before` has gone right and down in `after`, coarse to fine.

    A level halves (by `scale`) the one below while its shorter side has least_size pixels; each takes `rounds` rounds of
    displacement from both expansions, averaged over a window.
    """
    n, h, w = before.shape
    level = 0
    while level + 1 < levels and min(h, w) * scale ** (level + 1) >= least_size:
        level += 1
    flow = None
    box = np.full(window | 1, 1 / (window | 1))
    for k in range(level, -1, -1):
        size = (max(1, round(h * scale**k)), max(1, round(w * scale**k)))
        pair = []
        for frames in (before, after):
            x = frames.astype(float)
            if k:
                blur = (scale**-k - 1) * 0.5
                at = np.arange(-max(1, round(blur * 2.5)), max(1, round(blur * 2.5)) + 1)
                g = np.exp(-(at**2) / (2 * blur**2))
                x = weighted(_along(_along(x, g / g.sum(), 1), g / g.sum(), 2), linear_taps(h, size[0]), linear_taps(w, size[1]))
            pair.append(expansion(x, reach, sigma))
        if flow is None:
            flow = np.zeros((2, n, *size))
        else:
            taps = linear_taps(flow.shape[2], size[0]), linear_taps(flow.shape[3], size[1])
            flow = np.stack([weighted(flow[0], *taps) * (size[1] / flow.shape[3]), weighted(flow[1], *taps) * (size[0] / flow.shape[2])])
        for _ in range(rounds):
            moved = _shifted(pair[1], flow)
            xx, yy, xy = ((pair[0][i] + moved[i]) / 2 for i in (2, 3, 4))
            xy = xy / 2
            bx = (pair[0][0] - moved[0]) / 2 + xx * flow[0] + xy * flow[1]
            by = (pair[0][1] - moved[1]) / 2 + xy * flow[0] + yy * flow[1]
            sums = [_along(_along(p, box, 1), box, 2) for p in (xx * xx + xy * xy, xy * (xx + yy), yy * yy + xy * xy, xx * bx + xy * by, xy * bx + yy * by)]
            g11, g12, g22, h1, h2 = sums
            scaled = 1 / (g11 * g22 - g12 * g12 + 1e-3)
            flow = np.stack(((g22 * h1 - g12 * h2) * scaled, (g11 * h2 - g12 * h1) * scaled))
    return flow
