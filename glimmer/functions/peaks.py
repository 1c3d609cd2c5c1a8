"""Kernels on one series of scores."""

from __future__ import annotations

import numpy as np


def tops(x: np.ndarray) -> np.ndarray:
    """Places of local maxima, edges not among them; a flat top counts once, at its middle (the earlier of two)."""
    if len(x) < 3:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    last = np.concatenate((first[1:], [len(x)])) - 1
    height = x[first]
    up = np.flatnonzero((height[1:-1] > height[:-2]) & (height[1:-1] > height[2:])) + 1
    return (first[up] + last[up]) // 2


def apart(x: np.ndarray, at: np.ndarray, distance: int) -> np.ndarray:
    """Of ascending places those that stay when higher ones (of equal ones the later) take all within less than `distance`.

    A slot of `distance` places holds one kept place at most, so a candidate is held against its own slot and both beside it.
    """
    if distance <= 1:
        return at
    kept: dict[int, int] = {}
    for i in at[np.lexsort((-at, -x[at]))].tolist():
        slot = i // distance
        if all(abs(kept[s] - i) >= distance for s in (slot - 1, slot, slot + 1) if s in kept):
            kept[slot] = i
    return np.array(sorted(kept.values()), np.int64)


def _tables(x: np.ndarray, join: np.ufunc) -> list[np.ndarray]:
    """Level k joins 2**k samples from each place on; len(x) * log of them in all."""
    out = [x]
    while len(out[-1]) > 1 << (len(out) - 1):
        step = 1 << (len(out) - 1)
        out.append(join(out[-1][:-step], out[-1][step:]))
    return out


def prominences(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place its height over the higher of the two lowest points to either side, up to the next higher sample."""
    high, low = _tables(x, np.maximum), _tables(x, np.minimum)
    height = x[at]
    floors = []
    for back in (True, False):
        place, least = at.copy(), height.copy()
        for k in range(len(high) - 1, -1, -1):  # steps that meet no higher sample, the longest first
            step = 1 << k
            start = place - step if back else place + 1
            fits = (start >= 0) & (start < len(high[k]))
            inside = np.clip(start, 0, len(high[k]) - 1)
            go = fits & (high[k][inside] <= height)
            least = np.where(go, np.minimum(least, low[k][inside]), least)
            place = np.where(go, place - step if back else place + step, place)
        floors.append(least)
    return height - np.maximum(*floors)
