"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(x: Column, centre: Column, width: float) -> Column:
    return 1 / (1 + F.exp(-(x - centre) / F.lit(max(float(width), 1e-6))))


def strip(text: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def capitalize(text: Column) -> Column:
    """First letter in upper case, all others in lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1_000_000_000)))


#: Steps of a search in a sorted array of up to 2**24 entries.
_JUMPS = [1 << k for k in range(23, -1, -1)]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def count_before(items: Column, t: Column, time: Callable[[Column], Column] = lambda x: x, inclusive: bool = False) -> Column:
    """How many entries of an array sorted by time lie before t (inclusive: or at it), by bisection."""

    def step(low: Column, jump: Column) -> Column:
        x = time(F.get(items, low + jump - 1))
        return F.when((low + jump <= F.size(items)) & (x <= t if inclusive else x < t), low + jump).otherwise(low)

    return F.aggregate(F.array(*[F.lit(j) for j in _JUMPS]), F.lit(0), step)


def nearest(times: Column, t: Column) -> Column:
    """The entry of a sorted array that is nearest to t, the smaller on ties; null if there is none."""

    def near(i: Column) -> Column:
        low, high = F.get(times, i - 1), F.get(times, i)
        return F.when(low.isNull() | (high - t < t - low), high).otherwise(low)

    return bound(count_before(times, t), near)


def slot_of(t: Column, step: float, slots: Column) -> Column:
    """The grid slot nearest to t, halves to the even one, clamped to the grid."""
    return F.least(F.greatest(F.rint(t / F.lit(step)).cast("long"), F.lit(0)), slots - 1)


def signed_confidence(label: Column, confidence: Column) -> Column:
    """A classifier's label and confidence as a score from -1 to 1; positive names come before negative ones."""
    sure, name = clip(confidence), F.upper(label)
    return (
        F.when(name.contains("POS"), sure)
        .when(name.contains("NEG"), -sure)
        .when(name == "LABEL_2", sure)
        .when(name == "LABEL_0", -sure)
        .otherwise(F.lit(0.0))
    )
