"""Order-dependent operators on endless streams: refractory cuts, and merging of intervals with their mean recomputed.

Rows of a video wait in its state until the watermark has passed them, then go through the operator in order of
time; so the result is the batch operator's on the same rows, in whatever order they came within `late`. Rows later than
that are dropped by the watermark. Event-time timers wake a video whose rows are due; state holds what is waiting, the last cut or open
interval, and the points that the open one may still need. Needs the RocksDB state store, which these functions set.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glimmer.operators.series import KEY

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CUTS = "video_id string, time double"
MERGED = "video_id string, start double, end double, score double"
POINT, INTERVAL = 0, 1


def _with_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts)


class _InOrder(StatefulProcessor):
    """Keeps rows until the watermark has passed them. Subclasses say what a row is, and what rows in order do."""

    FIELDS: tuple[str, ...] = ()
    ROW = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.ROW)
        self.seen = handle.getValueState("seen", "seen boolean")

    def close(self) -> None:
        pass

    def first(self, key: str) -> pd.DataFrame:
        """What a video's first row brings about."""
        return self.rows([])

    def advance(self, key: str, rows: list[tuple], watermark: int) -> tuple[list[tuple], int | None]:
        """(output of rows that are due, when to be woken again if no row comes), all in microseconds."""
        raise NotImplementedError

    def rows(self, found: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh = [r for batch in rows for r in batch[list(self.FIELDS)].itertuples(index=False, name=None)]
        if fresh:
            self.pending.appendList(fresh)
            self._wake(min(r[0] for r in fresh))
        if not self.seen.exists():
            self.seen.update((True,))
            yield self.first(key[0])
        else:
            yield self.rows([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(r) for r in self.pending.get()] if self.pending.exists() else []
        due = sorted(r for r in waiting if r[0] <= watermark)
        rest = [r for r in waiting if r[0] > watermark]
        if due:
            self.pending.put(rest) if rest else self.pending.clear()
        found, again = self.advance(key[0], due, watermark)
        if rest:
            self._wake(min(r[0] for r in rest))
        if again is not None:
            self._wake(again)
        yield self.rows(found)


class _Cuts(_InOrder):
    """Times at or over the threshold, each min_length or more after the last one taken; 0 is the first."""

    FIELDS, ROW = ("at", "time", "score"), "at long, time double, score double"

    def __init__(self, threshold: float, min_length: float):
        self.threshold, self.min_length = threshold, min_length

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "time double")

    def first(self, key: str) -> pd.DataFrame:
        self.last.update((0.0,))
        return self.rows([(key, 0.0)])

    def advance(self, key: str, rows: list[tuple], watermark: int) -> tuple[list[tuple], int | None]:
        last, out = self.last.get()[0], []
        for _, time, score in rows:
            if score >= self.threshold and time - last >= self.min_length:
                last = time
                out.append((key, time))
        if out:
            self.last.update((last,))
        return out, None

    def rows(self, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({KEY: pd.Series([f[0] for f in found], dtype=object), "time": pd.Series([f[1] for f in found], dtype=float)})


class _Merge(_InOrder):
    """Intervals at most `gap` apart as one, with the mean of the points on all of it."""

    FIELDS, ROW = ("at", "kind", "time", "end", "value"), "at long, kind int, time double, end double, value double"

    def __init__(self, gap: float, origin: int):
        self.gap, self.origin = gap, origin

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "start double, end double, score double, n long")
        self.points = handle.getListState("points", "time double, value double")

    def _closed(self, key: str, group: tuple, points: list[tuple]) -> tuple:
        start, end, score, n = group
        if n > 1:
            inside = [v for t, v in points if start <= t <= end]
            score = sum(inside) / len(inside) if inside else 0.0
        return key, start, end, score

    def _due(self, group: tuple) -> int:
        """The last microsecond at which an interval may begin that joins the group."""
        return self.origin + int((group[1] + self.gap) * 1e6)

    def advance(self, key: str, rows: list[tuple], watermark: int) -> tuple[list[tuple], int | None]:
        group = tuple(self.open.get()) if self.open.exists() else None
        points = [tuple(p) for p in self.points.get()] if self.points.exists() else []
        out = []
        for _, kind, time, end, value in rows:
            if kind == POINT:
                points.append((time, value))
            elif group and time <= group[1] + self.gap:
                group = (group[0], max(group[1], end), group[2], group[3] + 1)
            else:
                if group:
                    out.append(self._closed(key, group, points))
                group = (time, end, value, 1)
        if group and self._due(group) < watermark:
            out.append(self._closed(key, group, points))
            group = None
        since = group[0] if group else (watermark - self.origin) / 1e6
        points = [p for p in points if p[0] >= since]
        self.points.put(points) if points else self.points.clear()
        self.open.update(group) if group else self.open.clear()
        return out, self._due(group) + 1000 if group else None

    def rows(self, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([f[k] for f in found], dtype=object if k == 0 else float) for k, c in enumerate((KEY, "start", "end", "score"))})


def shot_boundaries(scores: DataFrame, threshold: float, min_length: float, origin: str = "1970-01-01", late: str = "10 minutes") -> DataFrame:
    """scores (video_id, ts, score), a stream, as (video_id, time): what scenes.shot_boundaries() gives for times in seconds since `origin`.

    Cut 0 comes with a video's first row, each other one when the watermark has passed it. A null score is no cut.
    """
    _with_store(scores.sparkSession)
    ts = F.col("ts").cast("timestamp")
    timed = scores.select(KEY, ts.alias("ts"), _micros(ts).alias("at"), _seconds(ts, origin).alias("time"), F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))).alias("score")).withWatermark("ts", late)
    return timed.groupBy(KEY).transformWithStateInPandas(_Cuts(threshold, min_length), CUTS, "Append", "EventTime")


def merged(intervals: DataFrame, points: DataFrame, gap: float, origin: str = "1970-01-01", late: str = "10 minutes") -> DataFrame:
    """intervals (video_id, ts, end_ts, score) and points (video_id, ts, interest), streams, as (video_id, start, end, score).

    What intervals.merged() gives, in seconds since `origin`: intervals that begin at most `gap` after another's end become one, and
    its score the mean interest on all of it (0 without points); an interval on its own keeps its score. One comes out when
    the watermark says that nothing can join it any more. An interval without an end, or a point without interest, is left out.
    """
    spark = intervals.sparkSession
    _with_store(spark)
    ts, end = F.col("ts").cast("timestamp"), F.col("end_ts").cast("timestamp")
    spans = intervals.where(F.col("end_ts").isNotNull()).select(KEY, ts.alias("ts"), F.lit(INTERVAL).alias("kind"), _seconds(end, origin).alias("end"), F.col("score").cast("double").alias("value"))
    marks = points.where(F.col("interest").isNotNull()).select(KEY, ts.alias("ts"), F.lit(POINT).alias("kind"), F.lit(0.0).alias("end"), F.col("interest").cast("double").alias("value"))
    both = spans.unionByName(marks).withWatermark("ts", late).withColumns({"at": _micros(F.col("ts")), "time": _seconds(F.col("ts"), origin)})
    zero = spark.range(1).select(_micros(F.lit(origin).cast("timestamp"))).first()[0]
    return both.groupBy(KEY).transformWithStateInPandas(_Merge(gap, zero), MERGED, "Append", "EventTime")


def _seconds(ts: Column, origin: str) -> Column:
    return (_micros(ts) - _micros(F.lit(origin).cast("timestamp"))) / F.lit(1e6)
