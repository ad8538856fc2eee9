"""Reading sessions that open and close by events: a tab switch, a window's blur and focus, its closing.

Opening a reader's tab ends the session before it and begins one; another tab only ends it. A blur or the
window's closing ends it. A focus begins one anew on the tab that is open, and what had begun without an
end is forgotten. Sessions under five seconds are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.reading import MINIMUM_SECONDS

OPEN, BLUR, FOCUS, CLOSE = "open", "blur", "focus", "close"
ENDS = (OPEN, BLUR, CLOSE)


def sessions_by_events(events: DataFrame) -> DataFrame:
    """Sessions of ``events`` (user_id, ts, ord, kind, paper_id): user_id, paper_id, start_time, end_time,
    duration_seconds.

    Of a user's events in the order of ts and ord, one that begins a session gives it if the very next event
    ends it. Windows look at a user's days, then from day to day, so that no task gathers more of a user than
    a day's events or a row a day. Events of other kinds, or without a user or time, are no events; an open
    without paper_id is that of another tab."""
    e = events.where(F.col("kind").isin(OPEN, BLUR, FOCUS, CLOSE) & F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    e = e.select("user_id", "ts", "ord", "kind", "paper_id", F.to_date("ts").alias("day"))
    place = F.struct("ts", "ord")
    tab = F.when(F.col("kind") == OPEN, F.struct("paper_id")).when(F.col("kind") == CLOSE, F.struct(F.lit(None).cast(e.schema["paper_id"].dataType).alias("paper_id")))
    within = Window.partitionBy("user_id", "day").orderBy("ts", "ord")
    days = e.groupBy("user_id", "day").agg(F.min_by(F.struct("ts", "kind"), place).alias("first"), F.max_by(tab, F.when(tab.isNotNull(), place)).alias("tab"))
    by_day = Window.partitionBy("user_id").orderBy("day")
    days = days.select("user_id", "day", F.lead("first").over(by_day).alias("next_first"), F.last("tab", ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, -1)).alias("tab_before"))
    seen = e.select("*", F.lead(F.struct("ts", "kind")).over(within).alias("next"), F.last(tab, ignorenulls=True).over(within).alias("tab"))
    seen = seen.join(days, ["user_id", "day"]).select("user_id", "ts", "kind", F.coalesce("next", "next_first").alias("next"), F.coalesce("tab", "tab_before")["paper_id"].alias("paper_id"))
    begun = seen.where(F.col("kind").isin(OPEN, FOCUS) & F.col("paper_id").isNotNull() & F.col("next.kind").isin(*ENDS))
    return finished(begun.select("user_id", "paper_id", F.col("ts").alias("start_time"), F.col("next.ts").alias("end_time")))


def finished(sessions: DataFrame) -> DataFrame:
    """With whole seconds, without short ones."""
    seconds = F.call_function("div", F.col("end_time") - F.col("start_time"), F.expr("interval '1' second"))
    return sessions.withColumn("duration_seconds", seconds).where(F.col("duration_seconds") >= MINIMUM_SECONDS)


class Desk:
    """A window's state: the paper of its open tab, and since when it has been read, in microseconds."""

    def __init__(self, paper: Any = None, since: int | None = None) -> None:
        self.paper, self.since = paper, since

    def take(self, kind: str | None, at: int, paper: Any) -> tuple[Any, int, int] | None:
        """Changes the state; the session that this ends, if any."""
        done = (self.paper, self.since, at) if kind in ENDS and self.since is not None else None
        if kind in (OPEN, CLOSE):
            self.paper = paper if kind == OPEN else None
        if kind in ENDS:
            self.since = at if kind == OPEN and self.paper is not None else None
        elif kind == FOCUS and self.paper is not None:
            self.since = at
        return done


class ReadingStates(StatefulProcessor):
    """The same over a stream, a user at a time. Events wait until the watermark has passed them, as they may
    arrive in another order; a row that comes again counts once. One timer a user wakes the earliest of them. What waits is what arrives within
    the watermark's delay; beside it a user's state is one row."""

    def __init__(self, paper_type: str, user_type: str) -> None:
        self.paper_type, self.user_type = paper_type, user_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.desk = handle.getValueState("desk", f"paper {self.paper_type}, since long")
        self.waiting = handle.getListState("waiting", f"at long, ord long, kind string, paper {self.paper_type}")

    def wake(self, rows: list[tuple]) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if rows:
            self.handle.registerTimer(min(r[0] for r in rows) // 1000 + 1)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        waiting = list({*map(tuple, self.waiting.get()), *((r.at, r.ord, r.kind, r.paper_id) for r in rows)})
        self.waiting.put(waiting)
        self.wake(waiting)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1]))
        ready = [r for r in rows if r[0] < passed * 1000]
        held = self.desk.get()
        desk = Desk(*held) if held is not None else Desk()
        out = []
        for at, _, kind, paper in ready:
            done = desk.take(kind, at, paper)
            if done:
                out.append(Row(user_id=key[0], paper_id=done[0], start_time=done[1], end_time=done[2]))
        self.desk.update((desk.paper, desk.since))
        rest = rows[len(ready) :]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        self.wake(rest)
        return iter(out)

    def close(self) -> None:
        pass


def streamed_sessions(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """``sessions_by_events`` of a stream. A session comes out when the watermark, ``late`` behind the latest
    event, has passed its end; events later than that are dropped. Needs the RocksDB state store."""
    e = events.where(F.col("kind").isin(OPEN, BLUR, FOCUS, CLOSE) & F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    e = e.select("user_id", F.col("ts").cast("timestamp").alias("ts"), at, F.col("ord").cast("long").alias("ord"), "kind", "paper_id").withWatermark("ts", late)
    paper, user = (e.schema[c].dataType.simpleString() for c in ("paper_id", "user_id"))
    found = e.groupBy("user_id").transformWithState(ReadingStates(paper, user), f"user_id {user}, paper_id {paper}, start_time long, end_time long", "Append", "eventTime")
    return finished(found.select("user_id", "paper_id", F.timestamp_micros("start_time").alias("start_time"), F.timestamp_micros("end_time").alias("end_time")))
