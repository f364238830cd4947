"""Rows of a key in the order of their event time, whatever order they arrive in.

Rows wait in a list state until the watermark has passed them; then no earlier one can come any
more. One timer per key wakes it at its next due row. A subclass sees rows in order, as the batch
forms do, so rows that are dealt over micro-batches in any way give the same result. Rows later
than the allowed lateness are dropped, as the engine does with all late rows.

What waits is what has come in within the allowed lateness, no more.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidewatch.session import with_tasks

with_tasks(__name__)

LONG, DOUBLE, FLAG, TEXT = T.LongType(), T.DoubleType(), T.BooleanType(), T.StringType()
EVENT_MS = "_event_ms"


def fields(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


def cells(column: pd.Series, kind: T.DataType) -> list:
    """Values as the state store takes them: missing ones are None, whole numbers are int."""
    make = int if isinstance(kind, T.IntegralType) else float if isinstance(kind, T.FractionalType) else None
    return [None if missing else make(v) if make else v for v, missing in zip(column.tolist(), column.isna().tolist())]


class InOrder(StatefulProcessor):
    """Calls ``advance`` with due rows in order, and ``lapse`` once ``deadline`` has passed."""

    def __init__(self, schema: T.StructType, order: list[str], out: T.StructType):
        self.schema, self.order, self.out = schema, order, out

    # ---- for subclasses

    def setup(self) -> None:
        """Open states of its own."""

    def advance(self, key: tuple, rows: list[dict]) -> list[tuple]:
        """Result rows for rows that are due, in order."""
        raise NotImplementedError

    def deadline(self) -> int | None:
        """Event time in ms at which ``lapse`` is called if nothing comes before."""
        return None

    def lapse(self, key: tuple) -> list[tuple]:
        """Result rows for a key that has reached its deadline."""
        return []

    # ---- the engine's calls

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.setup()

    def handleInputRows(self, key, rows, timerValues):
        for batch in rows:
            # By place: the engine renames columns that begin with an underscore. The event time in ms is last.
            places = [*range(len(self.schema) - 1), -1]
            columns = [cells(batch.iloc[:, i], f.dataType) for i, f in zip(places, self.schema)]
            self.waiting.appendList(list(zip(*columns)))
            self._wake(min(columns[-1]))
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        at = self.schema.names.index(EVENT_MS)
        held = list(self.waiting.get())
        due = [dict(zip(self.schema.names, r)) for r in held if r[at] <= now]
        later = [tuple(r) for r in held if r[at] > now]
        found: list[tuple] = []
        if due:
            due.sort(key=lambda r: tuple((r[c] is not None, r[c]) for c in self.order))
            found += self.advance(key, due)
            self.waiting.put(later) if later else self.waiting.clear()
        ends = self.deadline()
        if ends is not None and ends <= now:
            found += self.lapse(key)
            ends = self.deadline()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        next_up = [r[at] for r in later] + ([] if ends is None else [ends])
        if next_up:
            self.handle.registerTimer(max(min(next_up), now + 1))
        yield self._frame(found)

    def close(self) -> None:
        pass

    def _wake(self, at: int) -> None:
        timers = list(self.handle.listTimers())
        if not timers or at < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        columns = list(zip(*rows)) if rows else [()] * len(self.out)
        kinds = {T.LongType: "Int64", T.IntegerType: "Int32", T.BooleanType: "boolean"}
        return pd.DataFrame({f.name: pd.Series(list(c), dtype=kinds.get(type(f.dataType), "object"))
                             for f, c in zip(self.out, columns)})


def timed(rows: DataFrame, time: str, lateness: str, columns: list[str]) -> DataFrame:
    """The columns and the event time in ms, under a watermark. Rows without a time are left out."""
    stamped = rows.select(*columns, F.col(time).cast("timestamp").alias("_event_time")).where("_event_time IS NOT NULL")
    return stamped.withWatermark("_event_time", lateness).withColumn(EVENT_MS, F.unix_millis("_event_time"))


def waiting_schema(rows: DataFrame, columns: list[str]) -> T.StructType:
    return T.StructType([*[T.StructField(c, rows.schema[c].dataType) for c in columns], T.StructField(EVENT_MS, LONG)])


def in_order(rows: DataFrame, key: str, time: str, lateness: str, columns: list[str], out: T.StructType, make) -> DataFrame:
    """Run the processor that ``make(waiting schema)`` gives over the rows of each key."""
    columns = list(dict.fromkeys([key, *columns]))
    processor = make(waiting_schema(rows, columns))
    return timed(rows, time, lateness, columns).groupBy(key).transformWithStateInPandas(processor, out, "Append", "EventTime")
