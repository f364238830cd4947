"""Rate windows, running totals and log thinning over a live stream of sample batches.

Each stream of samples is one key with one small state row. With an event time, batches are put
in order before they are metered, whatever micro-batch they come in; without, they are taken in
the order of their micro-batches. A micro-batch holds as many rows of a key as the source lets in
(``maxFilesPerTrigger`` and the like), so that limit also bounds the work of one key. The batch
forms split hot keys.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidewatch.session import with_tasks
from tidewatch.streaming.ordered import DOUBLE, FLAG, LONG, TEXT, InOrder, fields, in_order  # noqa: F401

with_tasks(__name__)

ADDED = fields(step_bytes=DOUBLE, total_bytes=DOUBLE, window_start_ms=LONG, window_bytes=DOUBLE, elapsed_ms=LONG,
               rate=DOUBLE, should_log=FLAG)
HELD = fields(start_ms=LONG, window_bits=LONG, total_bits=LONG, rate=DOUBLE, buffered=LONG)


class Meter:
    """The rule for one batch of samples; it counts bits, which need not fill whole bytes."""

    def __init__(self, bits: int, window_ms: int, budget: int | None):
        self.bits, self.window_ms, self.budget = bits, window_ms, budget

    def step(self, held: tuple | None, ts: int, size: int) -> tuple[tuple, tuple]:
        """What is held after a batch of ``size`` samples, and its result."""
        start, window, total, rate, buffered = held or (None, 0, 0, None, 0)
        step = int(size) * self.bits
        age = 0 if start is None else ts - start
        if age > self.window_ms:
            start, window, age = None, 0, 0
        if step and not window:
            start, age = ts, 0
        window, total, buffered = window + step, total + step, buffered + step
        if age * 2 > self.window_ms:
            rate = window / (age / 1000) / self.bits
        log = self.budget is None or total == step or buffered > self.budget
        found = (step / 8, total / 8, start, window / 8, age, rate, log)
        return (start, window, total, rate, 0 if log else buffered), found


class SampleMeter(StatefulProcessor):
    """Keeps the window, total, last rate and unlogged bits of one stream."""

    def __init__(self, meter, order, ts_ms, size, out, forget_ms):
        self.meter, self.forget_ms = meter, forget_ms
        self.order, self.ts_ms, self.size, self.out = order, ts_ms, size, out

    def init(self, handle) -> None:
        self.state = handle.getValueState("meter", HELD, self.forget_ms)

    def handleInputRows(self, key, rows, timerValues):
        held = self.state.get() if self.state.exists() else None
        batch = pd.concat(list(rows)).sort_values(self.order)
        found = []
        for ts, size in zip(batch[self.ts_ms].tolist(), batch[self.size].tolist()):
            held, result = self.meter.step(held, ts, size)
            found.append(result)
        self.state.update(held)
        yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(found, columns=ADDED.names)], axis=1)[self.out]

    def close(self) -> None:
        pass


class OrderedMeter(InOrder):
    """The same over batches in the order of their event time."""

    def __init__(self, schema, order, out, meter, columns, ts_ms, size, forget_ms):
        super().__init__(schema, order, out)
        self.meter, self.columns, self.ts_ms, self.size, self.forget_ms = meter, columns, ts_ms, size, forget_ms

    def setup(self) -> None:
        self.state = self.handle.getValueState("meter", fields(**{f.name: f.dataType for f in HELD}, last_ms=LONG))

    def advance(self, key, rows):
        held = self.state.get()[:-1] if self.state.exists() else None
        found = []
        for row in rows:
            held, result = self.meter.step(held, row[self.ts_ms], row[self.size])
            found.append((*[row[c] for c in self.columns], *result))
        self.state.update((*held, rows[-1]["_event_ms"]))
        return found

    def deadline(self):
        if self.forget_ms is None or not self.state.exists():
            return None
        return self.state.get()[-1] + self.forget_ms

    def lapse(self, key):
        self.state.clear()
        return []


def meter_samples(samples: DataFrame, stream: str, order: list[str], ts_ms: str, size: str, bits: int = 8,
                  window_ms: int = 10_000, sample_rate: int | None = None, channels: int = 1,
                  interval_seconds: int = 5, forget_ms: int | None = None, event_time: str | None = None,
                  lateness: str = "0 seconds") -> DataFrame:
    """Streaming form of ``stream_totals``, ``rate_windows`` and ``thin_log`` in one pass.

    With ``event_time``, a timestamp column, batches wait for the watermark and are metered in the
    given order; those later than ``lateness`` are dropped. The column itself is not in the result.
    A stream that is silent for ``forget_ms`` of event time (else of clock time) is forgotten."""
    budget = None if sample_rate is None else interval_seconds * sample_rate * bits * channels
    meter = Meter(bits, window_ms, budget)
    if event_time is not None:
        columns = [c for c in samples.columns if c != event_time]
        out = T.StructType([*[samples.schema[c] for c in columns], *ADDED])
        return in_order(samples, stream, event_time, lateness, columns, out,
                        lambda waiting: OrderedMeter(waiting, order, out, meter, columns, ts_ms, size, forget_ms))
    schema = T.StructType([*samples.schema, *ADDED])
    mode = "None" if forget_ms is None else "ProcessingTime"
    return samples.groupBy(stream).transformWithStateInPandas(
        SampleMeter(meter, order, ts_ms, size, schema.names, forget_ms), schema, "Append", mode)
