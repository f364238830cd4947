"""Live connections: accumulate until done or idle, and health checks."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidewatch.functions.automata import compiled
from tidewatch.operators.scripts import LATE, WAITING
from tidewatch.operators.sessions import CRLF, HEAD_LIMIT, HEAD_TOO_LONG
from tidewatch.session import with_tasks
from tidewatch.streaming.ordered import EVENT_MS, FLAG, LONG, TEXT, InOrder, fields, in_order

with_tasks(__name__)

MS = "chunk_arrived_ms"
# What ends a header and announces a length.
BLANK_LINE, CONTENT_LENGTH = CRLF + CRLF, re.compile("content-length: *([0-9]+)")


class Accumulator(StatefulProcessor):
    """Adds up the measures of one connection until they reach their quotas.

    Only totals are kept, never the data. A timer ends an idle connection; new data
    sets it anew. A second timer forgets a connection that has ended.
    """

    def __init__(self, conn, seq, quotas, timeout_ms, forget_ms):
        self.conn, self.seq = conn, seq
        self.quotas, self.timeout_ms, self.forget_ms = quotas, timeout_ms, forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("totals", fields(last_ms=LONG, over=FLAG, **dict.fromkeys(self.quotas, LONG)))

    def handleInputRows(self, key, rows, timerValues):
        last, over, *totals = self.state.get() if self.state.exists() else (None, False, *[0] * len(self.quotas))
        batch = pd.concat(list(rows)).sort_values(self.seq)
        times = batch[MS].tolist()
        found = []
        for now, seq, *steps in zip(times, batch[self.seq].tolist(), *[batch[q].tolist() for q in self.quotas]):
            if over:
                break
            if last is not None and now - last >= self.timeout_ms:
                found.append(self._ended(key, False))
                over = True
                break
            last, totals = now, [t + int(s) for t, s in zip(totals, steps)]
            if all(t >= q for t, q in zip(totals, self.quotas.values())):
                found.append(self._ended(key, True, seq, totals))
                over = True
        self.state.update((last, over, *totals))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last is not None:
            self.handle.registerTimer(max(times) + self.forget_ms if over else last + self.timeout_ms)
        yield pd.DataFrame(found, columns=self._columns())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, over, *totals = self.state.get()
        found = [] if over else [self._ended(key, False)]
        if over:
            self.state.clear()
        else:
            self.state.update((last, True, *totals))
            self.handle.registerTimer(last + self.timeout_ms + self.forget_ms)
        yield pd.DataFrame(found, columns=self._columns())

    def _columns(self):
        return [self.conn, "success", "seq", *self.quotas, "reason"]

    def _ended(self, key, success, seq=None, totals=None):
        reason = None if success else idle(self.timeout_ms)
        return (key[0], success, seq, *(totals or [None] * len(self.quotas)), reason)

    def close(self) -> None:
        pass


def accumulate_until(chunks: DataFrame, conn: str, seq: str, arrived: str, quotas: dict[str, int],
                     timeout_ms: int = 5000, lateness: str = "0 seconds", forget_ms: int = 60_000) -> DataFrame:
    """Streaming form of ``stream_until``: one row when a connection is done or idle.

    ``quotas`` maps whole-number columns of a chunk to the total that is needed.
    ``arrived`` is an event-time timestamp; rows later than ``lateness`` are dropped. Data
    that comes within ``forget_ms`` of the end belongs to the ended connection and is left
    out; after that its state is cleared, and the name may be used by a new one.
    """
    schema = T.StructType([chunks.schema[conn], *fields(success=FLAG, seq=LONG, **dict.fromkeys(quotas, LONG), reason=TEXT)])
    narrow = chunks.select(conn, seq, F.col(arrived).cast("timestamp").alias(arrived), *quotas)
    narrow = narrow.withColumn(MS, F.unix_millis(arrived))
    return (narrow.withWatermark(arrived, lateness).groupBy(conn)
            .transformWithStateInPandas(Accumulator(conn, seq, quotas, timeout_ms, forget_ms), schema, "Append", "EventTime"))


class Watch(StatefulProcessor):
    """Start time of one process."""

    def __init__(self, order, ts_ms, rss_mb, max_mb, ttl_seconds, out, forget_ms):
        self.forget_ms = forget_ms
        self.order, self.ts_ms, self.rss_mb = order, ts_ms, rss_mb
        self.max_mb, self.ttl_seconds, self.out = max_mb, ttl_seconds, out

    def init(self, handle) -> None:
        self.state = handle.getValueState("start", fields(start_ms=LONG), self.forget_ms)

    def handleInputRows(self, key, rows, timerValues):
        start = self.state.get()[0] if self.state.exists() else None
        batch = pd.concat(list(rows)).sort_values(self.order)
        found = []
        for ts, mb in zip(batch[self.ts_ms].tolist(), batch[self.rss_mb].tolist()):
            start, result = judged(start, ts, mb, self.max_mb, self.ttl_seconds)
            found.append(result)
        self.state.update((start,))
        columns = ["uptime_seconds", "instantiate", "memory_trigger", "ttl_expired", "restart"]
        yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(found, columns=columns)], axis=1)[self.out]

    def close(self) -> None:
        pass


class OrderedWatch(InOrder):
    """The same over checks in the order of their event time."""

    def __init__(self, schema, order, out, columns, ts_ms, rss_mb, max_mb, ttl_seconds, forget_ms):
        super().__init__(schema, order, out)
        self.columns, self.ts_ms, self.rss_mb = columns, ts_ms, rss_mb
        self.max_mb, self.ttl_seconds, self.forget_ms = max_mb, ttl_seconds, forget_ms

    def setup(self) -> None:
        self.state = self.handle.getValueState("start", fields(start_ms=LONG, last_ms=LONG))

    def advance(self, key, rows):
        start = self.state.get()[0] if self.state.exists() else None
        found = []
        for row in rows:
            start, result = judged(start, row[self.ts_ms], row[self.rss_mb], self.max_mb, self.ttl_seconds)
            found.append((*[row[c] for c in self.columns], *result))
        self.state.update((start, rows[-1][EVENT_MS]))
        return found

    def deadline(self):
        if self.forget_ms is None or not self.state.exists():
            return None
        return self.state.get()[1] + self.forget_ms

    def lapse(self, key):
        self.state.clear()
        return []


def judged(start: int | None, ts: int, mb: int, max_mb: int, ttl_seconds: int) -> tuple[int, tuple]:
    """Start of a process after a check, and (uptime, first, memory, age, restart)."""
    first = start is None
    uptime = 0 if first else (ts - start + 500) // 1000
    memory, old = mb > max_mb, uptime > ttl_seconds
    restart = first or memory or old
    return ts if restart else start, (uptime, first, memory, old, restart)


def watch_health(metrics: DataFrame, process: str, order: list[str], ts_ms: str, rss_mb: str, max_mb: int = 900,
                 ttl_seconds: int = 60 * 60 * 24 * 365, forget_ms: int | None = None, event_time: str | None = None,
                 lateness: str = "0 seconds") -> DataFrame:
    """Streaming form of ``health_alerts``; ``rss_mb`` is a whole-number column.

    With ``event_time``, a timestamp column, checks wait for the watermark and are judged in the
    given order; those later than ``lateness`` are dropped. The column itself is not in the result.
    A process that is silent for ``forget_ms`` of event time (else of clock time) is forgotten."""
    added = fields(uptime_seconds=LONG, instantiate=FLAG, memory_trigger=FLAG, ttl_expired=FLAG, restart=FLAG)
    if event_time is not None:
        columns = [c for c in metrics.columns if c != event_time]
        out = T.StructType([*[metrics.schema[c] for c in columns], *added])
        return in_order(metrics, process, event_time, lateness, columns, out, lambda waiting: OrderedWatch(
            waiting, order, out, columns, ts_ms, rss_mb, max_mb, ttl_seconds, forget_ms))
    schema = T.StructType([*metrics.schema, *added])
    watch = Watch(order, ts_ms, rss_mb, max_mb, ttl_seconds, schema.names, forget_ms)
    mode = "None" if forget_ms is None else "ProcessingTime"
    return metrics.groupBy(process).transformWithStateInPandas(watch, schema, "Append", mode)


class Messages(InOrder):
    """Text of one connection from the start of the message that is not complete yet."""

    def __init__(self, schema, order, out, text, head_limit, timeout_ms):
        super().__init__(schema, order, out)
        self.text, self.head_limit, self.timeout_ms = text, head_limit, timeout_ms

    def setup(self) -> None:
        # The chunks of the open message, and what is known of it: messages before it, characters,
        # where its body begins and how long that is, time of the last chunk, whether it has failed.
        self.chunks = self.handle.getListState("chunks", fields(text=TEXT))
        self.known = self.handle.getValueState("known", fields(
            nth=LONG, size=LONG, body_at=LONG, length=LONG, last_ms=LONG, over=FLAG, near=TEXT))

    def advance(self, key, rows):
        nth, size, body_at, length, _, over, near = self.known.get() if self.known.exists() else (0, 0, None, None, 0, False, "")
        found, fresh = [], []
        for row in rows:
            piece = row[self.text] or ""
            while not over and piece:
                if body_at is None:
                    # The blank line may begin in the three characters before this chunk.
                    at = (near + piece).find(BLANK_LINE)
                    at = at if at < 0 else size - len(near) + at
                    if at > self.head_limit or at < 0 and size + len(piece) > self.head_limit + len(BLANK_LINE):
                        found.append((key[0], nth, False, None, None, None, HEAD_TOO_LONG))
                        over = True
                    elif at >= 0:
                        head = ("".join(self._text(fresh)) + piece)[:at]
                        declared = CONTENT_LENGTH.search(head.lower())
                        body_at, length = at + len(BLANK_LINE), int(declared[1]) if declared else None
                        if length is None:
                            found.append((key[0], nth, False, None, None, None, "no content length"))
                            over = True
                if over:
                    break
                if body_at is None or size + len(piece) < body_at + length:
                    fresh.append(piece)
                    size, near = size + len(piece), (near + piece)[-3:]
                    break
                # The message ends in this chunk; what follows it begins the next one.
                used = body_at + length - size
                whole = "".join([*self._text(fresh), piece[:used]])
                found.append((key[0], nth, True, length, row[self.order[0]], whole[body_at:], None))
                self.chunks.clear()
                fresh, piece = [], piece[used:]
                nth, size, body_at, length, near = nth + 1, 0, None, None, ""
        if over:
            self.chunks.clear()
        elif fresh:
            self.chunks.appendList([(t,) for t in fresh])
        self.known.update((nth, size, body_at, length, rows[-1][EVENT_MS], over, near))
        return found

    def _text(self, fresh: list[str]) -> list[str]:
        return [*[r[0] for r in self.chunks.get()], *fresh]

    def deadline(self):
        return self.known.get()[4] + self.timeout_ms if self.known.exists() else None

    def lapse(self, key):
        """An idle connection ends, and so does the message that is still open."""
        nth, size, body_at, length, _, over, _ = self.known.get()
        self.known.clear()
        self.chunks.clear()
        if over or not size:
            return []
        return [(key[0], nth, False, length, None, None, "no blank line" if body_at is None else "body incomplete")]


def message_frames(chunks: DataFrame, conn: str, seq: str, text: str, arrived: str, lateness: str = "0 seconds",
                   head_limit: int = HEAD_LIMIT, timeout_ms: int = 5_000) -> DataFrame:
    """Streaming form of ``content_length_frames``, for any number of messages per connection.

    Chunks are put in order by event time and held until their message is complete, never longer
    than that: a header of more than ``head_limit`` characters or without a length ends the
    connection. A connection that is idle for ``timeout_ms`` ends, and all it held is cleared.
    Rows: the connection, number of the message, success, declared length, chunk it ended in, body,
    reason."""
    out = T.StructType([chunks.schema[conn], *fields(message=LONG, success=FLAG, content_length=LONG),
                        T.StructField("done_seq", chunks.schema[seq].dataType), *fields(body=TEXT, reason=TEXT)])
    return in_order(chunks, conn, arrived, lateness, [seq, text], out,
                    lambda waiting: Messages(waiting, [seq], out, text, head_limit, timeout_ms))


class ScriptWalk(InOrder):
    """How far a connection has come in a script: one number, whatever it has sent."""

    def __init__(self, schema, order, out, text, script, timeout_ms):
        super().__init__(schema, order, out)
        self.text, self.script, self.timeout_ms = text, script, timeout_ms

    def setup(self) -> None:
        self.state = self.handle.getValueState("walk", fields(
            state=LONG, done_seq=self.schema[self.order[0]].dataType, last_ms=LONG))

    def advance(self, key, rows):
        state, done, _ = self.state.get() if self.state.exists() else (0, None, 0)
        for row in rows:
            state, matched = self.script.feed(state, row[self.text])
            done = row[self.order[0]] if matched else done
        self.state.update((state, done, rows[-1][EVENT_MS]))
        return []

    def deadline(self):
        return self.state.get()[2] + self.timeout_ms if self.state.exists() else None

    def lapse(self, key):
        state, done, _ = self.state.get()
        self.state.clear()
        reason = LATE if state == self.script.late else WAITING if state < self.script.done else None
        return [(key[0], self.script.step(state), done, reason is None, reason)]


def follow_script(chunks: DataFrame, conn: str, seq: str, text: str, arrived: str, expected: list,
                  lateness: str = "0 seconds", timeout_ms: int = 5_000) -> DataFrame:
    """Streaming form of ``match_script``: a row per connection once it has been idle for
    ``timeout_ms`` of event time. Its state is a number and the last hit, and is cleared then."""
    out = T.StructType([chunks.schema[conn], T.StructField("matched", T.IntegerType()),
                        T.StructField("done_seq", chunks.schema[seq].dataType), *fields(success=FLAG, reason=TEXT)])
    script = compiled(expected)
    return in_order(chunks, conn, arrived, lateness, [seq, text], out,
                    lambda waiting: ScriptWalk(waiting, [seq], out, text, script, timeout_ms))


class Rotation(InOrder):
    """Data of one connection since it began, and the states its handlers have left."""

    def __init__(self, schema, order, out, text, handlers, waiting, timeout_ms, forget_ms):
        super().__init__(schema, order, out)
        self.text, self.handlers, self.still = text, handlers, waiting
        self.timeout_ms, self.forget_ms = timeout_ms, forget_ms

    def setup(self) -> None:
        self.buffer = self.handle.getListState("buffer", fields(text=TEXT))
        self.known = self.handle.getValueState("known", fields(states=TEXT, last_ms=LONG, over=FLAG))

    def advance(self, key, rows):
        kept, last, over = self.known.get() if self.known.exists() else ("{}", None, False)
        states = json.loads(kept)
        # The buffer is read only once something is new, and once for all that is due.
        held = "" if over else "".join(r[0] for r in self.buffer.get())
        found, fresh = [], []
        for row in rows:
            if over:
                break
            if last is not None and row[EVENT_MS] - last >= self.timeout_ms:
                found.append((key[0], False, None, json.dumps(states), idle(self.timeout_ms)))
                over = True
                break
            last = row[EVENT_MS]
            fresh.append(row[self.text] or "")
            held += fresh[-1]
            for name, handler in self.handlers:
                states[name] = handler(held, states.get(name), states)
                if not self.still(states):
                    found.append((key[0], True, row[self.order[0]], json.dumps(states), None))
                    over = True
                    break
        if over:
            self.buffer.clear()
        elif fresh:
            self.buffer.appendList([(t,) for t in fresh])
        self.known.update((json.dumps(states), rows[-1][EVENT_MS] if over else last, over))
        return found

    def deadline(self):
        if not self.known.exists():
            return None
        _, last, over = self.known.get()
        return last + (self.forget_ms if over else self.timeout_ms)

    def lapse(self, key):
        states, last, over = self.known.get()
        if over:
            self.known.clear()
            return []
        self.buffer.clear()
        self.known.update((states, last + self.timeout_ms, True))
        return [(key[0], False, None, states, idle(self.timeout_ms))]


def idle(timeout_ms: int) -> str:
    return f"socketWhile timeout, totalTimeWaited: {timeout_ms}"


def rotate_until(chunks: DataFrame, conn: str, seq: str, text: str, arrived: str, handlers: dict, waiting,
                 lateness: str = "0 seconds", timeout_ms: int = 5_000, forget_ms: int = 60_000) -> DataFrame:
    """Run handlers in rotation over what a connection has sent, until a test on their states is false.

    With each chunk, in the order of event time, every handler in turn gets all text so far, its
    own state (None at first) and the states of all, by which one hands over to the next; what it
    returns, plain JSON values, is its new state. After each, ``waiting(states)`` decides. A gap of
    ``timeout_ms`` fails the connection. Text is held in a list state while the test holds, and
    cleared then; the rest is forgotten after ``forget_ms`` more. Rows: the connection, success,
    chunk, states as JSON, reason."""
    out = T.StructType([chunks.schema[conn], *fields(success=FLAG), T.StructField("seq", chunks.schema[seq].dataType),
                        *fields(states=TEXT, reason=TEXT)])
    return in_order(chunks, conn, arrived, lateness, [seq, text], out, lambda held: Rotation(
        held, [seq], out, text, list(handlers.items()), waiting, timeout_ms, forget_ms))
