"""Key-value state and task queues kept in state, fed by streams in the order of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import with_tasks
from tidewatch.streaming.ordered import EVENT_MS, FLAG, LONG, TEXT, InOrder, fields, in_order

with_tasks(__name__)


class Register(InOrder):
    """Value of one key: what it was last set to, and how often it was counted up since."""

    def __init__(self, schema, order, out, defaults):
        super().__init__(schema, order, out)
        self.defaults = defaults

    def setup(self) -> None:
        kind = self.schema["value"].dataType
        self.state = self.handle.getValueState("value", T.StructType([T.StructField("base", kind), *fields(steps=LONG)]))

    def advance(self, key, rows):
        base, steps = self.state.get() if self.state.exists() else (self.defaults.get(key[0]), 0)
        for row in rows:
            if row["op"] == "increment":
                steps += 1
            else:
                base, steps = row["value"] if row["op"] == "set" else None, 0
        self.state.update((base, steps))
        name = "set" if base is not None else "nan" if steps else "absent"
        return [(key[0], name, steps, None if base is None else base + steps, rows[-1][EVENT_MS])]


def follow_changes(changes: DataFrame, time: str, order: list[str], defaults: dict | None = None,
                   lateness: str = "0 seconds") -> DataFrame:
    """Streaming form of ``fold_changes``: whenever changes of a key fall due, its state after them.

    ``changes`` has ``key``, ``op`` and ``value`` beside the order columns; ``defaults`` are the
    values that keys start with. The row with the largest ``as_of_ms`` of a key is its current state."""
    kind = changes.schema["value"].dataType
    out = T.StructType([changes.schema["key"], *fields(state=TEXT, increments=LONG), T.StructField("value", kind),
                        *fields(as_of_ms=LONG)])
    return in_order(changes, "key", time, lateness, ["op", "value", *order], out,
                    lambda waiting: Register(waiting, [EVENT_MS, *order], out, defaults or {}))


TASK = fields(id=LONG, task_id=LONG, rerun=FLAG, success=FLAG, reason=TEXT)


class Queue(InOrder):
    """Tasks of one runner by their place in line. A tick reads one of them, however many wait."""

    def __init__(self, schema, order, out, readonly):
        super().__init__(schema, order, out)
        self.readonly = readonly

    def setup(self) -> None:
        self.line = self.handle.getMapState("line", fields(place=LONG), TASK)
        self.ends = self.handle.getValueState("ends", fields(head=LONG, tail=LONG))

    def advance(self, key, rows):
        head, tail = self.ends.get() if self.ends.exists() else (0, 0)
        found = []
        for row in rows:
            if row["tick"] is None:
                self.line.updateValue((tail,), tuple(row[c] for c in TASK.names))
                tail += 1
            elif head < tail:
                task = tuple(self.line.getValue((head,)))
                number, task_id, rerun, success, reason = task
                found.append((key[0], row["tick"], number, task_id, "outcome", success, reason, not self.readonly))
                if rerun:
                    found.append((key[0], row["tick"], number, task_id, "requeue", None, None, not self.readonly))
                if not self.readonly:
                    self.line.removeKey((head,))
                    head += 1
                    if rerun:
                        self.line.updateValue((tail,), task)
                        tail += 1
        self.ends.update((head, tail))
        return found


def work_queue(tasks: DataFrame, ticks: DataFrame, runners: list[str], lateness: str = "0 seconds",
               readonly: bool = False) -> DataFrame:
    """Work off task queues by state: on each tick every runner takes its first task.

    ``tasks`` has runtime, id, task_id, queued (a timestamp), rerun, and success and reason of its
    run; ``ticks`` has tick and at. Both are put in order together, tasks before a tick of the same
    time. A task that runs again goes to the end of its line. What a tick costs does not depend on
    how many tasks wait or were recorded before; a read-only one takes nothing out of the line."""
    waiting = tasks.select("runtime", F.lit(None).cast("bigint").alias("tick"), F.col("queued").cast("timestamp").alias("at"),
                           *[F.col(f.name).cast(f.dataType).alias(f.name) for f in TASK])
    fan = ticks.select(F.explode(F.array(*[F.lit(r) for r in runners])).alias("runtime"), F.col("tick").cast("bigint").alias("tick"),
                       F.col("at").cast("timestamp").alias("at"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in TASK])
    out = T.StructType([tasks.schema["runtime"], *fields(tick=LONG, id=LONG, task_id=LONG, action=TEXT, success=FLAG,
                                                        reason=TEXT, written=FLAG)])
    return in_order(waiting.unionByName(fan), "runtime", "at", lateness, ["tick", *TASK.names], out,
                    lambda schema: Queue(schema, [EVENT_MS, "tick", "id"], out, readonly))
