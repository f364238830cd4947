"""Streams whose rows are dealt over micro-batches in any order, against the batch forms."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import monitor, scripts, services, sessions
from tidewatch.streaming import connections, queues, samples, sinks

START = 1_700_000_000_000
FAR = "365 days"


@pytest.fixture
def shuffled(spark, tmp_path):
    """Rows in random order over several files, then a file whose row puts the watermark past all."""
    def write(rows, schema, name, files=4, end=None, seed=1):
        path, rng = str(tmp_path / name), random.Random(seed)
        rows = list(rows)
        rng.shuffle(rows)
        parts = [rows[i::files] for i in range(files)] + ([[end]] if end else []) + ([[end]] if end else [])
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)
    return write


def finish(stream, tmp_path, name):
    query = (stream.writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start())
    query.awaitTermination(300)
    assert query.exception() is None
    return stream.sparkSession.table(name), query


def rows_of(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def stamp(df, column="at_ms"):
    return df.withColumn("at", F.timestamp_millis(column))


def test_meter_in_any_order(spark, tmp_path, shuffled):
    """12-bit samples: totals are not whole bytes, and a batch of one sample is not empty."""
    rng, rows, clock = random.Random(3), [], {}
    for i in range(400):
        s = rng.choice("ab")
        clock[s] = clock.get(s, START) + rng.choice([1, 700, 4_000, 15_000])
        rows.append((s, i, clock[s], rng.choice([0, 1, 1, 7, 300])))
    schema = "s string, id bigint, at_ms bigint, n bigint"
    end = ("z", 9_999, START + 86_400_000 * 400, 1)
    live = samples.meter_samples(stamp(shuffled(rows, schema, "m", end=end)), "s", ["at_ms", "id"], "at_ms", "n", 12, 10_000, 40,
                                 event_time="at", lateness=FAR)
    got, _ = finish(live, tmp_path, "meter")
    got = got.where("s <> 'z'")
    table = spark.createDataFrame(rows, schema)
    rates = monitor.rate_windows(table, "s", ["at_ms", "id"], "at_ms", "n", 12, 10_000, 3)
    columns = ["id", "step_bytes", "total_bytes", "window_start_ms", "window_bytes", "elapsed_ms", "rate"]
    assert rows_of(got, columns) == rows_of(rates, columns) and got.where("total_bytes % 1 <> 0").count() > 0
    logs = monitor.thin_log(table, "s", ["at_ms", "id"], "n", 40, 12, slices=3)
    assert rows_of(got, ["id", "should_log"]) == rows_of(logs, ["id", "should_log"])


def test_health_in_any_order(spark, tmp_path, shuffled):
    rng = random.Random(5)
    rows = [(rng.choice("pq"), i, START + i * 40_000, rng.choice([10, 50, 95])) for i in range(200)]
    schema = "process string, id bigint, at_ms bigint, rss_mb bigint"
    live = connections.watch_health(stamp(shuffled(rows, schema, "h", end=("z", 999, START + 86_400_000 * 400, 1))), "process",
                                    ["at_ms", "id"], "at_ms", "rss_mb", 90, 600, event_time="at", lateness=FAR)
    got, _ = finish(live, tmp_path, "health")
    batch = sessions.health_alerts(spark.createDataFrame(rows, schema), "process", ["at_ms", "id"], "at_ms", F.col("rss_mb"), 90, 600, 3)
    columns = ["id", "uptime_seconds", "instantiate", "memory_trigger", "ttl_expired", "restart"]
    assert rows_of(got.where("process <> 'z'"), columns) == rows_of(batch, columns)


def chunked(texts, rng, most=9):
    rows = []
    for conn, text in enumerate(texts):
        at = seq = 0
        while at < len(text):
            n = rng.randrange(1, most)
            rows.append((conn, seq, text[at:at + n], START + seq * 100))
            at, seq = at + n, seq + 1
    return rows


CHUNK = "conn bigint, seq bigint, t string, at_ms bigint"
END = (-1, 0, "x", START + 86_400_000 * 400)


def message(body, length=None):
    return f"HTTP/1.1 200 OK\r\nContent-Length: {len(body) if length is None else length}\r\n\r\n{body}"


def test_messages_of_a_connection(spark, tmp_path, shuffled):
    rng = random.Random(7)
    bodies = [["".join(rng.choice("xy\r\nz") for _ in range(rng.randrange(0, 40))) for _ in range(1 + c % 4)] for c in range(6)]
    texts = ["".join(map(message, b)) for b in bodies]
    texts += [message("short", 50), "no header at all", "X: 1\r\n\r\nno length", "h" * 300 + "\r\n\r\n", message("whole") + "rest"]
    rows = chunked(texts, rng)
    live = connections.message_frames(stamp(shuffled(rows, CHUNK, "f", end=END)), "conn", "seq", "t", "at", FAR, head_limit=200)
    got, query = finish(live, tmp_path, "frames")
    found = {(r.conn, r.message): (r.success, r.body, r.reason) for r in got.where("conn >= 0").collect()}
    want = {(c, i): (True, b, None) for c, own in enumerate(bodies) for i, b in enumerate(own)}
    want |= {(6, 0): (False, None, "body incomplete"), (7, 0): (False, None, "no blank line"), (8, 0): (False, None, "no content length"),
             (9, 0): (False, None, "header too long"), (10, 0): (True, "whole", None), (10, 1): (False, None, "no blank line")}
    assert found == want
    # First messages are those of the batch form, and nothing but the last row's key is held at the end.
    batch = sessions.content_length_frames(spark.createDataFrame(rows, CHUNK), "conn", "seq", "t", 3, head_limit=200)
    first = {r.conn: (r.success, r.content_length, r.done_seq, r.body, r.reason) for r in batch.collect()}
    live_first = {r.conn: (r.success, r.content_length, r.done_seq, r.body, r.reason) for r in got.where("message = 0 AND conn >= 0").collect()}
    assert live_first == first
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] < 10


def test_scripts_in_any_order(spark, tmp_path, shuffled):
    rng = random.Random(9)
    script = ["ab", re.compile("c+a$"), "b", re.compile("[ab]{2}c")]
    rows = chunked(["".join(rng.choice("aabbcc") for _ in range(rng.randrange(5, 120))) for _ in range(15)], rng, 4)
    live = connections.follow_script(stamp(shuffled(rows, CHUNK, "s", end=END)), "conn", "seq", "t", "at", script, FAR)
    got, _ = finish(live, tmp_path, "scripts")
    columns = ["conn", "matched", "done_seq", "success", "reason"]
    table = spark.createDataFrame(rows, CHUNK)
    for slices in (1, 5):
        batch = scripts.match_script(table, "conn", "seq", "t", script, slices)
        assert rows_of(got.where("conn >= 0"), columns) == rows_of(batch, columns)


def test_handlers_hand_over(spark, tmp_path, shuffled):
    def scan(text, state, states):
        """Place behind the blank line, once it is there."""
        at = text.find("\n\n")
        return None if at < 0 else at + 2

    def count(text, state, states):
        """Signs since the scan handed over."""
        return None if states["scan"] is None else len(text) - states["scan"]

    texts = ["head\n\n" + "b" * 30, "head\n\nfew", "no end of a head", "\n\n" + "c" * 12]
    rows = chunked(texts, random.Random(2), 6)
    rows += [(4, 0, "head\n", START), (4, 1, "\n" + "d" * 20, START + 9_000)]
    live = connections.rotate_until(stamp(shuffled(rows, CHUNK, "r", end=END)), "conn", "seq", "t", "at",
                                    {"scan": scan, "count": count}, lambda s: (s.get("count") or 0) < 10, FAR)
    got, query = finish(live, tmp_path, "rotation")
    found = {r.conn: (r.success, r.seq, json.loads(r.states), r.reason) for r in got.where("conn >= 0").collect()}
    late = "socketWhile timeout, totalTimeWaited: 5000"
    assert len(found) == 5 and {c: r[0] for c, r in found.items()} == {0: True, 1: False, 2: False, 3: True, 4: False}
    assert {r[3] for c, r in found.items() if c in (1, 2, 4)} == {late} and found[4][2] == {"scan": None, "count": None}
    for conn in (0, 3):
        own = sorted(r for r in rows if r[0] == conn)
        sent, done = "", None
        for _, seq, t, _ in own:
            sent += t
            if "\n\n" in sent and len(sent) - sent.find("\n\n") - 2 >= 10:
                done = seq
                break
        assert found[conn][1] == done and found[conn][2]["count"] == len(sent) - found[conn][2]["scan"]


def test_key_value_state_in_any_order(spark, tmp_path, shuffled):
    rng = random.Random(12)
    rows = [(rng.choice("abcde"), rng.choice(["set", "delete", "increment", "increment"]), rng.randrange(9), START + i * 1_000, i)
            for i in range(300)]
    rows = [(k, op, v if op == "set" else None, at, i) for k, op, v, at, i in rows] + [("only", "increment", None, START, 999)]
    schema = "key string, op string, value bigint, at_ms bigint, event_id bigint"
    live = queues.follow_changes(stamp(shuffled(rows, schema, "k", end=("z", "set", 1, START + 86_400_000 * 400, 0))), "at", ["event_id"],
                                 {"a": 3}, FAR)
    got, _ = finish(live, tmp_path, "register")
    columns = ["state", "increments", "value"]
    last = got.where("key <> 'z'").groupBy("key").agg(*[F.max_by(c, "as_of_ms").alias(c) for c in columns])
    log = spark.createDataFrame(rows, schema).withColumn("ts_us", F.col("at_ms") * 1000)
    batch = services.fold_changes(log, spark.createDataFrame([("a", 3)], "key string, value bigint"))
    assert rows_of(last, ["key", *columns]) == rows_of(batch, ["key", *columns])


def test_queue_by_state(spark, tmp_path, shuffled):
    """Fifty ticks against a plain queue; a tick reads no more when more was recorded before."""
    rng = random.Random(4)
    tasks = [(f"r{i % 2}", i, i + 100, START + rng.randrange(40) * 1_000, rng.random() < 0.4, i % 3 != 0, f"why {i}") for i in range(60)]
    ticks = [(n, START + n * 1_000 + 500) for n in range(50)]
    want, lines = [], {"r0": [], "r1": []}
    for n, at in ticks:
        for t in sorted((t for t in tasks if at - 1_000 < t[3] <= at or n == 0 and t[3] <= at), key=lambda t: (t[3], t[1])):
            lines[t[0]].append(t)
        for name, line in lines.items():
            if line:
                t = line.pop(0)
                want.append((name, n, t[1], "outcome", t[5]))
                if t[4]:
                    want.append((name, n, t[1], "requeue", None))
                    line.append(t)
    task_schema = "runtime string, id bigint, task_id bigint, at_ms bigint, rerun boolean, success boolean, reason string"
    queued = stamp(shuffled(tasks, task_schema, "t", files=2)).withColumnRenamed("at", "queued")
    clock = stamp(shuffled(ticks, "tick bigint, at_ms bigint", "c", files=2, end=(99, START + 86_400_000 * 400)))
    got, _ = finish(queues.work_queue(queued, clock, ["r0", "r1"], FAR), tmp_path, "queue")
    assert rows_of(got.where("tick < 99"), ["runtime", "tick", "id", "action", "success"]) == sorted(want, key=repr)


def test_routes_are_loaded_every_n_seconds(spark, tmp_path):
    local = spark.createDataFrame([(1, "*.local.net", "near")], "ord int, route string, handler string")
    now, loads = [START], []

    def load(_):
        loads.append(now[0])
        if len(loads) == 3:
            raise RuntimeError("down")
        return spark.createDataFrame([(1, "*.remote.net", f"v{len(loads)}")], local.schema)

    path = str(tmp_path / "requests")
    schema = "req_id bigint, host string, at_ms bigint"
    out = str(tmp_path / "routed")

    def batch(at, rows):
        now[0] = at
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = stamp(spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(path))
        query = sinks.route_requests_by_load(stream, "at", local, load, out, str(tmp_path / "loads"), str(tmp_path / "ck"), 60,
                                             clock=lambda: now[0])
        query.awaitTermination(200)
        assert query.exception() is None

    batch(START, [(1, "a.remote.net", START), (2, "b.local.net", START), (3, "a.remote.net", START - 5_000)])
    batch(START + 30_000, [(4, "a.remote.net", START + 30_000)])
    batch(START + 61_000, [(5, "a.remote.net", START + 61_500), (6, "a.remote.net", START + 20_000)])
    batch(START + 125_000, [(7, "a.remote.net", START + 125_500), (8, "b.local.net", START + 125_500), (9, "a.remote.net", START + 62_000)])
    got = {r.req_id: r.handler for r in spark.read.parquet(out).collect()}
    # Two micro-batches within a minute load once; late rows take the older load; a failed load leaves the local routes.
    assert loads == [START, START + 61_000, START + 125_000]
    assert got == {1: "v1", 2: "near", 3: "v1", 4: "v1", 5: "v2", 6: "v1", 7: None, 8: "near", 9: "v2"}
