"""Streams run to the end of their files and are compared with their batch forms."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import monitor as m
from tidewatch.operators import requests as r
from tidewatch.operators import services as s
from tidewatch.operators import sessions
from tidewatch.sources.tables import micros, table
from tidewatch.sources.views import chunks, monitor_events, requests, tasks
from tidewatch.streaming import connections, samples, sinks


@pytest.fixture
def as_stream(spark, tmp_path):
    """A table written as files that a stream reads one after the other."""
    def write(df, name, order, files=4):
        path = str(tmp_path / name)
        ranks = df.withColumn("_part", F.ntile(files).over(Window.orderBy(*order)))
        for i in range(1, files + 1):
            ranks.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return write


def finish(stream, tmp_path, spark, name):
    path = str(tmp_path / f"{name}-out")
    query = (stream.writeStream.format("parquet").option("path", path).outputMode("append")
             .option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start())
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.read.parquet(path)


def same(left, right):
    cols = sorted(left.columns)
    a = sorted((tuple(x) for x in left.select(cols).collect()), key=repr)
    b = sorted((tuple(x) for x in right.select(cols).collect()), key=repr)
    assert a == b and a


def test_meter(spark, folder, tmp_path, as_stream):
    e = table(spark, folder, "events")
    us = micros(F.col("ts"))
    rows = e.select("event_type", "event_id", us.alias("ts_us"), F.floor(us / 1000).cast("bigint").alias("ts_ms"),
                    F.round(F.col("value") * 100).cast("bigint").alias("n"))
    live = samples.meter_samples(as_stream(rows, "s", ["ts_us", "event_id"]), "event_type", ["ts_us", "event_id"], "ts_ms", "n",
                                 16, 86_400_000, 4000, 2)
    got = finish(live, tmp_path, spark, "meter")
    order = ["ts_us", "event_id"]
    rates = m.rate_windows(rows, "event_type", order, "ts_ms", "n", 16, 86_400_000, 5)
    cols = ["event_id", "total_bytes", "window_start_ms", "window_bytes", "elapsed_ms"]
    same(got.select(*cols, F.round("rate", 9).alias("rate")), rates.select(*cols, F.round("rate", 9).alias("rate")))
    logs = m.thin_log(rows, "event_type", order, "n", 4000, 16, 2, slices=5)
    same(got.select("event_id", "should_log"), logs.select("event_id", "should_log"))


def test_health(spark, folder, tmp_path, as_stream):
    e = table(spark, folder, "events")
    us = micros(F.col("ts"))
    rows = e.select(F.col("event_type").alias("process"), "event_id", F.floor(us / 1000).cast("bigint").alias("ts_ms"),
                    F.floor(F.col("value") + 0.5).cast("bigint").alias("rss_mb"))
    order = ["ts_ms", "event_id"]
    live = connections.watch_health(as_stream(rows, "h", order), "process", order, "ts_ms", "rss_mb", 60, 86_400)
    batch = sessions.health_alerts(rows, "process", order, "ts_ms", F.col("rss_mb"), 60, 86_400, 6)
    same(finish(live, tmp_path, spark, "health"), batch)


def test_accumulate(spark, folder, tmp_path, as_stream):
    late = F.when((F.col("conn") % 3 == 0) & (F.col("seq") >= 2), 6000).otherwise(0)
    log = chunks(spark, folder).select(
        "conn", "seq", F.octet_length("payload").cast("bigint").alias("size"),
        F.timestamp_millis(1_700_000_000_000 + F.col("seq") * 1000 + late).alias("arrived"))
    live = connections.accumulate_until(as_stream(log, "c", ["arrived"]), "conn", "seq", "arrived", {"size": 900},
                                        5000, "20 seconds")
    got = finish(live, tmp_path, spark, "acc")
    batch = sessions.stream_until(log.withColumn("at", F.unix_millis("arrived")), "conn", ["seq"], {}, F.col("bytes") >= 900, "at", slices=3)
    # A connection that simply stops waits for its timer, which needs later data.
    ended = got.select("conn", "success", "seq")
    assert ended.count() == ended.select("conn").distinct().count()
    same(ended.where("success"), batch.where("success").select("conn", "success", "seq"))
    assert ended.where("NOT success").join(batch.where("success"), "conn").isEmpty()
    assert not ended.where("NOT success").isEmpty()


def test_fan_out_is_stateless(spark, folder, tmp_path, as_stream):
    events = monitor_events(spark, folder).select(
        "event_id", F.when(F.col("k") % 17 != 0, F.col("service_name")).alias("service"), F.col("key").alias("source"))
    subs = spark.createDataFrame([("svc_0", "a", True, 1), ("svc_0", "a", True, 2), ("svc_1", "b", True, 3)],
                                 "service string, module string, has_callback boolean, ord int")
    live = s.fan_out(as_stream(events, "n", ["event_id"]), subs)
    same(finish(live, tmp_path, spark, "fan"), s.fan_out(events, subs))


def test_line_sink_replaces_a_repeated_batch(spark, folder, tmp_path, as_stream):
    rows = monitor_events(spark, folder).select(F.col("ts_us").alias("ts"), F.col("data").alias("line"), F.col("reason").alias("extra"))
    path = str(tmp_path / "lines")
    sinks.deliver_lines(as_stream(rows, "l", ["ts"]), str(tmp_path / "ck"), path=path).awaitTermination(200)
    assert spark.read.parquet(path).count() == rows.count()
    sinks.append_batch(spark.read.parquet(path).where("batch_id = 1").drop("batch_id").limit(3), 1, path)
    assert spark.read.parquet(path).where("batch_id = 1").count() == 3
    assert spark.read.parquet(path).where("batch_id <> 1").count() > 3


def test_failing_ingestion_goes_on(spark, folder, tmp_path, as_stream):
    seen = []

    def ingest(rows, batch_id):
        seen.append(batch_id)
        raise RuntimeError("no")

    rows = monitor_events(spark, folder).select("event_id")
    query = sinks.deliver_lines(as_stream(rows, "l", ["event_id"], 2), str(tmp_path / "ck"), ingest=ingest)
    query.awaitTermination(200)
    assert len(seen) == 2 and query.exception() is None
    with pytest.raises(ValueError):
        sinks.deliver_lines(rows, "x")
    with pytest.raises(ValueError):
        sinks.record_access(rows, "", "x")


def test_routes_are_loaded_again(spark, folder, tmp_path, as_stream):
    req = requests(spark, folder).select("req_id", "host")
    local = spark.createDataFrame([(1, "*.ththth.example.net", "h1")], "ord int, route string, handler string")
    remote = spark.createDataFrame([(1, "*.example.com", "h3"), (1, "*.ththth.example.net", "late")], local.schema)
    loads = []

    def load(_):
        loads.append(1)
        if len(loads) == 2:
            raise RuntimeError("down")
        return remote

    path = str(tmp_path / "routed")
    sinks.route_requests(as_stream(req, "r", ["req_id"], 3), local, load, path, str(tmp_path / "ck")).awaitTermination(200)
    got = {x["req_id"]: (x["batch_id"], x["handler"]) for x in spark.read.parquet(path).collect()}
    full = {x["req_id"]: x["handler"] for x in r.domain_routes(req, local.unionByName(remote.limit(1))).collect()}
    for req_id, (batch, handler) in got.items():
        assert handler == (None if batch == 1 and full[req_id] == "h3" else full[req_id])
    assert len(loads) == 3 and len(got) == req.count()


def test_task_polling(spark, folder, tmp_path, as_stream):
    ticks = spark.createDataFrame([(i,) for i in range(2)], "tick int")
    runners = spark.createDataFrame([("rt1", "p"), ("rt2", "p"), ("rt3", None)], "runtime string, package string")
    results = lambda sp: tasks(sp, folder).select("id", F.col("ok").alias("success"), F.lit(None).cast("string").alias("reason"))
    path = str(tmp_path / "polls")
    sinks.poll_tasks(as_stream(ticks, "t", ["tick"], 2), lambda sp: tasks(sp, folder), results, runners, path,
                     str(tmp_path / "ck"), loop=False).awaitTermination(200)
    rows = spark.read.parquet(path)
    taken = rows.where("action = 'outcome'").select("batch_id", "id").collect()
    first, second = ({r.id for r in taken if r.batch_id == b} for b in (0, 1))
    assert len(first) == len(second) == 2 and not first & second


def test_requeued_tasks_wait_behind_the_others(spark):
    from tidewatch.operators.tasks import next_tasks, record_outcomes, requeued
    queue = spark.createDataFrame([(1, 1, "rt", True, 5, True), (2, 2, "rt", True, 6, False)],
                                  "id int, task_id int, runtime string, outstanding boolean, queued_us int, rerun boolean")
    runners, taken, recorded = spark.createDataFrame([("rt", "p")], "runtime string, package string"), [], None
    for _ in range(4):
        now = queue if recorded is None else requeued(queue, recorded)
        task = next_tasks(now, runners).first()
        taken.append(task.id)
        run = queue.where(F.col("id") == task.id).select("id", "task_id", F.lit(True).alias("success"), F.lit(None).cast("string").alias("reason"), "rerun")
        rows = record_outcomes(run)
        recorded = rows if recorded is None else recorded.union(rows)
    assert taken == [1, 2, 1, 1]


def test_ended_connections_are_forgotten(spark, tmp_path, as_stream):
    rows = [(c, s, 50_000 + c * 100_000 + s * 1_000, 10) for c in range(4) for s in range(3)]
    chunks = spark.createDataFrame(rows, "conn bigint, seq bigint, at bigint, size bigint").withColumn("at", F.timestamp_millis("at"))
    log = connections.accumulate_until(as_stream(chunks, "c", ["at", "conn"], 4), "conn", "seq", "at", {"size": 25}, 5_000, forget_ms=20_000)
    query = (log.writeStream.format("memory").queryName("forgotten").option("checkpointLocation", str(tmp_path / "ck"))
             .trigger(availableNow=True).start())
    query.awaitTermination(200)
    assert spark.table("forgotten").where("success").count() == 4
    # Four connections came; never more than two are held, and all but the last are gone.
    held = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    removed = sum(o["numRowsRemoved"] for p in query.recentProgress for o in p["stateOperators"])
    assert removed == 3 and max(held) == 2 and held[-1] == 1
