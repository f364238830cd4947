"""Micro-batch sinks and jobs: log lines, access rows, task polling, reloaded routes.

Each micro-batch is written under its own batch number and replaces what an earlier
try of the same batch left, so a batch that runs again after a failure adds nothing
twice.
"""

from __future__ import annotations

import logging
import time as wall
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators.requests import access_rows, domain_routes, routes_by_load
from tidewatch.operators.services import route_union
from tidewatch.operators.tasks import poll_once, requeued

log = logging.getLogger(__name__)

BATCH = "batch_id"


def append_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Write a micro-batch as one partition of an append-only Parquet table."""
    (rows.withColumn(BATCH, F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path))


def _start(rows: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def deliver_lines(lines: DataFrame, checkpoint: str, every: str | None = None, path: str | None = None,
                  ingest: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Deliver (ts, line, extra) rows to an ingestion callback, else to a table.

    A callback that fails is reported and the stream goes on.
    """
    def work(rows: DataFrame, batch_id: int) -> None:
        if ingest is None:
            append_batch(rows, batch_id, path)
            return
        try:
            ingest(rows, batch_id)
        except Exception as error:  # noqa: BLE001 - delivery must never stop the stream
            log.error("monitoring ingestion failed for batch %s: %s", batch_id, error)

    if ingest is None and not path:
        raise ValueError("give a table path or an ingestion callback")
    return _start(lines, work, checkpoint, every)


def append_access_log(requests: DataFrame, path: str) -> None:
    """Append the access rows of a finished request log to a table."""
    if not path:
        raise ValueError("Please define the table the access log is written to.")
    access_rows(requests).write.mode("append").parquet(path)


def record_access(requests: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append access-log rows to a table. A failed write is reported, requests go on."""
    if not path:
        raise ValueError("Please define the table the access log is written to.")

    def work(rows: DataFrame, batch_id: int) -> None:
        try:
            append_batch(access_rows(rows), batch_id, path)
        except Exception as error:  # noqa: BLE001 - the log never blocks
            log.error("access log write failed for batch %s: %s", batch_id, error)

    return _start(requests, work, checkpoint, every)


def poll_tasks(ticks: DataFrame, read_tasks: Callable[[SparkSession], DataFrame],
               read_results: Callable[[SparkSession], DataFrame], runners: DataFrame, path: str, checkpoint: str,
               delay: str = "5 seconds", loop: bool = True, readonly: bool = False) -> StreamingQuery:
    """On each tick, take the first task of every runner and record how it ended.

    The queue and the results are read anew each time, and what earlier ticks recorded
    under ``path`` is applied to the queue: tasks that ran are done, those that run again
    wait behind the others. Without ``loop`` the ticks at hand are one pass. A read-only
    poll plans but writes nothing.
    """
    def work(rows: DataFrame, batch_id: int) -> None:
        if rows.isEmpty():
            return
        spark = rows.sparkSession
        queue = read_tasks(spark)
        try:
            earlier = spark.read.parquet(path).where(F.col("batch_id") < batch_id)
        except AnalysisException:  # nothing is recorded yet
            earlier = None
        queue = queue if earlier is None else requeued(queue, earlier)
        planned = poll_once(queue, runners, read_results(spark), readonly)
        if not readonly:
            append_batch(planned, batch_id, path)

    return _start(ticks, work, checkpoint, delay if loop else None)


def route_requests(requests: DataFrame, local: DataFrame, load_remote: Callable[[SparkSession], DataFrame], path: str,
                   checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Route each micro-batch by routes loaded anew for it.

    Every load starts from the local routes, so a load that fails leaves only those.
    """
    def work(rows: DataFrame, batch_id: int) -> None:
        remote = _loaded(rows.sparkSession, load_remote)
        routes = route_union(local, remote)
        ranked = routes.withColumn("ord", F.struct("source_rank", "ord")).drop("source_rank")
        append_batch(domain_routes(rows, ranked).withColumn("ord", F.col("ord.ord")), batch_id, path)

    return _start(requests, work, checkpoint, every)


def _loaded(spark: SparkSession, load_remote: Callable[[SparkSession], DataFrame]) -> DataFrame | None:
    try:
        remote = load_remote(spark)
        remote.isEmpty()
        return remote
    except Exception as error:  # noqa: BLE001 - routing goes on with the local routes
        log.error("route load failed: %s", error)
        return None


LOADED_MS = "loaded_ms"


def route_requests_by_load(requests: DataFrame, time: str, local: DataFrame, load_remote: Callable[[SparkSession], DataFrame],
                           path: str, loads: str, checkpoint: str, reload_seconds: int, every: str | None = None,
                           clock: Callable[[], int] = lambda: int(wall.time() * 1000)) -> StreamingQuery:
    """Route requests by the load in force at their time; routes are loaded every ``reload_seconds``.

    Loads are kept as tables under ``loads``: one that lists them, failed ones included, and one of
    their routes. A micro-batch loads only if the last load is that old by the ``clock``, in ms; a
    failed load leaves the local routes. Late requests take the load of their time, those before
    the first load that one. Only the loads that a micro-batch's times fall into are read.
    """
    listed, routes = f"{loads}/loads", f"{loads}/routes"
    schema = T.StructType([*local.schema, T.StructField(LOADED_MS, T.LongType())])

    def known(spark: SparkSession, folder: str) -> DataFrame | None:
        try:
            return spark.read.parquet(folder)
        except AnalysisException:  # nothing is loaded yet
            return None

    def work(rows: DataFrame, batch_id: int) -> None:
        spark, now = rows.sparkSession, clock()
        earlier = known(spark, listed)
        last = None if earlier is None else earlier.where(F.col(BATCH) != batch_id).agg(F.max(LOADED_MS)).first()[0]
        if last is None or now - last >= reload_seconds * 1000:
            remote = _loaded(spark, load_remote)
            if remote is not None:
                append_batch(remote.withColumn(LOADED_MS, F.lit(now)), batch_id, routes)
            append_batch(spark.createDataFrame([(now, remote is not None)], f"{LOADED_MS} bigint, success boolean"), batch_id, listed)
        at = F.unix_millis(F.col(time).cast("timestamp"))
        span = rows.agg(F.min(at), F.max(at)).first()
        if span[0] is None:
            return
        times = known(spark, listed).select(LOADED_MS)
        before = times.where(F.col(LOADED_MS) <= span[0]).agg(F.max(LOADED_MS)).first()[0]
        # A load lasts for some time, so the time a micro-batch spans bounds their number.
        used = times.where((F.col(LOADED_MS) >= (before or 0)) & (F.col(LOADED_MS) <= span[1]))
        used = sorted(r[0] for r in used.collect()) or [times.agg(F.min(LOADED_MS)).first()[0]]
        in_force = F.coalesce(F.array_max(F.filter(F.lit(used), lambda t: t <= at)), F.lit(used[0]))
        loaded = known(spark, routes)
        loaded = spark.createDataFrame([], schema) if loaded is None else loaded.where(F.col(LOADED_MS).isin(used)).drop(BATCH)
        append_batch(routes_by_load(rows.withColumn(LOADED_MS, in_force), local, loaded, LOADED_MS), batch_id, path)

    return _start(requests, work, checkpoint, every)
