"""Queries over task queues and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import tasks as t
from tidewatch.operators import traces as tr
from tidewatch.plans import view_sql as v
from tidewatch.plans.registry import query
from tidewatch.sources.tables import table
from tidewatch.sources.views import TRACE_ORDER, chunks, tasks, trace_steps


@query("next_task", f"""
WITH {v.TASK}, runners AS (SELECT DISTINCT runtime, CASE WHEN runtime <> 'rt3' THEN 'pkg' || substr(runtime, 3) END AS package FROM task
  UNION ALL SELECT 'rt without a queue', 'pkg'),
n AS (SELECT runtime, id, task_id, queued_us, row_number() OVER (PARTITION BY runtime ORDER BY queued_us, id) AS nth FROM task
  WHERE outstanding)
SELECT r.runtime, CASE WHEN package IS NULL THEN 'refused' WHEN n.id IS NULL THEN 'no outstanding tasks' ELSE 'task' END AS state,
  CASE WHEN package IS NULL THEN 2000001 END AS status, CASE WHEN package IS NOT NULL THEN id END AS id,
  CASE WHEN package IS NOT NULL THEN task_id END AS task_id, CASE WHEN package IS NOT NULL THEN queued_us END AS queued_us
FROM runners r LEFT JOIN n ON n.runtime = r.runtime AND nth = 1""")
def next_task(spark, folder):
    queue = tasks(spark, folder)
    name = F.concat(F.lit("pkg"), F.substring("runtime", F.lit(3), F.length("runtime")))
    runners = queue.select("runtime").distinct().withColumn("package", F.when(F.col("runtime") != "rt3", name))
    idle = spark.createDataFrame([("rt without a queue", "pkg")], "runtime string, package string")
    return t.next_tasks(queue, runners.union(idle))


@query("task_outcome_record", f"""
WITH {v.TASK}, runs AS (SELECT id, task_id, ok, CASE WHEN NOT ok THEN 'failed ' || id END AS reason, rerun FROM task WHERE outstanding)
SELECT id, task_id, 'outcome' AS action, ok AS success, reason, true AS written FROM runs
UNION ALL SELECT id, task_id, 'requeue', NULL, NULL, true FROM runs WHERE rerun""")
def task_outcome_record(spark, folder):
    failed = F.concat(F.lit("failed "), F.col("id").cast("string"))
    runs = tasks(spark, folder).where("outstanding").select(
        "id", "task_id", F.col("ok").alias("success"), F.when(~F.col("ok"), failed).alias("reason"), "rerun")
    return t.record_outcomes(runs)


@query("task_progress", """
SELECT l_orderkey AS trace, max(l_linenumber * 15) AS progress, count(*) AS reports, max(l_linenumber * 15) >= 100 AS done
FROM lineitem GROUP BY l_orderkey""")
def task_progress(spark, folder):
    reports = trace_steps(spark, folder).select("trace", (F.col("l_linenumber") * 15).alias("step"))
    return t.progress(reports, "trace", "step")


@query("first_failure", f"""
WITH {v.TRACE}, f AS (SELECT trace, min(step) FILTER (NOT ok) AS failed_step, count(*) AS total FROM trace GROUP BY trace)
SELECT o_orderkey AS trace, total IS NOT NULL AND failed_step IS NULL AS success, failed_step,
  coalesce(failed_step, total, 0) AS counted, coalesce(total - failed_step, 0) AS ignored,
  CASE WHEN total IS NULL THEN 'WARNING, returning from a chain that did not have the "outcome" property set.' WHEN failed_step IS NOT NULL THEN 'step failed: ' || failed_step END AS reason
FROM orders LEFT JOIN f ON trace = o_orderkey""")
def first_failure(spark, folder):
    traces = table(spark, folder, "orders").select(F.col("o_orderkey").alias("trace"))
    return tr.first_failures(traces, trace_steps(spark, folder), TRACE_ORDER)


@query("replay_iterations", f"""
WITH {v.TRACE}, i AS (SELECT trace, ship_us, CAST(sum(CASE WHEN restart THEN 1 ELSE 0 END)
    OVER (PARTITION BY trace ORDER BY step ROWS UNBOUNDED PRECEDING) AS BIGINT) AS iteration FROM trace)
SELECT trace, iteration, count(*) AS steps, max(ship_us) - min(ship_us) AS elapsed FROM i GROUP BY trace, iteration""")
def replay_iterations(spark, folder):
    steps = trace_steps(spark, folder).select("trace", "restart", *TRACE_ORDER)
    return tr.replay_iterations(steps, TRACE_ORDER, "ship_us")


@query("call_stack_paths", f"""
WITH RECURSIVE {v.CHUNK}, e AS (SELECT conn, seq, CASE WHEN seq > 0 THEN (seq - 1) // 2 END AS parent,
    chr(13) || chr(10) || '* ' || rpad(role, 70, ' ') || ' ' || CASE WHEN seq % 2 = 1
      THEN ' function at chain index ' || (seq + 1) || ' immediately following' ELSE ' chain index ' || seq END
    || ' [' || length(payload) || ']' AS entry FROM chunk),
s AS (SELECT conn, seq AS node, parent, 1 AS depth, entry AS stack_text FROM e
  UNION ALL SELECT s.conn, s.node, e.parent, s.depth + 1, s.stack_text || e.entry FROM s JOIN e ON e.conn = s.conn AND e.seq = s.parent)
SELECT conn, node, max(depth) AS depth, arg_max(stack_text, depth) AS stack_text FROM s GROUP BY conn, node""")
def call_stack_paths(spark, folder):
    seq = F.col("seq")
    entry = tr.stack_entry(F.col("role"), seq, F.length("payload").cast("string"), seq % 2 == 1)
    calls = chunks(spark, folder).select(
        "conn", seq.alias("node"), F.when(seq > 0, F.floor((seq - 1) / 2)).cast("bigint").alias("parent"), entry.alias("entry"))
    return tr.call_stacks(calls, ["conn"])


@query("task_poll_stream", f"""
WITH {v.TASK}, first AS (SELECT * FROM task WHERE outstanding QUALIFY row_number() OVER (PARTITION BY runtime ORDER BY queued_us, id) = 1)
SELECT id, task_id, 'outcome' AS action, ok AS success, CASE WHEN NOT ok THEN 'failed ' || id END AS reason, true AS written FROM first
UNION ALL SELECT id, task_id, 'requeue', NULL, NULL, true FROM first WHERE rerun""")
def task_poll_stream(spark, folder):
    queue = tasks(spark, folder)
    runners = queue.select("runtime").distinct().withColumn("package", F.lit("pkg"))
    failed = F.concat(F.lit("failed "), F.col("id").cast("string"))
    results = queue.select("id", F.col("ok").alias("success"), F.when(~F.col("ok"), failed).alias("reason"))
    return t.poll_once(queue, runners, results)
