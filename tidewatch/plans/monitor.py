"""Queries over monitoring events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.text import friendly, text
from tidewatch.operators import monitor as m
from tidewatch.plans import view_sql as v
from tidewatch.plans.registry import query
from tidewatch.sources.tables import micros, table
from tidewatch.sources.views import monitor_events

MISC = [("k", "misc_k"), ("data", "misc_data")]
FILTERED = m.MonitorConfig(force_up_to_level=2,
                           filters={"services": ["svc_0", "svc_2"], "actions": ["tick#"]})
LINE = m.MonitorConfig(
    force_up_to_level=2, filters={"services": ["svc_0", "svc_2"]},
    fields={"service": {"len": 14, "prefix": "~", "postfix": ":"},
            "context": {"len": 4, "prefix": "<", "postfix": ">"},
            "invokeString": {"len": -12, "prefix": "|", "postfix": "|"},
            "action": {"len": 16}, "device": {"len": 9}, "outcome": True, "misc": True})
# A sample is one and a half bytes.
SAMPLE_BITS, DAY_MS = 12, 86_400_000


def derived(spark, folder):
    events = monitor_events(spark, folder)
    events = events.withColumns({"misc_k": F.when(F.col("k") % 4 == 0, text(F.col("k"))),
                                 "misc_data": F.when(F.col("k") % 7 == 0, F.concat(F.lit("d"), text(F.col("k"))))})
    return m.derive_fields(events, MISC)


DERIVED = v.MON + """, derived AS (
  SELECT *,
    service_name AS service,
    usr || '@' || network AS context,
    module || '?' || method || CASE WHEN coalesce(callee, '') || coalesce(sub_method, '') <> ''
      THEN '->' || coalesce(callee, '') || coalesce(sub_method, '') ELSE '' END AS call,
    CASE WHEN event IS NULL THEN '' ELSE event || '#' END || action AS action_text,
    src || CASE WHEN dest IS NULL THEN '' ELSE '=>' || dest END AS device,
    CASE WHEN success THEN data ELSE reason END AS outcome_text,
    concat_ws(',', CASE WHEN k % 4 = 0 THEN 'k: ' || k END, CASE WHEN k % 7 = 0 THEN 'd' || k END) AS misc
  FROM mon)"""

_FILTERED_SQL = """(coalesce(level, 4) <= 2 OR ((contains(service_name, 'svc_0') OR contains(service_name, 'svc_2'))
    AND contains(action_text, 'tick#')))"""


@query("service_volume", f"""
WITH {DERIVED}, g AS (
  SELECT service, count(*) AS events, CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) AS BIGINT) AS failures,
    CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value_total
  FROM derived WHERE {_FILTERED_SQL} GROUP BY service)
SELECT *, {v.friendly('value_total', 'B', 1024)} AS volume FROM g""")
def service_volume(spark, folder):
    return m.volume_by(m.gate(derived(spark, folder), FILTERED), "service")


_PAYLOAD = """CASE event_id % 8 WHEN 1 THEN '"text ' || k || '"' WHEN 2 THEN '{"k": ' || k || '}'
  WHEN 3 THEN '{"msg": "text", "level": 2}' WHEN 4 THEN '{"key": "a", "msg": {"k": ' || k || '}}'
  WHEN 5 THEN '{"key": "a"}' WHEN 6 THEN CAST(k AS STRING) WHEN 7 THEN '{"level": 0, "data": "x"}' END"""


@query("log_event_normalise", f"""
WITH {v.MON}, p AS (
  SELECT event_id, k, event_id % 8 AS shape FROM mon)
SELECT event_id, CASE WHEN shape = 3 THEN 2 ELSE 4 END AS level,
  CASE WHEN shape IN (4, 5) THEN 'a' END AS key,
  CASE shape WHEN 0 THEN '' WHEN 1 THEN 'text ' || k WHEN 3 THEN 'text' WHEN 6 THEN CAST(k AS VARCHAR)
    WHEN 7 THEN 'x' END AS msg_data,
  CASE WHEN shape IN (2, 4) THEN k END AS msg_k,
  CASE WHEN shape = 7 THEN 0 END AS msg_level
FROM p
UNION ALL SELECT -event_id - 1, 4, NULL, NULL, k, NULL FROM p""")
def log_event_normalise(spark, folder):
    # Every event's own payload, and beside it one of each shape an event can have.
    events = monitor_events(spark, folder).select("event_id", F.expr(_PAYLOAD).alias("payload"))
    own = table(spark, folder, "events").select(-F.col("event_id") - 1, "props")
    events = events.union(own)
    return m.normalise_events(events, "payload").select(
        "event_id", "level", "key", F.try_variant_get("msg", "$.data", "string").alias("msg_data"),
        F.try_variant_get("msg", "$.k", "int").alias("msg_k"), F.try_variant_get("msg", "$.level", "int").alias("msg_level"))


@query("fillin_enrich", f"""
WITH {v.MON}, fills(service_name, module2, method2) AS (
  VALUES ('svc_0', 'app/zero', 'start'), ('svc_1', 'app/one', NULL), ('svc_2', NULL, 'run'))
SELECT event_id, service_name, coalesce(module2, module) AS module, coalesce(method2, method) AS method
FROM mon LEFT JOIN fills USING (service_name)""")
def fillin_enrich(spark, folder):
    fills = [("svc_0", "app/zero", "start"), ("svc_1", "app/one", None), ("svc_2", None, "run")]
    rows = m.overlay_by_service(spark, monitor_events(spark, folder), fills)
    return rows.select("event_id", "service_name", "module", "method")


@query("log_fields_derive", f"""
WITH {DERIVED}
SELECT event_id, service, context, call, action_text, device, outcome_text, misc FROM derived""")
def log_fields_derive(spark, folder):
    return derived(spark, folder).select("event_id", "service", "context", "call", "action_text", "device",
                                         "outcome_text", "misc")


@query("level_gate", f"WITH {v.MON} SELECT event_id, level, key FROM mon WHERE coalesce(level, 4) <= 3")
def level_gate(spark, folder):
    rows = monitor_events(spark, folder).where(m.forced(m.MonitorConfig(force_up_to_level=3)))
    return rows.select("event_id", "level", "key")


@query("key_gate", f"""
WITH {v.MON} SELECT event_id, level, key FROM mon WHERE coalesce(level, 4) <= 2 OR key IN ('click', 'purchase')""")
def key_gate(spark, folder):
    rows = derived(spark, folder)
    rows = m.gate(rows, m.MonitorConfig(force_up_to_level=2, keys_on=["click", "purchase"]))
    return rows.select("event_id", "level", "key")


@query("substring_filter_sets", f"""
WITH {DERIVED}
SELECT event_id, service, call, device, action_text FROM derived
WHERE (contains(service_name, 'svc_0') OR contains(service_name, 'svc_2'))
  AND (contains(call, 'm1?') OR contains(call, '->k')) AND (contains(device, 'dev1') OR contains(device, '=>out'))
  AND contains(action_text, 'tick#')""")
def substring_filter_sets(spark, folder):
    config = m.MonitorConfig(filters={"services": ["svc_0", "svc_2"], "invokeStrings": ["m1?", "->k"],
                                      "devices": ["dev1", "=>out"], "actions": ["tick#"]})
    return m.gate(derived(spark, folder), config).select("event_id", "service", "call", "device", "action_text")


_LINE_SQL = f"""'~' || {v.fixed_length('service', 14)} || ': ' || '<' || {v.fixed_length('context', 4)} || '> '
  || '|' || {v.fixed_length('call', -12)} || '| ' || {v.fixed_length('action_text', 16)} || ' '
  || {v.fixed_length('device', 9)} || ' ' || outcome_text || ' ' || misc"""
LINES = f"""{DERIVED}, lines AS (
  SELECT event_id, ts_us, {_LINE_SQL} AS line, success, reason FROM derived
  WHERE coalesce(level, 4) <= 2 OR contains(service_name, 'svc_0') OR contains(service_name, 'svc_2'))"""


def lines(spark, folder):
    return m.gate(derived(spark, folder), LINE).withColumn("line", m.render_line(LINE))


@query("log_line_render", f"WITH {LINES} SELECT event_id, line FROM lines")
def log_line_render(spark, folder):
    return lines(spark, folder).select("event_id", "line")


@query("qos_by_user", f"""
WITH {v.MON}
SELECT usr, count(*) AS packets, max(ts_us) AS latest_us, arg_max(k, (ts_us, event_id)) AS latest_head,
  CASE WHEN count(*) > 1 THEN (max(ts_us) - min(ts_us)) // (count(*) - 1) END AS mean_gap_us
FROM mon GROUP BY usr""")
def qos_by_user(spark, folder):
    packets = monitor_events(spark, folder).select("usr", F.col("k").alias("head"), F.col("ts_us").alias("qos_us"),
                                                   F.col("event_id").alias("packet_id"))
    return m.qos_by_user(packets)


@query("format_friendly", f"""
WITH g AS (SELECT event_type AS stream, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS bytes,
    CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount, count(*) AS n FROM events GROUP BY event_type)
SELECT stream, bytes, {v.friendly('bytes', 'B', 1024)} AS bytes_text, {v.friendly('amount', 'HZ', 1000)} AS amount_text,
  {v.friendly('n - n', 'B', 1024)} AS zero_text FROM g""")
def format_friendly(spark, folder):
    totals = table(spark, folder, "events").groupBy(F.col("event_type").alias("stream")).agg(
        F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("bytes"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("amount"),
        F.count(F.lit(1)).alias("n"))
    return totals.select("stream", "bytes", friendly(F.col("bytes"), "B", 1024).alias("bytes_text"),
                         friendly(F.col("amount"), "HZ", 1000).alias("amount_text"),
                         friendly(F.col("n") - F.col("n"), "B", 1024).alias("zero_text"))


def samples(spark, folder):
    """Sample batches per event type: the value in hundredths is the batch size."""
    e = table(spark, folder, "events")
    us = micros(F.col("ts"))
    return e.select("event_type", "event_id", us.alias("ts_us"),
                    F.floor(us / 1000).cast("bigint").alias("ts_ms"),
                    F.round(F.col("value") * 100).cast("bigint").alias("n_samples"))


SAMPLES = """samples AS (
  SELECT event_type, event_id, epoch_us(ts) AS ts_us, epoch_us(ts) // 1000 AS ts_ms,
    CAST(round(value * 100) AS BIGINT) AS n_samples,
    CAST(round(value * 100) AS BIGINT) * 12 / 8 AS step_bytes,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nth
  FROM events)"""


@query("running_stream_totals", f"""
WITH {SAMPLES}, t AS (SELECT *, sum(step_bytes) OVER (PARTITION BY event_type ORDER BY ts_us, event_id
    ROWS UNBOUNDED PRECEDING) AS total_bytes FROM samples)
SELECT event_id, event_type, step_bytes, total_bytes, total_bytes = step_bytes AS is_first,
  {v.friendly('total_bytes', 'B', 1024)} AS total_text FROM t""")
def running_stream_totals(spark, folder):
    rows = m.stream_totals(samples(spark, folder), "event_type", ["ts_us", "event_id"], "n_samples", SAMPLE_BITS)
    return rows.select("event_id", "event_type", "step_bytes", "total_bytes", "is_first", "total_text")


@query("rate_reset_window", f"""
WITH RECURSIVE {SAMPLES}, fold AS (
  SELECT event_type, nth, event_id, ts_ms AS start_ms, step_bytes AS acc, step_bytes AS total,
    CAST(0 AS BIGINT) AS elapsed, CAST(NULL AS DOUBLE) AS rate FROM samples WHERE nth = 1
  UNION ALL
  SELECT s.event_type, s.nth, s.event_id,
    CASE WHEN s.ts_ms - f.start_ms > {DAY_MS} OR f.acc = 0 THEN s.ts_ms ELSE f.start_ms END,
    CASE WHEN s.ts_ms - f.start_ms > {DAY_MS} THEN s.step_bytes ELSE f.acc + s.step_bytes END,
    f.total + s.step_bytes,
    CASE WHEN s.ts_ms - f.start_ms > {DAY_MS} THEN 0 ELSE s.ts_ms - f.start_ms END,
    CASE WHEN s.ts_ms - f.start_ms <= {DAY_MS} AND (s.ts_ms - f.start_ms) * 2 > {DAY_MS}
      THEN (f.acc + s.step_bytes) * 8 / (CAST(s.ts_ms - f.start_ms AS DOUBLE) / 1000) / 12
      ELSE f.rate END
  FROM fold f JOIN samples s ON s.event_type = f.event_type AND s.nth = f.nth + 1)
SELECT event_id, event_type, start_ms AS window_start_ms, acc AS window_bytes, elapsed AS elapsed_ms,
  round(rate, 6) AS rate, {v.friendly('rate', 'HZ', 1000)} AS rate_text FROM fold""")
def rate_reset_window(spark, folder):
    rows = m.rate_windows(samples(spark, folder), "event_type", ["ts_us", "event_id"], "ts_ms", "n_samples",
                          SAMPLE_BITS, DAY_MS)
    return rows.select("event_id", "event_type", "window_start_ms", "window_bytes", "elapsed_ms",
                       F.round("rate", 6).alias("rate"), "rate_text")


@query("log_thinning", f"""
WITH RECURSIVE {SAMPLES}, fold AS (
  SELECT event_type, nth, event_id, step_bytes AS total, true AS should_log, CAST(0 AS DOUBLE) AS buffered
  FROM samples WHERE nth = 1
  UNION ALL
  SELECT s.event_type, s.nth, s.event_id, f.total + s.step_bytes,
    f.total = 0 OR f.buffered + s.step_bytes > 5 * 4000 * 12 * 2 / 8,
    CASE WHEN f.total = 0 OR f.buffered + s.step_bytes > 5 * 4000 * 12 * 2 / 8 THEN 0
      ELSE f.buffered + s.step_bytes END
  FROM fold f JOIN samples s ON s.event_type = f.event_type AND s.nth = f.nth + 1)
SELECT event_id, event_type, total AS total_bytes, should_log FROM fold""")
def log_thinning(spark, folder):
    rows = m.thin_log(samples(spark, folder), "event_type", ["ts_us", "event_id"], "n_samples",
                      sample_rate=4000, bits=SAMPLE_BITS, channels=2)
    return rows.select("event_id", "event_type", "total_bytes", "should_log")
