"""Queries over connections, sessions and health checks."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidewatch.operators import scripts
from tidewatch.operators import sessions as s
from tidewatch.plans import view_sql as v
from tidewatch.plans.registry import query
from tidewatch.sources.tables import micros, table
from tidewatch.sources.views import chunks, monitor_events

# Texts and patterns, of which some go over the border of two chunks.
SCRIPT = ["a", re.compile("[aeiou]n[^ ]{2,}"), " de", re.compile("(e|o)[a-z]* [a-z]+[.?,]"), "ent", re.compile("^[A-Z].*[a-z]")]


@query("pipe_pairing", f"""
WITH {v.CHUNK}, c AS (SELECT conn // 2 AS pipe, CASE WHEN conn % 2 = 0 THEN 's1' ELSE 's2' END AS side, conn, seq,
    octet_length(encode(payload)) AS size, seq = 0 AS buffered FROM chunk),
t AS (SELECT pipe, CAST(coalesce(sum(size) FILTER (side = 's1'), 0) AS BIGINT) AS bytes_s1_s2, CAST(coalesce(sum(size) FILTER (side = 's2'), 0) AS BIGINT) AS bytes_s2_s1,
    CAST(coalesce(sum(size) FILTER (side = 's1' AND buffered), 0) AS BIGINT) AS buffered_s1,
    CAST(coalesce(sum(size) FILTER (side = 's2' AND buffered), 0) AS BIGINT) AS buffered_s2 FROM c GROUP BY pipe),
e AS (SELECT pipe, side, CASE WHEN conn % 11 <> 0 THEN max(seq) END AS closed, conn % 5 = 0 AS had_error FROM c GROUP BY pipe, side, conn),
f AS (SELECT pipe, arg_min(side, (closed, side)) FILTER (closed IS NOT NULL) AS first_close,
    arg_min(had_error, (closed, side)) FILTER (closed IS NOT NULL) AS had_error, count(*) AS sides FROM e GROUP BY pipe),
r AS (SELECT t.*, first_close, CASE WHEN sides < 2 THEN 'Invalid socketId for ' || CASE WHEN pipe * 2 IN (SELECT conn FROM c) THEN 's2' ELSE 's1' END
    WHEN first_close IS NULL THEN 'still open' WHEN had_error THEN 'hadError was set ' END AS reason FROM t LEFT JOIN f USING (pipe))
SELECT *, reason IS NULL AS success FROM r""")
def pipe_pairing(spark, folder):
    conn = F.col("conn")
    side = F.when(conn % 2 == 0, "s1").otherwise("s2")
    log = chunks(spark, folder).select(F.floor(conn / 2).cast("bigint").alias("pipe"), side.alias("side"), "conn", "seq",
                                       F.octet_length("payload").alias("size"), (F.col("seq") == 0).alias("buffered"))
    closes = log.groupBy("pipe", "side", "conn").agg(F.max("seq").alias("closed")).withColumns({
        "closed": F.when(conn % 11 != 0, F.col("closed")), "had_error": conn % 5 == 0})
    return s.pair_pipes(log, closes)


def _dashed(text, width):
    return f"CASE WHEN length({text}) < {width} THEN rpad({text}, {width}, '-') ELSE {text} END"


@query("session_elapsed", f"""
WITH {v.MON}, st AS (SELECT user_id, min(ts_us) AS start_us FROM mon GROUP BY user_id),
n AS (SELECT *, 'web' || row_number() OVER (ORDER BY start_us, user_id) AS session_id FROM st),
e AS (SELECT event_id, session_id, (ts_us // 1000000 - start_us // 1000000) * 1000 AS elapsed_ms, src AS socket,
    replace(CASE WHEN k % 5 = 0 THEN key || '#' ELSE key END, '#', '\\r\\n') || ' ' AS action, data || '\\r\\n' || chr(13) || chr(10) || 'end' AS msg
  FROM mon JOIN n USING (user_id))
SELECT event_id, session_id, elapsed_ms, '[ ' || {_dashed('session_id', 10)} || ' ' || {_dashed('CAST(elapsed_ms AS VARCHAR)', 10)} || ' '
  || {_dashed('socket', 15)} || ' ' || {_dashed('action', 20)} || '] ' || msg AS line FROM e""")
def session_elapsed(spark, folder):
    entries = monitor_events(spark, folder).select(
        "event_id", "user_id", "ts_us", F.col("src").alias("socket"),
        F.concat(F.col("data"), F.lit("\r\n\r\nend")).alias("msg"),
        F.when(F.col("k") % 5 == 0, F.concat(F.col("key"), F.lit("\r\n"))).otherwise(F.col("key")).alias("action"))
    return s.session_lines(entries, "user_id", "web").select("event_id", "session_id", "elapsed_ms", "line")


# The scan waits for a long word; then bytes and full stops are counted, from the next chunk on.
LONG_WORD = re.compile("[^ ]{14}")


@query("stream_until", f"""
WITH {v.CHUNK}, c AS (SELECT conn, seq, octet_length(encode(payload)) AS size, length(payload) - length(replace(payload, '.', '')) AS stops,
    string_agg(payload, '') OVER (PARTITION BY conn ORDER BY seq) AS sent,
    seq * 1000 + CASE WHEN conn % 3 = 0 AND seq >= 2 THEN 6000 ELSE 0 END AS arrived FROM chunk),
h AS (SELECT conn, min(seq) FILTER (regexp_matches(sent, '{LONG_WORD.pattern}')) AS hit FROM c GROUP BY conn),
r AS (SELECT conn, seq, hit, CAST(sum(size) OVER w AS BIGINT) AS bytes, sum(CASE WHEN seq > hit THEN stops ELSE 0 END) OVER w AS stops,
    sum(CASE WHEN seq > hit THEN size ELSE 0 END) OVER w AS later, arrived - lag(arrived) OVER w AS gap FROM c JOIN h USING (conn)
  WINDOW w AS (PARTITION BY conn ORDER BY seq ROWS UNBOUNDED PRECEDING)),
d AS (SELECT conn, min(seq) FILTER (seq >= hit AND stops >= 3 AND later >= 200) AS done, min(seq) FILTER (gap >= 5000) AS idle FROM r GROUP BY conn),
f AS (SELECT *, done IS NOT NULL AND (idle IS NULL OR done < idle) AS success FROM d)
SELECT f.conn, success, CASE WHEN success THEN done END AS seq, CASE WHEN success THEN bytes END AS bytes,
  CASE WHEN NOT success THEN 'socketWhile timeout, totalTimeWaited: 5000' END AS reason
FROM f LEFT JOIN r ON r.conn = f.conn AND r.seq = f.done""")
def stream_until(spark, folder):
    late = F.when((F.col("conn") % 3 == 0) & (F.col("seq") >= 2), 6000).otherwise(0)
    log = chunks(spark, folder).select(
        "conn", "seq", "payload", F.octet_length("payload").cast("bigint").alias("size"),
        (F.length("payload") - F.length(F.replace("payload", F.lit("."), F.lit("")))).alias("full_stops"),
        (F.col("seq") * 1000 + late).alias("at"))
    test = F.col("scanned") & (F.col("stops") >= 3) & (F.col("later") >= 200)
    return s.stream_until(log, "conn", ["seq"], {}, test, "at", text="payload", scan=LONG_WORD,
                          after={"stops": F.col("full_stops"), "later": F.col("size")})


@query("content_length_frames", f"""
WITH {v.CHUNK}, l AS (SELECT conn, CAST(sum(length(payload)) AS BIGINT) + CASE WHEN conn % 4 = 0 THEN 100000 WHEN conn % 4 = 1 THEN -5 ELSE 0 END AS n
    FROM chunk GROUP BY conn),
r AS (SELECT conn, seq, payload, n, sum(length(payload)) OVER (PARTITION BY conn ORDER BY seq) AS got FROM chunk JOIN l USING (conn)),
d AS (SELECT conn, n, min(seq) FILTER (got >= n) AS done_seq FROM r GROUP BY conn, n),
b AS (SELECT d.conn, string_agg(payload, '' ORDER BY seq) AS body FROM d JOIN chunk c ON c.conn = d.conn AND seq <= done_seq GROUP BY d.conn)
SELECT d.conn, done_seq IS NOT NULL AND d.conn % 7 <> 0 AS success, CASE WHEN done_seq IS NOT NULL AND d.conn % 7 <> 0 THEN 200 END AS status,
  CASE WHEN d.conn % 7 <> 0 THEN n END AS content_length, CASE WHEN d.conn % 7 <> 0 THEN done_seq END AS done_seq,
  CASE WHEN d.conn % 7 <> 0 THEN left(body, n) END AS body,
  CASE WHEN d.conn % 14 = 0 THEN 'no content length' WHEN d.conn % 7 = 0 THEN 'no blank line'
    WHEN done_seq IS NULL THEN 'body incomplete' END AS reason FROM d LEFT JOIN b USING (conn)""")
def content_length_frames(spark, folder):
    log = chunks(spark, folder)
    conn = F.col("conn")
    extra = F.when(conn % 4 == 0, 100_000).when(conn % 4 == 1, -5).otherwise(0)
    sizes = log.groupBy("conn").agg(F.sum(F.length("payload")).alias("n")).select(
        "conn", (F.col("n") + extra).alias("n"))
    # The header arrives in two chunks before the first one, its last byte with the body.
    name = F.when(conn % 14 == 0, "X-").otherwise("Content-")
    end = F.when((conn % 7 == 0) & (conn % 14 != 0), "").otherwise("\r\n\r")
    head = F.array(F.struct(F.lit(-2).cast("bigint").alias("seq"), F.concat(F.lit("HTTP/1.1 200 OK\r\n"), name).alias("text")),
                   F.struct(F.lit(-1).cast("bigint").alias("seq"),
                            F.concat(F.lit("Length: "), F.col("n").cast("string"), end).alias("text")))
    stream = sizes.select("conn", F.inline(head)).unionByName(log.select("conn", "seq", F.when(
        F.col("seq") == 0, F.concat(F.lit("\n"), "payload")).otherwise(F.col("payload")).alias("text")))
    return s.content_length_frames(stream, "conn", "seq", "text")


LIMIT_MB, TTL_SECONDS = 150, 5 * 86_400


@query("health_alerts", f"""
WITH RECURSIVE c AS (SELECT event_type AS process, event_id, epoch_us(ts) // 1000 AS ts_ms, CAST(floor(value + 0.5) AS BIGINT) AS rss_mb,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nth FROM events),
f AS (SELECT process, nth, event_id, rss_mb, ts_ms AS start_ms, CAST(0 AS BIGINT) AS uptime, true AS instantiate,
    rss_mb > {LIMIT_MB} AS memory_trigger, false AS ttl_expired FROM c WHERE nth = 1
  UNION ALL
  SELECT c.process, c.nth, c.event_id, c.rss_mb, CASE WHEN c.rss_mb > {LIMIT_MB} OR (c.ts_ms - f.start_ms + 500) // 1000 > {TTL_SECONDS}
    THEN c.ts_ms ELSE f.start_ms END, (c.ts_ms - f.start_ms + 500) // 1000, false, c.rss_mb > {LIMIT_MB},
    (c.ts_ms - f.start_ms + 500) // 1000 > {TTL_SECONDS}
  FROM f JOIN c ON c.process = f.process AND c.nth = f.nth + 1)
SELECT process, event_id, rss_mb, uptime AS uptime_seconds, instantiate, memory_trigger, ttl_expired,
  instantiate OR memory_trigger OR ttl_expired AS restart FROM f""")
def health_alerts(spark, folder):
    us = micros(F.col("ts"))
    checks = table(spark, folder, "events").select(
        F.col("event_type").alias("process"), "event_id", us.alias("ts_us"),
        F.floor(us / 1000).cast("bigint").alias("ts_ms"), F.col("value").alias("mb"))
    rows = s.health_alerts(checks, "process", ["ts_us", "event_id"], "ts_ms", F.col("mb"), LIMIT_MB, TTL_SECONDS)
    return rows.drop("ts_us", "ts_ms", "mb")


# A step as SQL: patterns are tested on the accumulated text, plain texts are looked for in it.
_STEP = "CASE f.matched " + " ".join(
    f"WHEN {i} THEN regexp_matches(f.acc || c.payload, '{e.pattern}')" if isinstance(e, re.Pattern)
    else f"WHEN {i} THEN contains(f.acc || c.payload, '{e}')" for i, e in enumerate(SCRIPT)) + " END"


@query("script_match", f"""
WITH RECURSIVE {v.CHUNK}, c AS (SELECT *, row_number() OVER (PARTITION BY conn ORDER BY seq) AS nth, max(seq) OVER (PARTITION BY conn) AS end_seq FROM chunk),
f AS (SELECT conn, CAST(0 AS BIGINT) AS nth, 0 AS matched, '' AS acc, CAST(NULL AS BIGINT) AS done_seq FROM (SELECT DISTINCT conn FROM chunk)
  UNION ALL
  SELECT c.conn, c.nth, f.matched + CASE WHEN {_STEP} THEN 1 ELSE 0 END, CASE WHEN {_STEP} THEN '' ELSE f.acc || c.payload END,
    CASE WHEN {_STEP} THEN c.seq ELSE f.done_seq END
  FROM f JOIN c ON c.conn = f.conn AND c.nth = f.nth + 1 WHERE f.matched < {len(SCRIPT)}),
l AS (SELECT conn, max(matched) AS matched, max(done_seq) AS done_seq FROM f GROUP BY conn),
e AS (SELECT conn, max(seq) AS end_seq FROM chunk GROUP BY conn)
SELECT conn, matched, done_seq, matched = {len(SCRIPT)} AND done_seq = end_seq AS success,
  CASE WHEN matched < {len(SCRIPT)} THEN 'waiting' WHEN end_seq > done_seq THEN 'More data transfer after finalized' END AS reason
FROM l JOIN e USING (conn)""")
def script_match(spark, folder):
    return scripts.match_script(chunks(spark, folder), "conn", "seq", "payload", SCRIPT)
