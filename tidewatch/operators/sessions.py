"""Connections: pipes, sessions, streams of chunks, health checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.automata import compiled
from tidewatch.functions.ordered import SLICE, chain, cut, running
from tidewatch.functions.skew import attach
from tidewatch.functions.text import blank, replace_first
from tidewatch.operators.requests import first_match
from tidewatch.operators.scripts import final_states, match_script, runs_of  # noqa: F401
from tidewatch.session import checkpointed

CRLF = "\r\n"
# A header of more characters than this is refused.
HEAD_LIMIT, HEAD_TOO_LONG = 65_536, "header too long"


def pair_pipes(chunks: DataFrame, closes: DataFrame) -> DataFrame:
    """Traffic and end of each pipe of two connections.

    Chunks have ``pipe``, ``side`` (s1 or s2), ``size`` and ``buffered`` (came before the
    binding, so it is forwarded first). ``closes`` has a row per connection: ``pipe``,
    ``side``, ``closed`` (null while open) and ``had_error``. Only the first close of a
    pipe counts; a pipe needs both sides.
    """
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("size"))), F.lit(0))
    s1, s2, buffered = F.col("side") == "s1", F.col("side") == "s2", F.col("buffered")
    traffic = chunks.groupBy("pipe").agg(
        total(s1).alias("bytes_s1_s2"), total(s2).alias("bytes_s2_s1"),
        total(s1 & buffered).alias("buffered_s1"), total(s2 & buffered).alias("buffered_s2"))
    close = F.when(F.col("closed").isNotNull(), F.struct("closed", "side", "had_error"))
    ends = closes.groupBy("pipe").agg(F.min(close).alias("first"), F.min("side").alias("one"), F.max("side").alias("other"))
    alone = F.col("one").isNull() | (F.col("one") == F.col("other"))
    reason = first_match([
        (alone, F.concat(F.lit("Invalid socketId for "), F.when(F.col("one") == "s1", "s2").otherwise("s1"))),
        (F.col("first").isNull(), F.lit("still open")),
        (F.col("first.had_error"), F.lit("hadError was set "))], F.lit(None).cast("string"))
    return (traffic.join(ends, "pipe", "left").withColumn("reason", reason)
            .select("pipe", "bytes_s1_s2", "bytes_s2_s1", "buffered_s1", "buffered_s2",
                    F.col("first.side").alias("first_close"), F.col("reason").isNull().alias("success"), "reason"))


def dashed(value: Column, width: int) -> Column:
    """Padded with dashes to a width, never cut."""
    body = blank(value)
    return F.when(F.length(body) < width, F.rpad(body, width, "-")).otherwise(body)


def session_lines(entries: DataFrame, session: str, handler: str, slices: int | None = None) -> DataFrame:
    """Session id, elapsed ms and log line of each entry.

    Entries have the session column, ``ts_us``, ``msg``, ``action`` and ``socket``. Sessions
    are numbered in order of their start; times count whole seconds.
    """
    starts = entries.groupBy(session).agg(F.min("ts_us").alias("start_us"), F.count(F.lit(1)).alias("_rows"))
    numbered = running(cut(starts, [], ["start_us", session], slices), [], ["start_us", session],
                       sums={"number": F.lit(1)}).drop(SLICE)
    rows = attach(entries, numbered, [session], "_rows", ["ts_us", "msg"])
    second = lambda c: F.floor(F.col(c) / 1_000_000)
    rows = rows.withColumns({
        "session_id": F.concat(F.lit(handler), F.col("number").cast("string")),
        "elapsed_ms": (second("ts_us") - second("start_us")) * 1000})
    fields = [dashed(F.col("session_id"), 10), dashed(F.col("elapsed_ms"), 10), dashed(F.col("socket"), 15),
              dashed(F.concat(replace_first(blank(F.col("action")), CRLF, "\\r\\n"), F.lit(" ")), 20)]
    line = F.concat(F.lit("["), *[F.concat(F.lit(" "), f) for f in fields], F.lit("] "), replace_first(blank(F.col("msg")), CRLF, "\\r\\n"))
    return rows.withColumn("line", line)


def stream_until(chunks: DataFrame, conn: str, order: list[str], measures: dict[str, Column], done: Column,
                 arrived_ms: str, timeout_ms: int = 5000, slices: int | None = None, text: str | None = None,
                 scan: str | re.Pattern | None = None, after: dict[str, Column] | None = None) -> DataFrame:
    """Accumulate a connection until a test holds, or until it is idle too long.

    ``measures`` are added up over the chunks (``size`` bytes are always counted) and
    ``done`` is a test on the totals so far. A gap of ``timeout_ms`` before the chunk
    that would finish fails the connection; so does data that ends too early.

    With ``scan``, the accumulated ``text`` is searched for a text or a pattern by an automaton
    that carries over from chunk to chunk. The test may then use ``scanned``, true from the chunk
    on with which it is found, and ``after``, measures of the chunks after that one: the scan
    hands over to them.
    """
    if scan is not None:
        ends = final_states(runs_of(chunks, conn, order[0], text, compiled([scan]), slices), conn)
        found = chunks.groupBy(conn).agg(F.count(F.lit(1)).alias("_rows")).join(ends.select(conn, F.col("hit").alias("_hit")), conn)
        chunks = attach(chunks, found, [conn], "_rows", order)
        since = lambda test: F.coalesce(test, F.lit(False))
        chunks = chunks.withColumns({"scanned": since(F.col(order[0]) >= F.col("_hit")), "_past": since(F.col(order[0]) > F.col("_hit"))})
        measures = measures | {n: F.when(F.col("_past"), c).otherwise(0) for n, c in (after or {}).items()}
    cut_rows = cut(chunks, [conn], order, slices)
    rows = running(cut_rows, [conn], order, sums=measures | {"bytes": F.col("size")},
                   previous={"_prior": (F.col(arrived_ms), 1)})
    gap = F.col(arrived_ms) - F.get("_prior", F.lit(0))
    position = F.struct(*order)
    ends = rows.groupBy(conn).agg(
        F.min(F.when(done, F.struct(position.alias("at"), "bytes"))).alias("_done"),
        F.min(F.when(gap >= timeout_ms, position)).alias("_idle"), F.max("bytes").alias("_all"))
    finished = F.col("_done").isNotNull() & (F.col("_idle").isNull() | (F.col("_done.at") < F.col("_idle")))
    return ends.select(conn, finished.alias("success"),
                       *[F.when(finished, F.col(f"_done.at.{c}")).alias(c) for c in order],
                       F.when(finished, F.col("_done.bytes")).alias("bytes"),
                       F.when(~finished, F.lit(f"socketWhile timeout, totalTimeWaited: {timeout_ms}")).alias("reason"))


def content_length_frames(chunks: DataFrame, conn: str, seq: str, text: str, slices: int | None = None,
                          head_limit: int = HEAD_LIMIT) -> DataFrame:
    """Reassemble one message per connection: header, blank line, counted body.

    A message is complete once its body is as long as the header says. Only the
    chunks of the message are joined together, never the rest of a connection, so
    a value is as large as the message it holds and no larger. A blank line is looked for in
    the first ``head_limit`` characters only; a longer header is refused.
    """
    cut_rows = cut(chunks.select(conn, seq, text), [conn], [seq], slices)
    near = F.concat(F.right(F.array_join("_near", ""), F.lit(3)), F.col(text))
    marks = running(cut_rows, [conn], [seq], sums={"_chars": F.length(text)}, previous={"_near": (F.right(text, F.lit(3)), 3)})
    marks = checkpointed(marks.select(conn, seq, "_chars", F.coalesce(F.length(text), F.lit(0)).alias("_own"),
                                      F.contains(near, F.lit(CRLF + CRLF)).alias("_blank")))
    # The blank line of a header within the limit has begun in a chunk that starts within it, or
    # ends in the next one.
    within = F.col("_blank") & (F.col("_chars") - F.col("_own") <= head_limit + 3)
    heads = marks.groupBy(conn).agg(F.min(F.when(within, F.col(seq))).alias("_head"), F.count(F.lit(1)).alias("_rows"),
                                    F.max("_chars").alias("_all"))
    joined = lambda df: df.groupBy(conn).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(seq, text))), lambda c: c[text]), "").alias("_text"))
    chunk_rows = cut_rows.select(conn, seq, text)
    head_text = joined(attach(chunk_rows, heads, [conn], "_rows", [seq]).where(F.col(seq) <= F.col("_head")))
    head = F.element_at(F.split("_text", CRLF + CRLF, 2), 1)
    length = F.regexp_extract(F.lower(head), "content-length: *([0-9]+)", 1)
    sizes = heads.select(conn, "_rows", "_all")
    # Both tables below hold one row per connection and are read several times.
    heads = checkpointed(head_text.where(F.length(head) <= head_limit).select(conn, F.length(head).alias("_body_at"),
                                          length.try_cast("bigint").alias("content_length")))
    needed = F.col("_body_at") + 4 + F.col("content_length")
    ends = checkpointed(attach(marks.select(conn, seq, "_chars"), sizes.drop("_all").join(heads, conn), [conn], "_rows", [seq])
            .where(F.col("_chars") >= needed).groupBy(conn).agg(F.min(seq).alias("done_seq")))
    whole = joined(attach(chunk_rows, sizes.drop("_all").join(ends, conn), [conn], "_rows", [seq])
                   .where(F.col(seq) <= F.col("done_seq")))
    found = sizes.select(conn, "_all").join(heads, conn, "left").join(ends, conn, "left").join(whole, conn, "left")
    body = F.substring("_text", F.col("_body_at") + 5, F.col("content_length"))
    complete = F.col("done_seq").isNotNull()
    long = F.col("_all") > head_limit + len(CRLF + CRLF)
    reason = first_match([(complete, F.lit(None).cast("string")), (F.col("_body_at").isNull() & long, F.lit(HEAD_TOO_LONG)),
                          (F.col("_body_at").isNull(), F.lit("no blank line")),
                          (F.col("content_length").isNull(), F.lit("no content length"))], F.lit("body incomplete"))
    return found.select(conn, complete.alias("success"), F.when(complete, 200).alias("status"), "content_length",
                        "done_seq", F.when(complete, body).alias("body"), reason.alias("reason"))


def health_alerts(metrics: DataFrame, process: str, order: list[str], ts_ms: str, rss_mb: Column,
                  max_mb: int = 900, ttl_seconds: int = 60 * 60 * 24 * 365, slices: int | None = None) -> DataFrame:
    """Restart alerts of each health check.

    The first check of a process starts it. Memory above the limit or an uptime
    above the allowed time (both strict) restart it, and the uptime counts anew.
    """
    rows = metrics.withColumn("rss_mb", F.floor(rss_mb + 0.5).cast("bigint"))
    rows = rows.withColumn("memory_trigger", F.col("rss_mb") > max_mb)
    # A rounded uptime of more than n seconds is more than n * 1000 + 499 ms.
    rows = chain(cut(rows, [process], order, slices), [process], order, ts_ms, ttl_seconds * 1000 + 499,
                 force="memory_trigger")
    uptime = F.floor((F.col(ts_ms) - F.coalesce("anchor_before", ts_ms) + 500) / 1000).cast("bigint")
    rows = rows.withColumns({"uptime_seconds": uptime, "instantiate": F.col("anchor_before").isNull()})
    return (rows.withColumn("ttl_expired", F.col("uptime_seconds") > ttl_seconds)
            .withColumnRenamed("is_anchor", "restart").drop(SLICE, "anchor", "anchor_before"))
