"""Telemetry views over the stored tables.

Each view is a narrow projection of one table (no shuffle), so filters and the
column list of a query still reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.tables import micros, table


def monitor_events(spark: SparkSession, folder: str) -> DataFrame:
    """Monitoring events (``mon``) from the event stream table."""
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    user, etype = F.col("user_id"), F.col("event_type")
    base = e.select("event_id", "user_id", "event_type", "value",
                    micros(F.col("ts")).alias("ts_us"), k.alias("k"))
    k = F.col("k")
    level = (F.when(etype == "error", 2).when(etype == "signup", 3)
             .when(etype == "view", 5).when(etype == "click", 6))
    return base.select(
        "event_id", "user_id", "ts_us", "value", "k",
        level.alias("level"),
        etype.alias("key"), etype.alias("method"), etype.alias("action"),
        F.concat(F.lit("svc_"), (user % 7).cast("string")).alias("service_name"),
        F.concat(F.lit("//inline/pkg"), (user % 3).cast("string")).alias("service_invoke"),
        F.concat(F.lit("app/m"), (user % 5).cast("string")).alias("module"),
        F.when(k % 3 == 0, F.concat(F.lit("k"), k.cast("string"))).alias("callee"),
        F.when(k % 6 == 0, F.lit("sub")).alias("sub_method"),
        F.when(k % 2 == 0, F.lit("tick")).alias("event"),
        user.cast("string").alias("usr"),
        F.concat(F.lit("c"), (F.col("event_id") % 50).cast("string")).alias("network"),
        F.concat(F.lit("dev"), (user % 3).cast("string")).alias("src"),
        F.when(k % 5 == 0, F.array(F.concat(F.lit("out"), (k % 4).cast("string")))).alias("dests"),
        (etype != "error").alias("success"),
        F.concat(F.lit("k="), k.cast("string")).alias("data"),
        F.concat(F.lit("err "), k.cast("string")).alias("reason"),
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Request log (``req``) from the page table."""
    p = table(spark, folder, "pages")
    pid = F.col("page_id")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    scheme = F.regexp_extract("url", r"^([a-z]+)://", 1)
    target = F.regexp_extract("url", r"^[a-z]+://[^/?#]*(.*)$", 1)
    agent = (F.when(pid % 4 == 0, "Mozilla/5.0").when(pid % 4 == 1, "curl/8")
             .when(pid % 4 == 2, "badbot/1.0"))
    method = F.when(pid % 5 == 0, "GET").when(pid % 5 == 1, "OPTIONS").otherwise("POST")
    ip = F.concat(F.lit("10.0."), (pid % 8).cast("string"), F.lit("."), (pid % 250).cast("string"))
    return p.select(
        pid.alias("req_id"), "url", host.alias("host"), scheme.alias("scheme"),
        target.alias("target"), agent.alias("agent"), method.alias("method"), ip.alias("ip"),
        F.create_map(
            F.lit("host"), host,
            F.lit("origin"), F.concat(scheme, F.lit("://"), host),
            F.lit("referer"), F.concat(F.lit("http://"), host, F.lit("/from?u="), host),
            F.lit("connection"), F.lit("keep-alive"),
            F.lit("accept-encoding"), F.lit("gzip"),
        ).alias("headers"),
    )


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Task queue (``task``) from the order table."""
    o = table(spark, folder, "orders")
    cust = F.col("o_custkey")
    return o.select(
        F.col("o_orderkey").alias("id"), cust.alias("task_id"),
        F.concat(F.lit("rt"), (cust % 16).cast("string")).alias("runtime"),
        (F.col("o_orderstatus") == "O").alias("outstanding"),
        micros(F.col("o_orderdate")).alias("queued_us"),
        (F.col("o_orderpriority") != "1-URGENT").alias("ok"),
        F.col("o_orderpriority").alias("priority"),
        (cust % 3 == 0).alias("rerun"),
    )


# The order of the steps of one trace; equal tuples are equal steps.
TRACE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "ship_us", "l_extendedprice", "l_quantity"]


def trace_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Trace steps (``trace``) from the line items, without a step number.

    Numbering is left to the operators that need it: most only compare
    positions, which needs no window over a trace.
    """
    li = table(spark, folder, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("trace"), "l_linenumber", "l_partkey", "l_suppkey",
        micros(F.col("l_shipdate")).alias("ship_us"), "l_extendedprice", "l_quantity",
        (F.col("l_returnflag") != "R").alias("ok"),
        (F.col("l_returnflag") == "A").alias("restart"),
        F.col("l_linestatus").alias("line_status"),
    )


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Connection chunk log (``chunk``) from the conversations."""
    c = table(spark, folder, "conversations")
    return c.select(F.col("conv_id").alias("conn"), F.col("turn").alias("seq"), "role",
                    F.col("text").alias("payload"))
