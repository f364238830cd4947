"""Traces of steps: first failure, iterations, call stacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.ordered import cut, running
from tidewatch.functions.skew import attach
from tidewatch.session import checkpointed

NO_OUTCOME = 'WARNING, returning from a chain that did not have the "outcome" property set.'


def first_failures(traces: DataFrame, steps: DataFrame, order: list[str]) -> DataFrame:
    """Result of each trace: its first failed step, else its last outcome.

    Steps after the first failure never count. A trace without steps failed with a
    warning. Positions are compared, not numbered, so a trace of any length is
    aggregated in parts.
    """
    position = F.struct(*order)
    ends = steps.groupBy("trace").agg(F.min(F.when(~F.col("ok"), position)).alias("_fail"),
                                      F.count(F.lit(1)).alias("total"))
    before = (attach(steps.select("trace", *order), ends, ["trace"], "total", order)
              .where(position < F.col("_fail")).groupBy("trace").agg(F.count(F.lit(1)).alias("_before")))
    rows = traces.join(ends, "trace", "left").join(before, "trace", "left")
    failed = F.col("_fail").isNotNull()
    step = F.when(failed, F.coalesce("_before", F.lit(0)) + 1)
    return rows.select(
        "trace", (F.col("total").isNotNull() & ~failed).alias("success"), step.alias("failed_step"),
        F.coalesce(step, "total", F.lit(0)).alias("counted"),
        F.coalesce(F.col("total") - step, F.lit(0)).alias("ignored"),
        F.when(F.col("total").isNull(), NO_OUTCOME).when(failed, F.concat(F.lit("step failed: "), step.cast("string")))
        .alias("reason"))


def replay_iterations(steps: DataFrame, order: list[str], at: str, slices: int | None = None) -> DataFrame:
    """Steps and elapsed time of each iteration; a restart begins the next one."""
    rows = running(cut(steps, ["trace"], order, slices), ["trace"], order,
                   sums={"iteration": F.col("restart").cast("bigint")})
    return rows.groupBy("trace", "iteration").agg(
        F.count(F.lit(1)).alias("steps"), (F.max(at) - F.min(at)).alias("elapsed"))


def stack_entry(module: Column, index: Column, item: Column, dynamic: Column) -> Column:
    """Text of one call-stack level."""
    padded = F.when(F.length(module) < 70, F.rpad(module, 70, " ")).otherwise(module)
    place = F.when(dynamic, F.concat(F.lit(" function at chain index "), (index + 1).cast("string"),
                                     F.lit(" immediately following"))
                   ).otherwise(F.concat(F.lit(" chain index "), index.cast("string")))
    return F.concat(F.lit("\r\n* "), padded, F.lit(" "), place, F.lit(" ["), item, F.lit("]"))


def call_stacks(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Call stack of every call, innermost level first.

    Calls have the key columns, ``node``, ``parent`` and ``entry``. Each round joins a
    stack to the stack of the node above its top, so the stacks double: a depth of
    d takes log2(d) rounds, each on the unique pair of key and node.
    """
    stacks = calls.select(*keys, "node", F.array("entry").alias("stack"), F.col("parent").alias("above"))
    known = calls.select(*keys, F.col("node").alias("above"), F.lit(True).alias("_known"))
    stacks = stacks.join(known, [*keys, "above"], "left")
    stacks = checkpointed(stacks.withColumn("above", F.when(F.col("_known"), F.col("above"))).drop("_known"))
    nodes, reach = stacks.count(), 1
    while not stacks.where("above IS NOT NULL").isEmpty():
        # After each round a stack holds twice as many levels; none has more than there are nodes.
        if reach > nodes:
            raise ValueError("the calls form a cycle")
        reach *= 2
        upper = stacks.select(*keys, F.col("node").alias("above"), F.col("stack").alias("_upper"),
                              F.col("above").alias("_next"))
        grown = stacks.join(upper, [*keys, "above"], "left")
        stack = F.when(F.col("_upper").isNull(), F.col("stack")).otherwise(F.concat("stack", "_upper"))
        stacks = checkpointed(grown.select(*keys, "node", stack.alias("stack"), F.col("_next").alias("above")))
    return stacks.select(*keys, "node", F.size("stack").alias("depth"), F.array_join("stack", "").alias("stack_text"))
