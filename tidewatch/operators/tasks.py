"""Task queues as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import present
from tidewatch.operators.requests import first_match

# Statuses of a runner that is not configured.
NO_PACKAGE, NO_RUNTIME = 2000001, 2000002


def next_tasks(tasks: DataFrame, runners: DataFrame) -> DataFrame:
    """The first outstanding task of every runner (``runtime``, ``package``).

    A runner without a package or runtime gets a status instead, one without
    outstanding tasks neither. Tasks that were requeued (``turns``) wait behind the others.
    """
    turns = ["turns"] if "turns" in tasks.columns else []
    first = (tasks.where("outstanding").groupBy("runtime")
             .agg(F.min(F.struct(*turns, "queued_us", "id", "task_id")).alias("t")))
    rows = runners.join(first, "runtime", "left")
    status = first_match([(~present(F.coalesce("package", F.lit(""))), F.lit(NO_PACKAGE)),
                          (~present(F.coalesce("runtime", F.lit(""))), F.lit(NO_RUNTIME))], F.lit(None).cast("int"))
    works = status.isNull()
    state = first_match([(~works, F.lit("refused")), (F.col("t").isNull(), F.lit("no outstanding tasks"))],
                        F.lit("task"))
    return rows.select("runtime", state.alias("state"), status.alias("status"),
                       *[F.when(works, F.col(f"t.{c}")).alias(c) for c in ("id", "task_id", "queued_us")])


def record_outcomes(runs: DataFrame, readonly: bool = False) -> DataFrame:
    """Outcome rows of task runs, and a requeue row where rerun is enabled.

    Runs have ``id``, ``task_id``, ``success``, ``reason`` and ``rerun``. A failed run is
    recorded like any other. ``written`` is false for a read-only plan.
    """
    actions = F.when(F.col("rerun"), F.array(F.lit("outcome"), F.lit("requeue"))).otherwise(F.array(F.lit("outcome")))
    rows = runs.withColumn("action", F.explode(actions))
    outcome = F.col("action") == "outcome"
    return rows.select("id", "task_id", "action", F.when(outcome, F.col("success")).alias("success"),
                       F.when(outcome, F.col("reason")).alias("reason"), F.lit(not readonly).alias("written"))


def requeued(tasks: DataFrame, recorded: DataFrame) -> DataFrame:
    """The queue after recording: run tasks are done, requeued ones outstanding again,
    behind those that have had fewer ``turns``."""
    count = lambda action: F.count(F.when(F.col("action") == action, 1))
    known = recorded.where("written").groupBy("id").agg(count("outcome").alias("_done"), count("requeue").alias("turns"))
    rows = tasks.drop("turns").join(known, "id", "left")
    open_ = F.when(F.col("turns") > 0, True).when(F.col("_done") > 0, False).otherwise(F.col("outstanding"))
    return rows.withColumns({"outstanding": open_, "turns": F.coalesce("turns", F.lit(0))}).drop("_done")


def progress(reports: DataFrame, task: str, step: str, done_at: int = 100) -> DataFrame:
    """Highest reported step per task and whether it is done."""
    return reports.groupBy(task).agg(F.max(step).alias("progress"), F.count(F.lit(1)).alias("reports"),
                                     (F.max(step) >= done_at).alias("done"))


def poll_once(tasks: DataFrame, runners: DataFrame, results: DataFrame, readonly: bool = False) -> DataFrame:
    """One pass of every runner: take its first task and record how it ended.

    ``results`` holds ``id``, ``success`` and ``reason`` of the task runs; running the task
    itself happens elsewhere.
    """
    taken = next_tasks(tasks, runners).where("state = 'task'").select("id")
    runs = taken.join(tasks.select("id", "task_id", "rerun"), "id").join(results, "id")
    return record_outcomes(runs, readonly)
