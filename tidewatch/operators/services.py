"""Services: compose table, subscriptions, layered settings, key-value state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.skew import attach
from tidewatch.functions.text import nth_part, present
from tidewatch.operators.requests import first_match

NO_COMPOSE = "please do service compose."


def fan_out(notifications: DataFrame, subscriptions: DataFrame, composed: bool = True) -> DataFrame:
    """One row per delivery, and one per notification that failed.

    Notifications have ``service`` and ``source``; subscriptions ``service``,
    ``module``, ``has_callback`` and ``ord``. The last subscription of a module to a
    service wins. A service without subscribers delivers nothing.
    """
    reason = first_match([(F.col("source").isNull(), F.lit("please specify source")),
                          (F.col("service").isNull(), F.lit("pass in a serviceName string"))],
                         F.lit(None if composed else NO_COMPOSE))
    checked = notifications.withColumn("reason", reason)
    latest = (subscriptions.groupBy("service", "module").agg(F.max_by("has_callback", "ord").alias("has_callback"))
              .where("has_callback").select("service", "module"))
    delivered = checked.where("reason IS NULL").join(latest, "service")
    failed = checked.where("reason IS NOT NULL").withColumn("module", F.lit(None).cast("string"))
    rows = delivered.unionByName(failed)
    return rows.withColumn("success", F.col("reason").isNull())


def validate_compose(calls: DataFrame, compose: DataFrame, user: str | None = None, composed: bool = True) -> DataFrame:
    """Resolve the column ``service`` against the compose table (``service``, ``package``).

    Adds ``success``, ``reason``, ``invoke_string`` and ``user_id``.
    """
    known = compose.select("service", "package", F.lit(True).alias("_defined"))
    rows = calls.join(known, "service", "left")
    name = F.col("service")
    reason = first_match([
        (~present(F.coalesce(name, F.lit(""))), F.lit("must specify service name in queryObject")),
        (F.lit(not composed), F.lit(NO_COMPOSE)),
        (F.col("_defined").isNull(), F.concat(F.lit("service is not defined in compose. please define: "), name)),
        (~present(F.coalesce("package", F.lit(""))),
         F.concat(F.lit("please define pkgModuleString for config: "), name))], F.lit(None).cast("string"))
    ok = F.col("reason").isNull()
    return rows.withColumn("reason", reason).withColumns({
        "success": ok, "invoke_string": F.when(ok, F.concat(F.lit("//inline/"), "package")),
        "user_id": F.when(ok, F.lit(user))}).drop("_defined", "package")


def detect_reuse(calls: DataFrame, module: str, context: str, shareable: DataFrame, severity: str = "error") -> DataFrame:
    """Modules used by more than one context and not marked shareable.

    ``severity`` is ``error`` or ``warning``. Distinct pairs are counted per pair
    first, so one busy module is not one task.
    """
    used = calls.groupBy(module).agg(F.countDistinct(context).alias("contexts")).where("contexts > 1")
    return used.join(shareable.select(module), module, "left_anti").withColumn("severity", F.lit(severity))


def fold_changes(changes: DataFrame, defaults: DataFrame) -> DataFrame:
    """Current state per key of a change log.

    Changes have ``key``, ``op`` (set, delete, increment), ``value`` and the order
    columns ``ts_us`` and ``event_id``; defaults ``key`` and ``value`` apply before the
    first change. An increment of an absent value gives NaN, as in the reference
    language. Two aggregations and no ordered pass: the last set or delete, then the
    increments after it.
    """
    position = F.struct("ts_us", "event_id")
    base = F.col("op") != "increment"
    last = changes.groupBy("key").agg(
        F.max(F.when(base, F.struct(position.alias("at"), "op", "value"))).alias("base"),
        F.count(F.when(~base, 1)).alias("_rows"))
    steps = changes.where(~base).select("key", "ts_us", "event_id")
    after = attach(steps, last, ["key"], "_rows", ["ts_us", "event_id"])
    later = after.where(F.col("base").isNull() | (position > F.col("base.at")))
    counts = later.groupBy("key").agg(F.count(F.lit(1)).alias("increments"))
    started = defaults.withColumnRenamed("value", "default")
    rows = (last.join(started, "key", "full").join(counts, "key", "left")
            .withColumn("increments", F.coalesce("increments", F.lit(0))))
    held = F.when(F.col("base").isNull(), F.col("default")).when(F.col("base.op") == "set", F.col("base.value"))
    state = first_match([(held.isNotNull(), F.lit("set")), (F.col("increments") > 0, F.lit("nan"))], F.lit("absent"))
    return rows.select("key", state.alias("state"), "increments", (held + F.col("increments")).alias("value"))


# --------------------------------------------------------------- layered config

def truthy_text(value: Column) -> Column:
    """The text, or null where it counts as absent."""
    return F.when(value != "", value)


def truthy_number(value: Column) -> Column:
    return F.when((value != 0) & ~F.isnan(value.cast("double")), value)


def truthy_flag(value: Column) -> Column:
    return F.when(value, value)


def layered(*layers: Column) -> Column:
    """The first layer with a value; pass each through a ``truthy_`` function."""
    return F.coalesce(*layers)


def target_parts(url: Column) -> dict[str, Column]:
    """Host and port of a target URL; port null where not given."""
    authority = nth_part(url, "/", 3)
    return {"host": nth_part(authority, ":", 1), "port": nth_part(authority, ":", 2)}


def target_url(host: Column, port: Column) -> Column:
    """Target URL of a host and port, null where no target is set."""
    return F.when(host.isNotNull(), F.concat(F.lit("http://"), host, F.lit(":"), port.cast("string")))


def module_names(current: Column, legacy: Column, prefix: str) -> Column:
    """Configured modules with the legacy ones appended under a prefix."""
    empty = F.array().cast("array<string>")
    named = F.transform(F.coalesce(legacy, empty), lambda m: F.concat(F.lit(f"{prefix}/"), m))
    return F.concat(F.coalesce(current, empty), named)


def route_union(local: DataFrame, remote: DataFrame | None) -> DataFrame:
    """Local routes first, then remote ones; a failed remote load (None) leaves the local.

    ``source_rank`` keeps the order in which routes are tried.
    """
    ranked = local.withColumn("source_rank", F.lit(0))
    return ranked if remote is None else ranked.unionByName(remote.withColumn("source_rank", F.lit(1)))


def route_rows(services: DataFrame, names: dict[str, str], service_type: str = "HTTP",
               status: str = "Enabled") -> DataFrame:
    """Enabled routes of one type from a service table, renamed (new name to column)."""
    kept = services.where((F.col("servicetype") == service_type) & (F.col("status") == status))
    return kept.select(*[F.col(old).alias(new) for new, old in names.items()])
