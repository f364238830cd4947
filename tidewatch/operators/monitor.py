"""Monitoring events: normalise, enrich, derive, gate, render, measure."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.ordered import chain, cut, running
from tidewatch.functions.text import blank, contains_any, fixed_length, friendly, text
from tidewatch.session import checkpointed
from tidewatch.sources.tables import rule_table

DEFAULT_LEVEL = 4

# The fields of a rendered line, all shown by default.
LINE_FIELDS = ("timestamp", "service", "context", "invokeString", "action", "device", "outcome", "misc")

# The substring lists of a filter and the column each one tests.
FILTERS = {"services": "service_name", "invokeStrings": "call", "devices": "device", "actions": "action_text"}

# Texts of an event that carries an error, or a context it should not.
ERROR_OUTCOME = "An errorObject is present and should be in the monitoring data"
CONTEXT_WARNING = "remove context from log"

# Terminal colour codes of the rendered fields.
COLOURS = {
    "service": "[33m", "context": "[34m", "invokeString": "[0;94m", "action": "[36m",
    "outcomeSuccess": "[1;33m", "outcomeFail": "[1;31m", "device": "[0;35m",
}


@dataclass
class MonitorConfig:
    """What to keep and how to show it.

    ``filters`` maps ``services``, ``invokeStrings``, ``devices`` and ``actions`` to
    lists of texts; None means no filter is configured at all. A field of
    ``fields`` is False (left out), True (as it is) or a dict with ``len``,
    ``prefix`` and ``postfix``.
    """

    force_up_to_level: int | None = None
    keys_on: list[str] = field(default_factory=list)
    filters: dict[str, list[str]] | None = None
    fields: dict[str, bool | dict] = field(default_factory=lambda: dict.fromkeys(LINE_FIELDS, True))
    colours: bool = False

    @classmethod
    def from_json(cls, config: dict) -> MonitorConfig:
        """From a ``verbose`` block; names that start otherwise (``_services``) are inactive.

        Every other name with a true value switches a key on.
        """
        known = ("forceUpToLevel", "extraInfoInLogs", "useANSIColors", "filter", "fieldsSchema")
        filters = config.get("filter")
        return cls(
            force_up_to_level=config.get("forceUpToLevel"),
            keys_on=[k for k, on in config.items() if on and k not in known],
            filters={n: filters[n] for n in FILTERS if filters.get(n) is not None} if isinstance(filters, dict) else None,
            fields=config.get("fieldsSchema") or dict.fromkeys(LINE_FIELDS, True),
            colours=bool(config.get("useANSIColors")))


def normalise_events(events: DataFrame, payload: str) -> DataFrame:
    """Add ``level``, ``key`` and the variant ``msg`` of events given as JSON text.

    Nothing gives empty data, a scalar becomes ``msg.data``, an object without msg,
    key or level becomes the msg, a text msg becomes ``{"data": text}``, and the
    level defaults to 4.
    """
    rows = events.withColumn("_v", F.try_parse_json(payload))
    rows = rows.withColumns({"_kind": F.schema_of_variant("_v"), "_msg": F.try_variant_get("_v", "$.msg", "variant"),
                             "_key": F.try_variant_get("_v", "$.key", "string"),
                             "_level": F.try_variant_get("_v", "$.level", "int")})
    rows = rows.withColumn("_msg_kind", F.coalesce(F.schema_of_variant("_msg"), F.lit("VOID")))
    is_object, no_msg = F.startswith("_kind", F.lit("OBJECT")), F.col("_msg_kind") == "VOID"
    bare = no_msg & (F.coalesce("_key", F.lit("")) == "") & (F.coalesce("_level", F.lit(0)) == 0)
    wrap = lambda c: F.parse_json(F.to_json(F.create_map(F.lit("data"), c)))
    msg = (F.when(F.coalesce("_kind", F.lit("VOID")) == "VOID", F.parse_json(F.lit('{"data":""}')))
           .when(~is_object, wrap(F.try_variant_get("_v", "$", "string")))
           .when(bare, F.col("_v")).when(no_msg, F.parse_json(F.lit("{}")))
           .when(F.col("_msg_kind") == "STRING", wrap(F.try_variant_get("_msg", "$", "string")))
           .otherwise(F.col("_msg")))
    kept = is_object & ~bare
    rows = rows.withColumns({"level": F.coalesce(F.when(kept & (F.col("_level") != 0), F.col("_level")), F.lit(DEFAULT_LEVEL)),
                             "key": F.when(kept, F.col("_key")), "msg": msg})
    return rows.drop("_v", "_kind", "_msg", "_key", "_level", "_msg_kind")


def overlay(events: DataFrame, fill: dict[str, Column | str]) -> DataFrame:
    """Fixed values override the event's own; a missing fixed value does not."""
    values = {n: F.lit(v) if isinstance(v, str) else v for n, v in fill.items()}
    return events.withColumns({n: F.coalesce(v, F.col(n)) for n, v in values.items()})


def overlay_by_service(spark: SparkSession, events: DataFrame, fills: list[tuple[str, str, str]]) -> DataFrame:
    """Per-service module and method, from a short list of (service, module, method)."""
    table = rule_table(spark, fills, "service_name string, _module string, _method string")
    joined = events.join(table, "service_name", "left")
    return overlay(joined, {"module": F.col("_module"), "method": F.col("_method")}).drop("_module", "_method")


def derive_fields(events: DataFrame, misc: list[tuple[str, str]] = ()) -> DataFrame:
    """Display fields of monitoring events.

    ``misc`` lists (label, column) pairs of the remaining message entries in
    order; label ``data`` is shown bare, objects as JSON. Missing entries are left out. Two optional
    columns are understood: ``error_object`` (text of an error, which is shown and
    fails the outcome) and ``has_context`` (adds a warning to the line).
    """
    callee = F.concat(blank(F.col("callee")), blank(F.col("sub_method")))
    call = F.concat(blank(F.col("module")), F.lit("?"), blank(F.col("method")),
                    F.when(callee != "", F.concat(F.lit("->"), callee)).otherwise(""))
    action = F.concat(F.when(F.col("event").isNotNull(), F.concat("event", F.lit("#"))).otherwise(""),
                      blank(F.col("action")))
    device = F.concat(blank(F.col("src")),
                      F.when(F.size("dests") > 0, F.concat(F.lit("=>"), F.array_join("dests", "")))
                      .otherwise(""))
    outcome = F.when(F.col("success").isNull(), "").when(F.col("success"), F.col("data")).otherwise(F.col("reason"))
    success, misc = F.col("success"), list(misc)
    if "error_object" in events.columns:
        failed = F.col("error_object").isNotNull()
        outcome = F.when(failed, ERROR_OUTCOME).otherwise(outcome)
        success = F.when(failed, False).otherwise(success)
        misc.append(("errorObject", "error_object"))
    nested = (T.StructType, T.ArrayType, T.MapType, T.VariantType)
    shown = lambda c: F.to_json(c) if isinstance(events.schema[c].dataType, nested) else text(F.col(c))
    entries = [F.when(F.col(c).isNotNull(), F.concat(F.lit("" if label == "data" else f"{label}: "), shown(c)))
               for label, c in misc]
    rest = F.concat_ws(",", *entries) if entries else F.lit("")
    if "has_context" in events.columns:
        rest = F.concat(rest, F.when(F.col("has_context"), CONTEXT_WARNING).otherwise(""))
    return events.withColumns({
        "service": F.coalesce(F.when(F.col("service_name") != "", F.col("service_name")),
                              F.col("service_invoke"), F.lit("")),
        "context": F.concat(blank(F.col("usr")), F.lit("@"), blank(F.col("network"))),
        "call": call, "action_text": action, "device": device,
        "outcome_text": outcome, "success": success, "misc": rest,
    })


def forced(config: MonitorConfig) -> Column:
    """Rows at or below the forced level pass every other test."""
    if not config.force_up_to_level:
        return F.lit(False)
    return F.coalesce(F.col("level"), F.lit(DEFAULT_LEVEL)) <= config.force_up_to_level


def key_on(config: MonitorConfig) -> Column:
    """The key is switched on; without a key the row is dropped. Any filter cancels this."""
    if config.filters is not None:
        return F.lit(True)
    return F.coalesce(F.col("key").isin(*config.keys_on), F.lit(False)) if config.keys_on else F.lit(False)


def filters_pass(config: MonitorConfig) -> Column:
    """Substring lists: any entry of a list, all lists. Services test the name only."""
    passes = F.lit(True)
    for name, column in FILTERS.items():
        if (config.filters or {}).get(name) is not None:
            passes = passes & contains_any(blank(F.col(column)), config.filters[name])
    return passes


def gate(derived: DataFrame, config: MonitorConfig) -> DataFrame:
    """The rows of :func:`derive_fields` that are logged."""
    return derived.where(forced(config) | (key_on(config) & filters_pass(config)))


def _field(config: MonitorConfig, name: str, value: Column, colour: Column | str | None = None) -> Column:
    shape = config.fields.get(name)
    if not shape:
        return F.lit("")
    if isinstance(shape, dict):
        if not shape.get("len"):
            return F.lit("")
        value = F.concat(F.lit(shape.get("prefix", "")), fixed_length(value, shape["len"]),
                         F.lit(shape.get("postfix", "")))
    value = F.coalesce(value, F.lit("undefined"))
    if config.colours:
        code = colour if isinstance(colour, Column) else F.lit(COLOURS[name])
        return F.concat(F.lit("\x1b"), code, value, F.lit("\x1b[0m "))
    return F.concat(value, F.lit(" "))


def render_line(config: MonitorConfig) -> Column:
    """One log line from the columns of :func:`derive_fields`."""
    paint = F.when(F.col("success"), COLOURS["outcomeSuccess"]).otherwise(COLOURS["outcomeFail"])
    return F.concat(
        _field(config, "service", F.col("service")),
        _field(config, "context", F.col("context")),
        _field(config, "invokeString", F.col("call")),
        _field(config, "action", F.col("action_text")),
        _field(config, "device", F.col("device")),
        F.when(F.col("success").isNotNull(), _field(config, "outcome", F.col("outcome_text"), paint))
        .otherwise(""),
        F.col("misc"),
    )


def stamped_line(config: MonitorConfig, ts_us: Column) -> Column:
    """The line as printed without an ingestion service: day and time, then the fields."""
    stamp = F.date_format(F.timestamp_micros(ts_us), "dd HH:mm:ss") if config.fields.get("timestamp") else F.lit("")
    return F.concat(stamp, render_line(config))


def volume_by(events: DataFrame, *by: str) -> DataFrame:
    """Events, failures, value total and its human-unit text per group."""
    grouped = events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("events"),
        F.sum(F.when(F.col("success"), 0).otherwise(1)).alias("failures"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value_total"),
    )
    return grouped.withColumn("volume", friendly(F.col("value_total"), "B", 1024))


def qos_by_user(packets: DataFrame) -> DataFrame:
    """Packets, latest head and mean gap per user."""
    n = F.count(F.lit(1))
    latest = F.max_by("head", F.struct("qos_us", "packet_id"))
    span = F.max("qos_us") - F.min("qos_us")
    return packets.groupBy("usr").agg(
        n.alias("packets"), F.max("qos_us").alias("latest_us"), latest.alias("latest_head"),
        F.when(n > 1, F.floor(span / (n - 1))).alias("mean_gap_us"))


def stream_totals(samples: DataFrame, stream: str, order: list[str], size: str, bits: int = 8,
                  slices: int | None = None) -> DataFrame:
    """Bytes of each sample batch, the running total per stream and its text.

    Bits are counted and divided once: samples need not fill whole bytes."""
    cut_rows = cut(samples.withColumn("_bits", _bits(size, bits)), [stream], order, slices)
    rows = running(cut_rows, [stream], order, sums={"_total": F.col("_bits")})
    rows = rows.withColumns({"step_bytes": _bytes("_bits"), "total_bytes": _bytes("_total"),
                             "is_first": F.col("_total") == F.col("_bits")})
    return rows.withColumn("total_text", friendly(F.col("total_bytes"), "B", 1024)).drop("_bits", "_total")


def _bits(size: str, bits: int) -> Column:
    return (F.col(size) * bits).cast("bigint")


def _bytes(bits: str) -> Column:
    return F.col(bits) / F.lit(8.0)


def rate_windows(samples: DataFrame, stream: str, order: list[str], ts_ms: str, size: str, bits: int = 8,
                 window_ms: int = 10_000, slices: int | None = None) -> DataFrame:
    """Sample rate per stream over a window that restarts when it is too old.

    The window is anchored at its first non-empty batch and restarts at the first
    batch more than ``window_ms`` later. The rate is recomputed only past half the
    window, with the current batch; otherwise the old rate is kept, also across
    restarts.
    """
    steps = samples.withColumn("_bits", _bits(size, bits))
    rows = running(cut(steps, [stream], order, slices), [stream], order, sums={"_total": F.col("_bits")})
    # Chains and running values read their rows twice, so those are written once.
    rows = checkpointed(rows.withColumns({"_before": F.col("_total") - F.col("_bits"), "_opens": F.col("_bits") > 0}))
    rows = checkpointed(chain(rows, [stream], order, ts_ms, window_ms, ["_before"], opens="_opens"))
    age = F.col(ts_ms) - F.col("anchor")
    # An empty batch may end a window, but it begins none.
    over = F.coalesce(age > window_ms, F.lit(False))
    held = F.when(over, 0).otherwise(F.col("_total") - F.coalesce(F.col("anchor__before"), F.col("_before")))
    rows = rows.withColumns({"window_start_ms": F.when(~over, F.col("anchor")), "_held": held,
                             "elapsed_ms": F.when(over, 0).otherwise(F.coalesce(age, F.lit(0)))})
    fresh = F.when(F.col("elapsed_ms") * 2 > window_ms, F.col("_held") / (F.col("elapsed_ms") / 1000) / bits)
    rows = running(rows, [stream], order, lasts={"rate": fresh})
    rows = rows.withColumns({"step_bytes": _bytes("_bits"), "total_bytes": _bytes("_total"), "window_bytes": _bytes("_held")})
    rows = rows.drop("_bits", "_total", "_held", "_before", "_opens", "anchor", "anchor_before", "anchor__before", "is_anchor")
    return rows.withColumn("rate_text", friendly(F.col("rate"), "HZ", 1000))


def thin_log(samples: DataFrame, stream: str, order: list[str], size: str, sample_rate: int | None,
             bits: int = 8, channels: int = 1, interval_seconds: int = 5,
             slices: int | None = None) -> DataFrame:
    """Which batches are logged: the first, and one per ``interval_seconds`` of stream.

    Without a sample rate (no stream properties) every batch is logged.
    """
    steps = samples.withColumn("_bits", _bits(size, bits))
    rows = running(cut(steps, [stream], order, slices), [stream], order, sums={"_total": F.col("_bits")})
    whole = {"step_bytes": _bytes("_bits"), "total_bytes": _bytes("_total")}
    if sample_rate is None:
        return rows.withColumns(whole | {"should_log": F.lit(True)}).drop("_bits", "_total")
    budget = interval_seconds * sample_rate * bits * channels
    rows = checkpointed(rows.withColumn("_first", F.col("_total") == F.col("_bits")))
    rows = chain(rows, [stream], order, "_total", budget, force="_first")
    rows = rows.withColumns(whole | {"should_log": F.col("is_anchor")})
    return rows.drop("_bits", "_total", "_first", "anchor", "anchor_before", "is_anchor")
