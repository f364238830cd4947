"""Report formats and the bounded log snapshot."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.text import number_text, text

MAX_LOG_LENGTH = 1000
# Which entry types are shown unless configured otherwise.
SHOWN_TYPES = {"WARNING": False, "INFO": False, "ERROR": True}
FORMATS = ("json", "ssv", "tsv")


def _cell(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    return number_text(column) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else text(column)


def tsv_lines(rows: DataFrame, key: str) -> DataFrame:
    """(section, key, line): the header line, then one tab-joined line per row."""
    cells = [F.coalesce(_cell(f), F.lit("")) for f in rows.schema]
    header = rows.sparkSession.range(1).select(
        F.lit(0).alias("section"), F.lit(None).cast("bigint").alias("key"), F.lit("\t".join(rows.columns)).alias("line"))
    body = rows.select(F.lit(1).alias("section"), F.col(key).cast("bigint").alias("key"),
                       F.concat_ws("\t", *cells).alias("line"))
    return header.unionByName(body)


def ssv_lines(rows: DataFrame, key: str) -> DataFrame:
    """(section, key, line): header, an empty line, then one padded line per row.

    A column is as wide as its longest value or its name, and one blank. The widths
    are one row of maxima, read as scalars by the second pass.
    """
    cells = {f.name: F.coalesce(_cell(f), F.lit("null")) for f in rows.schema}
    texts = rows.select(F.col(key).cast("bigint").alias("_key"), *[c.alias(n) for n, c in cells.items()])
    widths = texts.agg(F.struct(*[F.greatest(F.max(F.length(f"`{n}`")), F.lit(len(n))).alias(n) for n in cells]).alias("w"))
    w = widths.scalar()
    padded = lambda value, n: F.rpad(value, F.coalesce(F.col("_w").getField(n), F.lit(len(n))) + 1, F.lit(" "))
    one = rows.sparkSession.range(1)
    none = F.lit(None).cast("bigint")
    header = one.withColumn("_w", w).select(F.lit(0).alias("section"), none.alias("key"),
                        F.concat(*[padded(F.lit(n), n) for n in cells]).alias("line"))
    gap = one.select(F.lit(1).alias("section"), none.alias("key"), F.lit("").alias("line"))
    body = texts.withColumn("_w", w).select(F.lit(2).alias("section"), F.col("_key").alias("key"),
                        F.concat(*[padded(F.col(f"`{n}`"), n) for n in cells]).alias("line"))
    return header.unionByName(gap).unionByName(body)


def _quoted(value: Column) -> Column:
    packed = F.to_json(F.array(value))
    return F.substring(packed, F.lit(2), F.length(packed) - 2)


def _pretty(value: Column, kind: T.DataType, margin: str) -> Column:
    """A value as JSON, two blanks deeper at each level. What JSON has no sign for is null."""
    inner = margin + "  "

    def block(first: str, last: str, members: Column) -> Column:
        return F.concat(F.lit(f"{first}\n"), members, F.lit(f"\n{margin}{last}"))

    if isinstance(kind, T.StructType):
        members = [F.concat(F.lit(f"{inner}{json.dumps(f.name, ensure_ascii=False)}: "),
                            _pretty(value.getField(f.name), f.dataType, inner)) for f in kind]
        shown = block("{", "}", F.concat_ws(",\n", *members)) if members else F.lit("{}")
    elif isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda v: F.concat(F.lit(inner), _pretty(v, kind.elementType, inner)))
        shown = F.when(F.size(value) == 0, "[]").otherwise(block("[", "]", F.array_join(items, ",\n")))
    elif isinstance(kind, T.MapType):
        items = F.transform(F.map_entries(value), lambda e: F.concat(
            F.lit(inner), _quoted(text(e["key"])), F.lit(": "), _pretty(e["value"], kind.valueType, inner)))
        shown = F.when(F.size(value) == 0, "{}").otherwise(block("{", "}", F.array_join(items, ",\n")))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        shown = F.when(F.abs(value) < float("inf"), number_text(value))
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        shown = text(value)
    elif isinstance(kind, T.VariantType):
        shown = F.to_json(value)
    else:
        shown = _quoted(text(value))
    return F.coalesce(F.when(value.isNotNull(), shown), F.lit("null"))


def json_lines(rows: DataFrame, key: str) -> DataFrame:
    """(section, key, line): one JSON document, a list with a record per line of section 1.

    The key orders the records, those without one first; records with the same last key are one
    line. No records give an empty list."""
    members = [F.concat(F.lit(f"    {json.dumps(f.name, ensure_ascii=False)}: "),
                        _pretty(F.col(f"`{f.name}`"), f.dataType, "    ")) for f in rows.schema]
    record = F.concat(F.lit("  {\n"), F.concat_ws(",\n", *members), F.lit("\n  }"))
    at = F.col(key).cast("bigint")
    seen = rows.agg(F.struct(F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))).scalar()
    lines = rows.select(F.lit(1).alias("section"), at.alias("key"), record.alias("line")).withColumn("_seen", seen)
    ends = F.col("key").eqNullSafe(F.col("_seen.last"))
    body = lines.where(~ends).select("section", "key", F.concat("line", F.lit(",")).alias("line"))
    tail = lines.where(ends).groupBy("section", "key").agg(F.array_join(F.sort_array(F.collect_list("line")), ",\n").alias("line"))
    one = rows.sparkSession.range(1).withColumn("_seen", seen)
    none = F.lit(None).cast("bigint").alias("key")
    head = one.select(F.lit(0).alias("section"), none, F.when(F.col("_seen.n") == 0, "[]").otherwise("[").alias("line"))
    foot = one.where(F.col("_seen.n") > 0).select(F.lit(2).alias("section"), none, F.lit("]").alias("line"))
    return head.unionByName(body).unionByName(tail).unionByName(foot)


def export_lines(rows: DataFrame, key: str, fmt: str) -> DataFrame:
    """Lines of a report in one of the formats; any other is refused."""
    if fmt not in FORMATS:
        raise ValueError(f"invalid serialization format: {fmt}")
    return {"json": json_lines, "ssv": ssv_lines, "tsv": tsv_lines}[fmt](rows, key)


def write_lines(lines: DataFrame, path: str) -> None:
    """Write a report as text files that list its lines in order when read by name."""
    order = [c for c in ("section", "key") if c in lines.columns]
    lines.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(
        *[F.col(c).asc_nulls_first() for c in order]).select("line").write.mode("errorifexists").text(path)


def latest_entries(entries: DataFrame, order: list[str], shown: dict[str, bool] | None = None,
                   limit: int = MAX_LOG_LENGTH) -> DataFrame:
    """The newest entries (a top-k), and whether their type is shown."""
    on = [t for t, flag in (SHOWN_TYPES | (shown or {})).items() if flag]
    newest = entries.orderBy(*[F.col(c).desc() for c in order]).limit(limit)
    return newest.withColumn("shown", F.col("type").isin(on))


def entry_line() -> Column:
    """A log entry as printed, from the columns ts, type, plugin and msg."""
    return F.concat(F.lit("["), "ts", F.lit("] ("), "type", F.lit(")("), F.coalesce("plugin", F.lit("")), F.lit(") "), "msg")


def log_snapshot(entries: DataFrame, order: list[str], columns: list[str], limit: int = MAX_LOG_LENGTH) -> DataFrame:
    """One JSON document with the newest entries first; at most ``limit`` of them."""
    newest = latest_entries(entries, order, limit=limit)
    item = F.struct(F.struct(*order).alias("at"), F.struct(*columns).alias("entry"))
    ordered = F.transform(F.sort_array(F.collect_list(item), asc=False), lambda i: i["entry"])
    return newest.agg(F.to_json(F.struct(F.lit(limit).alias("maxLogLength"), ordered.alias("logEntries"))).alias("document"))
