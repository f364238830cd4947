"""JSON records, flat rows, wire text, text hygiene and date texts as column jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import WHITE_SPACE, text, trim_white
from tidewatch.operators.nested import flat_to_json, json_nodes, json_quote, json_to_flat, json_type  # noqa: F401
from tidewatch.operators.requests import first_match

# Markers of the text protocol between nodes.
ROW, COMMA, QUERY_SEP = "__ROW__", "__COMMA__", "__QUERY_SEP__"
SUCCESS, FAIL = "SUCCESS: ", "FAIL: "

# Month names of the second date form.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Units of an age and how many make the next one.
AGE_UNITS = [("sec", 60), ("min", 60), ("hour", 24), ("day", 30), ("month", 12), ("year", 1000)]


# ----------------------------------------------------------------------- records

def json_records(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Parse a JSON column into ``record``; a missing id or bad JSON is a failed outcome."""
    rows = rows.withColumn("record", F.try_parse_json(json_col))
    known, parsed = F.col(id_col).isNotNull(), F.col("record").isNotNull()
    reason = first_match([
        (~known, F.lit("please specify either an object or a string to loadById")),
        (~parsed, F.concat(F.lit("cannot parse "), F.coalesce(json_col, F.lit("null"))))], F.lit(None).cast("string"))
    return rows.withColumns({"success": known & parsed, "reason": reason})


def expand_typed(rows: DataFrame, value: str) -> DataFrame:
    """Parse values that start with ``json:``; each bad value has a reason of its own.

    Adds ``success``, ``type``, ``expanded`` (text) and ``reason``.
    """
    typed = F.startswith(value, F.lit("json:"))
    rows = rows.withColumn("_v", F.when(typed, F.try_parse_json(F.substring(value, F.lit(6), F.length(value)))))
    bad = F.coalesce(typed & F.col("_v").isNull(), F.lit(False))
    return rows.withColumns({
        "success": ~bad, "type": F.when(typed, json_type(F.col("_v"))).otherwise("string"),
        "expanded": F.when(typed, F.to_json("_v")).otherwise(F.col(value)),
        "reason": F.when(bad, F.concat(F.lit("cannot parse "), value))}).drop("_v")


def merge_rows(base: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Three merges of flat rows (keys, ``value``, ``type``).

    ``overwritten``: more wins or is added. ``patched``: only for keys of the base.
    ``deep``: empty, zero, false and null of more are ignored, and the texts true and
    false become booleans.
    """
    left = base.select(*keys, F.col("value").alias("_b"), F.col("type").alias("_bt"), F.lit(True).alias("_in_b"))
    right = more.select(*keys, F.col("value").alias("_m"), F.col("type").alias("_mt"), F.lit(True).alias("_in_m"))
    rows = left.join(right, keys, "full")
    in_b, in_m = F.col("_in_b").isNotNull(), F.col("_in_m").isNotNull()
    empty = (F.col("_m").isNull() | (F.col("_m") == "") | ((F.col("_mt") == "number") & (F.col("_m").try_cast("double") == 0))
             | ((F.col("_mt") == "boolean") & (F.col("_m") == "false")))
    takes = in_m & ~empty
    as_flag = (F.col("_mt") == "string") & F.col("_m").isin("true", "false")
    return rows.select(
        *keys, F.when(in_m, F.col("_m")).otherwise(F.col("_b")).alias("overwritten"),
        F.when(in_b & in_m, F.col("_m")).when(in_b, F.col("_b")).alias("patched"),
        F.when(takes, F.col("_m")).otherwise(F.col("_b")).alias("deep"),
        F.when(takes & as_flag, "boolean").when(takes, F.col("_mt")).otherwise(F.col("_bt")).alias("deep_type"))


# --------------------------------------------------------------------- wire text

def decode_wire(message: Column) -> dict[str, Column]:
    """success, reason and rows (array of arrays of cells) of a text result."""
    ok, failed = F.startswith(message, F.lit(SUCCESS)), F.startswith(message, F.lit(FAIL))
    body = F.substring(message, F.lit(len(SUCCESS) + 1), F.length(message))
    pieces = F.split(body, ROW, -1)
    cells = lambda row: F.transform(F.split(row, ",", -1), lambda c: F.replace(c, F.lit(COMMA), F.lit(",")))
    none = F.array().cast("array<array<string>>")
    rows = first_match([(~ok, none), (body.isin("OK", ""), none), (F.size(pieces) == 1, F.array(F.array(body)))],
                       F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), cells))
    reason = first_match([(ok, F.lit(None).cast("string")),
                          (failed, F.substring(message, F.lit(len(FAIL) + 1), F.length(message)))],
                         F.concat(F.lit("Unrecognized response from node: "), message))
    return {"success": ok, "reason": reason, "rows": rows}


def encode_batch(statements: Column) -> Column:
    """One request text from an array of statements."""
    joined = F.array_join(statements, QUERY_SEP)
    return F.concat(F.lit("hex_"), F.lower(F.hex(F.encode(joined, "utf-8"))))


# -------------------------------------------------------------------------- text

# Fixed value: the characters kept by the printable filter, besides white space.
PRINTABLE = r"""a-zA-Z0-9\-@.<>="'_\\&,/"""


def printable(value: Column) -> Column:
    """Trimmed text without the characters outside the printable set."""
    # Long runs of kept characters are matched as one. Wide spaces are kept too; they
    # are looked up only for the rare other characters.
    common, wide = WHITE_SPACE[1:-1].split(r"\x{1680}")
    runs = rf"([{PRINTABLE}{common}]++)|(?:[^{PRINTABLE}{common}](?<![\x{{1680}}{wide}]))++"
    return F.regexp_replace(trim_white(value), runs, "$1")


def clean_breaks(value: Column, replacement: str = "", keep: bool = False) -> Column:
    """Drop each CR and LF, or keep it, and put a replacement text after it."""
    if not replacement:
        return value if keep else F.replace(F.replace(value, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(""))
    by = ("$1" if keep else "") + replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(value, "([\r\n])", by)


def no_capitals(value: Column) -> Column:
    return ~F.rlike(value, F.lit("[A-Z]"))


def token_pattern(token: str) -> str:
    """Pattern of a token. Backslash, opening square bracket, dollar and round brackets
    are escaped; any other sign keeps its meaning in a pattern."""
    for sign in "\\[$()":
        token = token.replace(sign, "\\" + sign)
    return token


def replace_tokens(value: Column, tokens: list[tuple[str, str]]) -> list[Column]:
    """The text after each token, in list order; the last entry is the result."""
    steps = []
    for token, by in tokens:
        value = F.regexp_replace(value, token_pattern(token), by.replace("\\", "\\\\").replace("$", "\\$"))
        steps.append(value)
    return steps


# ------------------------------------------------------------------------- dates

def two_digits(number: Column) -> Column:
    return F.when(number < 10, F.concat(F.lit("0"), text(number))).otherwise(text(number))


def age_text(seconds: Column) -> Column:
    """Age as ``NN unit ago`` or ``from now`` for a whole number of seconds."""
    size, scale, rules = F.abs(seconds), 1, []
    direction = F.when(seconds < 0, "from now").otherwise("ago")
    for unit, count in AGE_UNITS:
        number = F.floor(size / scale + 0.5).cast("bigint")
        words = F.concat(two_digits(number), F.lit(f" {unit}"), F.when(number == 1, " ").otherwise("s"), F.lit(" "), direction)
        rules.append((size < scale * count, words))
        scale *= count
    return first_match(rules, F.lit("N/A"))


def ago_words(number: Column, unit: str) -> Column:
    """`` NN units ago `` or `` from now ``, with a word for yesterday; null for 0."""
    ahead = F.concat(two_digits(-number), F.lit(f" {unit}s from now"))
    back = F.concat(two_digits(number), F.lit(f" {unit}s ago"))
    if unit == "day":
        back = F.when(number == 1, "-yesterday-").otherwise(back)
    return F.when(number != 0, F.concat(F.lit(" "), F.when(number < 0, ahead).otherwise(back), F.lit(" ")))


def date_parts(value: Column) -> dict[str, Column]:
    """Form, year, month, day and time of ``2010-11-06 14:44:51`` or
    ``Sat Nov 6 14:44:51 PST 2010``; null parts for any other text. The zone name is
    not read."""
    sql, words = r"^(\d+)-(\d+)-(\d+) (\d+):(\d+):(\d+)", r"^\S+ (\S+) (\d+) (\d+):(\d+):(\d+) .*?(\d+)$"
    is_sql = F.contains(value, F.lit("-"))
    month = first_match([(F.contains(F.regexp_extract(value, words, 1), F.lit(m)), F.lit(i + 1))
                         for i, m in enumerate(MONTHS)], F.lit(None).cast("int"))
    part = lambda s, w: F.when(is_sql, F.regexp_extract(value, sql, s)).otherwise(
        F.regexp_extract(value, words, w)).try_cast("int")
    form = first_match([(~is_sql & F.rlike(value, F.lit(words)) & month.isNotNull(), F.lit("words")),
                        (is_sql & F.rlike(value, F.lit(sql)), F.lit("sql"))], F.lit("N/A"))
    known = form != "N/A"
    return {"form": form, "year": F.when(known, part(1, 6)),
            "month": F.when(known, F.when(is_sql, part(2, 6)).otherwise(month)), "day": F.when(known, part(3, 2)),
            "hour": F.when(known, part(4, 3)), "minute": F.when(known, part(5, 4)), "second": F.when(known, part(6, 5))}


def epoch_ms() -> Column:
    """Epoch milliseconds of the columns of :func:`date_parts`."""
    return F.unix_millis(F.try_make_timestamp("year", "month", "day", "hour", "minute", F.col("second").cast("decimal(16,6)")))


def shift_zone(ms: Column, zone_minutes: int = -8 * 60) -> Column:
    """Epoch ms of a text of another zone, read on a UTC server."""
    return ms - zone_minutes * 60_000


def date_text(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss")


