"""Column functions for text, numbers as text, and fixed-width output."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.session import with_tasks

with_tasks(__name__)

# Fixed value: the characters the reference language counts as white space, as a
# pattern and as a list.
WHITE_SPACE = (r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}"
               r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]")
WHITE_CHARS = ("\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
               + "\u2028\u2029\u202f\u205f\u3000\ufeff")


def text(value: Column) -> Column:
    return value.cast("string")


def blank(value: Column) -> Column:
    """The text, or the empty text where it is missing."""
    return F.coalesce(text(value), F.lit(""))


def present(value: Column) -> Column:
    """True unless the text is missing or empty."""
    return value.isNotNull() & (value != "")


def replace_first(value: Column, needle: Column | str, replacement: Column | str) -> Column:
    """Replace the first occurrence of a plain text."""
    if isinstance(replacement, str):
        replacement = F.lit(replacement)
    length = F.lit(len(needle)) if isinstance(needle, str) else F.length(needle)
    needle = F.lit(needle) if isinstance(needle, str) else needle
    at = F.instr(value, needle)
    rest = F.substring(value, at + length, F.length(value))
    return (F.when(at > 0, F.concat(F.substring(value, F.lit(1), at - 1), replacement, rest))
            .otherwise(value))


def fixed_length(value: Column, length: int) -> Column:
    """Cut or pad on the right to ``length``; a negative length keeps the end."""
    body = blank(value)
    if length < 0:
        body, length = F.right(body, F.lit(-length)), -length
    return F.rpad(body, length, " ")


def friendly(number: Column, name: str, thousand: int = 1000) -> Column:
    """Human units: M, K or none, two decimals at most, ``n/a`` for 0 or missing.

    A unit is used only when the value in it is strictly above one.
    """
    n = number.cast("double")
    mega, kilo = n / F.lit(float(thousand * thousand)), n / F.lit(float(thousand))
    units = F.when(mega > 1, mega).when(kilo > 1, kilo).otherwise(n)
    unit = F.when(mega > 1, "M").when(kilo > 1, "K").otherwise("")
    hundredths = F.floor(F.abs(units) * 100 + 0.5).cast("bigint")
    rest = hundredths % 100
    decimals = (F.when(rest == 0, "")
                .when(rest % 10 == 0, F.concat(F.lit("."), text((rest / 10).cast("bigint"))))
                .otherwise(F.concat(F.lit("."), F.lpad(text(rest), 2, "0"))))
    sign = F.when(n < 0, "-").otherwise("")
    whole = text(F.floor(hundredths / 100).cast("bigint"))
    return (F.when(n.isNull() | (n == 0), "n/a")
            .otherwise(F.concat(sign, whole, decimals, unit, F.lit(name))))


def number_text(value: Column) -> Column:
    """A number as the reference language prints it: plain from 0.000001 up to below 1e21,
    else with an exponent, and without a trailing ``.0``."""
    shown = text(value)
    sign, body = F.when(F.startswith(shown, F.lit("-")), "-").otherwise(""), F.ltrim(shown, F.lit("-"))
    parts = F.split(body, "E")
    mantissa, exponent = F.regexp_replace(F.get(parts, F.lit(0)), r"\.0$", ""), F.get(parts, F.lit(1)).try_cast("int")
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    rest = F.substring(digits, exponent + 2, F.length(digits))
    large = F.when(rest != "", F.concat(F.left(digits, exponent + 1), F.lit("."), rest)).otherwise(
        F.rpad(digits, exponent + 1, F.lit("0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    tail = F.substring(digits, F.lit(2), F.length(digits))
    power = F.concat(F.left(digits, F.lit(1)), F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""), F.lit("e"),
                     F.when(exponent > 0, "+").otherwise("-"), text(F.abs(exponent)))
    # Few numbers have an exponent; the others are shown as they are.
    plain = F.when(F.endswith(shown, F.lit(".0")), F.left(shown, F.length(shown) - 2)).otherwise(shown)
    return (F.when(value == 0, "0").when(~F.contains(shown, F.lit("E")), plain)
            .when(exponent.between(0, 20), F.concat(sign, large))
            .when(exponent.between(-6, -1), F.concat(sign, small)).otherwise(F.concat(sign, power)))


def script_number(value: float) -> str:
    """The same for one value, for helpers that run in Python."""
    if isinstance(value, int) and abs(value) < 1 << 53:
        return str(value)
    value = float(value) if not isinstance(value, int) or abs(value) < 1 << 1023 else math.inf * (1 if value > 0 else -1)
    if value != value:
        return "NaN"
    if math.isinf(value):
        return "Infinity" if value > 0 else "-Infinity"
    if not value:
        return "0"
    sign, (mantissa, exponent) = "-" if value < 0 else "", f"{abs(value)!r}e0".split("e")[:2]
    whole, _, part = mantissa.partition(".")
    digits = (whole + part.rstrip("0")).lstrip("0")
    exponent = int(exponent) + (len(whole) if whole.strip("0") else len(part.lstrip("0")) - len(part)) - 1
    digits = digits.rstrip("0") or "0"
    if 0 <= exponent <= 20:
        head, tail = digits[:exponent + 1].ljust(exponent + 1, "0"), digits[exponent + 1:]
        return sign + head + ("." + tail if tail else "")
    if -6 <= exponent < 0:
        return f"{sign}0.{'0' * (-exponent - 1)}{digits}"
    tail = "." + digits[1:] if len(digits) > 1 else ""
    return f"{sign}{digits[0]}{tail}e{'+' if exponent > 0 else '-'}{abs(exponent)}"


# Lists longer than this are tested as an array, whose plan does not grow with the list.
SPELLED_OUT = 50


def contains_any(value: Column, needles: list[str]) -> Column:
    """True where the text contains one of the needles."""
    if len(needles) > SPELLED_OUT:
        return F.exists(F.lit(list(needles)), lambda n: F.contains(value, n))
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(value, F.lit(needle))
    return hit


def trim_white(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITE_CHARS))


def nth_part(value: Column, separator: str, n: int) -> Column:
    """The n-th part (from 1) of a text split on a plain separator, or null."""
    return F.get(F.split(value, "\\Q" + separator + "\\E", -1), F.lit(n - 1))
