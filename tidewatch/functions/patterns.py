"""Long lists of patterns: an index of the texts that each one needs."""

from __future__ import annotations

import re
from collections import Counter
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.tables import rule_table

# Signs of a text by which patterns are looked up.
GRAM = 3


def needed_texts(pattern: str) -> list[str]:
    """Runs of signs that every text with a match holds; none if that can't be told."""
    try:
        parsed = parser.parse(pattern)
    except (re.error, OverflowError):
        return []
    if parsed.state.flags & ~re.UNICODE:
        return []
    runs = [""]

    def walk(items) -> None:
        for op, value in items:
            if op is sre.LITERAL:
                runs[-1] += chr(value)
            elif op is sre.SUBPATTERN and not value[1] and not value[2]:
                walk(value[3])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
                # Once at least; how often more is open.
                walk(value[2])
                runs.append("")
            elif op is not sre.AT:
                runs.append("")

    walk(parsed)
    return [run for run in runs if len(run) >= GRAM]


def indexed(patterns: list[str]) -> tuple[list[tuple[str, int, str]], list[int]]:
    """(gram, number, pattern) of the patterns that need a text, by the rarest of its grams, and the numbers of the others."""
    grams = [{run[i:i + GRAM] for run in needed_texts(p) for i in range(len(run) - GRAM + 1)} for p in patterns]
    counts = Counter(g for own in grams for g in own)
    found = [(min(own, key=lambda g: (counts[g], g)), i, patterns[i]) for i, own in enumerate(grams) if own]
    return found, [i for i, own in enumerate(grams) if not own]


def with_first_pattern(rows: DataFrame, column: str, patterns: list[str], into: str, others) -> DataFrame:
    """Add the number of the first pattern found in a text column, -1 if none.

    Each distinct text is cut into grams and meets, by an equality join, only patterns that need
    one of its grams. ``others(column, patterns)`` gives the number of the first one of the patterns
    that need no text; they are tested on every text."""
    found, rest = indexed(patterns)
    index = rule_table(rows.sparkSession, found, "gram string, number int, pattern string")
    texts = rows.select(F.col(column).alias("text")).where("text IS NOT NULL").distinct()
    spots = F.sequence(F.lit(1), F.greatest(F.length("text") - GRAM + 1, F.lit(1)))
    grams = texts.select("text", F.explode(F.array_distinct(F.transform(
        spots, lambda i: F.substring("text", i, F.lit(GRAM))))).alias("gram"))
    hits = grams.join(index, "gram").where(F.rlike("text", F.col("pattern"))).groupBy("text").agg(F.min("number").alias("_hit"))
    by_text = rows.join(hits.withColumnRenamed("text", column), column, "left")
    number = others(F.col(column), [patterns[i] for i in rest]) if rest else F.lit(-1)
    numbers = F.when(number >= 0, F.get(F.lit(rest or [0]), number))
    return by_text.withColumn(into, F.coalesce(F.least("_hit", numbers), F.lit(-1))).select(*rows.columns, into)
