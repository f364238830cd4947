"""Joining one row per key back to the many rows of that key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is joined by broadcast. No more than
# (all rows / HOT_ROWS) keys can be that large, which bounds what is broadcast:
# 10^12 rows have at most 200,000 of them.
HOT_ROWS = 5_000_000
SALTS = 4096


def attach(rows: DataFrame, per_key: DataFrame, keys: list[str], size: str, spread: list[str],
           hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left-join ``per_key`` (one row per key, ``size`` rows each in ``rows``) to ``rows``.

    A shuffle join would bring all rows of a key to one task, and a grouping on the
    same key after it keeps the engine from splitting that task. Here hot keys take
    their values from a broadcast, and their rows go through the shuffle join under
    a salt made of the ``spread`` columns, where they match nothing. The result is
    partitioned by key and salt, so a later grouping starts with partial results.
    """
    values = [c for c in per_key.columns if c not in (*keys, size)]
    packed = F.struct(F.lit(True).alias("_known"), *values)
    hot = per_key.where(F.col(size) > hot_rows).select(*keys, packed.alias("_hot"))
    cold = per_key.where(F.col(size) <= hot_rows).select(*keys, F.lit(0).alias("_salt"), packed.alias("_cold"))
    salt = (F.pmod(F.xxhash64(*spread), F.lit(SALTS)) + 1).cast("int")
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull(), salt).otherwise(0))
    found = salted.join(cold, [*keys, "_salt"], "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return found.select(*rows.columns, *[F.col(f"_found.{v}").alias(v) for v in values])
