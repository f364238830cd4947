"""Table access. Parquet keeps column pruning and filter pushdown in the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import pin_utc

# Rule tables up to this many rows may be broadcast; a longer list is joined
# like any other table. The size is known because the rows come from a list.
MAX_BROADCAST_RULES = 50_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rule_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A configured rule list as a table, broadcast only while it is short."""
    rules = spark.createDataFrame(rows, schema)
    return F.broadcast(rules) if len(rows) <= MAX_BROADCAST_RULES else rules


def micros(ts: Column) -> Column:
    """Whole microseconds since the epoch of a zone-less UTC timestamp."""
    return F.unix_micros(ts.cast("timestamp"))


def utc_second_text(epoch_micros: Column) -> Column:
    return F.date_format(F.timestamp_micros(epoch_micros), "yyyy-MM-dd HH:mm:ss")
