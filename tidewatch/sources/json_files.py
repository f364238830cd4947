"""JSON files as records, with unreadable ones kept as failed outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False) -> DataFrame:
    """Records of the given schema with ``success`` and ``reason``.

    The schema is given, so files are read once and not sampled first.
    """
    if not path:
        raise ValueError("please specify either an object or a string to loadById")
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    read = schema if CORRUPT in schema.names else T.StructType([*schema, T.StructField(CORRUPT, T.StringType())])
    rows = (spark.read.schema(read).option("multiLine", multi_line).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).json(path))
    bad = F.col(CORRUPT).isNotNull()
    return rows.withColumns({"success": ~bad, "reason": F.when(bad, F.concat(F.lit("cannot parse "), CORRUPT))}).drop(CORRUPT)
