"""Service-telemetry operators for Spark: DataFrame in, DataFrame out."""
