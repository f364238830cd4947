"""Service compose configuration as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.operators.monitor import MonitorConfig
from tidewatch.sources.tables import rule_table

# Entries of a compose file that are not services.
NOT_SERVICES = ("verbose", "user")


def compose_table(spark: SparkSession, compose: dict) -> DataFrame:
    """(service, package, protocol, address, forwarding_address) of each service."""
    rows = [(name, s.get("pkgModuleString"), s.get("protocol"), s.get("address"), s.get("forwardingAddress"))
            for name, s in compose.items() if name not in NOT_SERVICES and isinstance(s, dict)]
    return rule_table(spark, rows, "service string, package string, protocol string, address string, "
                                   "forwarding_address string")


def compose_user(compose: dict) -> str | None:
    return (compose.get("user") or {}).get("id")


def compose_monitoring(compose: dict) -> MonitorConfig:
    return MonitorConfig.from_json(compose.get("verbose") or {})
