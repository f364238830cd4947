"""Registered queries, one module per area."""

from tidewatch.plans import (  # noqa: F401
    calls, documents, export, monitor, quality, requests, services, sessions, tasks)
from tidewatch.plans.registry import CHECKS, QUERIES  # noqa: F401
