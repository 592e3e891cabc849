"""All queries over the supplied tables, by name, with the SQL that says the same."""

from __future__ import annotations

from tidelog.plans import admin_queries, cluster_queries, fold_queries, log_queries, monitor_queries, replica_queries, report_queries, serving_queries, write_queries  # noqa: F401
from tidelog.plans.registry import ORACLES, QUERIES  # noqa: F401
