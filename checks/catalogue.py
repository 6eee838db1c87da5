"""All registered queries."""

from checks import (  # noqa: F401
    q_accounting,
    q_actions,
    q_admission,
    q_arrivals,
    q_batches,
    q_filters,
    q_histories,
    q_requests,
    q_sinks,
    q_store,
    q_streams,
)
from checks.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
