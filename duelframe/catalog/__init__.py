"""All registered queries."""

from . import record_queries, history_queries, rating_queries, bias_queries, event_queries, clean_queries, scenario_queries, playoff_queries, forecast_queries, source_queries  # noqa: F401
from . import sink_queries  # noqa: F401  (after the queries whose rows it writes)
from .registry import CHECKS, COVERS, QUERIES  # noqa: F401
