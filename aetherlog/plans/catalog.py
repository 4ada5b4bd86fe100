"""All registered queries."""

from aetherlog.plans import aviation_queries, ops_queries, pass_queries, signal_queries, stream_queries, text_queries  # noqa: F401
from aetherlog.plans.registry import ORACLE, QUERIES  # noqa: F401
