"""All registered queries: importing this module registers them."""

from . import annotation_queries, audit_queries, distance_queries, json_queries, key_queries, placement_queries, queries, report_queries, round_trips, state_queries  # noqa: F401
from .queries import flagship  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
