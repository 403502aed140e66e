"""All queries of the point operators: importing this registers them."""

from pointmill.plans import box_queries, cluster_queries, file_queries, network_queries, point_queries  # noqa: F401
from pointmill.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
