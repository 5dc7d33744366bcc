from registry.core import QUERIES, SQL
from registry import faults, landed, monitoring, planning  # noqa: F401

__all__ = ["QUERIES", "SQL"]
