"""All queries with their SQL."""

from . import q_eval, q_more, q_rank, q_stats, q_tables  # noqa: F401
from .bindings import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
