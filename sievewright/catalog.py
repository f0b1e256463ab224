"""Registered queries of the core operators and their SQL."""

from sievewright.plans import core_queries, core_sql, data_queries

QUERIES = core_queries.QUERIES | data_queries.QUERIES
ORACLES = core_sql.ORACLES | data_queries.ORACLES

__all__ = ["ORACLES", "QUERIES"]
