"""Query plans over the driver tables and their SQL twins."""

from covary.plans.queries import ORACLE, QUERIES, oracle_sql, queries

__all__ = ["ORACLE", "QUERIES", "oracle_sql", "queries"]
