"""Queries of the surveillance operators, with the SQL that gives the same rows."""

from tidewatch.plans.oracle import ORACLE_SQL
from tidewatch.plans.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
