"""Queries over the driver tables, with SQL that says the same."""

from . import change_queries, flow_queries, intake_queries, queries, statement_queries, workflow_queries
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "change_queries", "flow_queries", "intake_queries", "queries", "statement_queries", "workflow_queries"]
