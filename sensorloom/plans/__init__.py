"""Queries that apply the operators to the tables at hand."""

from sensorloom.plans import data_queries, formation_queries, more_queries, sequence_queries, spike_queries, split_queries, trace_queries, unit_queries
from sensorloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "data_queries", "formation_queries", "more_queries", "sequence_queries", "spike_queries", "split_queries", "trace_queries", "unit_queries"]
