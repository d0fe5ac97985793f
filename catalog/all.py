"""Imports every query module so that the registry is complete."""

from catalog import network_queries, routing_queries, score_queries, store_queries, value_queries  # noqa: F401
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
