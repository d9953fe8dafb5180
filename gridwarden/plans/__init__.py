"""Registered queries and the SQL that checks them."""

from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
