"""Registered queries and their SQL oracle twins."""

from farebox.plans.oracle import ORACLE
from farebox.plans.queries import QUERIES

__all__ = ["ORACLE", "QUERIES"]
