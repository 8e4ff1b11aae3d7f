"""The numbered queries and the SQL that checks them."""

from __future__ import annotations

from loadline.llm.oracle import ORACLE
from loadline.llm.queries import QUERIES

__all__ = ["ORACLE", "QUERIES"]
