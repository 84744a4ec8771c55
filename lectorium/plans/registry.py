"""Queries by name, each with its SQL."""

from __future__ import annotations

QUERIES, ORACLES = {}, {}


def query(sql: str):
    """Register a query under its name, with its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = sql
        return function

    return add
