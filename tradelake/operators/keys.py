"""Consecutive numbers for the rows of a table in key order, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .scans import numbered


def number_rows(df: DataFrame, key: str, name: str, *ties: str) -> DataFrame:
    """df with the added long column name: 1, 2, ... in the order of key and then of ties, which together tell all rows
    apart."""
    return numbered(df, [key, *ties], name)
