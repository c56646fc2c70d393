"""Equi-join of a large table with a table that has one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def lookup_join(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join ``table`` to ``df`` without a hint.

    Adaptive execution sees the sizes: it broadcasts a small ``table`` and splits
    the rows of a hot key over several tasks.
    """
    return df.join(table, list(keys), how)
