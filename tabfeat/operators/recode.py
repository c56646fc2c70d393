"""Merging levels of categorical and integer columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabfeat.functions.columns import INTEGRALS, q

# (old levels, new level), applied one after the other
Rule = tuple[Sequence, object]


def compose(rules: Sequence[Rule]) -> dict:
    """One simultaneous map equal to applying the rules in order.

    A later rule also sees what an earlier one produced.
    """
    out = {}
    for value in {old for olds, _ in rules for old in olds}:
        now = value
        for olds, new in rules:
            if now in olds:
                now = new
        out[value] = now
    return out


def expand_keys(plan: Mapping) -> dict[str, object]:
    """A plan keyed by a column or a tuple of columns, with one entry per column."""
    return {c: v for k, v in plan.items() for c in (k if isinstance(k, tuple) else (k,))}


def present_only(df: DataFrame, plan: Mapping[str, object]) -> dict[str, object]:
    return {c: v for c, v in plan.items() if c in df.columns}


def _recoded(df: DataFrame, column: str, mapping: Mapping) -> Column:
    kind = df.schema[column].dataType
    text = isinstance(kind, T.StringType)
    if not text and not isinstance(kind, (*INTEGRALS, T.DoubleType, T.FloatType)):
        return q(column)
    # a rule whose levels are of the other kind never matches
    usable = {k: v for k, v in mapping.items() if isinstance(k, str) == text}
    if not usable:
        return q(column)
    pairs = [x for k in sorted(usable) for x in (F.lit(k).cast(kind), F.lit(usable[k]).cast(kind))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), q(column)), q(column))


def recode_levels(df: DataFrame, plan: Mapping[str | tuple[str, ...], Sequence[Rule]]) -> DataFrame:
    """Replace levels column by column; unlisted levels stay, absent columns are skipped."""
    flat = present_only(df, expand_keys(plan))
    return df.withColumns({c: _recoded(df, c, compose(rules)) for c, rules in flat.items()})
