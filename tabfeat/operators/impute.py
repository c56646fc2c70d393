"""Filling missing values: constants, means, most frequent levels, and whole plans of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabfeat.functions.columns import FLOATS, is_missing, numeric, q

TIMES = (T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class ImputeRule:
    """``how`` is 'constant', 'mean' or 'most_frequent'; ``fill`` is used by 'constant'."""

    name: str
    how: str
    fill: object
    columns: Sequence[str]


def filled(df: DataFrame, column: str, value) -> Column:
    """The column with missing values replaced by ``value`` in the column's own type."""
    if value is None:
        return q(column)
    return F.when(is_missing(df, column), F.lit(value).cast(df.schema[column].dataType)).otherwise(q(column))


def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: filled(df, c, v).alias(c) for c, v in values.items()})


def _micros(column: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(`{column}` as timestamp_ntz))")


def column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Means of numbers and of points in time, in one aggregation."""
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        if isinstance(df.schema[c].dataType, (*TIMES, T.DateType)):
            aggs.append(F.avg(_micros(c)).cast("long").alias(f"m{i}"))
        else:
            aggs.append(F.avg(numeric(df, c)).alias(f"m{i}"))
    named = df.agg(*aggs)
    back = [
        F.expr(f"timestampadd(MICROSECOND, m{i}, TIMESTAMP_NTZ '1970-01-01 00:00:00')").alias(f"m{i}")
        if isinstance(df.schema[c].dataType, (*TIMES, T.DateType)) else F.col(f"m{i}")
        for i, c in enumerate(columns)
    ]
    row = named.select(*back).first()
    return {c: row[f"m{i}"] for i, c in enumerate(columns)}


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value of each column; the lowest one on a tie.

    Counts levels by a shuffle instead of in one buffer, so columns with many
    levels are fine.
    """
    found: dict[str, object] = {}
    by_type: dict[str, list[str]] = {}
    for c in columns:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    for cols in by_type.values():
        present = df.select(*[F.when(~is_missing(df, c), q(c)).alias(c) for c in cols])
        counts = (
            present.unpivot([], [q(c) for c in cols], "variable", "value")
            .where("value is not null")
            .groupBy("variable", "value")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        best = counts.groupBy("variable").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
        found |= {r["variable"]: r["mode"] for r in best.collect()}
    return {c: found.get(c) for c in columns}


def fill_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean imputation; integral columns become double."""
    means = column_means(df, columns)
    return df.withColumns({c: F.coalesce(numeric(df, c), F.lit(means[c])) for c in columns})


def fill_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return fill_constant(df, column_modes(df, columns))


class Imputer:
    """Applies a list of rules; the result holds ``keep`` plus the rule columns in rule order."""

    def __init__(self, rules: Sequence[ImputeRule], keep: Sequence[str] = ()):
        self.rules = [r for r in rules if len(r.columns)]
        self.keep = list(keep)
        self.values: dict[str, object] = {}

    def fit(self, df: DataFrame) -> "Imputer":
        means = [c for r in self.rules if r.how == "mean" for c in r.columns]
        modes = [c for r in self.rules if r.how == "most_frequent" for c in r.columns]
        self.values = {c: r.fill for r in self.rules if r.how == "constant" for c in r.columns}
        self.values |= column_means(df, means) | column_modes(df, modes)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = [q(c) for c in self.keep]
        for r in self.rules:
            for c in r.columns:
                if r.how == "mean" and not isinstance(df.schema[c].dataType, (*FLOATS, *TIMES, T.DateType)):
                    out.append(F.coalesce(numeric(df, c), F.lit(self.values[c])).alias(c))
                else:
                    out.append(filled(df, c, self.values[c]).alias(c))
        return df.select(*out)


def base_plan(groups: Mapping[str, Sequence[str]]) -> list[ImputeRule]:
    """0 for numbers, 'Missing' for text, the mean for points in time."""
    return [
        ImputeRule("num_nan_zero", "constant", 0, list(groups["numeric"])),
        ImputeRule("num_nan_mean", "mean", None, []),
        ImputeRule("cat_nan_none", "constant", "None", []),
        ImputeRule("cat_nan_miss", "constant", "Missing", list(groups["categorical"])),
        ImputeRule("nan_most", "most_frequent", None, []),
        ImputeRule("date_nan_dummy", "mean", None, list(groups["datetime"])),
    ]


def tailored_plan(
    groups: Mapping[str, Sequence[str]], none_columns: Sequence[str], mode_columns: Sequence[str]
) -> list[ImputeRule]:
    """Like ``base_plan``, but some text columns get 'None' and some their most frequent level."""
    special = {*none_columns, *mode_columns}
    text = list(groups["categorical"])
    return [
        ImputeRule("num_nan_zero", "constant", 0, list(groups["numeric"])),
        ImputeRule("num_nan_mean", "mean", None, []),
        ImputeRule("cat_nan_none", "constant", "None", [c for c in none_columns if c in text]),
        ImputeRule("cat_nan_miss", "constant", "Missing", [c for c in text if c not in special]),
        ImputeRule("nan_most", "most_frequent", None, [c for c in mode_columns if c in text]),
        ImputeRule("date_nan_dummy", "mean", None, list(groups["datetime"])),
    ]
