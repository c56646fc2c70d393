"""Categories to numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabfeat.functions.columns import numeric, q
from tabfeat.operators.lookup import lookup_join
from tabfeat.operators.ranks import add_rank

# Output columns of one 0/1 expansion; beyond it use ``onehot_vector``.
MAX_DUMMIES = 2000


def ordinal_encode(df: DataFrame, levels: Mapping[str, Sequence[str]], unknown: str = "error") -> DataFrame:
    """Level to its 0-based position as a double.

    A missing or unlisted level raises, or becomes NULL with ``unknown='null'``.
    """
    out = {}
    for c, order in levels.items():
        at = F.array_position(F.array(*map(F.lit, order)), q(c))
        if unknown == "error":
            message = F.concat(F.lit(f"unknown level in {c}: "), F.coalesce(q(c), F.lit("NULL")))
            other = F.raise_error(message).cast("double")
        else:
            other = F.lit(None).cast("double")
        out[c] = F.when(at > 0, (at - 1).cast("double")).otherwise(other)
    return df.withColumns(out)


class OneHot:
    """0/1 column ``<col>_<level>`` for every level seen by ``fit``, levels in order, none left out.

    A missing value gives zeros everywhere. Numeric columns pass through.
    """

    def __init__(self, columns: Sequence[str], max_dummies: int = MAX_DUMMIES):
        self.columns = list(dict.fromkeys(columns))
        self.max_dummies = max_dummies
        self.levels: dict[str, list[str]] = {}

    def fit(self, df: DataFrame) -> "OneHot":
        text = [c for c in self.columns if isinstance(df.schema[c].dataType, T.StringType)]
        self.levels = {c: [] for c in text}
        if not text:
            return self
        seen = (
            df.unpivot([], [q(c) for c in text], "variable", "value")
            .where("value is not null")
            .distinct()
            .take(self.max_dummies + 1)
        )
        if len(seen) > self.max_dummies:
            raise ValueError(f"more than {self.max_dummies} levels; use onehot_vector for these columns")
        for r in sorted(seen):
            self.levels[r["variable"]].append(r["value"])
        return self

    @property
    def names(self) -> list[str]:
        return [f"{c}_{v}" for c in self.columns for v in self.levels.get(c, [])]

    def columns_of(self, df: DataFrame) -> list:
        return [
            F.when(q(c) == v, 1).otherwise(0).alias(f"{c}_{v}")
            for c in self.columns for v in self.levels.get(c, [])
        ]

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns, numeric listed columns, then the dummies."""
        passed = [c for c in self.columns if c not in self.levels and c not in keep]
        return df.select(*[q(c) for c in [*keep, *passed]], *self.columns_of(df))


def onehot_vector(df: DataFrame, column: str, out: str):
    """Fitted sparse encoder for a column with very many levels."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    index = StringIndexer(inputCol=column, outputCol=f"{out}_index", stringOrderType="alphabetAsc", handleInvalid="keep")
    return Pipeline(stages=[index, OneHotEncoder(inputCol=f"{out}_index", outputCol=out, dropLast=True)]).fit(df)


def appearance_encode(
    df: DataFrame, columns: Sequence[str], key: str, order_by: str = "appearance", target: str | None = None
) -> DataFrame:
    """Add ``<col>_E``: 1..k by first appearance along ``key``, or by mean target (equal means share a code).

    A missing value stays missing.
    """
    out = df
    for c in columns:
        present = df.where(q(c).isNotNull())
        score = F.min(q(key)) if order_by == "appearance" else F.avg(numeric(df, target))
        levels = present.groupBy(q(c).alias("_level")).agg(score.alias("_score"))
        ranked = add_rank(levels, "_score", salt=["_level"])
        table = ranked.select(F.col("_level").alias(c), (F.col("_score_before") + 1).cast("long").alias(f"{c}_E"))
        out = lookup_join(out, table, [c])
    return out

