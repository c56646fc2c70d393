"""Set operations, alignment, ordering."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabfeat.functions.columns import q


def append_rows(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows, matched by column name; columns absent from one side become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, first)


def tag_split(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("_split", F.lit(name))


def split_back(df: DataFrame, *names: str) -> DataFrame:
    return df.where(F.col("_split").isin(list(names))).drop("_split")


def distinct_levels(df: DataFrame, column: str) -> DataFrame:
    """Distinct values; a missing value is one of them."""
    return df.select(q(column)).distinct()


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    from tabfeat.operators.profile import melt

    kinds = {df.schema[v].dataType.simpleString() for v in values}
    return melt(df, ids, values, kinds.pop() if len(kinds) == 1 else "double")


def align_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Put two tables side by side on a key that is unique in both; unmatched rows stay."""
    return left.join(right, key, "full")


def sort_rows(df: DataFrame, by: Sequence[Column], tie_break: Sequence[str]) -> DataFrame:
    return df.orderBy(*by, *[q(c) for c in tie_break])


def top_k(df: DataFrame, column: str, k: int, tie_break: str) -> DataFrame:
    return df.orderBy(F.desc(column), q(tie_break)).limit(k)


def arg_extreme(df: DataFrame, column: str, key: str) -> DataFrame:
    """Key of the smallest and of the largest value; the lowest key on ties."""
    return df.agg(
        F.min_by(key, F.struct(q(column), q(key))).alias("arg_min"),
        F.max_by(key, F.struct(q(column), -q(key))).alias("arg_max"),
    )


def first_n(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    return df.orderBy(q(key)).limit(n)


def competition_rank(df: DataFrame, score: str, partition: Sequence[str] = (), top: int | None = None) -> DataFrame:
    """Rank 1,1,3 by descending score. Without ``partition`` meant for a leaderboard, not for a table."""
    ranked = df.withColumn("rank", F.rank().over(Window.partitionBy(*[q(c) for c in partition]).orderBy(F.desc(score))))
    return ranked if top is None else ranked.where(F.col("rank") <= top)
