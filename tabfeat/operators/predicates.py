"""Row filters, masks and simple projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabfeat.functions.columns import any_of, q

KEY_LIST_LIMIT = 1000


def drop_by_key(df: DataFrame, key: str, keys: Sequence) -> DataFrame:
    """Remove the rows with the listed keys; absent keys are ignored and a missing key stays."""
    if len(keys) <= KEY_LIST_LIMIT:
        return df.where(~F.coalesce(q(key).isin(list(keys)), F.lit(False)))
    listed = df.sparkSession.createDataFrame([(k,) for k in keys], [key])
    return df.join(listed.select(q(key).cast(df.schema[key].dataType).alias(key)), key, "left_anti")


def conditional_fix(df: DataFrame, column: str, above: float, shift: float, where: Column | None = None) -> DataFrame:
    """Add ``shift`` where the value exceeds ``above`` (and the extra condition holds)."""
    hit = q(column) > above
    if where is not None:
        hit = hit & where
    return df.withColumn(column, F.when(hit, q(column) + F.lit(shift).cast(df.schema[column].dataType)).otherwise(q(column)))


def low_quality(column: str = "OverallQual", below: float = 6) -> Column:
    return any_of(q(column) < below)


def member(column: str, levels: Sequence) -> Column:
    return any_of(q(column).isin(list(levels)))


def split_by_mask(df: DataFrame, mask: Column, names: tuple[str, str] = ("high", "low")) -> DataFrame:
    """Tag each row with its segment: the first name where the mask is false, the second where true."""
    return df.withColumn("segment", F.when(any_of(mask), names[1]).otherwise(names[0]))


def two_segments(df: DataFrame, mask: Column) -> tuple[DataFrame, DataFrame]:
    """Rows outside the mask and rows inside it."""
    return df.where(~any_of(mask)), df.where(any_of(mask))


def flag_columns(df: DataFrame, flags: Mapping[str, Column], yes="Y", no="N") -> DataFrame:
    """One flag column per condition; a missing operand gives ``no``."""
    return df.withColumns({n: F.when(c, F.lit(yes)).otherwise(F.lit(no)) for n, c in flags.items()})


def quadratic(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{f}_quad": q(f) * q(f) for f in features})


def cast_categorical(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f: q(f).cast("string") for f in features})


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the listed columns, ignoring absent ones."""
    gone = set(columns)
    return df.select(*[q(c) for c in df.columns if c not in gone])


def restore_dtypes(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Cast the int group back to long (dropping fractions) and the float group to double."""
    casts = {c: q(c).cast("long") for c in groups["int"]} | {c: q(c).cast("double") for c in groups["float"]}
    return df.withColumns({c: e for c, e in casts.items() if c in df.columns})
