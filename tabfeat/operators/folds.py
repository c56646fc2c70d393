"""Hold-out split, contiguous folds and regression metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabfeat.functions.columns import q
from tabfeat.operators.ranks import BUCKET_ROWS, row_number


def holdout_split(df: DataFrame, key: Sequence[str], seed: int = 0, train_share: int = 75) -> DataFrame:
    """Add ``is_train`` from a hash of the key: the same for every partitioning of the table."""
    drawn = F.pmod(F.xxhash64(*[q(c) for c in key], F.lit(seed)), F.lit(100))
    return df.withColumn("is_train", drawn < train_share)


def holdout_split_arithmetic(df: DataFrame, key: str, multiplier: int = 7919, train_share: int = 75) -> DataFrame:
    """Hold-out split by modular arithmetic on an integral key, reproducible in any engine."""
    return df.withColumn("is_train", F.pmod(q(key) * multiplier, F.lit(100)) < train_share)


def fold_of(rn: Column, n: int, folds: int) -> Column:
    """Fold of the 0-based position: contiguous, the first ``n % folds`` folds one row larger."""
    size, extra = divmod(n, folds)
    edge = extra * (size + 1)
    late = F.floor((rn - edge) / F.lit(max(size, 1))) + extra
    return F.when(rn < edge, F.floor(rn / F.lit(size + 1))).otherwise(late).cast("int")


def kfold_assign(df: DataFrame, key: str, folds: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``fold`` 0..folds-1, unshuffled in the order of the unique numeric key."""
    n = df.count()
    numbered = row_number(df, key, bucket_rows, largest=n)
    return numbered.withColumn("fold", fold_of(F.col("rn"), n, folds)).drop("rn")


def metric_exprs(label: Column, prediction: Column) -> list[Column]:
    """R2 and RMSE on the log scale, MAE on the original scale, for rows with both values."""
    both = label.isNotNull() & prediction.isNotNull()
    y, p = F.when(both, label), F.when(both, prediction)
    sse = F.sum((y - p) * (y - p))
    return [
        F.count(y).alias("n"),
        F.when(F.var_pop(y) == 0, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(
            1 - F.try_divide(sse, F.var_pop(y) * F.count(y))).alias("r2"),
        F.avg(F.abs(F.exp(y) - F.exp(p))).alias("mae"),
        F.sqrt(F.try_divide(sse, F.count(y))).alias("rmse"),
    ]


def metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*[q(c) for c in by]).agg(*metric_exprs(q(label), q(prediction)))
