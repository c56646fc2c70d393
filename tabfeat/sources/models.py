"""Keeping fitted models."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import SparkSession

from tabfeat.operators.linear import LinearModel


def model_name(family: str, when: datetime | None = None) -> str:
    """``<family>_<time>``."""
    when = when or datetime.now(timezone.utc)
    return f"{family}_{when:%Y-%m-%d-%H-%M-%S}"


def save_model(spark: SparkSession, model, folder: str, family: str) -> str:
    """Linear models as a parquet table of coefficients, Spark ML models in their own format."""
    path = f"{folder}/{model_name(family)}"
    if isinstance(model, LinearModel):
        model.save(spark, path)
    else:
        model.write().overwrite().save(path)
    return path


def load_model(spark: SparkSession, path: str, kind=LinearModel):
    """``kind`` is LinearModel or the Spark ML model class."""
    return LinearModel.load(spark, path) if kind is LinearModel else kind.load(path)
