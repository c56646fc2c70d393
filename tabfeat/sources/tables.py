"""Input tables and the prediction sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabfeat.functions.columns import q
from tabfeat.operators.reshape import append_rows, tag_split

# Spellings of a missing value in a text file. 'None' is a level, not a missing value.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
             "NA", "NULL", "NaN", "n/a", "nan", "null"]


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Headered CSV with a given schema; every usual spelling of a missing value becomes NULL.

    Columns are read as text and cast, since Spark's reader knows one spelling only.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.schema(text).option("header", True).option("escape", '"').csv(path)
    return raw.select(*[
        F.when(~q(f.name).isin(NA_TOKENS), q(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields
    ])


def load_inputs(
    train: DataFrame, test: DataFrame, extension: DataFrame | None = None, pseudo: DataFrame | None = None
) -> DataFrame:
    """One table of all rows with their origin in ``_split``; the optional inputs join the training side."""
    parts = [tag_split(train, "train")]
    parts += [tag_split(df, name) for df, name in ((pseudo, "pseudo"), (extension, "ext")) if df is not None]
    return append_rows(*parts, tag_split(test, "test"))


def training_rows() -> Column:
    return F.col("_split") != "test"


def predictions_of(scored: DataFrame, key: str, prediction: str = "prediction", out: str = "SalePrice") -> DataFrame:
    """Key and the prediction back on the original scale."""
    return scored.select(q(key), F.expm1(q(prediction)).alias(out))


def write_table(df: DataFrame, path: str) -> None:
    """Headered CSV with doubled quotes, written by the executors."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_predictions(scored: DataFrame, path: str, key: str, prediction: str = "prediction", out: str = "SalePrice") -> None:
    """CSV of (key, expm1(prediction))."""
    write_table(predictions_of(scored, key, prediction, out), path)
