"""Keeping the input of an algorithm that reads it many times."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """The frame cached for the duration of the block, its rows dealt and ordered by a hash of their values.

    Spark ML draws rows per partition and in their order. Dealt like this, over
    ``spark.sql.shuffle.partitions``, a fit depends neither on the cores nor on
    how the input was partitioned.
    """
    values = [vector_to_array(f"`{f.name}`") if f.dataType.typeName() == "vectorudt" else F.col(f"`{f.name}`") for f in df.schema.fields]
    place = F.xxhash64(*values)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cached = df.repartition(parts, place).sortWithinPartitions(place).persist()
    try:
        yield cached
    finally:
        cached.unpersist()
