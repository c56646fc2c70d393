"""Query registry and the derived inputs shared by the bindings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabfeat.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a callable of ``load`` (table name -> DataFrame), with its SQL twin if there is one."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Round the double columns: the order of summation differs between engines."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), special.get(f.name, digits)) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def r(expr: str, digits: int = 4) -> str:
    """SQL twin of ``rounded``."""
    return f"(ROUND({expr}, {digits}) + 0.0)"


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


# The tables hold no missing values; both engines put them in the same places.


def lineitem_nulls(load) -> DataFrame:
    df = load("lineitem")
    gaps = {"l_quantity": 7, "l_tax": 11, "l_returnflag": 13}
    return df.withColumns({c: F.when(F.col("l_orderkey") % k != 0, F.col(c)) for c, k in gaps.items()})


LINEITEM_NULLS = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity, l_extendedprice, l_discount,
  CASE WHEN l_orderkey % 11 <> 0 THEN l_tax END AS l_tax,
  CASE WHEN l_orderkey % 13 <> 0 THEN l_returnflag END AS l_returnflag, l_linestatus, l_shipdate FROM lineitem)"""


def part_nulls(load) -> DataFrame:
    return load("part").withColumns({
        "p_size": F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")),
        "p_type": F.when(F.col("p_partkey") % 11 != 0, F.col("p_type")),
    })


PART_NULLS = """(SELECT p_partkey, p_name, p_brand, CASE WHEN p_partkey % 11 <> 0 THEN p_type END AS p_type,
  CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS p_size, p_retailprice FROM part)"""


def net_lineitem(load) -> DataFrame:
    """Line items with a target that the features explain: log1p of the net price."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return load("lineitem").withColumns({
        "net": net, "label": F.log1p(net), "log_price": F.log1p("l_extendedprice"), "fold": F.col("l_orderkey") % 4,
    })


NET_LINEITEM = """(SELECT *, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS net,
  ln(1 + l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS label, ln(1 + l_extendedprice) AS log_price,
  l_orderkey % 4 AS fold FROM lineitem)"""

NET_FEATURES = ["log_price", "l_discount", "l_tax", "l_quantity"]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
