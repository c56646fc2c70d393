"""Profiles (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabfeat.bindings.registry import LINEITEM_NULLS, NUMBERS, lineitem_nulls, query, r, rounded, union
from tabfeat.operators import profile

NULL_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("p1_describe", union(
    f"""SELECT '{c}' AS feature, count({c}) AS count, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std,
  {r(f'min({c})')} AS min, {r(f'quantile_cont({c}, 0.25)')} AS p25, {r(f'quantile_cont({c}, 0.5)')} AS p50,
  {r(f'quantile_cont({c}, 0.75)')} AS p75, {r(f'max({c})')} AS max FROM {LINEITEM_NULLS}""" for c in NUMBERS))
def describe(load):
    return rounded(profile.describe(lineitem_nulls(load), NUMBERS))


@query("p2_missing_profile", f"""SELECT feature, total, {r('total * 1.0 / n', 8)} AS percent FROM ({union(
    f"SELECT '{c}' AS feature, count(*) - count({c}) AS total, count(*) AS n FROM {LINEITEM_NULLS}" for c in NULL_COLUMNS)})
WHERE total > 0""")
def missing_profile(load):
    return rounded(profile.missing_profile(lineitem_nulls(load)), 8)


@query("p5_symmetry", union(
    f"""SELECT '{c}' AS feature, {r(f'skewness({c})')} AS skewness, {r(f'kurtosis({c})')} AS kurtosis
FROM {LINEITEM_NULLS}""" for c in NUMBERS))
def symmetry(load):
    return rounded(profile.symmetry(lineitem_nulls(load), NUMBERS))


@query("p6_duplicate_count", """SELECT count(*) AS duplicates FROM
(SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(*) > 1)""")
def duplicate_count(load):
    return profile.duplicate_count(load("lineitem"), "l_partkey")


ORDER_LEVELS = ["o_orderstatus", "o_orderpriority"]


@query("p7_value_counts", union(
    f"SELECT '{c}' AS variable, {c} AS value, count(*) AS n FROM orders GROUP BY {c}" for c in ORDER_LEVELS))
def value_counts(load):
    return profile.value_counts(load("orders"), ORDER_LEVELS)


def _histogram_sql(column, table, bins):
    return f"""SELECT '{column}' AS variable, bin, {r('min(lo + bin * w)')} AS left_edge, count(*) AS n FROM (
  SELECT lo, w, CAST(least(floor(({column} - lo) / w), k - 1) AS BIGINT) AS bin FROM {table},
  (SELECT lo, k, (hi - lo) / k AS w FROM (SELECT min({column}) AS lo, max({column}) AS hi, {bins} AS k FROM {table})))
GROUP BY bin"""


FD_BINS = """greatest(1, least(50, ceil((max(value) - min(value)) /
  (2 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / pow(count(*), 1.0 / 3)))))"""


@query("p8_histogram_fixed", union([_histogram_sql("l_extendedprice", "lineitem", 10), _histogram_sql("l_quantity", "lineitem", 10)]))
def histogram_fixed(load):
    return rounded(profile.histogram(load("lineitem"), ["l_extendedprice", "l_quantity"], bins=10))


@query("p8_histogram", _histogram_sql("value", "events", FD_BINS))
def histogram(load):
    return rounded(profile.histogram(load("events"), ["value"]))


@query("p9_box_summary", union(
    f"""SELECT '{c}' AS variable, {c} AS value, count(*) AS n, {r('any_value(q1)')} AS q1,
  {r('any_value(median)')} AS median, {r('any_value(q3)')} AS q3,
  {r('min(CASE WHEN inside THEN y END)')} AS whisker_low, {r('max(CASE WHEN inside THEN y END)')} AS whisker_high,
  count(*) FILTER (NOT inside) AS outliers
FROM (SELECT {c}, l_extendedprice AS y, q1, median, q3,
  l_extendedprice >= q1 - 1.5 * (q3 - q1) AND l_extendedprice <= q3 + 1.5 * (q3 - q1) AS inside
  FROM lineitem JOIN (SELECT {c}, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
    quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY {c}) USING ({c}))
GROUP BY {c}""" for c in ("l_returnflag", "l_linestatus")))
def box_summary(load):
    return rounded(profile.box_summary(load("lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"]))


@query("p10_group_mean_curve", union(
    f"""SELECT '{c}' AS variable, CAST({e} AS VARCHAR) AS value, {r('avg(o_totalprice)')} AS mean_target
FROM orders GROUP BY {e}""" for c, e in (("o_orderstatus", "o_orderstatus"), ("year", "year(o_orderdate)"))))
def group_mean_curve(load):
    orders = load("orders").withColumn("year", F.year("o_orderdate"))
    return rounded(profile.group_mean_curve(orders, "o_totalprice", ["o_orderstatus", "year"]))


@query("p11_price_segments", union(
    f"""SELECT '{c}' AS feature, {r('(high - low) / low', 6)} AS difference FROM (SELECT
  avg(coalesce({c}, 0)) FILTER (l_extendedprice >= 50000) AS high,
  avg(coalesce({c}, 0)) FILTER (l_extendedprice < 50000) AS low FROM {LINEITEM_NULLS})"""
    for c in ("l_quantity", "l_discount", "l_tax")))
def price_segments(load):
    return rounded(profile.segment_difference(
        lineitem_nulls(load), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], 50000), 6)


def normal_cdf_sql(z: str) -> str:
    """Normal distribution function by the Abramowitz-Stegun polynomial, absolute error below 1e-7."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    tail = (f"exp(-({z}) * ({z}) / 2) * 0.3989422804014327 * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * "
            f"(1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))")
    return f"(CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END)"


# one more than the value, which may be zero
AMOUNTS = "(SELECT value + 1 AS value FROM events)"


def _amounts(load):
    return load("events").select((F.col("value") + 1).alias("value"))


def _ks_sql(name, z):
    return f"""SELECT '{name}' AS distribution, {r('max(greatest(abs(f - below), abs(upto - f)))')} AS ks FROM (
  SELECT {normal_cdf_sql('z')} AS f, below, upto FROM (SELECT {z} AS z, (cum - w) * 1.0 / n AS below, cum * 1.0 / n AS upto
    FROM (SELECT value, w, sum(w) OVER (ORDER BY value) AS cum FROM (SELECT value, count(*) AS w FROM {AMOUNTS} GROUP BY value)),
    (SELECT count(*) AS n, avg(value) AS m, stddev_pop(value) AS s, avg(ln(value)) AS lm, stddev_pop(ln(value)) AS ls FROM {AMOUNTS})))"""


@query("p12_distribution_fit", union([_ks_sql("normal", "(value - m) / s"), _ks_sql("lognormal", "(ln(value) - lm) / ls")]))
def distribution_fit(load):
    return rounded(profile.distribution_fit(_amounts(load), "value").where("distribution <> 'johnson_su'"))


@query("p12_johnson_fit")
def johnson_fit(load):
    """All three distances; the Johnson parameters come from an iterative fit."""
    return rounded(profile.distribution_fit(_amounts(load), "value"))
