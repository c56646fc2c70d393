"""Shapiro-Wilk test of many columns at any number of rows.

The statistic weighs the order statistics with normal scores. Values are counted and ranked in buckets, so a value knows the
span of ranks that it holds; spans are cut into pieces of bounded length, dealt out, and every rank adds its score once. Only
the two smallest and largest values of a column, which have weights of their own, and its sums come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfeat.functions.columns import numeric, probit
from tabfeat.functions.tails import normal_two_sided
from tabfeat.operators.profile import melt
from tabfeat.operators.ranks import add_rank
from tabfeat.session import cut_lineage

#: Ranks that one row of the dealt spans stands for.
SPAN = 10_000

# Royston's polynomials (1995), lowest power first: weights of the largest and second value by 1 / sqrt(n); mean
# and log deviation of the transformed statistic by n up to 11, and by ln n beyond; the shift of the small form.
LARGEST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_MEAN = (0.5440, -0.39978, 0.025054, -6.714e-4)
SMALL_DEVIATION = (1.3822, -0.77857, 0.062767, -0.0020322)
MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
DEVIATION = (-0.4803, -0.082676, 0.0030302)
SHIFT = (-2.273, 0.459)
SMALL = 11


def _poly(coefficients: Sequence[float], x: float) -> float:
    return sum(c * x ** i for i, c in enumerate(coefficients))


def statistic(n: int, projection: float, squares: float, scores: float, ends: Sequence[float], end_scores: Sequence[float]) -> float:
    """W of n values from the sum of score times centred value, the sum of squares of centred values and of scores, the centred
    values of ranks 1, 2, n - 1, n, and the scores of ranks n - 1 and n."""
    if squares <= 0:
        return 1.0
    second, last = end_scores
    if n == 3:
        return min(1.0, (math.sqrt(0.5) * (ends[3] - ends[0])) ** 2 / squares)
    a_last = _poly(LARGEST, 1 / math.sqrt(n)) + last / math.sqrt(scores)
    if n <= 5:
        rest = math.sqrt((scores - 2 * last ** 2) / (1 - 2 * a_last ** 2))
        inner, outer = projection - last * (ends[3] - ends[0]), a_last * (ends[3] - ends[0])
    else:
        a_second = _poly(SECOND, 1 / math.sqrt(n)) + second / math.sqrt(scores)
        rest = math.sqrt((scores - 2 * last ** 2 - 2 * second ** 2) / (1 - 2 * a_last ** 2 - 2 * a_second ** 2))
        inner = projection - last * (ends[3] - ends[0]) - second * (ends[2] - ends[1])
        outer = a_last * (ends[3] - ends[0]) + a_second * (ends[2] - ends[1])
    return min(1.0, (inner / rest + outer) ** 2 / squares)


def deviate(n: int, w: float) -> float:
    """The normal deviate of W: large when the values are not normal."""
    if w >= 1:
        return -math.inf
    if n <= SMALL:
        gap = _poly(SHIFT, n) - math.log1p(-w)
        return math.inf if gap <= 0 else (-math.log(gap) - _poly(SMALL_MEAN, n)) / math.exp(_poly(SMALL_DEVIATION, n))
    return (math.log1p(-w) - _poly(MEAN, math.log(n))) / math.exp(_poly(DEVIATION, math.log(n)))


def p_value(n: int, w: float) -> float:
    if w >= 1:
        return 1.0
    if n == 3:
        return min(1.0, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    z = deviate(n, w)
    return normal_two_sided(z) / 2 if z > 0 else 1 - normal_two_sided(z) / 2


def shapiro_wilk(df: DataFrame, features: Sequence[str], alpha: float = 0.01, span: int = SPAN, **rank) -> DataFrame:
    """feature, n, w, z, p and rejected (p < alpha) of every column; missing values count as 0.

    A constant column has W 1. Fewer than three rows have no statistic and are not rejected.
    """
    spark = df.sparkSession
    whole = df.select(*[F.coalesce(numeric(df, f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    sums = whole.agg(F.count(F.lit(1)).alias("n"), *[e for i, f in enumerate(features) for e in (
        F.avg(F.col(f"`{f}`")).alias(f"m{i}"), F.var_pop(F.col(f"`{f}`")).alias(f"v{i}"))]).first()
    n = sums["n"]
    if n < 3:
        return spark.createDataFrame([(f, n, None, None, None, 0) for f in features], "feature string, n long, w double, z double, p double, rejected int")
    means = F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(f), F.lit(sums[f"m{i}"]))])
    counted = melt(whole, [], features, "double").groupBy("variable", "value").agg(F.count(F.lit(1)).alias("_w"))
    ranked = cut_lineage(add_rank(counted, "value", ["variable"], weight="_w", **rank).select(
        "variable", (F.col("value") - means[F.col("variable")]).alias("x"), F.col("value_before").cast("long").alias("lo"),
        (F.col("value_before") + F.col("value_ties")).cast("long").alias("hi")))
    ends = {}
    outer = [0, 1, n - 2, n - 1]
    for r in ranked.where((F.col("lo") <= 1) | (F.col("hi") >= n - 1)).collect():  # four rows a column at most
        for k in outer:
            if r["lo"] <= k < r["hi"]:
                ends[r["variable"], k] = r["x"]
    start = F.explode(F.sequence(F.col("lo"), F.col("hi") - 1, F.lit(span).cast("long")))
    spans = ranked.withColumn("at", start).select("variable", "x", "at", F.least(F.col("at") + span, "hi").alias("to")).repartition("variable", "at")
    score = probit((F.col("i") + 0.625) / (n + 0.25))
    scored = spans.withColumn("i", F.explode(F.sequence(F.col("at"), F.col("to") - 1))).select("variable", "x", score.alias("m"))
    found = {r["variable"]: r for r in scored.groupBy("variable").agg(F.sum(F.col("m") * F.col("x")).alias("p"), F.sum(F.col("m") * F.col("m")).alias("s")).collect()}
    last = spark.range(1).select(*[probit(F.lit((n - k - 0.375) / (n + 0.25))) for k in (1, 0)]).first()
    rows = []
    for i, f in enumerate(features):
        w = statistic(n, found[f]["p"], sums[f"v{i}"] * n, found[f]["s"], [ends[f, k] for k in outer], last)
        p = p_value(n, w)
        rows.append((f, n, w, deviate(n, w), p, int(p < alpha)))
    return spark.createDataFrame(rows, "feature string, n long, w double, z double, p double, rejected int")
