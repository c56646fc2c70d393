"""Shapiro-Wilk against published values and a plain computation."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabfeat.operators.normality import LARGEST, SECOND, p_value, shapiro_wilk

# Samples with their published W and p.
FIRST = ([0.11, 7.87, 4.61, 10.14, 7.95, 3.14, 0.46, 4.43, 0.21, 4.75, 0.71, 1.52, 3.24, 0.93, 0.42, 4.97, 9.53, 4.55, 0.47, 6.66], 0.90047, 0.042089)
SECOND_ = ([1.36, 1.14, 2.92, 2.55, 1.46, 1.06, 5.27, -1.11, 3.48, 1.10, 0.88, -0.51, 1.46, 0.52, 6.20, 1.69, 0.08, 3.67, 2.81, 3.49], 0.95903, 0.52460)
WEIGHTS = ([148.0, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], 0.78881, 0.006704)


def plain(values):
    x, n = np.sort(np.asarray(values, float)), len(values)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    a = m / math.sqrt((m ** 2).sum())
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    else:
        u = 1 / math.sqrt(n)
        fixed = 1 if n <= 5 else 2
        for k, c in list(enumerate((LARGEST, SECOND)))[:fixed]:
            a[n - 1 - k] = sum(v * u ** i for i, v in enumerate(c)) + m[n - 1 - k] / math.sqrt((m ** 2).sum())
            a[k] = -a[n - 1 - k]
        inner = slice(fixed, n - fixed)
        a[inner] = m[inner] * math.sqrt((1 - 2 * (a[-fixed:] ** 2).sum()) / (m[inner] ** 2).sum()) if n > 2 * fixed and (m[inner] ** 2).sum() else 0
    return (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()


@pytest.mark.parametrize("values, w, p", [FIRST, SECOND_, WEIGHTS])
def test_published_values(spark, values, w, p):
    r = shapiro_wilk(spark.createDataFrame([(float(v),) for v in values], "x double"), ["x"]).first()
    assert (r["n"], r["w"], r["p"]) == (len(values), pytest.approx(w, abs=2e-5), pytest.approx(p, abs=2e-4))
    assert r["rejected"] == (p < 0.01)


@pytest.mark.parametrize("n", [3, 4, 5, 6, 11, 12, 50])
def test_against_plain_weights(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.exponential(size=n), 1 if n > 20 else 6)
    r = shapiro_wilk(spark.createDataFrame([(float(v),) for v in values], "x double").repartition(3), ["x"]).first()
    assert r["w"] == pytest.approx(plain(values), abs=1e-7) and r["p"] == pytest.approx(p_value(n, plain(values)), abs=1e-5)


def test_many_ties_short_spans_and_buckets(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.zeros(700), np.round(rng.normal(size=1300), 2)])
    df = spark.createDataFrame([(float(v), None if i % 5 == 0 else float(v)) for i, v in enumerate(values)], "a double, b double").repartition(4)
    got = {r["feature"]: r["w"] for r in shapiro_wilk(df, ["a", "b"], span=7, bucket_rows=50).collect()}
    assert got["a"] == pytest.approx(plain(values), abs=1e-7)
    assert got["b"] == pytest.approx(plain([0.0 if i % 5 == 0 else v for i, v in enumerate(values)]), abs=1e-7)


def test_constant_few_rows_and_shifted_columns(spark):
    df = spark.range(40).select(F.lit(5.0).alias("c"), (F.col("id") * F.col("id") + 1e9).alias("far"))
    got = {r["feature"]: r for r in shapiro_wilk(df, ["c", "far"]).collect()}
    assert got["c"]["w"] == 1 and got["c"]["rejected"] == 0
    assert got["far"]["w"] == pytest.approx(plain([i * i for i in range(40)]), abs=1e-6)
    few = shapiro_wilk(df.limit(2), ["c"]).first()
    assert few["w"] is None and few["rejected"] == 0
