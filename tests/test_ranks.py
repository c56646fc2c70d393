"""The distributed paths must give what the plain ones give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabfeat.operators import ranks
from tabfeat.operators.folds import kfold_assign


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(0)
    n = 6000
    x = np.round(rng.lognormal(3, 1.5, n), 2)
    x[: n // 3] = 7.0  # one value holds a third of the rows
    x[n // 3: n // 3 + 3] = [np.inf, -np.inf, np.nan]
    g = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n))
    pdf = pd.DataFrame({"id": rng.permutation(n), "x": x, "y": rng.integers(0, 500, n).astype(float), "g": g})
    return spark.createDataFrame(pdf).repartition(5).cache(), pdf


PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("limit", [10, 300, 10**6])
def test_exact_quantiles_match_numpy(skewed, limit):
    df, pdf = skewed
    got = ranks.exact_quantiles(df.where("x < 'Infinity' and x > '-Infinity'"), ["x", "y"], PROBS, limit)
    clean = pdf[np.isfinite(pdf["x"])]
    assert np.allclose(got["x"], np.quantile(clean["x"], PROBS))
    assert np.allclose(got["y"], np.quantile(clean["y"], PROBS))


def test_exact_quantiles_with_infinite_values(skewed):
    df, pdf = skewed
    got = ranks.exact_quantiles(df, ["x"], [0.0, 0.5, 1.0], 100)["x"]
    assert got == [-np.inf, float(np.nanquantile(pdf["x"], 0.5)), np.inf]


def test_exact_quantiles_many_probs_and_empty(spark, skewed):
    df, pdf = skewed
    probs = [i / 40 for i in range(41)]
    assert np.allclose(ranks.exact_quantiles(df, ["y"], probs, 200)["y"], np.quantile(pdf["y"], probs))
    empty = spark.createDataFrame([(None,)], "x double")
    assert ranks.exact_quantiles(empty, ["x"], [0.5]) == {"x": [None]}


def test_many_quantiles_in_a_small_plan(skewed, monkeypatch):
    """Plans of a literal or more for each wanted rank took all memory of the driver."""
    df, pdf = skewed
    probs, lit, made = [i / 999 for i in range(1000)], F.lit, []
    monkeypatch.setattr(ranks.F, "lit", lambda value: made.append(1) or lit(value))
    got = ranks.exact_quantiles(df, ["x", "y"], probs, 100)
    assert len(made) < 300
    assert np.allclose(got["y"], np.quantile(pdf["y"].dropna(), probs))
    values = np.sort(pdf["x"].dropna().to_numpy())
    at = np.array(probs) * (len(values) - 1)
    low, high = values[np.floor(at).astype(int)], values[np.ceil(at).astype(int)]
    same = low == high
    assert (np.array(got["x"])[same] == low[same]).all() and np.isinf(low[same]).any()
    inside = np.isfinite(low) & np.isfinite(high)
    assert np.allclose(np.array(got["x"])[inside], (low + (high - low) * (at - np.floor(at)))[inside])


def test_exact_quantiles_constant_column(spark):
    df = spark.range(500).select(F.lit(3.0).alias("x"))
    assert ranks.exact_quantiles(df, ["x"], [0.25, 0.5], 10)["x"] == [3.0, 3.0]


@pytest.mark.parametrize("rows", [100, 700])
@pytest.mark.parametrize("keys", [(), ("g",)])
def test_add_rank_buckets(skewed, rows, keys):
    df, pdf = skewed
    part = df.where("x < 'Infinity' and x > '-Infinity'")
    got = ranks.add_rank(part, "x", keys, salt=["id"], bucket_rows=rows).toPandas().set_index("id").sort_index()
    clean = pdf[np.isfinite(pdf["x"])].set_index("id").sort_index()
    col = clean.groupby("g")["x"] if keys else clean["x"]
    low, high = col.rank(method="min"), col.rank(method="max")
    assert (got["x_before"] == low - 1).all()
    assert (got["x_ties"] == high - low + 1).all()


def test_add_rank_spreads_a_frequent_value(skewed):
    df, _ = skewed
    part = df.where("x < 'Infinity' and x > '-Infinity'")
    plan = ranks.add_rank(part, "x", salt=["id"], bucket_rows=200)._jdf.queryExecution().toString()
    assert "_salt" in plan and "_bucket" in plan


def test_add_rank_weighted(spark):
    df = spark.createDataFrame([(float(i % 50), i % 7 + 1, i) for i in range(1000)], "x double, w long, id long")
    plain = ranks.add_rank(df, "x", weight="w").select("id", "x_before", "x_ties").toPandas().set_index("id").sort_index()
    cut = ranks.add_rank(df, "x", weight="w", salt=["id"], bucket_rows=90).select("id", "x_before", "x_ties")
    assert plain.equals(cut.toPandas().set_index("id").sort_index())


@pytest.mark.parametrize("limit", [150, 10**6])
def test_grouped_quantiles(skewed, limit):
    df, pdf = skewed
    got = {r["g"]: r["quantiles"] for r in ranks.grouped_quantiles(df, ["g"], "y", PROBS, limit).collect()}
    for g, part in pdf.groupby("g"):
        assert np.allclose(got[g], np.quantile(part["y"], PROBS)), g


@pytest.mark.parametrize("n,bucket", [(10, 10**6), (10, 3), (4003, 500), (2, 10)])
def test_kfold_sizes_and_contiguity(spark, n, bucket):
    df = spark.range(n).select((F.col("id") * 3 + 5).alias("id")).repartition(3)
    rows = sorted((r["id"], r["fold"]) for r in kfold_assign(df, "id", 4, bucket).collect())
    folds = [f for _, f in rows]
    assert folds == sorted(folds)
    assert folds == [f for f, part in enumerate(np.array_split(np.arange(n), 4)) for _ in part]


def test_ranks_of_large_integer_keys(spark):
    base = 2**60
    df = spark.range(1000).select((F.col("id") + base).alias("id"))
    got = ranks.row_number(df, "id", bucket_rows=90).orderBy("id").toPandas()
    assert (got["rn"] == np.arange(1000)).all()
