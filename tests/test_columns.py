"""Predicates, derived features, imputing, recoding, encoding, scaling, transforms."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tabfeat.functions.columns import hat_basis, right_closed_bin
from tabfeat.operators import derive, encode, impute, predicates, recode, scale, transforms
from tabfeat.operators.impute import ImputeRule, Imputer


def column(df, name, key="id"):
    return [r[name] for r in df.orderBy(key).collect()]


def test_masks_treat_missing_as_false(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id long, q long")
    low = predicates.low_quality("q", 6)
    assert column(df.withColumn("m", low), "m") == [True, False, False]
    outside, inside = predicates.two_segments(df, low)
    assert (outside.count(), inside.count()) == (2, 1)


def test_drop_by_key_keeps_missing_keys_and_takes_long_lists(spark):
    df = spark.createDataFrame([(i,) for i in [*range(1500), None]], "id long")
    assert predicates.drop_by_key(df, "id", [1, 2, 9999]).count() == 1499
    assert predicates.drop_by_key(df, "id", list(range(1200))).count() == 301


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(y,) for y in (1850, 1851, 1950, 1951, 2025, 2026, None)], "id long")
    got = {r["id"]: r["b"] for r in df.select("id", right_closed_bin(F.col("id"), [1850, 1950, 1975, 2000, 2025]).alias("b")).collect()}
    assert got == {1850: None, 1851: "(1850, 1950]", 1950: "(1850, 1950]", 1951: "(1950, 1975]",
                   2025: "(2000, 2025]", 2026: None, None: None}


def test_season_default_is_july(spark):
    df = spark.range(1, 13)
    assert column(df.withColumn("s", derive.season_flag(F.col("id"))), "s") == [1 if m == 7 else 0 for m in range(1, 13)]


def test_hat_basis_sums_to_one_with_left_out_function(spark):
    knots = [0.0, 1.0, 4.0, 10.0]
    df = spark.range(0, 101).select((F.col("id") / 10).alias("x"))
    pdf = df.select("x", *[b.alias(f"b{i}") for i, b in enumerate(hat_basis(F.col("x"), knots))]).toPandas()
    first = np.clip(1 - pdf["x"], 0, 1)
    assert np.allclose(pdf[["b0", "b1", "b2"]].sum(axis=1) + first, 1)


def test_model_matrix_keeps_knots_and_missing_values(spark):
    train = spark.createDataFrame([(float(i % 4),) for i in range(40)], "x double")
    fitted = derive.ModelMatrix("y", splines={"x": 7}).fit(train)
    assert fitted.knots["x"] == sorted(set(fitted.knots["x"]))
    new = spark.createDataFrame([(None,), (99.0,)], "x double")
    rows = fitted.transform(new).collect()
    assert rows[0][1] is None and rows[1][-1] == 1.0


def test_group_pc1_sign_and_centre(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=300)
    pdf = pd.DataFrame({"id": range(300), "a": a, "b": -2 * a + rng.normal(size=300) * 0.1, "c": rng.normal(size=300)})
    out = derive.group_pc1(spark.createDataFrame(pdf), {"p": ["a", "b", "c"], "q": ["a", "c"]}).toPandas()
    x = pdf[["a", "b", "c"]].to_numpy()
    v = np.linalg.svd(x - x.mean(0))[2][0]
    v = v * np.sign(v[np.abs(v).argmax()])
    assert np.allclose(out.sort_values("id")["p"], (x - x.mean(0)) @ v)


def test_mode_ties_take_the_lowest_level(spark):
    df = spark.createDataFrame([("b", 3), ("a", 1), ("b", 1), ("a", 3), (None, None)], "s string, k int")
    assert impute.column_modes(df, ["s", "k"]) == {"s": "a", "k": 1}


def test_imputer_orders_columns_and_fits_apart(spark):
    train = spark.createDataFrame([(1, 2.0, "a", None), (2, 4.0, "a", 5), (3, None, None, 6)], "id long, x double, s string, k long")
    rules = [ImputeRule("z", "constant", 0, ["k"]), ImputeRule("m", "mean", None, ["x"]), ImputeRule("f", "most_frequent", None, ["s"]),
             ImputeRule("none", "constant", "None", [])]
    fitted = Imputer(rules, ["id"]).fit(train)
    new = spark.createDataFrame([(9, float("nan"), None, None)], "id long, x double, s string, k long")
    out = fitted.transform(new)
    assert out.columns == ["id", "k", "x", "s"]
    assert tuple(out.first()) == (9, 0, 3.0, "a")


def test_mean_of_times(spark):
    df = spark.sql("select timestamp_ntz'2020-01-01 00:00:00' t union all select timestamp_ntz'2020-01-03 00:00:00' union all select null")
    out = Imputer([ImputeRule("d", "mean", None, ["t"])]).fit(df).transform(df)
    assert sorted(str(r["t"]) for r in out.collect())[1] == "2020-01-02 00:00:00"


def test_plans_cover_every_group():
    groups = {"numeric": ["n"], "categorical": ["c", "PoolQC", "MSZoning"], "datetime": ["d"]}
    tailored = {r.name: list(r.columns) for r in impute.tailored_plan(groups, ["PoolQC", "absent"], ["MSZoning"])}
    assert tailored["cat_nan_none"] == ["PoolQC"] and tailored["cat_nan_miss"] == ["c"] and tailored["nan_most"] == ["MSZoning"]
    assert [r.how for r in impute.base_plan(groups)] == ["constant", "mean", "constant", "constant", "most_frequent", "mean"]


def test_recode_is_sequential(spark):
    rules = [(["a"], "b"), (["b"], "c")]
    assert recode.compose(rules) == {"a": "c", "b": "c"}
    df = spark.createDataFrame([(1, "a", 2), (2, "b", 3), (3, "x", 4), (4, None, None)], "id long, s string, k int")
    out = recode.recode_levels(df, {("s", "gone"): rules, "k": [([2, 3], 1)]})
    assert column(out, "s") == ["c", "c", "x", None] and column(out, "k") == [1, 1, 4, None]
    # integer levels never match a text column
    assert column(recode.recode_levels(df, {"s": [([1, 2], 9)]}), "s") == ["a", "b", "x", None]


def test_ordinal_unknown_and_missing(spark):
    df = spark.createDataFrame([(1, "lo"), (2, "hi"), (3, "??"), (4, None)], "id long, s string")
    assert column(encode.ordinal_encode(df, {"s": ["lo", "hi"]}, unknown="null"), "s") == [0.0, 1.0, None, None]
    for bad in ("id = 3", "id = 4"):
        with pytest.raises(PySparkException):
            encode.ordinal_encode(df.where(bad), {"s": ["lo", "hi"]}).collect()


def test_onehot_levels_missing_and_limit(spark):
    df = spark.createDataFrame([(1, "b", 7), (2, "a", 8), (3, None, 9)], "id long, s string, k long")
    out = encode.OneHot(["s", "k", "s"]).fit(df).transform(df, ["id"])
    assert out.columns == ["id", "k", "s_a", "s_b"]
    assert [tuple(r)[2:] for r in out.orderBy("id").collect()] == [(0, 1), (1, 0), (0, 0)]
    with pytest.raises(ValueError):
        encode.OneHot(["s"], max_dummies=1).fit(df)
    sparse = encode.onehot_vector(df.dropna(), "s", "v").transform(df.dropna())
    assert [r["v"].toArray().tolist() for r in sparse.orderBy("s").collect()] == [[1, 0], [0, 1]]


def test_appearance_encoding(spark):
    df = spark.createDataFrame([(3, "x", 1.0), (1, "z", 5.0), (2, None, 2.0), (4, "z", 7.0)], "id long, s string, y double")
    assert column(encode.appearance_encode(df, ["s"], "id"), "s_E") == [1, None, 2, 1]
    by_mean = encode.appearance_encode(df, ["s"], "id", order_by="target_mean", target="y")
    assert column(by_mean, "s_E") == [2, None, 1, 2]


def test_scalers_on_constants_and_moments(spark):
    df = spark.createDataFrame([(float(i), 5.0) for i in range(10)], "x double, c double")
    plan = {how: ["x", "c"] for how in ("standard",)}
    out = scale.Scaler(plan).fit(df).transform(df).toPandas()
    assert abs(out["x"].mean()) < 1e-12 and math.isclose(out["x"].std(ddof=0), 1)
    for how in ("standard", "minmax", "robust"):
        got = scale.Scaler({how: ["c"]}).fit(df).transform(df).toPandas()["c"]
        assert (got == 0).all()
    assert (scale.Scaler({"maxabs": ["c"]}).fit(df).transform(df).toPandas()["c"] == 1).all()


def test_row_normalize_zero_row(spark):
    df = spark.createDataFrame([(1, 3.0, 4.0), (2, 0.0, 0.0)], "id long, a double, b double")
    out = scale.row_normalize(df, ["a", "b"])
    assert column(out, "a_unit") == [0.6, 0.0] and column(out, "b_unit") == [0.8, 0.0]


def test_log_branch_is_remembered(spark):
    df = spark.createDataFrame([(1, 2.0, 0.0), (2, 8.0, 3.0)], "id long, a double, b double")
    fitted = transforms.fit_log(df, ["a", "b"])
    assert fitted.plain == {"a": True, "b": False}
    out = fitted.transform(df)
    back = out.select("id", fitted.inverse(F.col("a_log"), "a").alias("a"), fitted.inverse(F.col("b_log"), "b").alias("b"))
    assert np.allclose(column(back, "a"), [2, 8]) and np.allclose(column(back, "b"), [0, 3])


def _yeo_likelihood(x, lam):
    up, down = x >= 0, x < 0
    t = np.empty_like(x)
    t[up] = np.log1p(x[up]) if lam == 0 else ((x[up] + 1) ** lam - 1) / lam
    t[down] = -np.log1p(-x[down]) if lam == 2 else -((1 - x[down]) ** (2 - lam) - 1) / (2 - lam)
    return -len(x) / 2 * np.log(t.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()


def test_power_lambda_is_the_likelihood_maximum(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"x": rng.gamma(2, 3, 800) - 2, "p": rng.lognormal(0, 0.7, 800), "c": np.ones(800)})
    df = spark.createDataFrame(pdf)
    fitted = transforms.fit_power(df, ["x", "c"])
    grid = np.linspace(fitted["x"].lam - 0.05, fitted["x"].lam + 0.05, 101)
    best = grid[np.argmax([_yeo_likelihood(pdf["x"].to_numpy(), g) for g in grid])]
    assert abs(best - fitted["x"].lam) < 3e-3
    assert fitted["c"].lam == 1.0
    z = df.select(fitted["x"].apply(F.col("x")).alias("z")).toPandas()["z"]
    assert abs(z.mean()) < 1e-9 and math.isclose(z.std(ddof=0), 1)
    assert abs(transforms.fit_power(df, ["p"], "box-cox")["p"].lam) < 0.1
    with pytest.raises(ValueError):
        transforms.fit_power(df, ["x"], "box-cox")


def test_johnson_recovers_parameters_and_inverts(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=20000)
    x = 10 + 4 * np.sinh((z - 0.8) / 1.6)
    df = spark.createDataFrame(pd.DataFrame({"id": range(20000), "x": x}))
    j = transforms.fit_johnson(df, ["x"])["x"]
    assert abs(j.gamma - 0.8) < 0.1 and abs(j.eta - 1.6) < 0.1 and abs(j.epsilon - 10) < 0.3 and abs(j.lam - 4) < 0.4
    out = transforms.johnson_features(df, {"x": j}).withColumn("back", j.invert(F.col("x_john"))).toPandas()
    assert np.allclose(out["back"], out["x"])
    assert abs(out["x_john"].mean()) < 1e-6 and abs(out["x_john"].std(ddof=0) - 1) < 1e-6


def test_quantile_transform_ties_and_ends(spark):
    x = np.repeat([1.0, 2.0, 3.0, 10.0], [30, 40, 20, 10])
    df = spark.createDataFrame(pd.DataFrame({"id": range(100), "x": x}))
    fitted = transforms.fit_quantiles(df, ["x"])["x"]
    marks = np.asarray(fitted.marks)
    refs = np.linspace(0, 1, len(marks))
    want = 0.5 * (np.interp(x, marks, refs) - np.interp(-x, -marks[::-1], -refs[::-1]))
    want[x == 1] = 0
    want[x == 10] = 1
    assert np.allclose(column(df.withColumn("u", fitted.uniform(F.col("x"))), "u"), want)
    normal = column(df.withColumn("n", fitted.normal(F.col("x"))), "n")
    assert min(normal) == -transforms.NORMAL_BOUND and max(normal) == transforms.NORMAL_BOUND


def test_quantile_transform_by_ranks(spark, monkeypatch):
    """Many marks over a column too large for one buffer come from the distributed ranks."""
    from tabfeat.operators import ranks

    x = np.random.default_rng(6).gamma(2, 3, 3000).round(2)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    monkeypatch.setattr(ranks.exact_quantiles, "__defaults__", (200,))
    fitted = transforms.fit_quantiles(df, ["x"], marks=100)["x"]
    assert np.allclose(fitted.marks, np.quantile(x, np.linspace(0, 1, 100)))
