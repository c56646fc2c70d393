"""Lasso paths, weighted Huber regression, out-of-bag scores, consensus with shares and stop rules, fitted votes."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabfeat.operators import ensemble, linear
from tabfeat.operators.gram import moments
from tabfeat.operators.linear import descend, lasso_path, on_path

COLS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4))
    x[:, 3] = 0.9 * x[:, 0] + 0.2 * x[:, 3]  # correlated, so that coefficients leave and come back
    y = x @ np.array([1.5, -0.7, 0.2, -1.0]) + rng.normal(size=600) * 0.3 + 4
    pdf = pd.DataFrame(x, columns=COLS).assign(y=y, id=np.arange(600), fold=np.arange(600) % 4, w=rng.integers(1, 4, 600).astype(float))
    return spark.createDataFrame(pdf).repartition(4), pdf


@pytest.mark.parametrize("positive", [False, True])
@pytest.mark.parametrize("normalize", [False, True])
def test_path_is_coordinate_descent_at_and_between_knots(data, positive, normalize):
    m = moments(data[0], [*COLS, "y"])[None]
    knots = lasso_path(m, normalize=normalize, positive=positive)
    assert [k[0] for k in knots] == sorted((k[0] for k in knots), reverse=True) and knots[-1][0] == pytest.approx(0, abs=1e-9)
    assert not knots[0][1].any()
    alphas = [k[0] for k in knots] + [(u[0] + v[0]) / 2 for u, v in zip(knots, knots[1:])] + [2 * knots[0][0]]
    a, b = m.scatter[:4, :4], m.scatter[:4, 4]
    d = np.sqrt(np.diag(a)) if normalize else np.ones(4)
    for alpha in alphas:
        want = descend(a / np.outer(d, d), b / d, m.n * alpha, 0.0, positive, 100_000, 0.0) / d
        assert on_path(knots, alpha) == pytest.approx(want, abs=1e-6)


def test_path_of_many_columns_and_degenerate_ones(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12))
    x[:, 5] = 3.0  # constant
    y = x @ (rng.normal(size=12) * (rng.random(12) < 0.5)) + rng.normal(size=300)
    cols = [f"x{i}" for i in range(12)]
    m = moments(spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(y=y)), [*cols, "y"])[None]
    knots = lasso_path(m)
    for alpha, coef in knots:
        want = descend(m.scatter[:12, :12], m.scatter[:12, 12], m.n * alpha, 0.0, False, 200_000, 0.0)
        assert coef == pytest.approx(want, abs=1e-4) and coef[5] == 0
    flat = moments(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, y double"), ["a", "y"])[None]
    assert [k[1].tolist() for k in lasso_path(flat)] == [[0.0]]


def test_path_search_finds_the_best_penalty(data):
    found = linear.path_search(data[0], COLS, "y")
    board = found.board.collect()
    assert board[0]["alpha"] == pytest.approx(found.alpha) and board[0]["mean_mse"] == min(r["mean_mse"] for r in board)
    assert len(found.model.coef) == 4 and board[0]["mean_mse"] < 0.12


def huber_gradient(pdf, model, scale, epsilon, alpha):
    r = pdf["y"].to_numpy() - pdf[COLS].to_numpy() @ np.array(model.coef) - model.intercept
    w, z = pdf["w"].to_numpy(), None
    z = r / scale
    psi = np.where(np.abs(z) <= epsilon, 2 * z, 2 * epsilon * np.sign(z))
    by_scale = (w * np.where(np.abs(z) <= epsilon, 1 - z * z, 1 - epsilon ** 2)).sum()
    return np.array([*(-(w * psi) @ pdf[COLS].to_numpy() + 2 * alpha * np.array(model.coef)), -(w * psi).sum(), by_scale]) / w.sum()


def test_weighted_huber_is_stationary_and_ignores_outliers(data, spark):
    _, pdf = data
    dirty = pdf.copy()
    dirty.loc[:60, "y"] += 40
    df = spark.createDataFrame(dirty).repartition(3)
    found = linear.fit_weighted_huber(df, COLS, "y", "w", epsilon=1.5, alpha=0.5)
    assert found.gap <= 1e-8 and found.steps < 100
    assert np.abs(huber_gradient(dirty, found.model, found.scale, 1.5, 0.5)).max() < 1e-6
    assert np.allclose(found.model.coef, [1.5, -0.7, 0.2, -1.0], atol=0.25)
    with pytest.raises(ValueError):
        linear.fit_weighted_huber(df, COLS, "y", epsilon=0.9)


def test_replica_moments_are_weighted_sums(data):
    df, pdf = data
    weights = F.array(F.col("w"), F.lit(0.0), (F.col("id") % 3).cast("double"))
    got = ensemble.replica_moments(df, [*COLS, "y"], weights, 3)
    x = pdf[[*COLS, "y"]].to_numpy()
    for m, w in zip(got, (pdf["w"], pdf["w"] * 0, pdf["id"] % 3)):
        w = w.to_numpy(float)
        assert m.n == w.sum()
        if m.n:
            mean = np.average(x, axis=0, weights=w)
            assert np.allclose(m.mean, mean) and np.allclose(m.scatter, ((x - mean) * w[:, None]).T @ (x - mean))


def test_out_of_bag_members_have_not_seen_the_row(data):
    df, pdf = data
    for family, share in (("ridge", 1.0), ("ridge", 0.5), ("decision_tree", 1.0), ("decision_tree", 0.5)):
        model = ensemble.bagging(df, ["id"], COLS, "y", family, n_estimators=4, max_samples=0.7, max_features=share)
        rows, names = model.members(df, ["id"])
        drawn = rows.select("id", *[F.col(n) for n in names], *[model.weight(F.lit(i)).alias(f"w{i}") for i in range(4)]).toPandas().set_index("id")
        free = drawn[[f"w{i}" for i in range(4)]].to_numpy() == 0
        want = {i: p[f].mean() for i, p, f in zip(drawn.index, drawn[names].to_numpy(), free) if f.any()}
        got = {r["id"]: r["prediction"] for r in ensemble.oob_predictions(model, df, ["id"], ["id"]).collect()}
        assert got == pytest.approx(want) and 0 < len(got) <= 600
        n, r2 = ensemble.oob_score(model, df, ["id"], "y")
        assert n == len(got) and r2 > 0.1  # half of the columns say little


def test_adaboost_over_linear_and_huber_bases(data, spark):
    _, pdf = data
    dirty = pdf.copy()
    dirty.loc[:60, "y"] += 40
    df = spark.createDataFrame(dirty).repartition(3)
    error = {}
    for family, params in (("linear", {}), ("huber", {"epsilon": 1.35})):
        model = ensemble.adaboost_r2(df, COLS, "y", family, params, n_estimators=3)
        out = model.predict(df.where("id > 60"), ["id", "y"])
        error[family] = out.agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
        assert out.count() == 539 and len(model.models) == len(model.weights)
    assert error["huber"] < 0.5 * error["linear"]
    with pytest.raises(ValueError):
        ensemble.adaboost_r2(df, COLS, "y", "no_such")


def test_consensus_of_shares_and_stop_rules(data, spark):
    _, pdf = data
    dirty = pdf.copy()
    dirty.loc[:120, "y"] += 50
    df = spark.createDataFrame(dirty).repartition(3)
    small = ensemble.ransac(df, ["id"], COLS, "y", residual_threshold=1.5, stop_probability=1.0)
    assert small.trials == 100 and np.allclose(small.model.coef, [1.5, -0.7, 0.2, -1.0], atol=0.2)
    early = ensemble.ransac(df, ["id"], COLS, "y", residual_threshold=1.5, stop_probability=0.9)
    assert early.trials < 100 and early.inliers > 400
    first = ensemble.ransac(df, ["id"], COLS, "y", residual_threshold=1.5, stop_n_inliers=1)
    assert first.trials <= early.trials
    share = ensemble.ransac(df, ["id"], COLS, "y", min_samples=0.01, residual_threshold=1.5, max_trials=60, family="ridge", params={"alpha": 0.01})
    assert share.inliers > 400 and np.allclose(share.model.coef, [1.5, -0.7, 0.2, -1.0], atol=0.3)
    for wrong in ({"min_samples": 0}, {"min_samples": 1.5}, {"family": "huber"}, {"stop_probability": 2}):
        with pytest.raises(ValueError):
            ensemble.ransac(df, ["id"], COLS, "y", **wrong)


def test_trials_needed():
    assert ensemble.trials_needed(0.5, 2, 0.99) == math.ceil(math.log(0.01) / math.log(0.75))
    assert ensemble.trials_needed(1.0, 3, 0.99) == 0 and ensemble.trials_needed(0.0, 3, 0.99) == math.inf
    assert ensemble.trials_needed(0.5, 3, 1.0) == math.inf and ensemble.trials_needed(0.5, 3, 0.0) == 0


def test_votes_of_fitted_members(data):
    df, pdf = data
    members = {"line": ("ridge", {"alpha": 1.0}, COLS), "leaves": ("decision_tree", {"max_leaf_nodes": 12}, COLS)}
    found = ensemble.fit_voting(df, members, "y", "id", weights=[(1.0, 0.0), (0.0, 1.0), (0.7, 0.3)])
    table = found.folded.toPandas().set_index("id").sort_index()
    assert len(table) == 600
    for k in range(4):
        train = pdf[pdf["fold"] != k]
        held = linear.solve_ridge(moments(df.where(F.col("fold") != k), [*COLS, "y"])[None], 1.0)
        mine = pdf[pdf["fold"] == k]
        want = mine[COLS].to_numpy() @ np.array(held.coef) + held.intercept
        assert np.allclose(table.loc[mine["id"], "line"], want) and len(train) == 450
        assert table.loc[mine["id"], "leaves"].nunique() <= 12
    assert found.weights["line"] > 0 and found.predict(df, "id").count() == 600
