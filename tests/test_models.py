import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from tabfeat.operators import ensemble, gram, linear, neighbors, screen, search, trees
from tabfeat.operators.folds import holdout_split, metrics
from tabfeat.operators.gram import moments, total

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 1200
    x = rng.normal(size=(n, 3)) * [1, 2, 0.5] + [0, 5, 1]
    y = x @ [1.5, -0.7, 0.0] + 2 + rng.normal(size=n) * 0.3
    pdf = pd.DataFrame(x, columns=COLS).assign(y=y, id=range(n), fold=np.repeat(range(4), n // 4))
    return spark.createDataFrame(pdf).repartition(4).cache(), pdf


def test_ridge_closed_form(data):
    df, pdf = data
    x, y = pdf[COLS].to_numpy(), pdf["y"].to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 7 * np.eye(3), xc.T @ yc)
    m = linear.fit_linear(df, COLS, "y", "ridge", alpha=7)
    assert np.allclose(m.coef, want) and math.isclose(m.intercept, y.mean() - x.mean(0) @ want)
    no_intercept = linear.fit_linear(df, COLS, "y", "linear", fit_intercept=False)
    assert np.allclose(no_intercept.coef, np.linalg.lstsq(x, y, rcond=None)[0]) and no_intercept.intercept == 0


def test_elastic_net_against_spark_ml(data):
    df, pdf = data
    from pyspark.ml.regression import LinearRegression
    alpha, ratio = 0.1, 0.3
    l1, l2 = alpha * ratio, alpha * (1 - ratio)
    std = pdf["y"].std()
    reg = l1 + l2 * std
    ready = trees.assemble(df, COLS, "y")
    spark_fit = LinearRegression(regParam=reg, elasticNetParam=l1 / reg, standardization=False, tol=1e-12, maxIter=500).fit(ready)
    ours = linear.fit_linear(df, COLS, "y", "elastic_net", alpha=alpha, l1_ratio=ratio, tol=1e-12)
    assert np.allclose(ours.coef, spark_fit.coefficients.toArray(), atol=1e-3)
    # optimality: the gradient of the squared error balances the penalty
    x = pdf[COLS].to_numpy()
    w = np.array(ours.coef)
    grad = (x - x.mean(0)).T @ (pdf["y"].to_numpy() - ours.intercept - x @ w) / len(x) - l2 * w
    assert np.allclose(grad[w != 0], l1 * np.sign(w[w != 0]), atol=1e-8) and (np.abs(grad[w == 0]) <= l1 + 1e-8).all()


def test_positive_weights_and_kkt(data):
    df, _ = data
    m = linear.fit_linear(df, COLS, "y", "lasso", alpha=0.01, positive=True, tol=1e-12)
    assert min(m.coef) >= 0 and m.coef[1] == 0


def test_bayesian_ridge_close_to_ols(data):
    df, _ = data
    assert np.allclose(linear.fit_linear(df, COLS, "y", "bayesian_ridge").coef,
                       linear.fit_linear(df, COLS, "y", "linear").coef, atol=5e-3)


def test_held_out_r2_from_moments_equals_rows(data):
    df, _ = data
    parts = moments(df, [*COLS, "y"], by="fold")
    for k, part in parts.items():
        m = linear.solve_ridge(total(parts) - part, alpha=3)
        held = m.transform(df.where(F.col("fold") == k)).withColumn("label", F.col("y"))
        assert math.isclose(metrics(held).first()["r2"], linear.r2_of(m, part), rel_tol=1e-9)


def test_huber_resists_outliers(spark, data):
    _, pdf = data
    dirty = pdf.copy()
    dirty.loc[:60, "y"] += 80
    df = spark.createDataFrame(dirty)
    m = linear.fit_huber(df, COLS, "y")
    assert np.allclose(m.coef, [1.5, -0.7, 0.0], atol=0.15)
    assert abs(linear.fit_linear(df, COLS, "y", "linear").intercept - 2) > 1 > abs(m.intercept - 2)


def _svr_objective(m, pdf, eps, c, squared=False):
    r = np.abs(pdf["y"] - pdf[COLS].to_numpy() @ np.array(m.coef) - m.intercept)
    loss = np.maximum(r - eps, 0)
    return 0.5 * np.dot(m.coef, m.coef) + c * ((loss**2).sum() if squared else loss.sum())


@pytest.mark.parametrize("squared", [False, True])
def test_insensitive_regression_is_a_minimum(data, squared):
    df, pdf = data
    loss = "squared_epsilon_insensitive" if squared else "epsilon_insensitive"
    m = linear.fit_insensitive(df, COLS, "y", epsilon=0.2, c=0.5, loss=loss, max_iter=60, tol=1e-6)
    best = _svr_objective(m, pdf, 0.2, 0.5, squared)
    rng = np.random.default_rng(1)
    for _ in range(200):
        near = linear.LinearModel(COLS, list(np.array(m.coef) + rng.normal(size=3) * 0.02), m.intercept + rng.normal() * 0.02)
        assert _svr_objective(near, pdf, 0.2, 0.5, squared) > best * (1 - 2e-3)


def test_insensitive_with_l1_drops_the_idle_column(data):
    df, _ = data
    m = linear.fit_insensitive(df, COLS, "y", epsilon=0.05, c=None, alpha=0.05, l1_ratio=1.0,
                               loss="squared_epsilon_insensitive")
    assert m.coef[2] == 0 and m.coef[0] > 1


def test_grid_search_board_refit_and_report(data):
    df, _ = data
    found = search.grid_search(df, "ridge", {"alpha": [0.1, 1.0, 1000.0], "fit_intercept": [True]}, COLS, "y")
    rows = found.leaderboard.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3] and json.loads(rows[-1]["params"])["alpha"] == 1000.0
    assert found.best_params["alpha"] == json.loads(rows[0]["params"])["alpha"]
    assert np.allclose(found.model.coef, linear.fit_linear(df, COLS, "y", "ridge", **found.best_params).coef)
    assert found.metrics(df).first()["r2"] > 0.9
    assert search.report(found.leaderboard, 2).count() == 2


def test_grid_search_scores_bad_candidates_zero(data):
    df, _ = data
    found = search.grid_search(df, "decision_tree", {"max_depth": [3], "min_samples_leaf": [5, -4], }, COLS, "y")
    rows = {json.loads(r["params"])["min_samples_leaf"]: r for r in found.leaderboard.collect()}
    assert rows[-4]["mean_score"] == 0.0 and rows[5]["mean_score"] > 0.5
    assert found.predict(df, ["id"]).count() == df.count()


def test_unknown_names_fail_before_any_job(data):
    df, _ = data
    for family, params in (("ridge", {"alhpa": [5.0]}), ("decision_tree", {"depth": [3]}), ("huber", {"eps": [1.0]}), ("no_such", {"a": [1]})):
        with pytest.raises(ValueError):
            search.grid_search(df, family, params, COLS, "y")
    with pytest.raises(ValueError):
        linear.fit_linear(df, COLS, "y", "ridge", alhpa=1.0)
    grids = {
        "decision_tree": {"criterion": ["mse"], "max_depth": [3], "min_samples_split": [4], "splitter": ["best"], "presort": [True], "min_impurity_split": [None]},
        "gradient_boosting": {"booster": ["gbtree"], "max_depth": [2], "n_estimators": [2], "min_child_weight": [3], "reg_lambda": [1.0], "colsample_bytree": [1.0],
                              "subsample": [1.0], "boosting_type": ["gbdt"], "subsample_for_bin": [200000], "scoring": ["r2"], "l2_regularization": [0.1]},
        "ridge": {"alpha": [1.0], "solver": ["svd"], "random_state": [3]},
    }
    for family, grid in grids.items():
        assert search.grid_search(df, family, grid, COLS, "y").best_score > 0


def test_constant_labels_score_one_or_zero(spark):
    rows = spark.createDataFrame([(i % 4, float(i), 5.0 if i % 4 == 0 else float(i)) for i in range(40)], "fold int, a double, y double")
    found = search.grid_search(rows, "ridge", {"alpha": [0.1]}, ["a"], "y").leaderboard.first()
    assert found["mean_score"] > -50  # the constant fold counts as 0
    same = rows.withColumn("prediction", F.lit(5.0)).withColumn("label", F.lit(5.0))
    assert metrics(same).first()["r2"] == 1.0


def test_moments_do_not_depend_on_order_or_partitions(data, spark):
    _, pdf = data
    far = pdf.assign(a=pdf["a"] + 1e9)
    want = None
    for frame, n in ((far, 1), (far.sort_values("a"), 4), (far.sample(frac=1, random_state=1), 13)):
        m = gram.moments(spark.createDataFrame(frame).repartition(n), ["a", "b", "y"])[None]
        got = np.append(m.scatter.ravel(), m.mean)
        want = got if want is None else want
        assert np.allclose(got, want, rtol=1e-9)


def test_trees_do_not_depend_on_partitions(data):
    df, _ = data
    fits = {
        "random_forest": lambda d: trees.fit_tree(d, COLS, "y", "random_forest", {"n_estimators": 4, "max_depth": 4}),
        "gradient_boosting": lambda d: trees.fit_tree(d, COLS, "y", "gradient_boosting", {"n_estimators": 4, "max_depth": 3, "subsample": 0.7}),
    }
    for name, fit in fits.items():
        found = []
        for n in (1, 4, 13):
            rows = fit(df.repartition(n)).transform(trees.assemble(df, COLS, "y", ["id"]))
            found.append([r["prediction"] for r in rows.orderBy("id").select("prediction").collect()])
        assert np.allclose(found[0], found[1]) and np.allclose(found[0], found[2]), name


def test_clusters_do_not_depend_on_partitions(data):
    df, _ = data
    found = [{r["id"]: r["cluster"] for r in screen.kmeans_segments(df.repartition(n), "id", COLS, 3, 4)[0].collect()} for n in (1, 4, 13)]
    assert found[0] == found[1] == found[2] and len(set(found[0].values())) == 4


def test_equal_candidates_share_a_rank(data):
    df, _ = data
    found = search.grid_search(df, "ridge", {"alpha": [1.0], "tol": [1e-3, 1e-2]}, COLS, "y")
    assert [r["rank"] for r in found.leaderboard.collect()] == [1, 1]
    assert search.report(found.leaderboard, 1).count() == 2


def test_random_search_is_seeded():
    space = {"alpha": lambda g: g.expovariate(1.0), "positive": [True, False]}
    assert search.sample_grid(space, 4, 7) == search.sample_grid(space, 4, 7)
    grid = search.sample_grid({"a": [1, 2, 3], "b": [1, 2]}, 20, 0)
    assert len(grid) == 6 and len({tuple(g.items()) for g in grid}) == 6


def test_search_over_huber(data):
    df, _ = data
    found = search.grid_search(df, "huber", {"epsilon": [1.35, 2.3], "max_iter": [30]}, COLS, "y")
    assert found.best_score > 0.9


def test_tree_parameters():
    tree = trees.tree_estimator("decision_tree", {"max_depth": None, "min_samples_leaf": 0.1, "min_impurity_decrease": 0.2})
    assert tree.getMaxDepth() == 30 and tree.getMinWeightFractionPerNode() == 0.1 and tree.getMinInfoGain() == 0.2
    assert trees.tree_estimator("gradient_boosting", {"loss": "lad"}).getLossType() == "absolute"
    for bad in ({"boosting_type": "dart"}, {"loss": "quantile"}):
        with pytest.raises((ValueError, KeyError)):
            trees.tree_estimator("gradient_boosting", bad)
    assert [trees.depth_for_leaves(s) for s in (2, 10, 16, 17)] == [1, 4, 4, 5]


def test_tree_size_search_bounds_leaves(data):
    """Sizes are numbers of leaves: a size has the error of a tree fitted with just that bound."""
    df, _ = data
    split = holdout_split(df, ["id"])
    rows = trees.tree_size_search(split, COLS, "y", sizes=[2, 10, 16, 60]).collect()
    assert rows[0]["mae"] == min(r["mae"] for r in rows)
    by = {r["size"]: r["mae"] for r in rows}
    assert len(set(by.values())) == 4 and by[60] < by[16] < by[10] < by[2]
    for size in (2, 16):
        model = trees.fit_tree(split.where("is_train"), COLS, "y", "decision_tree", {"max_leaf_nodes": size})
        held = trees.predict(model, split.where("not is_train"), COLS, ["y"])
        assert model.trees[0].leaves == size
        assert by[size] == pytest.approx(held.agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0])


def test_tree_size_search_of_a_forest(data):
    df, _ = data
    split = holdout_split(df, ["id"])
    alone, forest = (trees.tree_size_search(split, COLS, "y", kind, [4, 40], params=p).collect()
                     for kind, p in (("decision_tree", {}), ("random_forest", {"n_estimators": 5})))
    assert {r["size"] for r in forest} == {4, 40} and forest[0]["size"] == 40
    assert forest[0]["mae"] < alone[0]["mae"]


def test_search_over_leaves_and_penalties(data):
    df, _ = data
    found = search.grid_search(df, "decision_tree", {"max_leaf_nodes": [2, 30, 1], "min_impurity_split": [None, 1e-7]}, COLS, "y")
    board = {(json.loads(r["params"])["max_leaf_nodes"], json.loads(r["params"])["min_impurity_split"]): r["mean_score"] for r in found.leaderboard.collect()}
    assert board[30, None] > board[2, None] and board[1, None] == 0.0 and found.best_params["max_leaf_nodes"] == 30
    found = search.grid_search(df, "gradient_boosting", {"n_estimators": [8], "learning_rate": [0.4], "reg_lambda": [0.0, 1e6], "loss": ["ls", "huber"]}, COLS, "y")
    board = {(json.loads(r["params"])["reg_lambda"], json.loads(r["params"])["loss"]): r["mean_score"] for r in found.leaderboard.collect()}
    assert board[0.0, "ls"] > 0.5 > board[1e6, "ls"] and board[0.0, "huber"] > 0.5
    assert found.predict(df, ["id"]).count() == df.count() and found.metrics(df).first()["r2"] > 0.5


def test_holdout_is_stable_under_repartition(data):
    df, _ = data
    one = {r["id"] for r in holdout_split(df, ["id"]).where("is_train").collect()}
    two = {r["id"] for r in holdout_split(df.repartition(9), ["id"]).where("is_train").collect()}
    assert one == two and 0.65 < len(one) / 1200 < 0.85


def test_metrics_against_evaluator(data):
    df, _ = data
    scored = linear.fit_linear(df, COLS, "y", "ridge").transform(df).withColumn("label", F.col("y"))
    r = metrics(scored).first()
    ev = RegressionEvaluator()
    assert math.isclose(r["r2"], ev.evaluate(scored, {ev.metricName: "r2"}))
    assert math.isclose(r["rmse"], ev.evaluate(scored, {ev.metricName: "rmse"}))


def test_bagging_draws_each_number_once(spark, monkeypatch):
    """Hashes repeated in every test of a weight took most of the time of a search over many rows."""
    plans, plain = [], ensemble.replica_moments
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    df = spark.createDataFrame(pd.DataFrame({"id": range(400), "a": x[:, 0], "b": x[:, 1], "y": x @ [1.0, 2.0] + rng.normal(size=400)}))

    def seen(rows, cols, weights, replicas, *more):
        plans.append(rows.select(weights.alias("w"))._jdf.queryExecution().optimizedPlan().toString())
        plans.append(rows.select(weights.alias("w"), *cols).toPandas())
        return plain(rows, cols, weights, replicas, *more)

    monkeypatch.setattr(ensemble, "replica_moments", seen)
    found = ensemble.bagging(df, ["id"], ["a", "b"], "y", "ridge", {"alpha": 1.0}, n_estimators=3)
    assert plans[0].count("xxhash64") == 3
    own = plans[1]
    for i, m in enumerate(found.models):
        w = df.select(ensemble.poisson_weight(ensemble.draw_uniform(["id"], F.lit(i), 0), 1.0).alias("w")).toPandas()["w"].to_numpy()
        assert len(set(w)) > 2
        a, t = own[["x0", "x1"]].to_numpy(), own["y"].to_numpy()
        a, t = a - np.average(a, axis=0, weights=w), t - np.average(t, weights=w)
        assert np.allclose(m.coef, np.linalg.solve((a * w[:, None]).T @ a + np.eye(2), (a * w[:, None]).T @ t))


def test_poisson_weights(spark):
    df = spark.range(40000).withColumn("w", ensemble.poisson_weight(ensemble.draw_uniform(["id"], F.lit(3), 0), 1.0))
    r = df.agg(F.avg("w"), F.var_pop("w"), F.max("w")).first()
    assert abs(r[0] - 1) < 0.03 and abs(r[1] - 1) < 0.05 and r[2] >= 5


def test_bagging_linear_and_trees(data):
    df, _ = data
    for family, params in (("ridge", {"alpha": 1.0}), ("decision_tree", {"max_depth": 5})):
        for share in (1.0, 0.67):
            model = ensemble.bagging(df, ["id"], COLS, "y", family, params, n_estimators=4, max_features=share)
            out = model.predict(df, ["id", "y"]).withColumn("label", F.col("y"))
            assert out.count() == 1200 and metrics(out).first()["r2"] > 0.5
    with pytest.raises(ValueError):
        ensemble.bagging(df, ["id"], COLS, "y", max_samples=1.5)


def test_adaboost_median(data, spark):
    df, _ = data
    model = ensemble.adaboost_r2(df, COLS, "y", params={"max_depth": 3}, n_estimators=7)
    assert len(model.models) == 7 and len(model.weights) == 7
    out = model.predict(df, ["id", "y"]).withColumn("label", F.col("y"))
    alone = trees.fit_tree(df, COLS, "y", "decision_tree", {"max_depth": 3}).transform(trees.assemble(df, COLS, "y"))
    assert metrics(out).first()["r2"] > metrics(alone).first()["r2"]
    # the median of the members, by hand
    rows = trees.assemble(df, COLS, None, ["id"])
    preds = np.array([[r["prediction"] for r in m.setPredictionCol("prediction").transform(rows).orderBy("id").collect()] for m in model.models])
    order = preds.argsort(0)
    weight = np.array(model.weights)[order].cumsum(0)
    pick = (weight >= weight[-1] / 2 - 1e-12).argmax(0)
    want = np.take_along_axis(preds, np.take_along_axis(order, pick[None], 0), 0)[0]
    assert np.allclose([r["prediction"] for r in out.orderBy("id").collect()], want)


def test_ransac_ignores_outliers(spark, data):
    _, pdf = data
    dirty = pdf.copy()
    dirty.loc[:300, "y"] += 50
    df = spark.createDataFrame(dirty).repartition(3)
    found = ensemble.ransac(df, ["id"], COLS, "y", residual_threshold=1.0)
    assert np.allclose(found.model.coef, [1.5, -0.7, 0.0], atol=0.1) and 880 <= found.inliers <= 900
    assert ensemble.ransac(df, ["id"], COLS, "y").threshold > 0


def test_weight_search_equals_row_scores(data):
    df, _ = data
    rows = df.withColumns({"p": F.col("y") + F.col("c"), "q": F.col("y") * 0.9, "label": F.col("y")})
    board = ensemble.search_weights(rows, ["p", "q"], "y", "fold", ensemble.weight_grid(2, 2)).collect()
    assert len(board) == 8 and board[0]["mean_score"] == max(b["mean_score"] for b in board)
    some = next(b for b in board if b["weights"] == [0.5, 1.0])
    scored = rows.withColumn("prediction", ensemble.blend({"p": 0.5, "q": 1.0}))
    r2 = [r["r2"] for r in metrics(scored, by=["fold"]).collect()]
    assert math.isclose(some["mean_score"], np.mean(r2)) and math.isclose(some["std_score"], np.std(r2))
    with pytest.raises(ValueError):
        ensemble.blend({"p": 0, "q": 0})


# ---- neighbours ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(8)
    n = 300
    x = rng.normal(size=(n, 4))
    x[:100] = x[0]  # a third of the rows are copies of one point
    pdf = pd.DataFrame({"id": range(n), "v": x.tolist(), "y": rng.normal(size=n)})
    return spark.createDataFrame(pdf).repartition(4), x, pdf["y"].to_numpy()


def _distance(x, p):
    return (np.abs(x[:, None] - x[None]) ** p).sum(-1) ** (1 / p)


@pytest.mark.parametrize("block,p", [(10**6, 2), (40, 2), (40, 1), (25, 3)])
def test_neighbors_match_brute_force(points, block, p):
    df, x, _ = points
    got = neighbors.nearest_neighbors(df, df, "id", "v", "y", k=6, p=p, exclude_self=True, block_rows=block).toPandas()
    d = _distance(x, p)
    np.fill_diagonal(d, np.inf)
    assert len(got) == 300 * 6
    for qid, part in got.groupby("qid"):
        want = np.lexsort((np.arange(300), d[qid]))[:6]
        assert np.allclose(sorted(part["distance"]), d[qid][want])
        if qid < 100:  # copies: the lowest keys win
            assert sorted(part["id"]) == [i for i in range(7) if i != qid][:6]


@pytest.mark.parametrize("block", [10**6, 40])
def test_knn_weights(points, block):
    df, x, y = points
    got = neighbors.knn_regression(df, df, "id", "v", "y", k=3, weights="distance", block_rows=block).toPandas()
    assert len(got) == 300
    got = got.set_index("id").sort_index()["prediction"]
    assert np.allclose(got[150:], y[150:])  # at distance zero from itself only
    assert math.isclose(got[5], y[:3].mean())


@pytest.mark.parametrize("block", [10**6, 40])
@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_radius_matches_brute_force(points, block, weights):
    df, x, y = points
    got = neighbors.radius_regression(df, df, "id", "v", "y", radius=0.9, weights=weights, exclude_self=True,
                                      block_rows=block).toPandas().set_index("id").sort_index()
    d = _distance(x, 2)
    np.fill_diagonal(d, np.inf)
    near = d <= 0.9
    assert (got["neighbors"] == near.sum(1)).all()
    lonely = near.sum(1) == 0
    assert got["prediction"][lonely].isna().all() and lonely.any()
    for i in np.flatnonzero(~lonely):
        if weights == "uniform":
            want = y[near[i]].mean()
        elif (d[i] == 0).any():
            want = y[d[i] == 0].mean()
        else:
            want = np.average(y[near[i]], weights=1 / d[i][near[i]])
        assert math.isclose(got["prediction"][i], want)
