"""Best-first trees and boosting against plain single-process recomputation on small tables."""

import heapq
import math
import random

import numpy as np
import pytest

from tabfeat.operators import boosting, growth
from tabfeat.operators.growth import Rules


def table(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.randrange(12), rng.randrange(7), round(rng.random(), 3)
        rows.append((i, float(a), float(b), c, math.sin(a) * 3 + (b > 3) * 2 + c + rng.gauss(0, 0.3)))
    return rows


FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rows = table()
    x, y = np.array([r[1:4] for r in rows]), np.array([r[4] for r in rows])
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(5), x, y


def plain_tree(x, g, h, rules):
    """Nodes as (rows, value, split or None) by exhaustive search, opened by gain; rows are sets of positions."""
    def value(rows):
        return float(growth.leaf_value(g[rows].sum(), np.asarray(h[rows].sum()), rules))

    def split(rows):
        best = None
        whole = growth.score(g[rows].sum(), np.asarray(h[rows].sum()), rules)
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                if min(len(left), len(right)) < rules.min_rows or min(h[left].sum(), h[right].sum()) < rules.min_hessian:
                    continue
                gain = float(sum(growth.score(g[s].sum(), np.asarray(h[s].sum()), rules) for s in (left, right)) - whole)
                if best is None or gain > best[0] + 1e-9:
                    best = gain, f, cut, left, right
        return best if best and best[0] > rules.min_gain + 1e-12 else None

    nodes, queue = [(np.arange(len(g)), 0)], []

    def offer(i):
        rows, depth = nodes[i]
        found = split(rows) if rules.max_depth is None or depth < rules.max_depth else None
        if found:
            heapq.heappush(queue, (-found[0], i, found))

    offer(0)
    leaves, prediction = 1, np.full(len(g), value(nodes[0][0]))
    while queue and (rules.max_leaves is None or leaves < rules.max_leaves):
        _, i, (_, f, cut, left, right) = heapq.heappop(queue)
        for side in (left, right):
            nodes.append((side, nodes[i][1] + 1))
            prediction[side] = value(side)
            offer(len(nodes) - 1)
        leaves += 1
    return leaves, prediction, nodes


def predictions(rows, bins, tree):
    model = boosting.BoostedModel(bins, 0.0, [tree], [1.0])
    return {r["id"]: r["prediction"] for r in model.predict_binned(rows).collect()}


@pytest.mark.parametrize("rules", [
    Rules(max_leaves=1), Rules(max_leaves=2), Rules(max_leaves=4), Rules(max_leaves=23), Rules(max_leaves=None, max_depth=3),
    Rules(max_leaves=40, min_rows=15), Rules(max_leaves=None, min_gain=30.0), Rules(max_leaves=9, max_depth=2),
])
def test_tree_is_the_exhaustive_one(data, rules):
    df, x, y = data
    bins = growth.fit_bins(df, FEATURES, 1024)
    with growth.binned(df, bins, "y", ["id"]) as rows:
        tree = growth.grow(rows, bins, rules)
        got = predictions(rows, bins, tree)
    leaves, want, _ = plain_tree(x, -y, np.ones(len(y)), rules)
    assert tree.leaves == leaves
    assert [got[i] for i in range(len(y))] == pytest.approx(list(want), abs=1e-9)


def test_one_growth_serves_all_sizes(data):
    df, x, y = data
    bins = growth.fit_bins(df, FEATURES, 1024)
    with growth.binned(df, bins, "y", ["id"]) as rows:
        tree = growth.grow(rows.where("id % 4 <> 0"), bins, Rules(max_leaves=60))
        sizes = [1, 2, 3, 10, 33, 60, 500]
        found = growth.errors_by_size(rows.where("id % 4 = 0"), bins, [tree], sizes)
    train, held = np.arange(len(y)) % 4 != 0, np.arange(len(y)) % 4 == 0
    codes = bins.codes(list(x[held].T))
    for size in sizes:
        leaves, _, _ = plain_tree(x[train], -y[train], np.ones(train.sum()), Rules(max_leaves=min(size, 60)))
        cut = np.array(tree.value)[tree.node_of(codes, nodes=2 * leaves - 1)]
        assert found[size] == pytest.approx(np.abs(y[held] - cut).mean(), abs=1e-9)
        _, fitted, _ = plain_tree(x[train], -y[train], np.ones(train.sum()), Rules(max_leaves=min(size, 60)))
        own = np.array(tree.value)[tree.node_of(bins.codes(list(x[train].T)), nodes=2 * leaves - 1)]
        assert list(own) == pytest.approx(list(fitted), abs=1e-9)


def test_regularised_leaves():
    rules = Rules(reg_lambda=2.0, reg_alpha=3.0)
    assert float(growth.leaf_value(np.float64(-10.0), np.asarray(5.0), rules)) == pytest.approx(7 / 7)
    assert float(growth.leaf_value(np.float64(2.0), np.asarray(5.0), rules)) == 0
    assert float(growth.leaf_value(np.float64(1.0), np.asarray(0.0), Rules())) == 0


def plain_boosting(x, y, plan):
    """The same rounds in one process, with exact splits."""
    at = plan.alpha if plan.loss == "quantile" else 0.5
    f = np.full(len(y), y.mean() if plan.loss == "squared" else np.quantile(y, at)) if plan.base is None else np.full(len(y), plan.base)
    for _ in range(plan.rounds):
        r = y - f
        delta = np.quantile(np.abs(r), plan.alpha) if plan.loss == "huber" else math.inf
        g = -boosting._negative_gradient(plan, r, delta)
        _, step, nodes = plain_tree(x, g, np.ones(len(y)), plan.rules)
        if plan.loss != "squared":
            leaf = np.zeros(len(y), int)
            for i, (rows, _) in enumerate(nodes):
                leaf[rows] = i
            for i in np.unique(leaf):
                own = r[leaf == i]
                middle = np.quantile(own, at)
                step[leaf == i] = middle + np.clip(own - middle, -delta, delta).mean() if plan.loss == "huber" else middle
        f = f + plan.rate * step
    return f


@pytest.mark.parametrize("plan", [
    boosting.Plan(rounds=10, rate=0.3, rules=Rules(max_leaves=None, max_depth=2)),
    boosting.Plan(rounds=3, rate=0.5, base=0.5, rules=Rules(max_leaves=6, reg_lambda=3.0, reg_alpha=2.0, min_hessian=20.0)),
    boosting.Plan(loss="huber", rounds=3, rate=0.4, rules=Rules(max_leaves=4)),
    boosting.Plan(loss="quantile", alpha=0.8, rounds=3, rate=0.4, rules=Rules(max_leaves=None, max_depth=2)),
    boosting.Plan(loss="absolute", rounds=2, rate=0.4, rules=Rules(max_leaves=3)),
])
def test_rounds_of_every_loss(data, plan):
    df, x, y = data
    bins = growth.fit_bins(df, FEATURES, 1024)
    with growth.binned(df, bins, "y", ["id"]) as rows:
        model = boosting.fit_binned(rows, bins, plan)
        got = {r["id"]: r["prediction"] for r in model.predict_binned(rows).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(list(plain_boosting(x, y, plan)), abs=1e-8)
    again = {r["id"]: r["prediction"] for r in model.transform(df).collect()}
    assert got == pytest.approx(again)


def test_dropout_and_gradient_sampling(data):
    df, _, y = data
    bins = growth.fit_bins(df, FEATURES)
    rules = Rules(max_leaves=4)
    with growth.binned(df, bins, "y") as rows:
        def fit(**how):
            return boosting.fit_binned(rows, bins, boosting.Plan(rounds=4, rate=0.5, rules=rules, **how))

        usual = fit()
        assert fit(drop_rate=0.5, skip_drop=1.0).trees == usual.trees  # every round skips dropout
        assert fit(top_rate=1.0).trees == usual.trees
        dropped = fit(drop_rate=1.0, most_dropped=1)
        assert dropped.trees[0] == usual.trees[0] and dropped.weights[0] < 0.5  # one of the trees was dropped and scaled
        assert sum(dropped.weights) < sum(usual.weights)
        chosen = fit(top_rate=0.3, other_rate=0.2)
        assert chosen.trees[0].rows[0] < len(y) * 0.6 and chosen.trees != usual.trees
        codes = bins.codes(list(data[1].T))
        error = {name: np.mean((y - m.base - m.margin(codes)) ** 2) for name, m in (("usual", usual), ("chosen", chosen))}
        assert error["chosen"] < 2 * error["usual"]


def test_early_stopping_is_read_off_the_losses(data):
    df, x, y = data
    plan = boosting.Plan(rounds=60, rate=0.9, rules=Rules(max_leaves=12), validation=0.3, stop_after=3)
    bins = growth.fit_bins(df, FEATURES)
    with growth.binned(df, bins, "y", ["id"]) as rows:
        model = boosting.fit_binned(rows, bins, plan)
        kept = rows.select("id", "_hash").collect()
    best = min(range(len(model.losses)), key=lambda i: model.losses[i])
    assert len(model.trees) == best and len(model.losses) - 1 - best == 3 < 57
    held = np.zeros(len(y), bool)
    hashes = {r["id"]: r["_hash"] for r in kept}
    held[:] = boosting.uniform(np.array([hashes[i] for i in range(len(y))], np.int64), boosting._seed(plan, boosting._HELD)) < 0.3
    codes = bins.codes(list(x.T))
    for i in range(best + 1):
        f = model.base + sum(w * t.predict(codes) for w, t in zip(model.weights[:i], model.trees[:i]))
        assert model.losses[i] == pytest.approx(((y - f)[held] ** 2 / 2).mean())
    assert model.base == pytest.approx(y[~held].mean())


def test_fit_does_not_depend_on_partitions(data, spark):
    df, _, _ = data
    params = {"n_estimators": 9, "max_depth": 2, "subsample": 0.7, "max_features": "sqrt", "loss": "huber"}
    models = [boosting.fit_boosting(d, FEATURES, "y", params) for d in (df, df.repartition(2))]
    assert models[0].trees == models[1].trees and models[0].base == models[1].base


def test_names_and_values(spark):
    plan, bins = boosting.plan_of({"boosting_type": "dart", "num_leaves": 21, "max_depth": -1, "reg_lambda": 0.1, "reg_alpha": 1, "min_child_samples": 10}, 4)
    assert (plan.rules.max_leaves, plan.rules.max_depth, plan.rules.reg_lambda, plan.rules.reg_alpha, plan.rules.min_rows) == (21, None, 0.1, 1, 10)
    assert plan.drop_rate == 0.1 and bins == 256
    assert boosting.plan_of({"booster": "gbtree"}, 4)[0].rules == Rules(max_leaves=None, max_depth=6, min_hessian=1.0, reg_lambda=1.0)
    assert boosting.plan_of({"n_iter_no_change": 5}, 4)[0].validation == 0.1
    assert boosting.plan_of({"max_features": "sqrt"}, 4)[0].features == 2
    for wrong in ({"no_such": 1}, {"loss": "cube"}, {"boosting_type": "rf"}, {"max_leaf_nodes": 1}, {"learning_rate": 0}, {"subsample": 0},
                  {"colsample_bytree": 0}, {"alpha": 2, "loss": "quantile"}):
        with pytest.raises(ValueError):
            boosting.plan_of(wrong, 4)


def test_missing_values_and_empty_table(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (2.0, None), (3.0, 8.0)], "a double, y double")
    model = boosting.fit_boosting(df, ["a"], "y", {"n_estimators": 2, "learning_rate": 1.0, "max_depth": 1})
    got = {r["a"]: r["prediction"] for r in model.transform(df).collect()}
    assert got[None] is None and got[1.0] == pytest.approx(2.0) and got[3.0] == pytest.approx(8.0)
    none = boosting.fit_boosting(df.where("a > 9"), ["a"], "y", {"n_estimators": 1})
    assert none.base == 0 and none.trees[0].leaves == 1
