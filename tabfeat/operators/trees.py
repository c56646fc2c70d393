"""Tree regressors: the usual parameter names mapped to Spark ML estimators."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfeat.functions.columns import numeric, q
from tabfeat.operators import boosting
from tabfeat.operators.boosting import BoostedModel, uniform
from tabfeat.operators.growth import Bins, Rules, binned, errors_by_size, fit_bins, grow, label_gradients
from tabfeat.operators.iterate import kept

MAX_DEPTH = 30

#: Chances that a row is drawn at most 0, 1, 2, ... times.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
# Losses and feature subset names as users write them.
LOSSES = {"ls": "squared", "least_squares": "squared", "lad": "absolute"}
SUBSETS = {None: "all", "auto": "all", "sqrt": "sqrt", "log2": "log2"}
SQUARED = {"mse", "friedman_mse", "squared_error"}
# Names that change nothing here: how splits are looked for, how a library runs and what it prints.
NO_EFFECT = {
    "splitter", "presort", "scoring", "random_state", "n_jobs", "verbose", "warm_start", "oob_score", "subsample_for_bin", "silent", "nthread",
    "objective",
}
# Names that only ``boosting`` honours.
ONLY_BOOSTING = {
    "reg_lambda", "reg_alpha", "l2_regularization", "n_iter_no_change", "validation_fraction", "num_leaves", "max_leaf_nodes", "max_leaves",
    "min_split_gain", "gamma", "top_rate", "other_rate", "drop_rate", "rate_drop", "max_drop", "skip_drop", "base_score", "subsample_freq",
}
# Names that only trees grown here honour, not Spark's: a decision tree that has one of them is grown leaf by leaf.
LEAFWISE = {"max_leaf_nodes", "min_impurity_split"}
# Names with a Spark form, for all kinds and for those that draw.
MAPPED = {
    "max_depth", "max_leaf_nodes", "num_leaves", "min_samples_leaf", "min_child_samples", "min_child_weight", "min_samples_split",
    "min_weight_fraction_leaf", "min_impurity_decrease", "min_split_gain", "gamma", "max_bins", "max_features", "colsample_bytree",
    "criterion", "booster", "boosting_type",
}
DRAWN = {
    "decision_tree": {"min_impurity_split"}, "random_forest": {"n_estimators", "bootstrap", "max_samples"},
    "gradient_boosting": {"n_estimators", "max_iter", "learning_rate", "subsample", "loss"},
}


def assemble(df: DataFrame, features: Sequence[str], label: str | None, keep: Sequence[str] = ()) -> DataFrame:
    """``features`` vector, double ``label`` and the kept columns; incomplete rows are left out."""
    cols = [numeric(df, f).alias(f"_f{i}") for i, f in enumerate(features)]
    cols += [numeric(df, label).alias("label")] if label else []
    rows = df.select(*cols, *[q(k) for k in keep]).dropna(subset=[f"_f{i}" for i in range(len(features))])
    names = [f"_f{i}" for i in range(len(features))]
    return VectorAssembler(inputCols=names, outputCol="features").transform(rows).drop(*names)


def boosted(params: Mapping | None) -> bool:
    """Whether boosting parameters ask for what only ``boosting`` has: penalties, leaf bounds, robust losses, dropout and so on."""
    p = {k: v for k, v in (params or {}).items() if v is not None}
    return bool(ONLY_BOOSTING & set(p)) or p.get("loss") in ("huber", "quantile") or bool({"dart", "goss"} & {p.get("booster"), p.get("boosting_type")})


def unknown_names(kind: str, params: Mapping) -> None:
    """ValueError for names that are neither mapped nor without effect."""
    wrong = sorted(set(params) - MAPPED - NO_EFFECT - DRAWN[kind] - (boosting.NAMES if kind == "gradient_boosting" else set()))
    if wrong:
        raise ValueError(f"no equivalent for {wrong}")


def tree_estimator(kind: str, params: Mapping | None = None, weight: str | None = None, seed: int = 0):
    """'decision_tree', 'random_forest' or 'gradient_boosting' of Spark; unknown parameters, and values without a Spark form,
    are an error. Losses, penalties and stopping rules that Spark lacks are those of ``boosting``.

    ``min_samples_split`` asks for half as many rows on either side of a split,
    ``min_child_weight`` for that many.
    """
    if kind not in DRAWN:
        raise ValueError(f"unknown tree kind {kind}")
    unknown_names(kind, params or {})
    if kind == "gradient_boosting" and boosted(params) or kind == "decision_tree" and leafwise(params) and (params or {}).get("min_impurity_split") is not None:
        raise ValueError("Spark's trees have no such bound, loss or penalty; fit_tree and the searches have")
    quiet = NO_EFFECT | {"min_impurity_split"} | (boosting.NAMES - MAPPED - DRAWN[kind] if kind == "gradient_boosting" else set())
    p = {k: v for k, v in (params or {}).items() if k not in quiet}
    for name, forms in (("criterion", SQUARED), ("booster", {"gbtree"}), ("boosting_type", {"gbdt"})):
        if p.pop(name, next(iter(forms))) not in forms:
            raise ValueError(f"{name} has no Spark form but {sorted(forms)}")
    depth = p.pop("max_depth", None)
    args = {"seed": seed, "maxDepth": MAX_DEPTH if depth in (None, -1, 0) else int(depth)}
    if kind == "gradient_boosting" and depth is None:
        args["maxDepth"] = 3
    leaves = p.pop("max_leaf_nodes", p.pop("num_leaves", None))
    if leaves:
        args["maxDepth"] = min(args["maxDepth"], depth_for_leaves(leaves))
    leaf = p.pop("min_samples_leaf", p.pop("min_child_samples", 1))
    split = p.pop("min_samples_split", 2)
    weight_of_child = p.pop("min_child_weight", 1)
    share = p.pop("min_weight_fraction_leaf", 0.0)
    if isinstance(leaf, float) and leaf < 1:
        share = max(share, leaf)
    else:
        half = math.ceil(split / 2) if split >= 1 and not (isinstance(split, float) and split == 1.0) else 1
        args["minInstancesPerNode"] = int(leaf) if leaf < 1 else max(int(leaf), half, math.ceil(weight_of_child))
    if share:
        args["minWeightFractionPerNode"] = float(share)
    args["minInfoGain"] = float(p.pop("min_impurity_decrease", p.pop("min_split_gain", p.pop("gamma", 0.0))))
    args["maxBins"] = int(p.pop("max_bins", 32))
    subset = p.pop("max_features", p.pop("colsample_bytree", None))
    subset = None if subset == 1.0 else subset
    if weight:
        args["weightCol"] = weight
    if kind == "decision_tree":
        estimator = DecisionTreeRegressor
    elif kind == "random_forest":
        estimator = RandomForestRegressor
        args |= {"numTrees": int(p.pop("n_estimators", 100)), "bootstrap": bool(p.pop("bootstrap", True)),
                 "featureSubsetStrategy": SUBSETS.get(subset, str(subset)),
                 "subsamplingRate": float(p.pop("max_samples", None) or 1.0)}
    else:
        estimator = GBTRegressor
        args |= {"maxIter": int(p.pop("n_estimators", p.pop("max_iter", 100))), "stepSize": float(p.pop("learning_rate", 0.1)),
                 "subsamplingRate": float(p.pop("subsample", 1.0)), "lossType": _loss(p.pop("loss", "ls")),
                 "featureSubsetStrategy": SUBSETS.get(subset, str(subset))}
    return estimator(**args)


def _loss(name: str) -> str:
    if name not in LOSSES:
        raise ValueError(f"no Spark form of the loss {name}")
    return LOSSES[name]


def depth_for_leaves(leaves: int) -> int:
    """Smallest depth whose full tree has at least that many leaves."""
    return max(1, min(MAX_DEPTH, math.ceil(math.log2(leaves))))


def leafwise(params: Mapping | None) -> bool:
    return any((params or {}).get(name) is not None for name in LEAFWISE)


def leafwise_rules(params: Mapping, rows: int, n_features: int) -> tuple[Rules, int, list[int] | None]:
    """Rules, number of bins and features of a decision tree that is grown here; shares are of ``rows``."""
    unknown_names("decision_tree", params)
    p = {k: v for k, v in params.items() if k not in NO_EFFECT}
    if p.pop("criterion", "mse") not in SQUARED:
        raise ValueError(f"criterion has no form but {sorted(SQUARED)}")

    def number(value, least):
        count = math.ceil(value * rows) if isinstance(value, float) and value < 1 else int(value)
        if count < least:
            raise ValueError(f"too small a number of rows: {value!r}")
        return count

    depth, leaves = p.get("max_depth"), p.get("max_leaf_nodes")
    if leaves is not None and leaves < 2 or depth is not None and depth < 1:
        raise ValueError("a tree needs two leaves")
    share = float(p.get("min_weight_fraction_leaf", 0.0))
    rules = Rules(
        max_leaves=None if leaves is None else int(leaves), max_depth=None if depth is None else int(depth),
        min_rows=max(number(p.get("min_samples_leaf", 1), 1), math.ceil(share * rows)), min_split=number(p.get("min_samples_split", 2), 2),
        min_gain=float(p.get("min_impurity_decrease", 0.0)) * rows, min_impurity=p.get("min_impurity_split"))
    subset = p.get("max_features")
    if subset not in (None, "auto", 1.0):
        raise ValueError("a single tree takes all features")
    return rules, int(p.get("max_bins", 256)), None


def fit_leafwise(rows: DataFrame, bins: Bins, params: Mapping, gradients=label_gradients) -> BoostedModel:
    """A best-first tree over ``binned`` rows, as a model of one tree."""
    rules, _, features = leafwise_rules(params, rows.count(), len(bins.features))
    return BoostedModel(bins, 0.0, [grow(rows, bins, rules, gradients, features)], [1.0])


def fit_tree(df: DataFrame, features: Sequence[str], label: str, kind: str, params: Mapping | None = None, seed: int = 0):
    """Fitted model; apply it with ``predict``. A decision tree with a bound on its leaves has that bound."""
    if kind == "decision_tree" and leafwise(params):
        bins = fit_bins(df, features, leafwise_rules(params, 1 << 40, len(features))[1])
        with binned(df, bins, label) as rows:
            return fit_leafwise(rows, bins, params)
    if kind == "gradient_boosting" and boosted(params):
        return boosting.fit_boosting(df, features, label, {"random_state": seed, **params})
    with kept(assemble(df, features, label)) as ready:
        return tree_estimator(kind, params, seed=seed).fit(ready)


def predict(model, df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Kept columns and ``prediction`` of a model of either kind; incomplete rows are left out."""
    if isinstance(model, BoostedModel):
        rows = df.dropna(subset=[f for f in features])
        return model.transform(rows).select(*[q(c) for c in keep], "prediction")
    return model.transform(assemble(df, features, None, keep)).select(*[q(c) for c in keep], "prediction")


def drawn_rows(rows: DataFrame, seed: int):
    """Gradients of a regression tree over a bootstrap draw: each row as often as a Poisson number from its hash."""
    def run(batch, codes):
        g, h, _ = label_gradients(batch, codes)
        u = uniform(batch.column("_hash").to_numpy(zero_copy_only=False), seed)
        return g, h, np.searchsorted(POISSON, u, side="right").astype(float)

    return run


def tree_size_search(
    df: DataFrame, features: Sequence[str], label: str, kind: str = "decision_tree",
    sizes: Sequence[int] = tuple(range(10, 2000, 10)), train: str = "is_train", params: Mapping | None = None, seed: int = 0,
) -> DataFrame:
    """Hold-out MAE per number of leaves, best first: size, leaves (of the grown tree at most) and mae.

    A best-first tree of the greatest size holds all smaller ones, so there is one growth for a tree, or one for each tree
    of a forest ('random_forest' with ``n_estimators``, drawn by hashes), and one scan of the held-out rows.
    """
    if kind not in ("decision_tree", "random_forest"):
        raise ValueError(f"sizes are searched for trees and forests, not {kind}")
    params = dict(params or {})
    n_trees = int(params.pop("n_estimators", 10)) if kind == "random_forest" else 1
    bins = fit_bins(df.where(q(train)), features, leafwise_rules(params, 1 << 40, len(features))[1])
    with binned(df, bins, label, keep=[train]) as rows:
        trained = rows.where(q(train))
        rules, _, _ = leafwise_rules({**params, "max_leaf_nodes": max(2, *sizes)}, trained.count(), len(features))
        trees = [grow(trained, bins, rules, drawn_rows(rows, seed + i) if kind == "random_forest" else label_gradients) for i in range(n_trees)]
        mae = errors_by_size(rows.where(~q(train)), bins, trees, sizes)
    most = max(t.leaves for t in trees)
    rows = [(int(s), min(int(s), most), mae[s]) for s in sizes]
    return df.sparkSession.createDataFrame(rows, "size int, leaves int, mae double").orderBy("mae", "size")
