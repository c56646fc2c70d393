"""Gradient boosting over histogram trees: second order with regularised leaves, robust losses, dropout, gradient-based
sampling and early stopping.

The rows are binned and cached once. Every round is a few jobs over them: the histograms of a tree's levels, and for robust
losses the exact quantiles of the residuals per leaf. Rows carry their prediction, which takes in the trees of the last
rounds every few rounds; in between, tasks add those trees themselves. Draws come from a hash of the row's values, so a fit
does not depend on the partitioning; equal rows are drawn alike.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tabfeat.functions.columns import numeric, q
from tabfeat.operators.growth import Bins, Rules, Tree, binned, codes_of, fit_bins, grow
from tabfeat.operators.ranks import exact_quantiles, grouped_quantiles

#: Rounds after which the trees since then go into the rows' prediction.
REFRESH = 8

LOSSES = ("squared", "absolute", "huber", "quantile")

# Losses as users write them.
LOSS_NAMES = {"ls": "squared", "least_squares": "squared", "squared_error": "squared", "lad": "absolute", "absolute_error": "absolute",
              "huber": "huber", "quantile": "quantile"}


@dataclass(frozen=True)
class Plan:
    """One boosting fit. ``alpha`` is the quantile of the quantile loss, and of the residuals that bound the Huber loss.

    ``drop_rate`` > 0 is boosting with dropout; ``top_rate`` + ``other_rate`` < 1 samples by gradients; ``stop_after`` rounds
    without a loss better by ``tolerance`` on the hashed ``validation`` share, or on the rows where the boolean column
    ``held`` is true, end the fit at the best round.
    """

    loss: str = "squared"
    rounds: int = 100
    rate: float = 0.1
    rules: Rules = Rules(max_leaves=None, max_depth=3)
    alpha: float = 0.9
    base: float | None = None
    subsample: float = 1.0
    features: float | int = 1.0
    drop_rate: float = 0.0
    most_dropped: int = 50
    skip_drop: float = 0.0
    top_rate: float = 1.0
    other_rate: float = 0.0
    validation: float = 0.0
    held: str | None = None
    stop_after: int | None = None
    tolerance: float = 1e-7
    seed: int = 0

    def __post_init__(self):
        if self.loss not in LOSSES:
            raise ValueError(f"unknown loss {self.loss!r}; known are {LOSSES}")
        for name, low, high in (("alpha", 0, 1), ("subsample", 0, 1), ("top_rate", 0, 1), ("other_rate", 0, 1), ("validation", 0, 1), ("drop_rate", 0, 1)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie between {low} and {high}")
        if not self.rate > 0 or self.subsample == 0:
            raise ValueError("learning rate and subsample must be above 0")
        if self.stop_after is not None and not 0 < self.validation < 1 and self.held is None:
            raise ValueError("early stopping needs a validation share")


@dataclass
class BoostedModel:
    """base + sum of weights[i] * trees[i]; ``losses`` has the validation loss before the first and after every round, if any."""

    bins: Bins
    base: float
    trees: list[Tree] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def margin(self, codes: np.ndarray, first: int = 0, without: Sequence[int] = ()) -> np.ndarray:
        """The sum of the trees from ``first`` on, without some."""
        out = np.zeros(len(codes))
        for i in range(first, len(self.trees)):
            if i not in without:
                out += self.weights[i] * self.trees[i].predict(codes)
        return out

    def predict_binned(self, rows: DataFrame) -> DataFrame:
        """``binned`` rows with ``prediction``."""
        def run(batches):
            for batch in batches:
                found = self.base + self.margin(codes_of(batch, self.bins)) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "prediction"])

        return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("prediction", DoubleType())]))

    def transform(self, df: DataFrame) -> DataFrame:
        """All columns of ``df`` and ``prediction``; null where a feature is missing."""
        names = [f"_x{i}" for i in range(len(self.bins.features))]
        fields = df.schema.fields

        def run(batches):
            for batch in batches:
                columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
                found = self.base + self.margin(self.bins.codes(columns)) if batch.num_rows else np.zeros(0)
                missing = np.isnan(np.column_stack(columns)).any(axis=1) if names else np.zeros(batch.num_rows, bool)
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(fields))], pa.array(found, pa.float64(), mask=missing)],
                                                 [*[f.name for f in fields], "prediction"])

        ready = df.select(*[q(c) for c in df.columns], *[numeric(df, f).cast("double").alias(n) for f, n in zip(self.bins.features, names)])
        return ready.mapInArrow(run, StructType([*fields, StructField("prediction", DoubleType())]))


def uniform(hashes: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each row and seed, from the row's hash."""
    x = hashes.view(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(float) / (1 << 53)


#: Seeds of the draws: validation share, and of each round its rows, its rest by gradient and its features.
_HELD, _ROWS, _REST = 0, 1, 2


def _seed(plan: Plan, kind: int, round_: int = 0) -> int:
    return plan.seed * 1_000_003 + round_ * 4 + kind


def _held(batch: pa.RecordBatch, plan: Plan) -> np.ndarray:
    if plan.held is not None:
        return batch.column(plan.held).fill_null(False).to_numpy(zero_copy_only=False)
    return uniform(batch.column("_hash").to_numpy(zero_copy_only=False), _seed(plan, _HELD)) < plan.validation


def _negative_gradient(plan: Plan, residual: np.ndarray, delta: float) -> np.ndarray:
    if plan.loss == "squared":
        return residual
    if plan.loss == "absolute":
        return np.sign(residual)
    if plan.loss == "huber":
        return np.clip(residual, -delta, delta)
    return np.where(residual > 0, plan.alpha, plan.alpha - 1.0)


def _loss(plan: Plan, residual: np.ndarray, delta: float) -> np.ndarray:
    size = np.abs(residual)
    if plan.loss == "squared":
        return residual ** 2 / 2
    if plan.loss == "absolute":
        return size
    if plan.loss == "huber":
        return np.where(size <= delta, residual ** 2 / 2, delta * (size - delta / 2))
    return np.where(residual > 0, plan.alpha, plan.alpha - 1.0) * residual


@dataclass
class _View:
    """What a task needs to know of a fit: the plan, the model so far, and the first tree that the rows' margin lacks."""

    plan: Plan
    model: BoostedModel
    first: int

    def residual(self, batch: pa.RecordBatch, codes: np.ndarray, without: Sequence[int] = ()) -> np.ndarray:
        label, margin = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "margin"))
        return label - margin - self.model.margin(codes, self.first, without)


class _State:
    """The cached rows with their ``margin``, and the trees that it does not hold yet."""

    def __init__(self, rows: DataFrame, plan: Plan, model: BoostedModel):
        self.rows, self.plan, self.model, self.held_trees = rows.withColumn("margin", F.lit(model.base)), plan, model, 0
        self.cached: DataFrame | None = None

    @property
    def view(self) -> _View:
        return _View(self.plan, self.model, self.held_trees)

    def refresh(self) -> None:
        """Takes the trees so far into the margin; not with dropout, which changes the weights of trees."""
        if self.plan.drop_rate or len(self.model.trees) - self.held_trees < REFRESH:
            return
        model, first, bins, names = self.model, self.held_trees, self.model.bins, self.rows.columns

        def run(batches):
            for batch in batches:
                margin = batch.column("margin").to_numpy(zero_copy_only=False)
                margin = margin + (model.margin(codes_of(batch, bins), first) if batch.num_rows else 0)
                yield pa.RecordBatch.from_arrays([pa.array(margin) if n == "margin" else batch.column(n) for n in names], names)

        rows = self.rows.mapInArrow(run, self.rows.schema).persist()
        rows.count()
        self.close()
        self.rows, self.cached, self.held_trees = rows, rows, len(model.trees)

    def close(self) -> None:
        if self.cached is not None:
            self.cached.unpersist()

    def residuals(self, leaf_of: Tree | None = None, without: Sequence[int] = ()) -> DataFrame:
        """``r`` and, if asked for, ``leaf`` of the training rows."""
        view = self.view

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                codes = codes_of(batch, view.model.bins)
                use = ~_held(batch, view.plan)
                leaf = leaf_of.node_of(codes) if leaf_of else np.zeros(len(codes), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(leaf[use].astype(np.int32)), pa.array(view.residual(batch, codes, without)[use])], ["leaf", "r"])

        return self.rows.mapInArrow(run, "leaf int, r double")

    def validation_loss(self, delta: float) -> float:
        view = self.view

        def run(batches):
            total, n = 0.0, 0
            for batch in batches:
                if batch.num_rows:
                    use, residual = _held(batch, view.plan), view.residual(batch, codes_of(batch, view.model.bins))
                    total, n = total + _loss(view.plan, residual[use], delta).sum(), n + int(use.sum())
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([n], pa.int64())], ["total", "n"])

        parts = self.rows.mapInArrow(run, "total double, n long").collect()  # one row a task
        n = sum(p["n"] for p in parts)
        return math.fsum(p["total"] for p in parts) / n if n else math.nan

    def gradients(self, delta: float, round_: int, without: Sequence[int], large: float | None):
        """Gradient, Hessian and weight of each row; rows below the ``large`` gradient are drawn and weighed up."""
        plan, view = self.plan, self.view

        def run(batch, codes):
            residual, hashes = view.residual(batch, codes, without), batch.column("_hash").to_numpy(zero_copy_only=False)
            down = _negative_gradient(plan, residual, delta)
            weight = (~_held(batch, plan)).astype(float)
            if plan.subsample < 1:
                weight *= uniform(hashes, _seed(plan, _ROWS, round_)) < plan.subsample
            if large is not None:
                rest = np.abs(down) < large
                drawn = uniform(hashes, _seed(plan, _REST, round_)) < plan.other_rate / (1 - plan.top_rate)
                weight *= np.where(rest, drawn * (1 - plan.top_rate) / plan.other_rate, 1.0) if plan.other_rate else ~rest
            return -down, np.ones(len(down)), weight

        return run


def _base(rows: DataFrame, plan: Plan, bins: Bins) -> float:
    if plan.base is not None:
        return float(plan.base)
    state = _State(rows, plan, BoostedModel(bins, 0.0))
    labels = state.residuals()
    if plan.loss == "squared":
        return float(labels.agg(F.avg("r")).first()[0] or 0.0)
    return float(exact_quantiles(labels, ["r"], [plan.alpha if plan.loss == "quantile" else 0.5])["r"][0] or 0.0)


def _robust_leaves(state: _State, tree: Tree, delta: float, without: Sequence[int]) -> None:
    """Leaf values from the residuals in each leaf: their quantile, or the Huber step around their median."""
    plan, rows = state.plan, state.residuals(tree, without)
    at = plan.alpha if plan.loss == "quantile" else 0.5
    quantiles = {r["leaf"]: r["quantiles"][0] for r in grouped_quantiles(rows, ["leaf"], "r", [at]).collect()}  # one row a leaf
    if plan.loss == "huber":
        middle = F.create_map(*[F.lit(x) for pair in quantiles.items() for x in pair])[F.col("leaf")]
        step = F.least(F.greatest(F.col("r") - middle, F.lit(-delta)), F.lit(delta))
        quantiles = {r["leaf"]: quantiles[r["leaf"]] + r["s"] for r in rows.groupBy("leaf").agg(F.avg(step).alias("s")).collect()}
    for leaf, value in quantiles.items():
        tree.value[leaf] = float(value)


def _dropped(plan: Plan, trees: int, draw: np.random.Generator) -> list[int]:
    """Trees left out in this round; at least one unless the round skips dropout."""
    if not plan.drop_rate or not trees or draw.random() < plan.skip_drop:
        return []
    chosen = np.flatnonzero(draw.random(trees) < plan.drop_rate).tolist()
    return sorted(draw.permutation(chosen or [int(draw.integers(trees))])[:plan.most_dropped].tolist())


def _chosen_features(plan: Plan, n: int, draw: np.random.Generator) -> list[int] | None:
    count = plan.features if isinstance(plan.features, int) and not isinstance(plan.features, bool) else math.ceil(plan.features * n)
    return None if count >= n else sorted(draw.choice(n, max(1, count), replace=False).tolist())


def fit_binned(rows: DataFrame, bins: Bins, plan: Plan) -> BoostedModel:
    """The model of a plan over ``binned`` rows."""
    model = BoostedModel(bins, _base(rows, plan, bins))
    state, draw, best = _State(rows, plan, model), np.random.default_rng(plan.seed), 0
    try:
        delta = math.inf
        for k in range(plan.rounds):
            without = _dropped(plan, len(model.trees), draw)
            if plan.loss == "huber":
                spread = state.residuals(without=without).select(F.abs("r").alias("r"))
                delta = float(exact_quantiles(spread, ["r"], [plan.alpha])["r"][0] or 0.0)
            if plan.stop_after is not None and not model.losses:
                model.losses.append(state.validation_loss(delta))
            large = _large_gradient(state, delta, without) if plan.top_rate < 1 else None
            tree = grow(rows=state.rows, bins=bins, rules=plan.rules, gradients=state.gradients(delta, k, without, large),
                        features=_chosen_features(plan, len(bins.features), draw))
            if plan.loss != "squared":
                _robust_leaves(state, tree, delta, without)
            model.trees.append(tree)
            model.weights.append(plan.rate)
            if without:  # the new tree and the dropped ones share the step that both have learned
                model.weights[-1] = plan.rate / (len(without) + plan.rate)
                for i in without:
                    model.weights[i] *= len(without) / (len(without) + plan.rate)
            if plan.stop_after is not None:
                model.losses.append(state.validation_loss(delta))
                if model.losses[-1] < model.losses[best] - plan.tolerance:
                    best = len(model.losses) - 1
                elif len(model.losses) - 1 - best >= plan.stop_after:
                    break
            state.refresh()
    finally:
        state.close()
    if plan.stop_after is not None and not plan.drop_rate:
        model.trees, model.weights = model.trees[:best], model.weights[:best]
    return model


def _large_gradient(state: _State, delta: float, without: Sequence[int]) -> float:
    """The size of gradient from which rows are always taken: its exact quantile."""
    plan = state.plan
    rows = state.residuals(without=without)
    size = F.abs("r")
    if plan.loss == "huber":
        size = F.least(size, F.lit(delta))
    elif plan.loss != "squared":
        return 0.0  # gradients of one or two sizes: nothing to choose by
    return float(exact_quantiles(rows.select(size.alias("r")), ["r"], [1 - plan.top_rate])["r"][0] or 0.0)


# ---- parameters as users write them ----------------------------------------------------------

_SAME = {"n_estimators": "rounds", "max_iter": "rounds", "learning_rate": "rate", "alpha": "alpha", "base_score": "base", "subsample": "subsample",
         "top_rate": "top_rate", "other_rate": "other_rate", "drop_rate": "drop_rate", "rate_drop": "drop_rate", "max_drop": "most_dropped",
         "skip_drop": "skip_drop", "validation_fraction": "validation", "n_iter_no_change": "stop_after", "tol": "tolerance", "random_state": "seed"}
_RULES = {"max_leaf_nodes": "max_leaves", "num_leaves": "max_leaves", "max_leaves": "max_leaves", "max_depth": "max_depth",
          "min_samples_leaf": "min_rows", "min_child_samples": "min_rows", "min_child_weight": "min_hessian", "reg_lambda": "reg_lambda",
          "l2_regularization": "reg_lambda", "reg_alpha": "reg_alpha", "min_split_gain": "min_gain", "min_samples_split": "min_split",
          "min_impurity_split": "min_impurity"}
_INTEGERS = {"rounds", "max_leaves", "max_depth", "min_rows", "most_dropped", "stop_after", "seed", "min_split"}
# Names that only say how a library runs, or what it prints.
QUIET = {"scoring", "n_jobs", "nthread", "verbose", "verbosity", "silent", "warm_start", "presort", "subsample_for_bin", "objective"}
OTHERS = {"loss", "booster", "boosting_type", "gamma", "max_bins", "max_features", "colsample_bytree", "subsample_freq", "criterion"}
NAMES = {*_SAME, *_RULES, *QUIET, *OTHERS}


def unknown_names(params: Mapping) -> None:
    wrong = sorted(set(params) - NAMES)
    if wrong:
        raise ValueError(f"no equivalent for {wrong}")


def plan_of(params: Mapping, n_features: int) -> tuple[Plan, int]:
    """The plan and number of bins of boosting parameters under the names users know; unknown names or values raise."""
    unknown_names(params)
    p = {k: v for k, v in params.items() if k not in QUIET}
    values: dict = {}
    rules: dict = {"max_leaves": None, "max_depth": 3}
    kind = p.pop("boosting_type", None) or p.pop("booster", None) or "gbdt"
    if "boosting_type" in params:
        rules = {"max_leaves": 31, "max_depth": None, "min_rows": 20, "min_hessian": 1e-3}
    elif "booster" in params:
        rules = {"max_leaves": None, "max_depth": 6, "min_hessian": 1.0, "reg_lambda": 1.0}
    elif "max_leaf_nodes" in params or "max_iter" in params:
        rules = {"max_leaves": 31, "max_depth": None, "min_rows": 20}
    if p.pop("booster", None) not in (None, "gbtree", "dart") or p.pop("criterion", "mse") not in ("mse", "friedman_mse", "squared_error"):
        raise ValueError("no such booster or criterion")
    if kind == "dart":
        values["drop_rate"] = 0.1
    elif kind == "goss":
        values |= {"top_rate": 0.2, "other_rate": 0.1}
    elif kind not in ("gbdt", "gbtree"):
        raise ValueError(f"boosting of kind {kind!r} is not built")
    for name, value in list(p.items()):
        target, into = (_SAME[name], values) if name in _SAME else (_RULES[name], rules) if name in _RULES else (None, None)
        if into is None:
            continue
        if target in ("max_depth", "max_leaves") and value in (None, 0, -1):
            value = None
        elif value is None and target in ("stop_after", "base"):
            pass
        elif value is None:
            continue
        elif target == "min_rows" and isinstance(value, float) and value < 1:
            raise ValueError(f"{name} must be a number of rows")
        elif target in _INTEGERS:
            value = int(value)
        into[target] = value
    if rules.get("max_leaves") is not None and rules["max_leaves"] < 2 or rules.get("max_depth") is not None and rules["max_depth"] < 1:
        raise ValueError("a tree needs two leaves")
    if "gamma" in p:
        rules["min_gain"] = 2 * float(p["gamma"])
    if p.get("subsample_freq") == 0:
        values["subsample"] = 1.0
    loss = p.get("loss", "ls")
    if loss not in LOSS_NAMES:
        raise ValueError(f"unknown loss {loss!r}")
    values["loss"] = LOSS_NAMES[loss]
    subset = p.get("max_features", p.get("colsample_bytree"))
    named = {"auto": 1.0, "sqrt": max(1, int(math.sqrt(n_features))), "log2": max(1, int(math.log2(n_features)))}
    if subset is not None:
        if isinstance(subset, str) and subset not in named or not isinstance(subset, str) and not subset > 0:
            raise ValueError(f"no such share of features: {subset!r}")
        values["features"] = named[subset] if isinstance(subset, str) else subset
    if values.get("stop_after") is not None:
        values.setdefault("validation", 0.1)
    else:
        values.pop("validation", None)
    bins = int(p.get("max_bins", 256))
    if not 2 <= bins <= 65_536:
        raise ValueError("max_bins must lie between 2 and 65536")
    return Plan(rules=Rules(**rules), **values), bins


def fit_boosting(df: DataFrame, features: Sequence[str], label: str, params: Mapping | None = None) -> BoostedModel:
    """Bins, cached rows and fit in one go; incomplete rows are left out."""
    plan, max_bins = plan_of(params or {}, len(features))
    bins = fit_bins(df, features, max_bins)
    with binned(df, bins, label) as rows:
        return fit_binned(rows, bins, plan)
