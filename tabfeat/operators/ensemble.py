"""Averages, boosts and robust fits over base regressors."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorSlicer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabfeat.functions.columns import numeric, q
from tabfeat.operators.folds import metric_exprs
from tabfeat.operators.gram import NARROW, Moments, moments, total
from tabfeat.operators.iterate import kept
from tabfeat.operators.linear import SOLVERS, LinearModel, fit_weighted_huber, r2_from, solve, usable
from tabfeat.operators.ranks import exact_quantiles
from tabfeat.operators.search import TREES
from tabfeat.operators.trees import assemble, fit_tree, predict, tree_estimator
from tabfeat.session import cut_lineage

# ---- bagging ---------------------------------------------------------------------------------


def draw_uniform(key: Sequence[str], replica: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by the key and the replica, whatever the partitioning."""
    bits = F.xxhash64(*[q(c) for c in key], replica, F.lit(seed))
    return F.shiftrightunsigned(bits, 11) / F.lit(float(1 << 53))


def _poisson_borders(rate: float) -> list[float]:
    """Where the uniform draw gives one more: the distribution function at 0, 1, ..."""
    p, cumulative, k = math.exp(-rate), 0.0, 0
    borders = []
    while cumulative + p < 1 - 1e-12 and k < 60:
        cumulative += p
        borders.append(cumulative)
        k += 1
        p *= rate / k
    return borders


def poisson_weight(u: Column, rate: float) -> Column:
    """Poisson count of the uniform draw: how often a bootstrap sample of this rate takes the row."""
    out = F.lit(0.0)
    for i, border in enumerate(_poisson_borders(rate)):
        out = F.when(u >= border, F.lit(float(i + 1))).otherwise(out)
    return out


@dataclass
class Average:
    """Mean of several models; linear members are one expression, tree members one projection each."""

    models: list
    features: list[str]
    weight: Callable[[Column], Column] | None = None

    def members(self, df: DataFrame, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
        """Kept columns and a prediction column for each member, and their names."""
        names = [f"_p{i}" for i in range(len(self.models))]
        if isinstance(self.models[0], LinearModel):
            found = df.select(*[q(c) for c in keep], *[m.predict(df).alias(n) for m, n in zip(self.models, names)])
            return found.dropna(subset=names), names
        rows = assemble(df, self.features, None, keep)
        for n, m in zip(names, self.models):
            rows = m.setPredictionCol(n).transform(rows)
        return rows, names

    def predict(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        if isinstance(self.models[0], LinearModel):
            mean = sum((m.predict(df) for m in self.models), F.lit(0.0)) / len(self.models)
            return df.select(*[q(c) for c in keep], mean.alias("prediction"))
        rows, names = self.members(df, keep)
        mean = sum((F.col(n) for n in names), F.lit(0.0)) / len(names)
        return rows.select(*[q(c) for c in keep], mean.alias("prediction"))


Draw = Callable[[Column], Column]


def replica_moments(
    df: DataFrame, cols: Sequence[str], weights: Column, replicas: int, borders: Sequence[float] | None = None,
) -> list[Moments]:
    """Moments of the rows under each of the weights in an array column, from one scan; a row is not copied per replica.

    With ``borders`` a weight is how many of them do not exceed the number in the array. A task multiplies each batch by the weights of one replica after the other and sends one row of sums a replica.
    """
    cols, p = list(cols), len(cols)
    x = [numeric(df, c).cast("double") for c in cols]
    row = df.select(*[F.avg(v).alias(f"x{i}") for i, v in enumerate(x)]).first()
    centre = np.array([0.0 if v is None else v for v in row])
    work = df.select(weights.alias("w"), *[(v - F.lit(float(c))).alias(f"x{i}") for i, (v, c) in enumerate(zip(x, centre))]).dropna()

    def multiply(batches):
        out = np.zeros((replicas, 1 + p + p * p))
        for batch in batches:
            w = batch.column("w").flatten().to_numpy(zero_copy_only=False).reshape(-1, replicas)
            if borders is not None:
                w = np.searchsorted(borders, w, side="right").astype(float)
            block = np.column_stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(p)])
            if p <= NARROW:  # one product for all replicas
                products = (block[:, :, None] * block[:, None]).reshape(len(block), p * p)
                out += w.T @ np.concatenate([np.ones((len(block), 1)), block, products], axis=1)
                continue
            for k in range(replicas):
                scaled = block * w[:, k:k + 1]
                out[k] += np.concatenate([[w[:, k].sum()], scaled.sum(axis=0), (scaled.T @ block).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicas)), pa.array(out.tolist(), pa.list_(pa.float64()))], ["k", "s"])

    summed = work.mapInArrow(multiply, "k long, s array<double>").select("k", F.posexplode("s")).groupBy("k", "pos").agg(F.sum("col").alias("v"))
    table = np.zeros((replicas, 1 + p + p * p))
    for r in summed.collect():  # replicas x columns² sums
        table[r["k"], r["pos"]] = r["v"]
    return [Moments(cols, centre, t[0], t[1:1 + p], t[1 + p:].reshape(p, p)) for t in table]


def bagging(
    df: DataFrame, key: Sequence[str], features: Sequence[str], label: str, family: str = "ridge",
    params: Mapping | None = None, n_estimators: int = 10, max_samples: float = 1.0, max_features: float = 1.0,
    bootstrap: bool = True, seed: int = 0, draw: Draw | None = None,
) -> Average:
    """Base models on hash-drawn samples of the rows and of the columns.

    Linear bases need one scan for all replicas. ``draw`` may give another number in [0, 1) for a replica than the hash of the
    key. The model remembers its draws, so ``oob_score`` can replay them.
    """
    features, params = list(features), dict(params or {})
    if not 0 < max_samples <= 1 or not 0 < max_features <= 1:
        raise ValueError("max_samples and max_features are shares in (0, 1]")
    rng = np.random.default_rng(seed)
    width = max(1, int(round(max_features * len(features))))
    subsets = [sorted(rng.choice(len(features), width, replace=False).tolist()) for _ in range(n_estimators)]

    def uniform(replica: Column) -> Column:
        return draw(replica) if draw else draw_uniform(key, replica, seed)

    def weight(replica: Column) -> Column:
        return poisson_weight(uniform(replica), max_samples) if bootstrap else (uniform(replica) < max_samples).cast("double")

    if family in SOLVERS:
        # the draws travel as they are: the weight as a column would draw anew in each of its tests
        drawn = [F.coalesce(uniform(F.lit(i)), F.lit(-1.0)) if bootstrap else weight(F.lit(i)) for i in range(n_estimators)]
        rows = df.select(*[numeric(df, f).alias(f"x{i}") for i, f in enumerate(features)], numeric(df, label).alias("y"), F.array(*drawn).alias("w"))
        parts = replica_moments(rows, [*[f"x{i}" for i in range(len(features))], "y"], F.col("w"), n_estimators,
                                _poisson_borders(max_samples) if bootstrap else None)
        models = []
        for part, chosen in zip(parts, subsets):
            if part.n <= 0:
                raise ValueError("a replica has drawn no row")
            found = solve(family, part.of([*[f"x{j}" for j in chosen], "y"]), params)
            models.append(LinearModel([features[j] for j in chosen], found.coef, found.intercept))
        return Average(models, features, weight)
    models = []
    with kept(assemble(df, features, label, keep=key)) as ready:
        for i in range(n_estimators):
            drawn = ready.withColumn("_w", weight(F.lit(i))).where("_w > 0")
            if width < len(features):
                slicer = VectorSlicer(inputCol="features", outputCol="_s", indices=subsets[i])
                drawn = slicer.transform(drawn).drop("features").withColumnRenamed("_s", "features")
            models.append((tree_estimator(family, params, weight="_w", seed=seed + i).fit(drawn), subsets[i]))
    if width == len(features):
        return Average([m for m, _ in models], features, weight)
    return SlicedAverage(models, features, weight)


def oob_predictions(model: Average | SlicedAverage, df: DataFrame, key: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Kept columns and ``prediction``: the mean of the members that did not draw the row; rows that all have drawn are left out."""
    columns = list(dict.fromkeys([*keep, *key]))
    rows, names = model.members(df, columns)
    missed = [model.weight(F.lit(i)) == 0 for i in range(len(names))]
    total = sum((F.when(out, F.col(n)).otherwise(0.0) for out, n in zip(missed, names)), F.lit(0.0))
    count = sum((out.cast("int") for out in missed), F.lit(0))
    return rows.select(*[q(c) for c in keep], total.alias("_t"), count.alias("_c")).where("_c > 0").select(
        *[q(c) for c in keep], (F.col("_t") / F.col("_c")).alias("prediction"))


def oob_score(model: Average | SlicedAverage, df: DataFrame, key: Sequence[str], label: str) -> tuple[int, float]:
    """Rows that some member has not drawn, and the R2 of the out-of-bag predictions on them."""
    named = df.withColumn("_label", numeric(df, label).cast("double"))
    r = oob_predictions(model, named, key, ["_label"]).agg(*metric_exprs(F.col("_label"), F.col("prediction"))).first()
    return r["n"], r["r2"]


@dataclass
class SlicedAverage:
    """Mean of tree models that each see some of the features."""

    models: list
    features: list[str]
    weight: Callable[[Column], Column] | None = None

    def members(self, df: DataFrame, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
        rows = assemble(df, self.features, None, keep)
        for i, (m, subset) in enumerate(self.models):
            rows = VectorSlicer(inputCol="features", outputCol=f"_s{i}", indices=subset).transform(rows)
            rows = m.setFeaturesCol(f"_s{i}").setPredictionCol(f"_p{i}").transform(rows)
        return rows, [f"_p{i}" for i in range(len(self.models))]

    def predict(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        rows, names = self.members(df, keep)
        mean = sum((F.col(n) for n in names), F.lit(0.0)) / len(self.models)
        return rows.select(*[q(c) for c in keep], mean.alias("prediction"))


# ---- boosting --------------------------------------------------------------------------------

CHECKPOINT_EVERY = 5


@dataclass
class WeightedMedian:
    """Boosted models; the prediction is the weighted median of theirs."""

    models: list
    weights: list[float]
    features: list[str]

    def predict(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        rows, _ = Average(self.models, self.features).members(df, keep)
        pairs = F.array_sort(F.array(*[
            F.struct(F.col(f"_p{i}").alias("p"), F.lit(float(w)).alias("w")) for i, w in enumerate(self.weights)
        ]))
        half = 0.5 * sum(self.weights)
        start = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("p"))

        def step(acc, x):
            seen = acc["seen"] + x["w"]
            found = F.when(acc["p"].isNull() & (seen >= half - 1e-12), x["p"]).otherwise(acc["p"])
            return F.struct(seen.alias("seen"), found.alias("p"))

        median = F.aggregate(pairs, start, step, lambda acc: acc["p"])
        return rows.select(*[q(c) for c in keep], median.alias("prediction"))


def adaboost_r2(
    df: DataFrame, features: Sequence[str], label: str, family: str = "decision_tree", params: Mapping | None = None,
    n_estimators: int = 50, learning_rate: float = 1.0, loss: str = "linear", seed: int = 0,
) -> WeightedMedian:
    """AdaBoost.R2 (Drucker 1997) with row weights handed to the base learner: a tree, Huber regression, or a linear family."""
    shape = {"linear": lambda e: e, "square": lambda e: e * e, "exponential": lambda e: 1 - F.exp(-e)}[loss]
    features = list(features)
    if family in TREES:
        ready, inputs = assemble(df, features, label), ["features"]

        def fit(rows, i):
            return tree_estimator(family, {"max_depth": 3, **(params or {})}, weight="_w", seed=seed + i).fit(rows)
    elif family == "huber" or family in SOLVERS:
        ready = df.select(*[numeric(df, f).cast("double").alias(f) for f in features], numeric(df, label).cast("double").alias("label")).dropna()
        inputs = features

        def fit(rows, i):
            if family == "huber":
                return fit_weighted_huber(rows, features, "label", "_w", **usable(fit_weighted_huber, params or {}, ["weight"])).model
            return solve(family, moments(rows, [*features, "label"], weight=F.col("_w"))[None], params or {})
    else:
        raise ValueError(f"boosting needs trees, Huber regression or a linear base, not {family!r}")
    models, weights = [], []
    with kept(ready) as base:
        rows = base.withColumn("_w", F.lit(1.0))
        held = None
        for i in range(n_estimators):
            model = fit(rows, i)
            gap = F.abs(F.col("label") - F.col("prediction"))
            scored = model.transform(rows).select(*[q(c) for c in inputs], "label", "_w", gap.alias("_e"))
            top, mass = scored.agg(F.max("_e"), F.sum("_w")).first()
            e = shape(F.col("_e") / F.lit(top)) if top else F.lit(0.0)
            error = scored.agg(F.sum(F.col("_w") * e)).first()[0] / mass if top else 0.0
            if error >= 0.5 and models:
                break
            models.append(model)
            beta = error / (1 - error) if error < 0.5 else 1.0
            weights.append(learning_rate * math.log(1 / beta) if 0 < beta < 1 else 1.0)
            if not 0 < beta < 1 or i + 1 == n_estimators:
                break
            # the worst row keeps its weight, the others lose some; all are brought back to mean one at every checkpoint
            raised = F.col("_w") * F.pow(F.lit(beta), (1 - e) * learning_rate)
            rows = scored.select(*[q(c) for c in inputs], "label", raised.alias("_w"))
            if (i + 1) % CHECKPOINT_EVERY == 0:
                mean = rows.agg(F.avg("_w")).first()[0]
                rows = cut_lineage(rows.withColumn("_w", F.col("_w") / F.lit(mean)))
            else:
                rows = rows.persist()
            if held is not None:
                held.unpersist()
            held = rows
        if held is not None:
            held.unpersist()
    return WeightedMedian(models, weights, list(features))


# ---- consensus -------------------------------------------------------------------------------


@dataclass
class Consensus:
    model: LinearModel
    inliers: int
    threshold: float
    trials: int = 0

    def is_inlier(self, df: DataFrame, label: str) -> Column:
        return F.abs(numeric(df, label) - self.model.predict(df)) <= self.threshold


def ransac(
    df: DataFrame, key: Sequence[str], features: Sequence[str], label: str, min_samples: int | float | None = None,
    residual_threshold: float | None = None, max_trials: int = 100, loss: str = "absolute_loss", seed: int = 0, family: str = "linear",
    params: Mapping | None = None, stop_n_inliers: float = math.inf, stop_score: float = math.inf, stop_probability: float = 0.99,
    draw: Draw | None = None,
) -> Consensus:
    """A linear family on the largest consensus of randomly drawn fits.

    Trial samples of a number of rows are the rows of smallest hash, a bounded number; those of a share are drawn by a hash
    for each trial, and fitted from moments of one scan. All fits are judged in one pass; the trials are then gone through in
    their order, and end where enough rows agree, or where so many trials would have met a sample of inliers alone with
    ``stop_probability``. ``draw`` may give another number in [0, 1) for a trial than the hash of the key.
    """
    features = list(features)
    p = len(features)
    if family not in SOLVERS:
        raise ValueError(f"consensus needs a linear family, not {family!r}")
    if min_samples is not None and (min_samples <= 0 or isinstance(min_samples, float) and min_samples > 1 and min_samples != int(min_samples)):
        raise ValueError("min_samples is a share in (0, 1] or a number of rows")
    if not 0 <= stop_probability <= 1:
        raise ValueError("stop_probability must lie between 0 and 1")
    share = float(min_samples) if isinstance(min_samples, float) and min_samples <= 1 else None
    size = p + 1 if min_samples is None else int(min_samples) if share is None else None
    rows = df.select(*[numeric(df, f).alias(f"x{i}") for i, f in enumerate(features)], numeric(df, label).alias("y"),
                     *[q(k) for k in key]).dropna()
    if residual_threshold is None:  # median absolute deviation of the label
        mid = exact_quantiles(rows, ["y"], [0.5])["y"][0]
        spread = rows.select(F.abs(F.col("y") - mid).alias("d"))
        residual_threshold = exact_quantiles(spread, ["d"], [0.5])["d"][0]
    names = [f"x{i}" for i in range(p)]
    fits = []
    if share is not None:
        chosen = F.array(*[((draw(F.lit(t)) if draw else draw_uniform(key, F.lit(t), seed)) < share).cast("double") for t in range(max_trials)])
        parts = [m for m in replica_moments(rows.withColumn("_w", chosen), [*names, "y"], F.col("_w"), max_trials) if m.n > p]
    else:
        drawn = rows.orderBy(F.xxhash64(*[q(k) for k in key], F.lit(seed)), *[q(k) for k in key]).limit(size * max_trials)
        pool = np.array([tuple(r) for r in drawn.select(*names, "y").collect()]).reshape(-1, p + 1)  # size x trials rows
        parts = [_small_moments([*names, "y"], pool[t * size:(t + 1) * size]) for t in range(min(max_trials, len(pool) // size))]
    for m in parts:
        found = solve(family, m, params or {})
        fits.append(np.append(found.coef, found.intercept))
    if not fits:
        raise ValueError("fewer rows than min_samples")
    coef = np.array(fits).T  # (p + 1) x trials
    limit = residual_threshold if loss == "absolute_loss" else math.sqrt(residual_threshold)

    def judge(batches):
        out = np.zeros((coef.shape[1], 4))
        for b in batches:
            x = np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(p + 1)])
            y = x[:, p]
            r = y[:, None] - x[:, :p] @ coef[:p] - coef[p]
            ok = np.abs(r) <= limit
            out += np.column_stack([ok.sum(0), (ok * y[:, None]).sum(0), (ok * y[:, None] ** 2).sum(0), (ok * r * r).sum(0)])
        trials = np.arange(coef.shape[1], dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(trials), *[pa.array(c) for c in out.T]], names=["t", "n", "sy", "syy", "sse"])

    judged = rows.select(*names, "y").mapInArrow(judge, "t int, n double, sy double, syy double, sse double")
    table = judged.groupBy("t").agg(*[F.sum(c).alias(c) for c in ("n", "sy", "syy", "sse")]).collect()

    def r2(r):
        spread = r["syy"] - r["sy"] ** 2 / r["n"] if r["n"] else 0.0
        return 1 - r["sse"] / spread if spread > 0 else -math.inf

    everyone, by_trial = float(rows.count()), {r["t"]: r for r in table}
    best, tried, enough = None, 0, float(len(fits))
    while tried < min(enough, len(fits)):
        r = by_trial[tried]
        tried += 1
        if not r["n"] or best is not None and (r["n"], r2(r)) <= (best["n"], r2(best)):
            continue
        best = r
        enough = min(enough, trials_needed(best["n"] / everyone, share * everyone if share is not None else size, stop_probability))
        if best["n"] >= stop_n_inliers or r2(best) >= stop_score:
            break
    if best is None:
        raise ValueError("no inliers for any trial")
    start = LinearModel(names, [float(w) for w in coef[:p, best["t"]]], float(coef[p, best["t"]]))
    inside = rows.where(F.abs(F.col("y") - start.predict(rows)) <= limit)
    final = solve(family, moments(inside, [*names, "y"])[None], params or {})
    return Consensus(LinearModel(features, final.coef, final.intercept), int(best["n"]), limit, tried)


def _small_moments(cols: Sequence[str], rows: np.ndarray) -> Moments:
    centre = rows.mean(axis=0)
    return Moments(list(cols), centre, float(len(rows)), (rows - centre).sum(axis=0), (rows - centre).T @ (rows - centre))


def trials_needed(inliers: float, size: float, probability: float) -> float:
    """Trials after which a sample of inliers alone has been met with that probability, at this share of inliers."""
    if probability <= 0:
        return 0.0
    clean = inliers ** size
    if probability >= 1 or clean <= 0:
        return math.inf if clean < 1 else 0.0
    return 0.0 if clean >= 1 else math.ceil(math.log(1 - probability) / math.log1p(-clean))


# ---- weighted voting -------------------------------------------------------------------------


def blend(columns: Mapping[str, float]) -> Column:
    """Weighted mean of prediction columns."""
    whole = sum(columns.values())
    if whole == 0:
        raise ValueError("all weights are zero")
    return sum((q(c) * F.lit(w / whole) for c, w in columns.items()), F.lit(0.0))


def weight_grid(models: int, steps: int = 10) -> list[tuple[float, ...]]:
    """Every weight vector over 0, 0.1 .. 1 except the zero vector."""
    values = [i / steps for i in range(steps + 1)]
    return [w for w in itertools.product(values, repeat=models) if any(w)]


def search_weights(
    df: DataFrame, predictions: Sequence[str], label: str, fold: str, weights: Sequence[Sequence[float]]
) -> DataFrame:
    """Mean and deviation over folds of the R2 of every weight vector, from one scan of the predictions."""
    parts = moments(df, [*predictions, label], by=fold)
    w = np.asarray(weights, dtype=float)
    w = w / w.sum(1, keepdims=True)
    v = np.column_stack([-w, np.ones(len(w))])
    scores = []
    for m in parts.values():
        sse = np.einsum("ij,jk,ik->i", v, m.scatter, v) + m.n * (v @ m.mean) ** 2
        scores.append([r2_from(e, m) for e in sse])
    scores = np.array(scores)
    rows = [([float(x) for x in given], float(a), float(b))
            for given, a, b in zip(weights, scores.mean(0), scores.std(0))]
    board = df.sparkSession.createDataFrame(rows, "weights array<double>, mean_score double, std_score double")
    return board.orderBy(F.desc("mean_score"), "weights")


@dataclass
class Voting:
    """``folded``: the kept key, fold, label and an out-of-fold column for each member, written once; ``board`` of the weights;
    the members refitted on all rows, and the best weights."""

    folded: DataFrame
    board: DataFrame
    models: dict
    weights: dict[str, float]
    features: dict[str, list[str]]

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        """key and prediction: the weighted mean of the members."""
        rows = df
        for name, model in self.models.items():
            if isinstance(model, LinearModel):
                rows = rows.withColumn(name, model.predict(rows))
            else:
                found = predict(model, df, self.features[name], [key]).withColumnRenamed("prediction", name)
                rows = rows.join(found, key)
        return rows.select(q(key), blend(self.weights).alias("prediction"))


def fit_voting(df: DataFrame, members: Mapping[str, tuple[str, Mapping, Sequence[str]]], label: str, key: str, fold: str = "fold",
               weights: Sequence[Sequence[float]] | None = None) -> Voting:
    """Members (family, parameters, features) fitted without each fold in turn, then weights searched on what they say of it.

    Linear members of all folds come from one scan of moments; others are fitted fold by fold. ``weights`` are all vectors over
    0, 0.1 .. 1 if not given. Rows with a missing value in any member are left out.
    """
    names = list(members)
    used = list(dict.fromkeys(f for _, _, features in members.values() for f in features))
    rows = df.dropna(subset=[*used, label, fold])
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect())
    linear = {n: m for n, m in members.items() if m[0] in SOLVERS}
    parts = moments(rows, [*dict.fromkeys(f for _, _, fs in linear.values() for f in fs), label], by=fold) if linear else {}
    whole = total(parts) if parts else None
    columns, models = {}, {}
    for n, (family, params, features) in linear.items():
        out = F.lit(None).cast("double")
        for k in folds:
            held = solve(family, (whole - parts[k]).of([*features, label]), params)
            out = F.when(q(fold) == F.lit(k), held.predict(rows)).otherwise(out)
        columns[n], models[n] = out, solve(family, whole.of([*features, label]), params)
    table = rows.select(q(key), q(fold).alias("fold"), numeric(rows, label).cast("double").alias("label"), *[c.alias(n) for n, c in columns.items()])
    for n, (family, params, features) in members.items():
        if n in linear:
            continue
        said = None
        for k in folds:
            model = fit_tree(rows.where(q(fold) != F.lit(k)), features, label, family, params)
            part = predict(model, rows.where(q(fold) == F.lit(k)), features, [key]).withColumnRenamed("prediction", n)
            said = part if said is None else said.unionByName(part)
        table, models[n] = table.join(said, key), fit_tree(rows, features, label, family, params)
    folded = cut_lineage(table)
    board = search_weights(folded, names, "label", "fold", weights if weights is not None else weight_grid(len(names)))
    best = board.orderBy(F.desc("mean_score"), "weights").first()["weights"]
    return Voting(folded, board, models, dict(zip(names, best)), {n: list(m[2]) for n, m in members.items()})
