"""Linear regressions solved from second moments; one scan serves every candidate and fold."""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabfeat.functions.columns import numeric
from tabfeat.operators.gram import Moments, moments, total
from tabfeat.operators.iterate import kept


@dataclass(frozen=True)
class LinearModel:
    cols: list[str]
    coef: list[float]
    intercept: float

    def predict(self, df: DataFrame) -> Column:
        out = F.lit(float(self.intercept))
        for c, w in zip(self.cols, self.coef):
            if w != 0:
                out = out + numeric(df, c) * F.lit(float(w))
        return out

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.predict(df))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [("intercept", -1, float(self.intercept))]
        rows += [(c, i, float(w)) for i, (c, w) in enumerate(zip(self.cols, self.coef))]
        spark.createDataFrame(rows, "term string, position int, coef double").coalesce(1).write.mode(
            "overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "LinearModel":
        rows = spark.read.parquet(path).orderBy("position").collect()
        return LinearModel([r["term"] for r in rows[1:]], [r["coef"] for r in rows[1:]], rows[0]["coef"])


# Every solver takes moments whose last column is the label.


def _system(m: Moments, fit_intercept: bool):
    p = len(m.cols) - 1
    s = m.scatter if fit_intercept else m.raw
    return s[:p, :p], s[:p, p], s[p, p]


def _finish(m: Moments, coef: np.ndarray, fit_intercept: bool) -> LinearModel:
    mean = m.mean
    intercept = float(mean[-1] - mean[:-1] @ coef) if fit_intercept else 0.0
    return LinearModel(m.cols[:-1], [float(w) for w in coef], intercept)


def _unit_scale(a: np.ndarray, normalize: bool, fit_intercept: bool) -> np.ndarray:
    """Lengths of the centred columns when the solver is to see them with length one."""
    d = np.ones(len(a))
    if normalize and fit_intercept:
        d = np.sqrt(np.diag(a)).copy()
        d[d == 0] = 1.0
    return d


def solve_ridge(m: Moments, alpha: float = 1.0, fit_intercept: bool = True, normalize: bool = False) -> LinearModel:
    a, b, _yy = _system(m, fit_intercept)
    d = _unit_scale(a, normalize, fit_intercept)
    scaled = a / np.outer(d, d) + alpha * np.eye(len(a))
    coef = (np.linalg.solve(scaled, b / d) if alpha > 0 else np.linalg.pinv(scaled) @ (b / d)) / d
    return _finish(m, coef, fit_intercept)


def solve_ols(m: Moments, fit_intercept: bool = True, normalize: bool = False) -> LinearModel:
    a, b, _yy = _system(m, fit_intercept)
    return _finish(m, np.linalg.pinv(a, hermitian=True) @ b, fit_intercept)


def descend(a: np.ndarray, b: np.ndarray, l1: float, l2: float, positive: bool, max_iter: int, tol: float) -> np.ndarray:
    """Minimise w'aw/2 - b'w + l1*|w| + l2*w'w/2 one coordinate at a time."""
    w = np.zeros(len(b))
    grad = b.copy()  # b - a w
    diag = np.diag(a)
    for _ in range(max_iter):
        step = 0.0
        for j in range(len(b)):
            if diag[j] + l2 == 0:
                continue
            rho = grad[j] + diag[j] * w[j]
            new = max(rho - l1, 0.0) if positive or rho > 0 else min(rho + l1, 0.0)
            new /= diag[j] + l2
            if new != w[j]:
                grad -= a[:, j] * (new - w[j])
                step = max(step, abs(new - w[j]) * math.sqrt(diag[j]))
                w[j] = new
        if step <= tol:
            break
    return w


def solve_elastic_net(
    m: Moments,
    alpha: float = 1.0,
    l1_ratio: float = 0.5,
    fit_intercept: bool = True,
    normalize: bool = False,
    positive: bool = False,
    max_iter: int = 1000,
    tol: float = 1e-4,
) -> LinearModel:
    """Squared error / 2n + alpha * (l1_ratio * L1 + (1 - l1_ratio) * L2 / 2).

    ``tol`` is relative to the spread of the label.
    """
    a, b, yy = _system(m, fit_intercept)
    d = _unit_scale(a, normalize, fit_intercept)
    coef = descend(a / np.outer(d, d), b / d, m.n * alpha * l1_ratio, m.n * alpha * (1 - l1_ratio), positive,
                   max_iter, tol * math.sqrt(max(yy, 1e-300)) * 1e-3)
    return _finish(m, coef / d, fit_intercept)


def solve_lasso(m: Moments, **params) -> LinearModel:
    return solve_elastic_net(m, **{**params, "l1_ratio": 1.0})


def lasso_path(m: Moments, fit_intercept: bool = True, normalize: bool = False, positive: bool = False) -> list[tuple[float, np.ndarray]]:
    """Knots (penalty, coefficients) of the lasso from the least penalty without a coefficient down to none.

    Between knots the coefficients are linear in the penalty, so all penalties are solved at once. A step ends where a
    column outside gets the same correlation as those inside, or where a coefficient comes back to 0.
    """
    a, b, _yy = _system(m, fit_intercept)
    d = _unit_scale(a, normalize, fit_intercept)
    a, b = a / np.outer(d, d), b / d
    live = [j for j in range(len(b)) if a[j, j] > 1e-14 * max(a.max(initial=0.0), 1e-300)]
    w, active, left_out = np.zeros(len(b)), [], None
    level = max([b[j] if positive else abs(b[j]) for j in live], default=0.0)
    start, tiny = level, 1e-11 * max(level, 1e-300)
    knots = [(max(level, 0.0) / m.n, w / d)]
    for _ in range(8 * len(b) + 8):
        if level <= tiny:
            break
        c = b - a @ w
        if not active:
            active.append(max(live, key=lambda j: c[j] if positive else abs(c[j])))
        sign = np.ones(len(active)) if positive else np.sign(c[active])
        way = np.linalg.lstsq(a[np.ix_(active, active)], sign, rcond=None)[0]
        slope = a[:, active] @ way
        step, event = level, None
        for j in live:
            if j in active:
                continue
            for top, bottom in ([(level - c[j], 1 - slope[j])] if positive else [(level - c[j], 1 - slope[j]), (level + c[j], 1 + slope[j])]):
                if bottom > 1e-12 and (found := top / bottom) < step - tiny and (found > tiny or j != left_out):
                    step, event = max(found, 0.0), ("in", j)
        for j, v in zip(active, way):
            if v and tiny < -w[j] / v < step - tiny:
                step, event = -w[j] / v, ("out", j)
        w[active] += step * way
        level -= step
        left_out = None
        if event and event[0] == "in":
            active.append(event[1])
        elif event:
            left_out = event[1]
            active.remove(left_out)
            w[left_out] = 0.0
        if step > tiny or event is None:
            knots.append((max(level, 0.0) / m.n, w / d))
    return knots if start > 0 else knots[:1]


def on_path(knots: list[tuple[float, np.ndarray]], alpha: float) -> np.ndarray:
    """Coefficients at a penalty: linear between knots."""
    levels = np.array([k[0] for k in knots])[::-1]
    coefs = np.array([k[1] for k in knots])[::-1]
    return np.array([np.interp(alpha, levels, coefs[:, j]) for j in range(coefs.shape[1])])


@dataclass
class PathSearch:
    """``board``: alpha, mean_mse and std_mse over folds, best first; the model at the best penalty on all rows, and its path."""

    board: DataFrame
    alpha: float
    model: LinearModel
    knots: list[tuple[float, np.ndarray]]


def path_search(df: DataFrame, features: Sequence[str], label: str, fold: str = "fold", fit_intercept: bool = True, normalize: bool = False,
                positive: bool = False) -> PathSearch:
    """The penalty of least mean held-out squared error, among all knots of the folds' lasso paths; one scan of the rows."""
    parts = moments(df, [*features, label], by=fold)
    whole = total(parts)
    paths = {k: lasso_path(whole - part, fit_intercept, normalize, positive) for k, part in parts.items()}
    alphas = sorted({a for knots in paths.values() for a, _ in knots}, reverse=True)

    def error(k, alpha):
        train, held = whole - parts[k], parts[k]
        model = _finish(train, on_path(paths[k], alpha), fit_intercept)
        return squared_error(model, held) / held.n

    errors = [[error(k, a) for k in parts] for a in alphas]
    best = min(range(len(alphas)), key=lambda i: np.mean(errors[i]))
    knots = lasso_path(whole, fit_intercept, normalize, positive)
    rows = [(float(a), float(np.mean(e)), float(np.std(e))) for a, e in zip(alphas, errors)]
    board = df.sparkSession.createDataFrame(rows, "alpha double, mean_mse double, std_mse double").orderBy("mean_mse", F.desc("alpha"))
    return PathSearch(board, alphas[best], _finish(whole, on_path(knots, alphas[best]), fit_intercept), knots)


def solve_bayes(
    m: Moments,
    alpha_1: float = 1e-6,
    alpha_2: float = 1e-6,
    lambda_1: float = 1e-6,
    lambda_2: float = 1e-6,
    n_iter: int = 300,
    tol: float = 1e-3,
    fit_intercept: bool = True,
) -> LinearModel:
    """Ridge whose noise and weight precisions maximise the evidence."""
    a, b, yy = _system(m, fit_intercept)
    values, vectors = np.linalg.eigh(a)
    values = np.maximum(values, 0)
    rotated = vectors.T @ b
    noise, prior = m.n / max(yy, 1e-300), 1.0
    coef = np.zeros(len(b))
    for _i in range(n_iter):
        new = vectors @ (rotated / (values + prior / noise))
        sse = max(yy - 2 * new @ b + new @ a @ new, 0.0)
        gamma = float(np.sum(noise * values / (prior + noise * values)))
        prior = (gamma + 2 * lambda_1) / (float(new @ new) + 2 * lambda_2)
        noise = (m.n - gamma + 2 * alpha_1) / (sse + 2 * alpha_2)
        moved = float(np.abs(new - coef).sum())
        coef = new
        if _i and moved < tol:
            break
    return _finish(m, coef, fit_intercept)


SOLVERS = {
    "linear": solve_ols,
    "ridge": solve_ridge,
    "lasso": solve_lasso,
    "elastic_net": solve_elastic_net,
    "bayesian_ridge": solve_bayes,
}


#: Names that change nothing here: the solution is the same whichever way it is reached.
NO_EFFECT = {
    "solver", "tol", "max_iter", "selection", "precompute", "warm_start", "copy_X", "random_state", "n_jobs", "verbose", "compute_score",
    "intercept_scaling", "dual", "average", "learning_rate", "eta0", "power_t", "shuffle", "early_stopping", "n_iter_no_change",
    "validation_fraction", "gamma", "cache_size",
}


def usable(fn: Callable, params: Mapping, fixed: Sequence[str] = ()) -> dict:
    """The parameters that ``fn`` takes; those without effect are left out, all other names are an error."""
    known = {n for n, p in inspect.signature(fn).parameters.items() if p.default is not inspect.Parameter.empty} - set(fixed)
    wrong = sorted(n for n in params if n not in known and n not in NO_EFFECT)
    if wrong:
        raise ValueError(f"unknown parameters {wrong}")
    return {n: v for n, v in params.items() if n in known}


def solve(family: str, m: Moments, params: Mapping) -> LinearModel:
    """Solve one of the families of ``SOLVERS`` with checked parameters."""
    if family == "lasso":
        return solve_lasso(m, **usable(solve_elastic_net, params, ["l1_ratio"]))
    return SOLVERS[family](m, **usable(SOLVERS[family], params))


def fit_linear(df: DataFrame, features: Sequence[str], label: str, family: str, **params) -> LinearModel:
    return solve(family, moments(df, [*features, label])[None], params)


def r2_of(model: LinearModel, m: Moments) -> float:
    """R2 of a model on rows known only by their moments; on a constant label 1 without an error, else 0."""
    v = np.append(-np.asarray(model.coef), 1.0)
    sse = v @ m.scatter @ v + m.n * (v @ m.mean - model.intercept) ** 2
    return r2_from(sse, m)


def r2_from(sse: float, m: Moments) -> float:
    """1 - sse / spread of the last column, with a spread of rounding errors counted as none."""
    spread, size = m.scatter[-1, -1], m.raw[-1, -1] + 1e-300
    if spread <= 1e-14 * size:
        return 1.0 if sse <= 1e-14 * size else 0.0
    return float(1 - sse / spread)


# ---- robust and insensitive losses -----------------------------------------------------------


def fit_huber(df: DataFrame, features: Sequence[str], label: str, epsilon: float = 1.35, alpha: float = 1e-4,
              max_iter: int = 100) -> LinearModel:
    """Huber regression with a concurrently estimated scale."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = df.select(*[numeric(df, c).alias(c) for c in features], numeric(df, label).alias("_y")).dropna()
    with kept(VectorAssembler(inputCols=list(features), outputCol="_x").transform(rows).select("_x", "_y")) as ready:
        fitted = LinearRegression(
            featuresCol="_x", labelCol="_y", loss="huber", epsilon=epsilon, regParam=alpha / ready.count(),
            elasticNetParam=0.0, maxIter=max_iter, standardization=False).fit(ready)
    return LinearModel(list(features), [float(w) for w in fitted.coefficients], float(fitted.intercept))


@dataclass(frozen=True)
class WeightedHuber:
    """``gap``: how far the last step moved the standardised solution; near 0 at the fixed point."""

    model: LinearModel
    scale: float
    gap: float
    steps: int


def fit_weighted_huber(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, epsilon: float = 1.35, alpha: float = 1e-4,
                       max_iter: int = 100, tol: float = 1e-8) -> WeightedHuber:
    """Huber regression of weighted rows by reweighted least squares, one scan of moments a step.

    Minimises sum of w (s + h(r / s) s) + alpha |coef|^2, h(z) = z^2 up to epsilon and 2 epsilon |z| - epsilon^2 beyond. Rows
    within epsilon scales count in full, others by epsilon scales over their residual; the scale solves its own equation.
    """
    if not epsilon > 1 or alpha < 0:
        raise ValueError("epsilon must be above 1 and alpha not negative")
    names = [f"x{i}" for i in range(len(features))]
    mass = numeric(df, weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*[numeric(df, c).cast("double").alias(n) for c, n in zip(features, names)], numeric(df, label).cast("double").alias("y"),
                     mass.alias("w")).dropna().where("w > 0").persist()
    m = moments(rows, [*names, "y"], weight=F.col("w"))[None]
    model, gap, steps = solve_ridge(m, alpha), math.inf, 0
    scale = math.sqrt(max(squared_error(model, m) / m.n, 1e-300))
    while steps < max_iter and gap > tol:
        steps += 1
        size = F.abs(F.col("y") - model.predict(rows))
        inside = size <= F.lit(epsilon * scale)
        r = rows.agg(F.sum(F.when(inside, F.col("w") * size * size)), F.sum(F.when(inside, F.col("w")).otherwise(F.col("w") * (1 - epsilon * epsilon)))).first()
        new_scale = math.sqrt(r[0] / r[1]) if r[0] and r[1] > 0 else scale
        pull = F.when(size <= F.lit(epsilon * new_scale), F.col("w")).otherwise(F.col("w") * F.try_divide(F.lit(epsilon * new_scale), size))
        part = moments(rows, [*names, "y"], weight=pull, centre=m.centre)[None]
        new = solve_ridge(part, alpha * new_scale)
        spread = np.sqrt(np.maximum(np.diag(m.scatter) / m.n, 1e-300))
        moved = [abs(x - y) * k for x, y, k in zip(new.coef, model.coef, spread)]
        centre = m.mean[:-1]
        moved += [abs(new.intercept + centre @ np.array(new.coef) - model.intercept - centre @ np.array(model.coef)), abs(new_scale - scale)]
        gap = max(moved) / spread[-1]
        model, scale = new, new_scale
    rows.unpersist()
    return WeightedHuber(LinearModel(list(features), model.coef, model.intercept), scale, gap, steps)


def squared_error(model: LinearModel, m: Moments) -> float:
    """Sum of squared errors of a model on rows known by their moments."""
    v = np.append(-np.asarray(model.coef), 1.0)
    return float(v @ m.scatter @ v + m.n * (v @ m.mean - model.intercept) ** 2)


def fit_insensitive(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    epsilon: float = 0.1,
    loss: str = "epsilon_insensitive",
    c: float | None = 1.0,
    alpha: float = 1e-4,
    l1_ratio: float = 0.0,
    max_iter: int = 30,
    tol: float = 1e-4,
) -> LinearModel:
    """Linear regression that ignores residuals below ``epsilon``.

    With ``c``: |w|^2/2 + c * sum of losses (support vector form). Without it:
    mean loss + alpha * penalty (gradient-descent form). The intercept is free.
    Each iteration replaces the loss by a quadratic above it that touches it at
    the present residuals, which is one weighted second-moment scan; the
    objective never rises.
    """
    features = list(features)
    rows = df.select(*[numeric(df, f).alias(f) for f in features], numeric(df, label).alias("_y")).dropna()
    with kept(rows) as rows:
        m = moments(rows, [*features, "_y"])[None]
        n = m.n
        l1, l2, scale = (0.0, 1.0, c) if c is not None else (n * alpha * l1_ratio, n * alpha * (1 - l1_ratio), 1.0)
        floor = 1e-3 * max(math.sqrt(m.scatter[-1, -1] / n) * 1e-2, 1e-9)
        model = solve_ridge(m, alpha=max(l2, 1e-9))
        for _ in range(max_iter):
            r = F.col("_y") - model.predict(rows)
            if loss == "epsilon_insensitive":
                up = F.greatest(F.abs(r - epsilon), F.lit(floor))
                down = F.greatest(F.abs(r + epsilon), F.lit(floor))
                weight = 0.25 / up + 0.25 / down
                target = ((epsilon - up) * 0.25 / up + (down - epsilon) * 0.25 / down) / weight
            else:
                weight = F.lit(1.0)
                target = F.greatest(F.lit(-epsilon), F.least(F.lit(epsilon), r))
            bent = rows.withColumn("_z", F.col("_y") - target).withColumn("_w", weight * (2 * scale))
            wm = moments(bent, [*features, "_z"], weight=F.col("_w"), centre=m.centre)[None]
            a, b, zz = _system(wm, True)
            if l1 == 0:
                coef = np.linalg.solve(a + l2 * np.eye(len(a)) + 1e-12 * np.trace(a) * np.eye(len(a)), b)
            else:
                coef = descend(a, b, l1, l2, False, 1000, 1e-9 * math.sqrt(max(zz, 1e-300)))
            new = _finish(wm, coef, True)
            new = LinearModel(features, new.coef, new.intercept)
            spread = np.sqrt(np.diag(m.scatter)[:-1] / n)
            moved = float(np.max(np.abs(np.asarray(new.coef) - np.asarray(model.coef)) * spread, initial=0.0))
            moved = max(moved, abs(float(np.asarray(new.coef) @ m.mean[:-1]) + new.intercept
                                   - float(np.asarray(model.coef) @ m.mean[:-1]) - model.intercept))
            model = new
            if moved <= tol * math.sqrt(m.scatter[-1, -1] / n):
                break
    return model
