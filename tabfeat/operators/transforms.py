"""Transforms that change the shape of a distribution. Fitted by aggregations, applied as expressions."""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabfeat.functions.columns import count_below, let, numeric, probit, q
from tabfeat.operators.iterate import kept
from tabfeat.operators.ranks import exact_quantiles
from tabfeat.operators.scale import Scaler, row_normalize

# ---- logarithm -------------------------------------------------------------------------------


@dataclass(frozen=True)
class LogTransform:
    """``ln`` for columns whose minimum exceeds 1, else ``log1p``; the branch is kept for the inverse."""

    plain: Mapping[str, bool]

    def transform(self, df: DataFrame, suffix: str = "_log") -> DataFrame:
        return df.withColumns({
            f"{c}{suffix}": F.log(numeric(df, c)) if plain else F.log1p(numeric(df, c))
            for c, plain in self.plain.items()
        })

    def inverse(self, value: Column, column: str) -> Column:
        return F.exp(value) if self.plain[column] else F.expm1(value)


def fit_log(df: DataFrame, columns: Sequence[str]) -> LogTransform:
    row = df.agg(*[F.min(numeric(df, c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return LogTransform({c: row[f"m{i}"] is not None and row[f"m{i}"] > 1 for i, c in enumerate(columns)})


# ---- power transforms ------------------------------------------------------------------------


def power_value(x: Column, lam: float | Column, method: str) -> Column:
    """Box-Cox or Yeo-Johnson value at a fixed lambda, given as a number or as a column."""

    def power(base, log, exponent):
        if isinstance(exponent, Column):
            raised = F.try_divide(F.pow(base, exponent) - 1, exponent)
            return F.when(F.abs(exponent) < 1e-12, log).otherwise(raised)
        return log if abs(exponent) < 1e-12 else (F.pow(base, F.lit(exponent)) - 1) / F.lit(exponent)

    if method == "box-cox":
        return power(x, F.log(x), lam)
    up = power(x + 1, F.log1p(x), lam)
    down = -power(1 - x, F.log1p(-x), 2 - lam)
    return F.when(x >= 0, up).otherwise(F.when(x < 0, down))


@dataclass(frozen=True)
class PowerTransform:
    method: str
    lam: float
    mean: float
    std: float

    def apply(self, x: Column) -> Column:
        return (power_value(x, self.lam, self.method) - F.lit(self.mean)) / F.lit(self.std)


def _rate(df: DataFrame, work: Mapping[str, Column], grids: Mapping[str, Sequence[tuple]], stats: Callable) -> dict:
    """Aggregates ``stats(x, point...)`` for every grid point of every column, in one job.

    The grid is data, not code: each row meets the points of its column and is
    summed per point before any shuffle, and every round runs the same compiled plan.
    """
    names = list(grids)
    points = [[list(map(float, g)) for g in grids[c]] for c in names]
    table = F.from_json(F.lit(json.dumps(points)), "array<array<array<double>>>")
    values = F.array(*[F.struct(F.lit(i).alias("i"), work[c].alias("x")) for i, c in enumerate(names)])
    long = (
        df.select(F.inline(values)).where("x is not null")
        .select("i", "x", F.posexplode(F.get(table, F.col("i"))).alias("k", "g"))
    )
    rows = long.groupBy("i", "k").agg(*stats(F.col("x"), *[F.get("g", j) for j in range(len(points[0][0]))])).collect()
    out = {c: [None] * len(grids[c]) for c in names}
    for r in rows:
        out[names[r["i"]]][r["k"]] = r
    return out


def _maximise(score: Callable, starts: Mapping[str, tuple], step: float, points: int, rounds: int) -> dict[str, tuple]:
    """Maximise one function per column over a shrinking grid; ``score`` rates all grids in one job.

    A window whose best point lies on its border moves without shrinking.
    """
    centre = dict(starts)
    width = {c: (step,) * len(s) for c, s in starts.items()}
    half = points // 2
    for _ in range(rounds):
        grids = {
            c: list(itertools.product(*[[m + w * k for k in range(-half, half + 1)] for m, w in zip(mid, width[c])]))
            for c, mid in centre.items()
        }
        scores = score(grids)
        for c, grid in grids.items():
            at = grid[max(range(len(grid)), key=lambda i: scores[c][i])]
            border = [abs(a - m) > w * (half - 0.5) for a, m, w in zip(at, centre[c], width[c])]
            width[c] = tuple(w if b else w / half for w, b in zip(width[c], border))
            centre[c] = at
    return centre


def fit_power(df: DataFrame, columns: Sequence[str], method: str = "yeo-johnson", rounds: int = 6) -> dict[str, PowerTransform]:
    """Lambda of largest profile likelihood per column, then the moments that standardise the result.

    Each round rates eleven lambdas of every column in one aggregation.
    """
    work = {c: numeric(df, c) for c in columns}
    base = []
    for i, x in enumerate(work.values()):
        weight = F.log(x) if method == "box-cox" else F.signum(x) * F.log1p(F.abs(x))
        base += [F.avg(weight).alias(f"j{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    known = df.agg(*base).first()
    jac = {c: known[f"j{i}"] for i, c in enumerate(columns)}
    if method == "box-cox":
        bad = [c for i, c in enumerate(columns) if known[f"lo{i}"] is not None and known[f"lo{i}"] <= 0]
        if bad:
            raise ValueError(f"Box-Cox needs positive values: {bad}")
    fixed = [c for i, c in enumerate(columns) if known[f"lo{i}"] is None or known[f"lo{i}"] == known[f"hi{i}"]]
    free = [c for c in columns if c not in fixed]

    def score(grids):
        rated = _rate(rows, {c: q(c) for c in free}, grids, lambda x, lam: [F.var_pop(power_value(x, lam, method)).alias("v")])
        return {
            c: [_log_likelihood(r and r["v"], lam, jac[c]) for r, (lam,) in zip(rated[c], grid)]
            for c, grid in grids.items()
        }

    lams = {c: (1.0,) for c in fixed}
    if free:
        with kept(df.select(*[work[c].alias(c) for c in free])) as rows:
            lams |= _maximise(score, {c: (0.0,) for c in free}, 1.0, 11, rounds)
    row = df.agg(*[
        e for i, c in enumerate(columns)
        for e in (F.avg(power_value(work[c], lams[c][0], method)).alias(f"m{i}"),
                  F.stddev_pop(power_value(work[c], lams[c][0], method)).alias(f"s{i}"))
    ]).first()
    return {
        c: PowerTransform(method, lams[c][0], row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0)
        for i, c in enumerate(columns)
    }


def _log_likelihood(variance, lam, jac):
    """Per-row profile log-likelihood of a power transform."""
    if variance is None or not math.isfinite(variance) or variance <= 0:
        return -math.inf
    return -0.5 * math.log(variance) + (lam - 1) * jac


# ---- Johnson SU ------------------------------------------------------------------------------


@dataclass(frozen=True)
class JohnsonSU:
    gamma: float
    eta: float
    epsilon: float
    lam: float

    def apply(self, x: Column) -> Column:
        return F.lit(self.gamma) + F.lit(self.eta) * F.asinh((x - F.lit(self.epsilon)) / F.lit(self.lam))

    def invert(self, y: Column) -> Column:
        return F.lit(self.lam) * F.sinh((y - F.lit(self.gamma)) / F.lit(self.eta)) + F.lit(self.epsilon)


def fit_johnson(df: DataFrame, columns: Sequence[str], rounds: int = 12) -> dict[str, JohnsonSU]:
    """Maximum-likelihood Johnson SU.

    For a given location and width the other two parameters follow from the mean
    and deviation of asinh((x - epsilon) / lambda), so only those two are searched;
    every round rates 25 pairs per column in one aggregation.
    """
    work = {c: numeric(df, c) for c in columns}
    quart = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    spread = {c: (hi - lo) or 1.0 for c, (lo, _, hi) in quart.items()}

    # in units of the interquartile range around the median
    unit = {c: (work[c] - F.lit(quart[c][1])) / F.lit(spread[c]) for c in columns}

    def stats(x, location, log_width):
        z = (x - location) / F.exp(log_width)
        u = F.asinh(z)
        return [F.var_pop(u).alias("v"), F.avg(u).alias("m"), F.avg(F.log1p(z * z)).alias("tail")]

    def score(grids):
        rated = _rate(rows, {c: q(c) for c in columns}, grids, stats)
        return {
            c: [
                -math.inf if r is None or not r["v"] else -0.5 * math.log(r["v"]) - point[1] - 0.5 * r["tail"]
                for r, point in zip(rated[c], grid)
            ]
            for c, grid in grids.items()
        }

    with kept(df.select(*[unit[c].alias(c) for c in columns])) as rows:
        best = _maximise(score, {c: (0.0, 0.0) for c in columns}, 0.5, 5, rounds)
        final = _rate(rows, {c: q(c) for c in columns}, {c: [best[c]] for c in columns}, stats)
    out = {}
    for c in columns:
        mean, std = final[c][0]["m"], math.sqrt(final[c][0]["v"]) or 1.0
        out[c] = JohnsonSU(-mean / std, 1 / std, quart[c][1] + best[c][0] * spread[c], spread[c] * math.exp(best[c][1]))
    return out


def johnson_features(df: DataFrame, fitted: Mapping[str, JohnsonSU], suffix: str = "_john") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": j.apply(numeric(df, c)) for c, j in fitted.items()})


# ---- empirical quantiles ---------------------------------------------------------------------

# Bounds of the normal output and the distance at which a value counts as an end.
NORMAL_BOUND = 5.199337582605575
END_DISTANCE = 1e-7


@dataclass(frozen=True)
class QuantileTransform:
    marks: Sequence[float]

    def uniform(self, x: Column) -> Column:
        """Empirical distribution value by linear interpolation; the middle of a run of equal marks."""
        n = len(self.marks)
        marks = F.split(F.lit(" ".join(map(repr, self.marks))), " ").cast("array<double>")
        places = F.struct(
            x.alias("x"), count_below(x, marks, n, False).alias("upto"), count_below(x, marks, n, True).alias("below"))

        def value(at: Column) -> Column:
            left, right = F.get(marks, at["upto"] - 1), F.get(marks, at["upto"])
            between = (at["upto"] - 1 + (at["x"] - left) / (right - left)) / F.lit(float(n - 1))
            tied = (at["below"] + at["upto"] - 1) / F.lit(2.0 * (n - 1))
            return (
                F.when(at["x"] <= self.marks[0] + END_DISTANCE, F.lit(0.0))
                .when(at["x"] >= self.marks[-1] - END_DISTANCE, F.lit(1.0))
                .when(at["upto"] > at["below"], tied)
                .when(at["x"].isNotNull(), between)
            )

        return let(places, value)

    def normal(self, x: Column) -> Column:
        def value(u: Column) -> Column:
            inner = F.greatest(F.lit(-NORMAL_BOUND), F.least(F.lit(NORMAL_BOUND), probit(u)))
            return (
                F.when(u <= 0, F.lit(-NORMAL_BOUND)).when(u >= 1, F.lit(NORMAL_BOUND)).when(u.isNotNull(), inner)
            )

        return let(self.uniform(x), value)


def fit_quantiles(df: DataFrame, columns: Sequence[str], marks: int = 1000) -> dict[str, QuantileTransform]:
    row = df.agg(*[F.count(numeric(df, c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    out = {}
    by_size: dict[int, list[str]] = {}
    for i, c in enumerate(columns):
        by_size.setdefault(max(2, min(marks, row[f"n{i}"])), []).append(c)
    for k, cols in by_size.items():
        found = exact_quantiles(df, cols, [j / (k - 1) for j in range(k)])
        out |= {c: QuantileTransform(v) for c, v in found.items()}
    return out


# ---- side by side ----------------------------------------------------------------------------


def transform_panel(df: DataFrame, column: str, keep: Sequence[str] = (), marks: int = 1000) -> DataFrame:
    """One column under nine transforms, in one projection."""
    plan = {how: [column] for how in ("standard", "minmax", "maxabs", "robust", "power")}
    scaled = Scaler(plan).fit(df)
    quantile = fit_quantiles(df, [column], marks)[column]
    x = numeric(df, column)
    panel = {
        "log1p": F.log1p(x),
        "standard": scaled.expr(df, "standard", column),
        "minmax": scaled.expr(df, "minmax", column),
        "maxabs": scaled.expr(df, "maxabs", column),
        "robust": scaled.expr(df, "robust", column),
        "yeo_johnson": scaled.expr(df, "power", column),
        "gaussian": quantile.normal(x),
        "uniform": quantile.uniform(x),
        "normalized": F.col("_unit"),
    }
    unit = row_normalize(df, [column], "_u").withColumnRenamed(f"{column}_u", "_unit")
    return unit.select(*[q(c) for c in keep], *[e.alias(n) for n, e in panel.items()])
