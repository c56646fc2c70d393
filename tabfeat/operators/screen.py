"""Statistical screening of features against a target."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfeat.functions.columns import numeric, q
from tabfeat.functions.tails import correlation_p, f_tail, log_f_tail, normal_two_sided, t_two_sided
from tabfeat.operators.gram import Moments, fit_pca, masked_correlations, moments
from tabfeat.operators.iterate import kept
from tabfeat.operators.profile import melt, moments_of
from tabfeat.operators.ranks import BUCKET_ROWS, add_rank
from tabfeat.session import cut_lineage


def _pearson(df: DataFrame, a: str, b: str):
    """Pearson over the rows with both values; NULL for a constant column, where corr() divides by zero or by noise."""
    x, y = numeric(df, a), numeric(df, b)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    size = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.try_divide(F.covar_pop(x, y), size))


#: Pairs up to which coefficients are plain aggregates.
FEW_PAIRS = 6


def _correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> dict[tuple[str, str], float | None]:
    """Pairwise complete coefficients: aggregates of one job for a few pairs, one scan of masked products for many."""
    pairs = list(dict.fromkeys(pairs))
    if len(pairs) > FEW_PAIRS:
        cols = list(dict.fromkeys(c for p in pairs for c in p))
        found, at = masked_correlations(df, cols), {c: i for i, c in enumerate(cols)}
        return {(a, b): None if np.isnan(r := found[at[a], at[b]]) else float(r) for a, b in pairs}
    row = df.agg(*[_pearson(df, a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]).first()
    return {p: row[f"r{i}"] for i, p in enumerate(pairs)}


def pair_correlations(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Pearson coefficient of every left column with every right column, pairwise complete."""
    found = _correlations(df, [(a, b) for a in left for b in right])
    return df.sparkSession.createDataFrame([(a, b, r) for (a, b), r in found.items()], "a string, b string, corr double")


def correlation_matrix(df: DataFrame, features: Sequence[str], target: str, k: int | None = None) -> DataFrame:
    """Long matrix over the target and the k features most correlated with it in absolute value."""
    cols = [*features, target]
    found = _correlations(df, [(a, b) for i, a in enumerate(cols) for b in cols[i:]])
    if k is not None:
        size = {f: -1.0 if found[f, target] is None else abs(found[f, target]) for f in features}
        cols = sorted(features, key=lambda f: (-size[f], f))[:k] + [target]
    rows = [(a, b, found.get((a, b), found.get((b, a)))) for a in cols for b in cols]
    return df.sparkSession.createDataFrame(rows, "a string, b string, corr double")


def top_correlations(df: DataFrame, features: Sequence[str], target: str, k: int) -> DataFrame:
    return (
        pair_correlations(df, features, [target])
        .select(F.col("a").alias("feature"), "corr")
        .orderBy(F.desc(F.abs("corr")), "feature")
        .limit(k)
    )


# ---- rank correlation ------------------------------------------------------------------------



def _counted_pairs(base: DataFrame, target: str, features: Sequence[str], rows: int, bucket_rows: int) -> DataFrame:
    """Distinct (feature, x, y) with their count ``w`` and the ranks of x and y inside the feature.

    Counting equal pairs first keeps frequent values from travelling row by row.
    ``rows`` bounds the pairs of one feature.
    """
    long = base.unpivot([q(target).alias("y")], [q(f) for f in features], "feature", "x")
    long = long.where("x is not null and y is not null")
    counted = long.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("w"))
    if rows > bucket_rows:  # ranking then reads the pairs several times
        counted = cut_lineage(counted)
    ranked = add_rank(counted, "x", ["feature"], "w", salt=["y"], bucket_rows=bucket_rows, largest=rows)
    return add_rank(ranked, "y", ["feature"], "w", salt=["x"], bucket_rows=bucket_rows, largest=rows)


def _rank_statistics(df, target, features, bucket_rows, spearman=True, kendall=True, pearson=True) -> dict[str, dict]:
    """The wanted coefficients of every feature, as one small row per feature."""
    cols = dict.fromkeys([*features, target])
    out = {f: {} for f in features}
    with kept(df.select(*[numeric(df, c).alias(c) for c in cols])) as base:
        rows = base.count()
        if target in features:
            base = base.withColumn("_target", q(target))
            target = "_target"
        ranked = _counted_pairs(base, target, features, rows, bucket_rows)
        if spearman and kendall:
            ranked = ranked.persist()
        parts = [_spearman(ranked)] if spearman else []
        parts += [_kendall(ranked, rows)] if kendall else []
        for r in (r for p in parts for r in p.collect()):
            out[r["feature"]] |= r.asDict()
        if pearson:
            for r in pair_correlations(base, features, [target]).collect():
                out[r["a"]]["pearson"] = r["corr"]
        if spearman and kendall:
            ranked.unpersist()
    return out


def _spearman(ranked: DataFrame) -> DataFrame:
    rx, ry = (F.col(f"{v}_before") + (F.col(f"{v}_ties") + 1) / 2 for v in "xy")
    n = F.sum("w").cast("double")
    mid = (n + 1) / 2
    w = F.col("w")
    sxy, sxx, syy = F.sum(w * rx * ry), F.sum(w * rx * rx), F.sum(w * ry * ry)
    top = sxy - n * mid * mid
    return ranked.groupBy("feature").agg(
        n.alias("n"),
        F.try_divide(top, F.sqrt((sxx - n * mid * mid) * (syy - n * mid * mid))).alias("spearman"),
    )


# Ranks are split into digits of this many bits; within a task the digits are split once more.
DIGIT_BITS = 10
PART_BITS = 5
SMALL_GROUP = 64
PRODUCTS = 1 << 22


def _grid_score(i, j, w):
    """Concordant minus discordant weight of one group of cells, by running sums over the grid."""
    grid = np.zeros((1 << PART_BITS, 1 << PART_BITS))
    grid[i, j] = w
    below = np.zeros_like(grid)
    below[1:] = grid.cumsum(0)[:-1]
    left = np.zeros_like(grid)
    left[:, 1:] = below.cumsum(1)[:, :-1]
    right = below.sum(1, keepdims=True) - left - below
    return float((grid * (left - right)).sum())


def _part_scores(size, i, j, w):
    """Summed score of consecutive groups of cells; groups of similar small size are compared in one numpy step."""
    start = np.cumsum(size) - size
    score = 0.0
    for g in np.flatnonzero(size > SMALL_GROUP):
        at = slice(start[g], start[g] + size[g])
        score += _grid_score(i[at], j[at], w[at])
    width = 2
    while width <= SMALL_GROUP:
        members = np.flatnonzero((size <= width) & (size > width // 2))
        for part in np.array_split(members, max(1, len(members) * width * width // PRODUCTS)):
            place = np.arange(width)
            at = np.minimum(start[part][:, None] + place, len(i) - 1)
            weight = np.where(place < size[part][:, None], w[at], 0.0)
            order = np.sign(i[at][:, :, None] - i[at][:, None, :]) * np.sign(j[at][:, :, None] - j[at][:, None, :])
            score += np.einsum("gp,gpq,gq->", weight, order.astype(float), weight) / 2
        width *= 2
    return score


def _digit_scores(group, i, j, w):
    """Summed score of cells (i, j, w) over groups; two cells differ first in one part of each digit."""
    score, mask = 0.0, (1 << PART_BITS) - 1
    places = range(0, DIGIT_BITS, PART_BITS)
    for a in places:
        for b in places:
            px, py = i >> (a + PART_BITS), j >> (b + PART_BITS)
            pi, pj = (i >> a) & mask, (j >> b) & mask
            key = (((group << DIGIT_BITS | px) << DIGIT_BITS | py) << PART_BITS | pi) << PART_BITS | pj
            cells, at = np.unique(key, return_inverse=True)
            weight = np.bincount(at, w)
            _, size = np.unique(cells >> (2 * PART_BITS), return_counts=True)
            score += _part_scores(size, (cells >> PART_BITS) & mask, cells & mask, weight)
    return score


def _concordance(ranked: DataFrame, n: int) -> DataFrame:
    """Concordant minus discordant pairs per feature, exact and without comparing rows.

    Ranks are written in base 1024. Two rows differ first in exactly one digit of
    x and one of y, so each pair of rows is counted once, in the group that shares
    the higher digits of both; a group holds at most 1024 x 1024 counted cells
    however many rows fall into it.
    """
    digits = max(1, math.ceil(max(n, 2).bit_length() / DIGIT_BITS))
    places = F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(digits) for b in range(digits)
    ])).alias("at")
    x, y = F.col("x_before").cast("long"), F.col("y_before").cast("long")
    placed = ranked.select("feature", x.alias("x"), y.alias("y"), "w", places)

    def digit(v, place):
        return F.expr(f"cast(shiftright({v}, cast(at.{place} * {DIGIT_BITS} as int)) & {(1 << DIGIT_BITS) - 1} as int)")

    def prefix(v, place):
        return F.expr(f"shiftright({v}, cast((at.{place} + 1) * {DIGIT_BITS} as int))")

    cells = placed.groupBy(
        "feature", F.col("at.a").alias("a"), F.col("at.b").alias("b"),
        prefix("x", "a").alias("px"), prefix("y", "b").alias("py"), digit("x", "a").alias("i"), digit("y", "b").alias("j"),
    ).agg(F.sum("w").cast("double").alias("w"))
    groups = cells.groupBy("feature", "a", "b", "px", "py").agg(F.collect_list(F.struct("i", "j", "w")).alias("cells"))
    # a single cell has no partner
    many = groups.where(F.size("cells") > 1)

    def score(batches):
        for batch in batches:
            names = pc.dictionary_encode(batch.column("feature"))
            cells = batch.column("cells")
            size = np.diff(cells.offsets.to_numpy())
            flat = cells.flatten()
            i, j, w = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            owner = np.repeat(names.indices.to_numpy(), size)
            group = np.repeat(np.arange(len(size)), size)
            out = [
                _digit_scores(group[at], i[at].astype(np.int64), j[at].astype(np.int64), w[at])
                for at in (owner == f for f in range(len(names.dictionary)))
            ]
            yield pa.RecordBatch.from_arrays([names.dictionary, pa.array(out, pa.float64())], names=["feature", "s"])

    scored = many.select("feature", "cells").mapInArrow(score, "feature string, s double")
    return scored.groupBy("feature").agg(F.sum("s").alias("score"))


def _kendall(ranked: DataFrame, rows: int) -> DataFrame:
    """tau-b, and the tie sums its p-value needs."""
    out = None
    for v in "xy":
        t = ranked.groupBy("feature", v).agg(F.first(f"{v}_ties").cast("double").alias("t"))
        f = F.col("t")
        sums = t.groupBy("feature").agg(
            F.sum(f * (f - 1)).alias(f"{v}1"), F.sum(f * (f - 1) * (f - 2)).alias(f"{v}2"),
            F.sum(f * (f - 1) * (2 * f + 5)).alias(f"{v}3"))
        out = sums if out is None else out.join(sums, "feature")
    out = out.join(_concordance(ranked, rows), "feature", "left")
    sizes = ranked.groupBy("feature").agg(F.sum("w").cast("double").alias("n"))
    return out.join(sizes, "feature").withColumn("score", F.coalesce("score", F.lit(0.0)))


def corr_screen(
    df: DataFrame, target: str, features: Sequence[str], bucket_rows: int = BUCKET_ROWS,
    coefficients: Sequence[str] = ("kendall", "pearson", "spearman"),
) -> DataFrame:
    """Kendall tau-b, Pearson and Spearman with two-sided p-values, one row per feature.

    Coefficients that are not asked for are not computed and NULL; Pearson alone
    needs no ranks.
    """
    if set(coefficients) == {"pearson"}:
        return _pearson_screen(df, target, features)
    nan, out = math.nan, []
    wanted = {c: c in coefficients for c in ("kendall", "pearson", "spearman")}
    for f, r in _rank_statistics(df, target, features, bucket_rows, **wanted).items():
        if "n" not in r:  # no row with both values
            out.append((f, *[None] * 6))
            continue
        n = int(r["n"])
        p, s = r.get("pearson"), r.get("spearman")
        out.append((f, *(_tau(r) if wanted["kendall"] else (None, None)), nan if p is None else p, nan if p is None else correlation_p(p, n),
                    nan if s is None else s, nan if s is None else correlation_p(s, n)))
    return df.sparkSession.createDataFrame(
        out, "feature string, kendall_tau double, kendall_p double, pearson double, pearson_p double, "
             "spearman double, spearman_p double")


def _pearson_screen(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """One aggregate over the rows: each feature's rows with both values."""
    y, aggs = numeric(df, target), []
    for i, f in enumerate(features):
        x = numeric(df, f)
        both = x.isNotNull() & y.isNotNull()
        aggs += [F.corr(F.when(both, x), F.when(both, y)).alias(f"p{i}"), F.count(F.when(both, 1)).alias(f"n{i}")]
    row, out = df.agg(*aggs).first(), []
    for i, f in enumerate(features):
        p, n = row[f"p{i}"], row[f"n{i}"]
        known = p is not None and not math.isnan(p)
        pair = (p, correlation_p(p, n)) if known else (math.nan, math.nan) if n else (None, None)
        out.append((f, None, None, *pair, None, None))
    return df.sparkSession.createDataFrame(
        out, "feature string, kendall_tau double, kendall_p double, pearson double, pearson_p double, "
             "spearman double, spearman_p double")


def _tau(r):
    n = r["n"]
    pairs = n * (n - 1) / 2
    free = (pairs - r["x1"] / 2) * (pairs - r["y1"] / 2)
    if free <= 0:
        return math.nan, math.nan
    tau = r["score"] / math.sqrt(free)
    var = (n * (n - 1) * (2 * n + 5) - r["x3"] - r["y3"]) / 18 + r["x1"] * r["y1"] / (2 * n * (n - 1))
    if n > 2:
        var += r["x2"] * r["y2"] / (9 * n * (n - 1) * (n - 2))
    return tau, (normal_two_sided(r["score"] / math.sqrt(var)) if var > 0 else math.nan)


def spearman(df: DataFrame, target: str, features: Sequence[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Spearman coefficients, largest first."""
    found = _rank_statistics(df, target, features, bucket_rows, kendall=False, pearson=False)
    rows = [(f, r.get("spearman")) for f, r in found.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, spearman double").orderBy(F.desc("spearman"), "feature")


def kendall_tau(df: DataFrame, target: str, features: Sequence[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    found = _rank_statistics(df, target, features, bucket_rows, spearman=False, pearson=False)
    rows = [(f, _tau(r)[0] if "n" in r else None) for f, r in found.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, kendall_tau double")


def select_by_pearson(
    screen: DataFrame, rho: float = 0.7, alpha: float = 0.05, positive_only: bool = False
) -> DataFrame:
    """Features whose Pearson coefficient is strong and significant."""
    size = F.col("pearson") if positive_only else F.abs("pearson")
    return screen.where((size > rho) & (F.col("pearson_p") < alpha)).select("feature")


# ---- collinearity, variance, regression ------------------------------------------------------


def vif_values(m: Moments) -> np.ndarray:
    """Variance inflation from uncentred products, without an intercept."""
    g = m.raw
    d = np.sqrt(np.diag(g))
    d[d == 0] = 1.0
    r = g / np.outer(d, d)
    # a singular matrix means at least one column is a combination of others
    values, vectors = np.linalg.eigh(r)
    small = values < 1e-10
    out = np.diag((vectors / np.where(small, 1.0, values)) @ vectors.T).copy()
    if small.any():
        out[(np.abs(vectors[:, small]) > 1e-6).any(1)] = np.inf
    return out


def vif_select(df: DataFrame, features: Sequence[str], threshold: float = 5.0) -> DataFrame:
    """Repeatedly drop the feature with the largest VIF above the threshold; one scan in all.

    ``step`` is the order of removal, NULL for the kept ones with their final VIF.
    """
    m = moments(df, features)[None]
    kept, dropped = list(features), []
    while kept:
        values = vif_values(m.of(kept))
        worst = int(np.argmax(values))
        if not values[worst] > threshold:
            break
        dropped.append((kept.pop(worst), float(values[worst]), len(dropped) + 1))
        values = np.delete(values, worst)
    final = vif_values(m.of(kept)) if kept else []
    rows = [(f, float(v), None) for f, v in zip(kept, final)] + dropped
    return df.sparkSession.createDataFrame(rows, "feature string, vif double, step int")


def anova_sums(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Between/within sums of squares and F per feature: one unpivot, two aggregations."""
    base = df.select(numeric(df, target).alias("_y"), *[q(f) for f in features])
    long = melt(base, ["_y"], features, "string").where("value is not null and _y is not null")
    levels = long.groupBy("variable", "value").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("_y").alias("m"), F.var_pop("_y").alias("v"))
    n, m = F.col("n"), F.col("m")
    grand = F.sum(n * m) / F.sum(n)
    sums = levels.groupBy(F.col("variable").alias("feature")).agg(
        F.sum(n).alias("n"), F.count(F.lit(1)).cast("double").alias("k"),
        (F.sum(n * m * m) - F.sum(n) * grand * grand).alias("between"),
        F.sum(n * F.col("v")).alias("within"))
    return sums.withColumn(
        "f", F.try_divide(F.col("between") / F.nullif(F.col("k") - 1, F.lit(0.0)),
                          F.try_divide(F.col("within"), F.col("n") - F.col("k"))))


def anova(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """One-way F test per feature with p-value and disparity ln(1/p), smallest p first."""
    out = []
    for r in anova_sums(df, target, features).collect():
        f, df1, df2 = r["f"], r["k"] - 1, r["n"] - r["k"]
        log_p = log_f_tail(f, df1, df2) if f is not None else math.nan
        out.append((r["feature"], f, math.exp(log_p) if log_p == log_p else math.nan, -log_p))
    schema = "feature string, f double, p double, disparity double"
    return df.sparkSession.createDataFrame(out, schema).orderBy(F.desc("disparity"), "feature")


def ols_summary(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Least squares with intercept: coefficient table with the fit statistics on every row."""
    features = list(features)
    m = moments(df, [*features, target])[None]
    p, n = len(features), m.n
    s = m.scatter
    sxx, sxy, syy = s[:p, :p], s[:p, p], s[p, p]
    inv = np.linalg.pinv(sxx)
    beta = inv @ sxy
    mean = m.mean
    intercept = mean[p] - mean[:p] @ beta
    dof = n - p - 1
    sse = max(syy - beta @ sxy, 0.0)
    sigma2 = sse / dof
    se = np.sqrt(np.maximum(sigma2 * np.diag(inv), 0))
    se0 = math.sqrt(sigma2 * (1 / n + mean[:p] @ inv @ mean[:p]))
    r2 = 1 - sse / syy
    adjusted = 1 - (1 - r2) * (n - 1) / dof
    f = (syy - sse) / p / sigma2 if sigma2 > 0 else math.inf
    rows = []
    for name, b, e in [("const", intercept, se0), *zip(features, beta, se)]:
        t = float(b / e) if e > 0 else math.inf
        rows.append((name, float(b), float(e), t, t_two_sided(t, dof), float(r2), float(adjusted), float(f),
                     f_tail(f, p, dof)))
    return df.sparkSession.createDataFrame(
        rows, "term string, coef double, std_err double, t double, p double, r2 double, adj_r2 double, "
              "f double, f_p double")


def normality_screen(df: DataFrame, features: Sequence[str], alpha: float = 0.01) -> DataFrame:
    """Jarque-Bera test per feature; missing values count as 0."""
    whole = df.select(*[F.coalesce(numeric(df, f), F.lit(0.0)).alias(f) for f in features])
    jb = F.col("n") / 6 * (F.col("g1") * F.col("g1") + F.col("g2") * F.col("g2") / 4)
    return (
        moments_of(whole, features)
        .withColumn("jb", jb)
        .select("feature", "jb", F.exp(-F.col("jb") / 2).alias("p"))
        .withColumn("rejected", (F.col("p") < alpha).cast("int"))
    )


def all_normal(screen: DataFrame) -> DataFrame:
    return screen.agg((F.max("rejected") == 0).cast("int").alias("all_normal"))


# ---- segments --------------------------------------------------------------------------------


def kmeans_segments(
    df: DataFrame, key: str, features: Sequence[str], components: int = 30, k: int = 5, seed: int = 0, max_iter: int = 20,
    tol: float = 1e-4,
):
    """Standardise, project on principal components, cluster; returns labelled keys and the components.

    Missing values count as 0. The first centres are rows drawn by a hash of the key, far ones likelier (each draw is one
    aggregate), so the clusters depend neither on the partitioning nor on the cores.
    """
    fitted = fit_pca(df, features, min(components, len(features)))
    scores = fitted.transform(df, keep=[key])
    names = [c for c in scores.columns if c != key]
    points = scores.select(q(key).alias("_key"), F.array(*[q(c) for c in names]).alias("_pc"))
    schema = f"_key {points.schema['_key'].dataType.simpleString()}, _pc array<double>, cluster int, near double"

    def gaps(x, centres):
        return np.stack([((x - c) ** 2).sum(1) for c in centres], axis=1)

    def vectors(batch):
        return batch.column("_pc").flatten().to_numpy().reshape(batch.num_rows, -1)

    def nearest(rows, centres):
        """Every point with its nearest centre and the squared distance to it."""
        centres = np.array(centres)

        def assign(batches):
            for b in batches:
                found = gaps(vectors(b), centres)
                columns = [b.column("_key"), b.column("_pc"), pa.array(found.argmin(1), pa.int32()), pa.array(found.min(1))]
                yield pa.RecordBatch.from_arrays(columns, names=["_key", "_pc", "cluster", "near"])

        return rows.mapInArrow(assign, schema)

    def drawn(rows, centres, turn):
        """The far point of least waiting time: each task offers its own, the driver takes the first of them."""
        centres = np.array(centres)
        draw = (F.pmod(F.xxhash64("_key", F.lit(seed), F.lit(turn)), F.lit(1 << 52)) + 0.5) / (1 << 52)

        def offer(batches):
            best = None
            for b in batches:
                if not b.num_rows:
                    continue
                x, u = vectors(b), b.column("_u").to_numpy(zero_copy_only=False)
                near = gaps(x, centres).min(1) if len(centres) else np.ones(len(x))
                wait = np.divide(-np.log(u), near, out=np.full(len(x), np.inf), where=near > 0)
                low = wait.min()
                if np.isfinite(low):
                    at = min(np.flatnonzero(wait == low), key=lambda i: b.column("_key")[int(i)].as_py())
                    mine = low, b.column("_key")[int(at)].as_py(), x[at].tolist()
                    best = mine if best is None or mine[:2] < best[:2] else best
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[2]], pa.list_(pa.float64())), pa.array([str(best[1])])], ["wait", "pc", "id"])

        offers = rows.withColumn("_u", draw).mapInArrow(offer, "wait double, pc array<double>, id string").collect()  # one row a task
        return min(offers, key=lambda r: (r["wait"], r["id"]))["pc"] if offers else None

    def means(rows, centres):
        """Sums and numbers of the points of each centre, one row a task and centre."""
        centres = np.array(centres)

        def add(batches):
            total = np.zeros((len(centres), centres.shape[1] + 1))
            for b in batches:
                if b.num_rows:
                    x = vectors(b)
                    own = gaps(x, centres).argmin(1)
                    for j in np.unique(own):
                        total[j, 0] += (own == j).sum()
                        total[j, 1:] += x[own == j].sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["s"])

        parts = rows.mapInArrow(add, "s array<double>").collect()
        return np.sum([np.array(p["s"]).reshape(len(centres), -1) for p in parts], axis=0) if parts else np.zeros((len(centres), centres.shape[1] + 1))

    with kept(points) as rows:
        centres: list = []
        for turn in range(k):
            row = drawn(rows, centres, turn)
            if row is None:  # fewer distinct points than clusters
                break
            centres.append(row)
        for _ in range(max_iter if centres else 0):
            total = means(rows, centres)
            new = [(t[1:] / t[0]).tolist() if t[0] else c for t, c in zip(total, centres)]
            moved = max((sum((a - b) ** 2 for a, b in zip(x, y)) for x, y in zip(new, centres)), default=0.0)
            centres = new
            if moved <= tol * tol:
                break
    return nearest(points, centres).select(q("_key").alias(key), "cluster"), fitted
