"""Paths, out-of-bag scores, boosted and robust linear bases, fitted votes (R-3, M-5, N-1..N-4) next to SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabfeat.bindings.registry import NET_FEATURES, NET_LINEITEM, net_lineitem, query, r, rounded
from tabfeat.functions.columns import q
from tabfeat.operators import ensemble, linear
from tabfeat.operators.folds import metric_exprs
from tabfeat.operators.gram import moments

SUMS = "avg(log_price) AS x_bar, avg(label) AS y_bar, regr_sxx(label, log_price) AS sxx, regr_sxy(label, log_price) AS sxy, CAST(count(*) AS DOUBLE) AS n"
FITS = f"(SELECT t.test, {SUMS} FROM {NET_LINEITEM} d, (SELECT unnest([0, 1, 2, 3]) AS test) t WHERE d.fold <> t.test GROUP BY t.test)"


@query("r3_lasso_path", f"""SELECT unnest([0, 1]) AS knot, unnest([{r('abs(sxy) / n', 6)}, 0.0]) AS alpha, unnest([0.0, {r('sxy / sxx', 6)}]) AS coef
FROM (SELECT {SUMS} FROM {NET_LINEITEM})""")
def lasso_path(load):
    """All penalties of one feature: two knots."""
    df = net_lineitem(load)
    knots = linear.lasso_path(moments(df, ["log_price", "label"])[None])
    return rounded(df.sparkSession.createDataFrame([(i, float(a), float(w[0])) for i, (a, w) in enumerate(knots)], "knot int, alpha double, coef double"), 6)


@query("m5_path_search", f"""WITH fits AS {FITS}, alphas AS (SELECT DISTINCT unnest([abs(sxy) / n, 0.0]) AS alpha FROM fits),
  errors AS (SELECT alpha, test, avg((label - (y_bar + sign(sxy) * greatest(abs(sxy) / n - alpha, 0) / (sxx / n) * (log_price - x_bar))) ** 2) AS mse
    FROM alphas, fits JOIN {NET_LINEITEM} held ON held.fold = fits.test GROUP BY alpha, test)
SELECT {r('alpha', 6)} AS alpha, {r('avg(mse)', 6)} AS mean_mse, {r('stddev_pop(mse)', 6)} AS std_mse FROM errors GROUP BY alpha""")
def path_search(load):
    """Held-out error at every knot of the folds' paths."""
    return rounded(linear.path_search(net_lineitem(load), ["log_price"], "label").board, 6)


def _draw(replica):
    """Arithmetic draws that both engines know; a row of the table is drawn by four of its columns."""
    return F.pmod(q("l_orderkey") * 7919 + q("l_linenumber") * 104729 + q("l_partkey") * 31 + q("l_suppkey") + replica * 15485863, F.lit(1000)) / 1000.0


DRAW = "(l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31 + l_suppkey + replica * 15485863) % 1000 < 600"
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
NUMBERED = f"(SELECT *, row_number() OVER () AS rid FROM {NET_LINEITEM})"


@query("n1_bagging_oob", f"""WITH drawn AS MATERIALIZED (SELECT *, {DRAW} AS used FROM {NUMBERED}, (SELECT range AS replica FROM range(5))),
  fits AS (SELECT replica, {SUMS} FROM drawn WHERE used GROUP BY replica),
  said AS (SELECT rid, any_value(label) AS label, avg(y_bar + sxy / sxx * (log_price - x_bar)) AS p FROM drawn JOIN fits USING (replica) WHERE NOT used GROUP BY rid)
SELECT count(*) AS n, {r('1 - sum((label - p) ** 2) / (var_pop(label) * count(*))', 6)} AS r2 FROM said""")
def bagging_oob(load):
    """Every row scored by the members that did not draw it."""
    df = net_lineitem(load)
    model = ensemble.bagging(df, KEY, ["log_price"], "label", "linear", n_estimators=5, max_samples=0.6, bootstrap=False, draw=_draw)
    n, r2 = ensemble.oob_score(model, df, KEY, "label")
    return rounded(df.sparkSession.createDataFrame([(n, r2)], "n long, r2 double"), 6)


@query("n2_adaboost_linear", f"""WITH one AS (SELECT {SUMS} FROM {NET_LINEITEM}),
  first AS (SELECT log_price, label, y_bar + sxy / sxx * (log_price - x_bar) AS p1 FROM {NET_LINEITEM}, one),
  gaps AS (SELECT *, abs(label - p1) / max(abs(label - p1)) OVER () AS e FROM first),
  b1 AS (SELECT avg(e) / (1 - avg(e)) AS beta FROM gaps),
  weighed AS (SELECT *, pow(beta, 1 - e) AS w FROM gaps, b1),
  means AS (SELECT sum(w * log_price) / sum(w) AS xm, sum(w * label) / sum(w) AS ym FROM weighed),
  two AS (SELECT any_value(xm) AS xm, any_value(ym) AS ym, sum(w * (log_price - xm) * (label - ym)) / sum(w * (log_price - xm) ** 2) AS slope FROM weighed, means),
  second AS (SELECT *, ym + slope * (log_price - xm) AS p2 FROM weighed, two),
  gaps2 AS (SELECT *, abs(label - p2) / max(abs(label - p2)) OVER () AS e2 FROM second),
  b2 AS (SELECT sum(w * e2) / sum(w) / (1 - sum(w * e2) / sum(w)) AS beta2 FROM gaps2),
  said AS (SELECT label, CASE WHEN (p1 <= p2) = (ln(1 / beta) >= ln(1 / beta2)) THEN least(p1, p2) ELSE greatest(p1, p2) END AS p FROM gaps2, b2)
SELECT count(*) AS n, {r('1 - sum((label - p) ** 2) / (var_pop(label) * count(*))', 6)} AS r2, {r('avg(abs(exp(label) - exp(p)))', 2)} AS mae,
  {r('sqrt(avg((label - p) ** 2))', 6)} AS rmse FROM said""")
def adaboost_linear(load):
    """Two rounds over least squares; the weighted median of two is the one that weighs more."""
    df = net_lineitem(load)
    model = ensemble.adaboost_r2(df, ["log_price"], "label", "linear", n_estimators=2)
    return rounded(model.predict(df, ["label"]).agg(*metric_exprs(q("label"), F.col("prediction"))), 6, mae=2)


@query("n2_huber_fixed_point", f"SELECT CAST(sum(w) AS DOUBLE) AS mass, 0.0 AS gap FROM (SELECT 1 + l_orderkey % 3 AS w FROM {NET_LINEITEM})")
def huber_fixed_point(load):
    """The last step of the weighted Huber fit moves nothing."""
    df = net_lineitem(load).withColumn("w", (1 + q("l_orderkey") % 3).cast("double"))
    found = linear.fit_weighted_huber(df, NET_FEATURES, "label", "w", epsilon=1.35, alpha=1e-4)
    return rounded(df.agg(F.sum("w").alias("mass")).withColumn("gap", F.lit(found.gap)), 6)


@query("n3_ransac_share", f"""WITH drawn AS MATERIALIZED (SELECT *, {DRAW} AS used FROM {NUMBERED}, (SELECT range AS replica FROM range(4))),
  fits AS (SELECT replica, {SUMS} FROM drawn WHERE used GROUP BY replica),
  judged AS (SELECT replica, count(*) AS agree, 1 - sum(e * e) / (var_pop(label) * count(*)) AS r2 FROM (
    SELECT replica, label, label - (y_bar + sxy / sxx * (log_price - x_bar)) AS e FROM {NET_LINEITEM}, fits) WHERE abs(e) <= 0.06 GROUP BY replica),
  best AS (SELECT fits.*, agree FROM judged JOIN fits USING (replica) ORDER BY agree DESC, r2 DESC, replica LIMIT 1),
  final AS (SELECT any_value(agree) AS agree, regr_slope(label, log_price) AS slope, regr_intercept(label, log_price) AS start FROM {NET_LINEITEM}, best
    WHERE abs(label - (y_bar + sxy / sxx * (log_price - x_bar))) <= 0.06)
SELECT agree AS inliers, {r('slope', 6)} AS slope, {r('start', 6)} AS intercept FROM final""")
def ransac_share(load):
    """Four trials, each on a drawn share of all rows."""
    df = net_lineitem(load)
    found = ensemble.ransac(df, KEY, ["log_price"], "label", min_samples=0.6, residual_threshold=0.06, max_trials=4, stop_probability=1.0, draw=_draw)
    row = [(found.inliers, found.model.coef[0], found.model.intercept)]
    return rounded(df.sparkSession.createDataFrame(row, "inliers long, slope double, intercept double"), 6)


VOTES = [[1.0, 0.0, 0.0], [0.5, 0.5, 0.0], [0.2, 0.7, 0.1], [1.0, 1.0, 1.0], [0.0, 0.0, 1.0]]
QUANTITY = "avg(l_quantity) AS q_bar, regr_sxx(label, l_quantity) AS qxx, regr_sxy(label, l_quantity) AS qxy"


@query("n4_fitted_voting", f"""WITH fits AS (SELECT t.test, {SUMS}, {QUANTITY} FROM {NET_LINEITEM} d, (SELECT unnest([0, 1, 2, 3]) AS test) t WHERE d.fold <> t.test GROUP BY t.test),
  said AS (SELECT fold, label, y_bar + sxy / (sxx + 0.1) * (log_price - x_bar) AS a, y_bar + sxy / (sxx + 5000) * (log_price - x_bar) AS b,
    y_bar + qxy / qxx * (l_quantity - q_bar) AS c FROM fits JOIN {NET_LINEITEM} d ON d.fold = fits.test)
SELECT weights, {r('avg(score)', 6)} AS mean_score, {r('stddev_pop(score)', 6)} AS std_score FROM (
  SELECT array_to_string(list_transform(w, lambda x: printf('%.1f', x)), ',') AS weights, fold,
    1 - sum((label - (w[1] * a + w[2] * b + w[3] * c) / (w[1] + w[2] + w[3])) ** 2) / (var_pop(label) * count(*)) AS score
  FROM said, (SELECT unnest({VOTES}::DOUBLE[][]) AS w) GROUP BY w, fold) GROUP BY weights""")
def fitted_voting(load):
    """Three members fitted without each fold, and the scores of five votes over what they say of it."""
    members = {"a": ("ridge", {"alpha": 0.1}, ["log_price"]), "b": ("ridge", {"alpha": 5000}, ["log_price"]), "c": ("linear", {}, ["l_quantity"])}
    found = ensemble.fit_voting(net_lineitem(load), members, "label", "l_orderkey", weights=VOTES)
    return rounded(found.board.select(F.array_join("weights", ",").alias("weights"), "mean_score", "std_score"), 6)
