"""Regressions, searches, ensembles (R, M, N) and the whole preparation (X)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tabfeat.bindings.registry import NET_FEATURES, NET_LINEITEM, net_lineitem, query, r, rounded
from tabfeat.functions.columns import q
from tabfeat.operators import ensemble, linear, neighbors, search, trees
from tabfeat.operators.derive import district_tag, season_flag
from tabfeat.operators.folds import holdout_split_arithmetic, kfold_assign, metric_exprs
from tabfeat.operators.gram import moments
from tabfeat.operators.impute import ImputeRule
from tabfeat.operators.predicates import low_quality
from tabfeat.plans.prepare import Preparation, PreparePlan

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _terms(df, model):
    rows = [("intercept", float(model.intercept)), *zip(model.cols, model.coef)]
    return df.sparkSession.createDataFrame(rows, "term string, coef double")


def _scores(df, predicted, label="label"):
    return rounded(predicted.agg(*metric_exprs(q(label), F.col("prediction"))))


# ---- linear ----------------------------------------------------------------------------------

ONE = "x_bar, y_bar, sxx, sxy, n FROM (SELECT avg(log_price) AS x_bar, avg(label) AS y_bar, regr_sxx(label, log_price) AS sxx, " \
      f"regr_sxy(label, log_price) AS sxy, CAST(count(*) AS DOUBLE) AS n FROM {NET_LINEITEM})"


def _one_feature_sql(slope):
    return f"""SELECT term, {r('coef', 6)} AS coef FROM (SELECT unnest(['intercept', 'log_price']) AS term,
  unnest([y_bar - w * x_bar, w]) AS coef FROM (SELECT {slope} AS w, {ONE}))"""


@query("r1_linear_regression", _one_feature_sql("sxy / sxx"))
def linear_regression(load):
    df = net_lineitem(load)
    return rounded(_terms(df, linear.fit_linear(df, ["log_price"], "label", "linear")), 6)


@query("r2_ridge", _one_feature_sql("sxy / (sxx + 500)"))
def ridge(load):
    df = net_lineitem(load)
    return rounded(_terms(df, linear.fit_linear(df, ["log_price"], "label", "ridge", alpha=500)), 6)


@query("r3_lasso", _one_feature_sql("greatest(sxy / n - 0.05, 0) / (sxx / n)"))
def lasso(load):
    df = net_lineitem(load)
    return rounded(_terms(df, linear.fit_linear(df, ["log_price"], "label", "lasso", alpha=0.05)), 6)


@query("r3_elastic_net", _one_feature_sql("greatest(sxy / n - 0.02, 0) / (sxx / n + 0.08)"))
def elastic_net(load):
    df = net_lineitem(load)
    return rounded(_terms(df, linear.fit_linear(df, ["log_price"], "label", "elastic_net", alpha=0.1, l1_ratio=0.2)), 6)


@query("r3_elastic_net_positive")
def elastic_net_positive(load):
    df = net_lineitem(load)
    return rounded(_terms(df, linear.fit_linear(
        df, NET_FEATURES, "label", "elastic_net", alpha=0.0011, l1_ratio=0.008, positive=True)), 6)


@query("r4_bayesian_ridge")
def bayesian_ridge(load):
    df = net_lineitem(load)
    return rounded(_terms(df, linear.fit_linear(df, NET_FEATURES, "label", "bayesian_ridge")), 6)


@query("r5_huber")
def huber(load):
    df = net_lineitem(load)
    return rounded(_terms(df, linear.fit_huber(df, NET_FEATURES, "label", epsilon=2.3, alpha=5e-4)), 4)


@query("r6_linear_svr")
def linear_svr(load):
    df = net_lineitem(load)
    return rounded(_terms(df, linear.fit_insensitive(df, NET_FEATURES, "label", epsilon=0.01, c=1.4)), 4)


@query("r6_sgd_regression")
def sgd_regression(load):
    df = net_lineitem(load)
    model = linear.fit_insensitive(df, NET_FEATURES, "label", epsilon=0.01, loss="squared_epsilon_insensitive",
                                   c=None, alpha=1e-4, l1_ratio=0.15)
    return rounded(_terms(df, model), 4)


# ---- trees -----------------------------------------------------------------------------------


def _tree(load, kind, params):
    df = net_lineitem(load)
    model = trees.fit_tree(df, NET_FEATURES, "label", kind, params)
    return _scores(df, model.transform(trees.assemble(df, NET_FEATURES, "label")))


@query("r7_decision_tree")
def decision_tree(load):
    return _tree(load, "decision_tree", {"max_depth": 8, "min_samples_leaf": 5})


@query("r8_random_forest")
def random_forest(load):
    return _tree(load, "random_forest", {"n_estimators": 20, "max_depth": 6, "max_features": "sqrt"})


@query("r9_gradient_boosting")
def gradient_boosting(load):
    return _tree(load, "gradient_boosting", {"n_estimators": 15, "learning_rate": 0.22, "max_depth": 4})


# ---- neighbours ------------------------------------------------------------------------------

PAIRS = """(SELECT a.vec_id AS id, b.vec_id AS other, b.label AS y, {distance} AS d FROM
  (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) a JOIN
  (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings) b ON a.vec_id <> b.vec_id)"""
L2 = PAIRS.format(distance="list_distance(a.v, b.v)")
L1 = PAIRS.format(distance="list_sum(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i])))")


@query("r10_knn_regression", f"""SELECT id AS vec_id, {r('avg(y)')} AS prediction FROM (SELECT *, row_number() OVER
  (PARTITION BY id ORDER BY d, other) AS rn FROM {L2}) WHERE rn <= 10 GROUP BY id""")
def knn_regression(load):
    """Leave-one-out over the whole table."""
    e = load("embeddings")
    return rounded(neighbors.knn_regression(e, e, "vec_id", "embedding", "label", k=10, exclude_self=True))


@query("r10_knn_distance_weights", f"""SELECT id AS vec_id, {r('sum(y / d) / sum(1 / d)')} AS prediction FROM (SELECT *, row_number() OVER
  (PARTITION BY id ORDER BY d, other) AS rn FROM {L1}) WHERE rn <= 8 GROUP BY id""")
def knn_distance_weights(load):
    e = load("embeddings")
    return rounded(neighbors.knn_regression(e, e, "vec_id", "embedding", "label", k=8, weights="distance", p=1, exclude_self=True))


@query("r11_radius_regression", f"""SELECT vec_id, coalesce(n, 0) AS neighbors, {r('m')} AS prediction FROM embeddings LEFT JOIN
  (SELECT id, count(*) AS n, avg(y) AS m FROM {L2} WHERE d <= 1.2 GROUP BY id) ON id = vec_id""")
def radius_regression(load):
    e = load("embeddings")
    return rounded(neighbors.radius_regression(e, e, "vec_id", "embedding", "label", radius=1.2, exclude_self=True))


# ---- search ----------------------------------------------------------------------------------

ALPHAS = [0.1, 1, 100, 10000]


def _ridge_board(top):
    return f"""SELECT params, mean_score, std_score, rank FROM (SELECT params, {r('mean', 6)} AS mean_score, {r('std', 6)} AS std_score,
  CAST(rank() OVER (ORDER BY mean DESC) AS INTEGER) AS rank FROM (
  SELECT params, avg(score) AS mean, stddev_pop(score) AS std FROM (
    SELECT params, test, 1 - sum((label - (y_bar + sxy / (sxx + alpha) * (log_price - x_bar))) ** 2) / (var_pop(label) * count(*)) AS score
    FROM (SELECT t.test, avg(log_price) AS x_bar, avg(label) AS y_bar, regr_sxx(label, log_price) AS sxx, regr_sxy(label, log_price) AS sxy
          FROM {NET_LINEITEM} d, (SELECT unnest([0, 1, 2, 3]) AS test) t WHERE d.fold <> t.test GROUP BY t.test) fit
    JOIN {NET_LINEITEM} held ON held.fold = fit.test,
    (SELECT unnest({ALPHAS}::DOUBLE[]) AS alpha, unnest({[f'{{"alpha": {a}}}' for a in ALPHAS]}) AS params)
    GROUP BY params, alpha, test) GROUP BY params)) WHERE rank <= {top}"""


def _ridge_search(load):
    return search.grid_search(net_lineitem(load), "ridge", {"alpha": ALPHAS}, ["log_price"], "label")


@query("m2_grid_search", _ridge_board(99))
def grid_search(load):
    return rounded(_ridge_search(load).leaderboard.drop("candidate"), 6)


@query("m4_leaderboard", _ridge_board(3))
def leaderboard(load):
    return rounded(search.report(_ridge_search(load).leaderboard, 3).drop("candidate"), 6)


@query("m2_grid_search_linear_family")
def grid_search_family(load):
    """Elastic-net grid over all features, including the forms with and without intercept and positive weights."""
    found = search.grid_search(
        net_lineitem(load), "elastic_net",
        {"alpha": [0.0009, 0.0010, 0.0011], "l1_ratio": [0.004, 0.01, 0.1], "positive": [True, False], "fit_intercept": [True, False]},
        NET_FEATURES, "label")
    return rounded(found.leaderboard, 6)


@query("m2_grid_search_trees")
def grid_search_trees(load):
    """Contiguous folds over the orders; an unusable candidate scores 0."""
    from tabfeat.session import cut_lineage

    orders = cut_lineage(kfold_assign(load("orders"), "o_orderkey", 4).select(
        F.log1p("o_totalprice").alias("label"), F.floor(q("o_totalprice") / 50000).alias("band"), q("o_custkey"), "fold"))
    grid = {"max_depth": [2, 4], "min_samples_leaf": [5, -1]}
    found = search.grid_search(orders, "decision_tree", grid, ["band", "o_custkey"], "label")
    return rounded(found.leaderboard, 4)


def _neighbor_board(candidates: str, prediction: str, pairs: dict[int, str]) -> str:
    """R2 of leave-one-fold-out predictions by candidate (params, p, size, weights) and fold; 0 where a row has no prediction."""
    rows = "(SELECT vec_id, label, vec_id % 4 AS fold FROM embeddings)"
    near = "\n  UNION ALL ".join(f"SELECT {p} AS p, id, other, y, d FROM {sql} WHERE id % 4 <> other % 4" for p, sql in pairs.items())
    return f"""SELECT params, {r('avg(score)', 6)} AS mean_score, {r('stddev_pop(score)', 6)} AS std_score FROM (
  SELECT params, fold, CASE WHEN count(prediction) < count(*) THEN 0 ELSE 1 - sum((label - prediction) ** 2) / (var_pop(label) * count(*)) END AS score
  FROM {rows} CROSS JOIN ({candidates}) c LEFT JOIN (
    SELECT params, id, {prediction} AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY p, id ORDER BY d, other) AS rn FROM ({near})) n
    JOIN ({candidates}) c USING (p) WHERE {{limit}} GROUP BY params, id) f ON f.id = vec_id AND f.params = c.params GROUP BY c.params, fold) GROUP BY params"""


def _listed(candidates) -> str:
    return " UNION ALL ".join(f"SELECT '{json.dumps(c, sort_keys=True)}' AS params, {c['p']} AS p, {c.get('n_neighbors', c.get('radius'))} AS size, '{c['weights']}' AS weights"
                              for c in candidates)


MEAN_OF_NEAR = "CASE WHEN any_value(weights) = 'uniform' THEN avg(y) ELSE sum(y / d) / sum(1 / d) END"
KNN_GRID = {"n_neighbors": [3, 8, 14], "weights": ["uniform", "distance"], "p": [1, 2]}
RADIUS_GRID = {"radius": [1.1, 1.25, 1.5], "weights": ["uniform", "distance"], "p": [2]}


@query("m2_grid_search_knn", _neighbor_board(_listed(search.expand_grid(KNN_GRID)), MEAN_OF_NEAR, {1: L1, 2: L2}).replace("{limit}", "rn <= size").replace(
    "SELECT params, fold", "SELECT c.params, fold"))
def grid_search_knn(load):
    """Twelve candidates from one search for each distance."""
    e = load("embeddings").withColumn("fold", q("vec_id") % 4)
    return rounded(search.grid_search(e, "knn", KNN_GRID, ["embedding"], "label", key="vec_id").leaderboard.drop("candidate", "rank"), 6)


@query("m2_grid_search_radius", _neighbor_board(_listed(search.expand_grid(RADIUS_GRID)), MEAN_OF_NEAR, {2: L2}).replace("{limit}", "d <= size").replace(
    "SELECT params, fold", "SELECT c.params, fold"))
def grid_search_radius(load):
    """Radii from one search of the greatest; the smallest leaves rows without a neighbour, which scores 0."""
    e = load("embeddings").withColumn("fold", q("vec_id") % 4)
    return rounded(search.grid_search(e, "radius", RADIUS_GRID, ["embedding"], "label", key="vec_id").leaderboard.drop("candidate", "rank"), 6)


@query("m3_random_search")
def random_search(load):
    space = {"alpha": lambda g: g.expovariate(1.0) * 0.01, "l1_ratio": lambda g: g.random(), "positive": [True, False]}
    return rounded(search.random_search(net_lineitem(load), "elastic_net", space, NET_FEATURES, "label", n_iter=20).leaderboard, 6)


@query("m5_estimator_cv")
def estimator_cv(load):
    """Ready-made searches of the linear family: best score and metrics of each on the training rows."""
    df = net_lineitem(load).withColumn("fold10", F.col("l_orderkey") % 10)
    out = None
    for family, fold in (("elastic_net", "fold"), ("lasso", "fold"), ("ridge", "fold10")):
        found = search.current_best(df, family, NET_FEATURES, "label", fold)
        row = found.metrics(df).withColumns({"family": F.lit(family), "best_score": F.lit(found.best_score)})
        out = row if out is None else out.unionByName(row)
    return rounded(out, 4)


TEN = f"(SELECT *, l_orderkey % 10 AS fold10 FROM {NET_LINEITEM})"


@query("m5_current_best_ridge", f"""WITH fits AS (SELECT t.test, avg(log_price) AS x_bar, avg(label) AS y_bar, regr_sxx(label, log_price) AS sxx, regr_sxy(label, log_price) AS sxy
    FROM {TEN} d, (SELECT range AS test FROM range(10)) t WHERE d.fold10 <> t.test GROUP BY t.test),
  scores AS (SELECT alpha, test, 1 - sum((label - (y_bar + sxy / (sxx + alpha) * (log_price - x_bar))) ** 2) / (var_pop(label) * count(*)) AS score
    FROM fits JOIN {TEN} held ON held.fold10 = fits.test, (SELECT unnest([0.1, 1.0, 10.0]::DOUBLE[]) AS alpha) GROUP BY alpha, test),
  best AS (SELECT alpha, avg(score) AS score FROM scores GROUP BY alpha ORDER BY score DESC, alpha LIMIT 1),
  whole AS (SELECT avg(log_price) AS x_bar, avg(label) AS y_bar, regr_sxx(label, log_price) AS sxx, regr_sxy(label, log_price) AS sxy FROM {TEN}),
  scored AS (SELECT label, y_bar + sxy / (sxx + alpha) * (log_price - x_bar) AS p FROM {TEN}, whole, best)
SELECT (SELECT {r('score', 6)} FROM best) AS best_score, count(*) AS n, {r('1 - sum((label - p) ** 2) / (var_pop(label) * count(*))', 6)} AS r2,
  {r('avg(abs(exp(label) - exp(p)))', 2)} AS mae, {r('sqrt(avg((label - p) ** 2))', 6)} AS rmse FROM scored""")
def current_best_ridge(load):
    """The ready-made ridge search over ten folds, and the metrics of its refit."""
    df = net_lineitem(load).withColumn("fold10", F.col("l_orderkey") % 10)
    found = search.current_best(df, "ridge", ["log_price"], "label", "fold10")
    return rounded(found.metrics(df).withColumn("best_score", F.lit(found.best_score)), 6, mae=2)


@query("m1_tree_size_search")
def tree_size_search(load):
    df = holdout_split_arithmetic(net_lineitem(load), "l_orderkey")
    return rounded(trees.tree_size_search(df, NET_FEATURES, "label", sizes=range(10, 2000, 10)))


@query("m6_predict_mae", f"""SELECT {r('sqrt(avg(pow(ln(net) - (y_bar + sxy / sxx * (log_price - x_bar)), 2)))', 6)} AS error
FROM {NET_LINEITEM}, (SELECT avg(log_price) AS x_bar, avg(label) AS y_bar, regr_sxx(label, log_price) AS sxx,
  regr_sxy(label, log_price) AS sxy FROM {NET_LINEITEM})""")
def predict_mae(load):
    df = net_lineitem(load)
    scored = linear.fit_linear(df, ["log_price"], "label", "linear").transform(df)
    return rounded(search.log_error(scored, "net", "prediction"), 6)


# ---- ensembles -------------------------------------------------------------------------------


@query("n1_bagging")
def bagging(load):
    df = net_lineitem(load)
    model = ensemble.bagging(df, KEY, NET_FEATURES, "label", "ridge", {"alpha": 1.0}, n_estimators=10, max_features=0.75)
    return _scores(df, model.predict(df, ["label"]))


@query("n1_bagging_trees")
def bagging_trees(load):
    df = net_lineitem(load)
    model = ensemble.bagging(df, KEY, NET_FEATURES, "label", "decision_tree", {"max_depth": 5}, n_estimators=5, max_samples=0.5)
    return _scores(df, model.predict(df, ["label"]))


@query("n2_adaboost")
def adaboost(load):
    df = net_lineitem(load)
    model = ensemble.adaboost_r2(df, NET_FEATURES, "label", params={"max_depth": 5}, n_estimators=6, loss="exponential")
    return _scores(df, model.predict(df, ["label"]))


@query("n3_ransac")
def ransac(load):
    df = net_lineitem(load)
    found = ensemble.ransac(df, KEY, NET_FEATURES, "label", residual_threshold=0.02, max_trials=50)
    return rounded(_terms(df, found.model), 4)


BLEND = {"a": 0.2, "b": 0.3, "c": 0.5}
MEMBERS = "(SELECT *, log_price AS a, log_price * 0.99 + 0.1 AS b, label * 0.9 + 1 AS c FROM " + NET_LINEITEM + ")"


def _members(load):
    return net_lineitem(load).withColumns({
        "a": q("log_price"), "b": q("log_price") * 0.99 + 0.1, "c": q("label") * 0.9 + 1})


@query("n4_weighted_voting", f"""SELECT count(*) AS n, {r('1 - sum((label - p) * (label - p)) / (var_pop(label) * count(*))', 6)} AS r2,
  {r('avg(abs(exp(label) - exp(p)))', 2)} AS mae, {r('sqrt(avg((label - p) * (label - p)))', 6)} AS rmse
FROM (SELECT label, 0.2 * a + 0.3 * b + 0.5 * c AS p FROM {MEMBERS})""")
def weighted_voting(load):
    scored = _members(load).withColumn("prediction", ensemble.blend(BLEND))
    return rounded(scored.agg(*metric_exprs(q("label"), q("prediction"))), 6, mae=2)


@query("n4_weight_search", f"""SELECT {r('w[1]', 1)} AS wa, {r('w[2]', 1)} AS wb, {r('w[3]', 1)} AS wc, {r('avg(score)', 6)} AS mean_score,
  {r('stddev_pop(score)', 6)} AS std_score FROM (SELECT w, fold, 1 - sum((label - (w[1] * a + w[2] * b + w[3] * c) / (w[1] + w[2] + w[3])) ** 2)
  / (var_pop(label) * count(*)) AS score FROM {MEMBERS}, (SELECT unnest([[1, 0, 0], [0.5, 0.5, 0], [0.2, 0.3, 0.5], [0.1, 0.9, 1]]) AS w)
  GROUP BY w, fold) GROUP BY w""")
def weight_search(load):
    given = [(1, 0, 0), (0.5, 0.5, 0), (0.2, 0.3, 0.5), (0.1, 0.9, 1)]
    board = ensemble.search_weights(_members(load), ["a", "b", "c"], "label", "fold", given)
    named = [F.col("weights")[i].alias(f"w{m}") for i, m in enumerate("abc")]
    return rounded(board.select(*named, "mean_score", "std_score"), 6)


@query("n4_weight_search_grid", f"""SELECT weights, {r('avg(score)', 6)} AS mean_score, {r('stddev_pop(score)', 6)} AS std_score FROM (
  SELECT printf('%.1f,%.1f,%.1f', i / 10.0, j / 10.0, k / 10.0) AS weights, fold,
    1 - sum((label - (i * a + j * b + k * c) / (i + j + k)) ** 2) / (var_pop(label) * count(*)) AS score
  FROM {MEMBERS}, (SELECT x.range AS i, y.range AS j, z.range AS k FROM range(11) x, range(11) y, range(11) z) WHERE i + j + k > 0 GROUP BY i, j, k, fold)
  GROUP BY weights""")
def weight_search_grid(load):
    """All 1330 weight vectors from one scan."""
    board = ensemble.search_weights(_members(load), ["a", "b", "c"], "label", "fold", ensemble.weight_grid(3))
    return rounded(board.select(F.array_join("weights", ",").alias("weights"), "mean_score", "std_score"), 6)


# ---- whole preparation -----------------------------------------------------------------------

STATUS = {"o_orderstatus": [(["F"], "Done"), (["P", "Done"], "Closed")]}


def _order_rows(load):
    orders, customer = load("orders"), load("customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        "o_orderkey", "o_totalprice", F.year("o_orderdate").cast("long").alias("o_year"),
        F.month("o_orderdate").cast("long").alias("o_month"), F.when(q("o_orderkey") % 7 != 0, q("o_orderpriority")).alias("o_orderpriority"),
        F.when(q("o_orderkey") % 5 != 0, q("o_orderstatus")).alias("o_orderstatus"),
        F.when(q("o_orderkey") % 11 != 0, q("c_mktsegment")).alias("c_mktsegment"),
        F.when(q("o_orderkey") % 3 != 0, q("c_acctbal")).alias("c_acctbal"))


ORDER_ROWS = """(SELECT o_orderkey, o_totalprice, year(o_orderdate) AS o_year, month(o_orderdate) AS o_month,
  coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END, 'Missing') AS o_orderpriority,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS o_orderstatus,
  coalesce(CASE WHEN o_orderkey % 11 <> 0 THEN c_mktsegment END, 'None') AS c_mktsegment,
  coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN c_acctbal END, 0) AS c_acctbal,
  CASE WHEN year(o_orderdate) >= 2000 THEN 'test' ELSE 'train' END AS _split
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT (o_orderkey IN (524, 1299) AND year(o_orderdate) < 2000))"""

PRIORITY_LEVELS = ["Missing", "5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
STATUS_LEVELS = ["Closed", "O"]
SEGMENT_LEVELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "None"]


def order_plan() -> PreparePlan:
    def rules(groups):
        return [
            ImputeRule("zero", "constant", 0, groups["numeric"]),
            ImputeRule("none", "constant", "None", ["c_mktsegment"]),
            ImputeRule("missing", "constant", "Missing", ["o_orderpriority"]),
            ImputeRule("most", "most_frequent", None, ["o_orderstatus"]),
        ]

    def derived(df):
        return df.withColumns({
            "season": season_flag(q("o_month"), (6, 7)), "span": q("o_year") + q("o_month"),
            "district": district_tag(q("c_mktsegment"), low_quality("c_acctbal", 4000))})

    return PreparePlan(
        key="o_orderkey", target="o_totalprice", outlier_keys=[524, 1299], test_fix=("o_year", 2000, -100), rules=rules,
        derive=derived, recode=STATUS, ordinal={"o_orderpriority": PRIORITY_LEVELS, "o_orderstatus": STATUS_LEVELS},
        quantitative=["c_acctbal", "span"], onehot_first=["district"], onehot_codes=["o_month"],
        onehot_excluded=["c_mktsegment"], dropped=["c_mktsegment"])


DISTRICTS = [f"{s}_{side}" for s in SEGMENT_LEVELS for side in ("Lower", "Upper")]
STATUS_MODE = f"(SELECT o_orderstatus FROM {ORDER_ROWS} WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
X1_ROWS = f"""(SELECT o_orderkey, _split, o_totalprice, fixed AS o_year, c_acctbal,
  CAST(list_position({PRIORITY_LEVELS}, o_orderpriority) - 1 AS DOUBLE) AS o_orderpriority,
  CASE WHEN status IN ('F', 'P') THEN 0.0 ELSE 1.0 END AS o_orderstatus, CASE WHEN o_month IN (6, 7) THEN 1 ELSE 0 END AS season,
  fixed + o_month AS span, c_mktsegment || CASE WHEN c_acctbal < 4000 THEN '_Lower' ELSE '_Upper' END AS district
  FROM (SELECT *, coalesce(o_orderstatus, {STATUS_MODE}) AS status, CASE WHEN _split = 'test' AND o_year > 2000 THEN o_year - 100 ELSE o_year END AS fixed
        FROM {ORDER_ROWS}))"""
MINMAX = ["o_year", "o_orderpriority", "o_orderstatus", "season"]


@query("x1_preprocess", "SELECT o_orderkey, _split, " + r("CASE WHEN _split = 'train' THEN ln(1 + o_totalprice) END") + " AS label, "
       + ", ".join(f"{r(f'({c} - a_{c}) / (b_{c} - a_{c})')} AS {c}" for c in MINMAX) + ", "
       + ", ".join(f"{r(f'({c} - m_{c}) / s_{c}')} AS {c}" for c in ("c_acctbal", "span")) + ", "
       + ", ".join(f"CASE WHEN district = '{d}' THEN 1 ELSE 0 END AS \"district_{d}\"" for d in DISTRICTS)
       + f" FROM {X1_ROWS}, (SELECT " + ", ".join(f"min({c}) AS a_{c}, max({c}) AS b_{c}" for c in MINMAX) + ", "
       + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in ("c_acctbal", "span")) + f" FROM {X1_ROWS})")
def preprocess(load):
    rows = _order_rows(load)
    late = q("o_year") >= 2000
    prepare = Preparation(order_plan())
    gathered = prepare.gather(rows.where(~late), rows.where(late).drop("o_totalprice"))
    return rounded(prepare.fit(gathered).transform(gathered))
