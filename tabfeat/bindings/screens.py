"""Second moments and statistical screening (G, D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabfeat.bindings.registry import NET_FEATURES, NET_LINEITEM, NUMBERS, net_lineitem, query, r, rounded, union
from tabfeat.functions import columns
from tabfeat.operators import normality, screen
from tabfeat.operators.gram import fit_pca, moments

GRAM = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


@query("g1_gram", union(
    f"""SELECT fold, '{a}' AS a, '{b}' AS b, count(*) AS n, {r(f'avg({a})')} AS mean_a, {r(f'covar_pop({a}, {b})')} AS cov
FROM {NET_LINEITEM} GROUP BY fold""" for i, a in enumerate(GRAM) for b in GRAM[i:]))
def gram(load):
    df = net_lineitem(load)
    rows = []
    for fold, m in moments(df, GRAM, by="fold").items():
        cov = m.scatter / m.n
        rows += [(fold, a, b, int(m.n), float(m.mean[i]), float(cov[i, j]))
                 for i, a in enumerate(GRAM) for j, b in enumerate(GRAM) if j >= i]
    return rounded(df.sparkSession.createDataFrame(rows, "fold long, a string, b string, n long, mean_a double, cov double"))


CORR_FEATURES = ["l_quantity", "l_discount", "l_tax", "net"]


@query("g2_correlation_matrix", union(
    f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 6)} AS corr FROM {NET_LINEITEM}"
    for a in [*CORR_FEATURES, "l_extendedprice"] for b in [*CORR_FEATURES, "l_extendedprice"]))
def correlation_matrix(load):
    return rounded(screen.correlation_matrix(net_lineitem(load), CORR_FEATURES, "l_extendedprice"), 6)


@query("g2_top_correlations", "SELECT * FROM (" + union(
    f"SELECT '{a}' AS feature, {r(f'corr({a}, l_extendedprice)', 6)} AS corr FROM {NET_LINEITEM}" for a in CORR_FEATURES)
    + ") ORDER BY abs(corr) DESC, feature LIMIT 2")
def top_correlations(load):
    return rounded(screen.top_correlations(net_lineitem(load), CORR_FEATURES, "l_extendedprice", 2), 6)


@query("g2_cross_block", union(
    f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 6)} AS corr FROM lineitem"
    for a in ("l_quantity", "l_extendedprice") for b in ("l_discount", "l_tax")))
def cross_block(load):
    return rounded(screen.pair_correlations(load("lineitem"), ["l_quantity", "l_extendedprice"], ["l_discount", "l_tax"]), 6)


def _spearman_sql(x, y, table):
    def ranks(v):
        return f"rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0"
    return f"SELECT '{x}' AS feature, {r('corr(rx, ry)', 6)} AS spearman FROM (SELECT {ranks(x)} AS rx, {ranks(y)} AS ry FROM {table})"


@query("g3_spearman", union(_spearman_sql(x, "l_extendedprice", NET_LINEITEM) for x in CORR_FEATURES))
def spearman(load):
    return rounded(screen.spearman(net_lineitem(load), "l_extendedprice", CORR_FEATURES), 6)


@query("g3_kendall", union(f"""SELECT '{x}' AS feature, {r('s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty))', 6)} AS kendall_tau FROM
  (SELECT CAST(sum(a.w * b.w * CASE WHEN a.y < b.y THEN 1.0 WHEN a.y > b.y THEN -1.0 ELSE 0.0 END) AS DOUBLE) AS s
   FROM (SELECT {x} AS x, l_tax AS y, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY ALL) a
   JOIN (SELECT {x} AS x, l_tax AS y, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY ALL) b ON a.x < b.x),
  (SELECT CAST(count(*) AS DOUBLE) AS n FROM lineitem),
  (SELECT sum(w * (w - 1) / 2) AS tx FROM (SELECT CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY {x})),
  (SELECT sum(w * (w - 1) / 2) AS ty FROM (SELECT CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY l_tax))"""
    for x in ("l_quantity", "l_discount")))
def kendall(load):
    return rounded(screen.kendall_tau(load("lineitem"), "l_tax", ["l_quantity", "l_discount"]), 6)


@query("g3_corr_screen")
def corr_screen(load):
    return rounded(screen.corr_screen(net_lineitem(load), "label", NET_FEATURES), 6)


@query("g4_select_by_pearson", "SELECT feature FROM (" + union(
    f"SELECT '{a}' AS feature, corr({a}, label) AS c, count(*) AS n FROM {NET_LINEITEM}" for a in [*NET_FEATURES, "l_extendedprice"])
    + ") WHERE abs(c) > 0.7 AND abs(c) * sqrt((n - 2) / (1 - c * c)) > 1.961")
def select_by_pearson(load):
    screened = screen.corr_screen(net_lineitem(load), "label", [*NET_FEATURES, "l_extendedprice"], coefficients=["pearson"])
    return screen.select_by_pearson(screened)


@query("g5_vif", union(f"""SELECT '{c}' AS feature, {r('1 / (1 - xy * xy / (xx * yy))')} AS vif, CAST(NULL AS INTEGER) AS step FROM (
  SELECT sum(l_quantity * l_quantity) AS xx, sum(l_extendedprice * l_extendedprice) AS yy,
  sum(l_quantity * l_extendedprice) AS xy FROM lineitem)""" for c in ("l_quantity", "l_extendedprice")))
def vif(load):
    return rounded(screen.vif_select(load("lineitem"), ["l_quantity", "l_extendedprice"], threshold=1e6))


@query("g5_vif_select")
def vif_select(load):
    return rounded(screen.vif_select(net_lineitem(load), [*NUMBERS, "net", "log_price"]))


ANOVA = ["l_returnflag", "l_linestatus", "l_linenumber"]


@query("g6_anova", union(f"""SELECT '{c}' AS feature, {r('(sst - ssw) / (k - 1) / (ssw / (n - k))')} AS f FROM (
  SELECT sum(n) AS n, count(*) AS k, sum(v) AS ssw FROM (SELECT count(*) AS n, var_pop(l_extendedprice) * count(*) AS v
  FROM lineitem GROUP BY {c})), (SELECT var_pop(l_extendedprice) * count(*) AS sst FROM lineitem)""" for c in ANOVA))
def anova_f(load):
    return rounded(screen.anova_sums(load("lineitem"), "l_extendedprice", ANOVA).select("feature", "f"))


@query("g6_anova_p")
def anova_p(load):
    return rounded(screen.anova(load("lineitem"), "l_extendedprice", ANOVA), 6)


@query("g7_ols_summary", f"""SELECT 'l_extendedprice' AS term, {r('b', 8)} AS coef, {r('se', 8)} AS std_err, {r('b / se', 2)} AS t, {r('r2', 6)} AS r2,
  {r('1 - (1 - r2) * (n - 1) / (n - 2)', 6)} AS adj_r2, {r('b * b / (se * se)', 0)} AS f FROM (
  SELECT *, sqrt((1 - r2) * syy / (n - 2) / sxx) AS se FROM (SELECT regr_slope(net, l_extendedprice) AS b, regr_r2(net, l_extendedprice) AS r2,
  regr_sxx(net, l_extendedprice) AS sxx, regr_syy(net, l_extendedprice) AS syy, CAST(count(*) AS DOUBLE) AS n FROM {NET_LINEITEM}))""")
def ols_summary(load):
    out = screen.ols_summary(net_lineitem(load), "net", ["l_extendedprice"]).where("term <> 'const'")
    return rounded(out.drop("p", "f_p"), coef=8, std_err=8, t=2, r2=6, adj_r2=6, f=0)


@query("g7_ols_summary_const", f"""SELECT 'const' AS term, {r('a', 3)} AS coef, {r('se', 4)} AS std_err, {r('a / se', 2)} AS t FROM (
  SELECT a, sqrt((1 - r2) * syy / (n - 2) * (1 / n + x_bar * x_bar / sxx)) AS se FROM (SELECT regr_intercept(net, l_extendedprice) AS a,
  regr_r2(net, l_extendedprice) AS r2, regr_sxx(net, l_extendedprice) AS sxx, regr_syy(net, l_extendedprice) AS syy, avg(l_extendedprice) AS x_bar,
  CAST(count(*) AS DOUBLE) AS n FROM {NET_LINEITEM}))""")
def ols_summary_const(load):
    """The other row of the same table: the intercept."""
    out = screen.ols_summary(net_lineitem(load), "net", ["l_extendedprice"]).where("term = 'const'")
    return rounded(out.select("term", "coef", "std_err", "t"), coef=3, std_err=4, t=2)


@query("g7_ols_summary_all")
def ols_summary_all(load):
    return rounded(screen.ols_summary(net_lineitem(load), "label", NET_FEATURES), 6)


JARQUE_BERA = union(f"""SELECT '{c}' AS feature, {r('jb', 2)} AS jb, {r('exp(-jb / 2)', 6)} AS p,
  CASE WHEN exp(-jb / 2) < 0.01 THEN 1 ELSE 0 END AS rejected FROM (SELECT n / 6.0 * (g1 * g1 + g2 * g2 / 4) AS jb FROM (
  SELECT CAST(count(*) AS DOUBLE) AS n, avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5) AS g1,
  avg(pow(x - m, 4)) / pow(avg(pow(x - m, 2)), 2) - 3 AS g2 FROM (SELECT {c} AS x FROM lineitem), (SELECT avg({c}) AS m FROM lineitem)))"""
    for c in NUMBERS)


@query("g8_normality_screen", JARQUE_BERA)
def normality_screen(load):
    return rounded(screen.normality_screen(load("lineitem"), NUMBERS), jb=2, p=6)


@query("g8_all_normal", f"SELECT CASE WHEN max(rejected) = 0 THEN 1 ELSE 0 END AS all_normal FROM ({JARQUE_BERA})")
def all_normal(load):
    return screen.all_normal(screen.normality_screen(load("lineitem"), NUMBERS))


def _horner(coefficients, x):
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _probit_sql(p):
    """The rational approximation that the library uses."""
    def tail(t):
        return f"{_horner(columns.PROBIT_C, t)} / {_horner(columns.PROBIT_D, t)}"

    low, high, middle = (f"(sqrt(-2 * ln({p})))", f"(sqrt(-2 * ln(1 - {p})))", f"(({p} - 0.5) * ({p} - 0.5))")
    return f"""CASE WHEN {p} < {columns.PROBIT_TAIL} THEN {tail(low)} WHEN {p} > 1 - {columns.PROBIT_TAIL} THEN -{tail(high)}
    ELSE ({p} - 0.5) * {_horner(columns.PROBIT_A, middle)} / {_horner(columns.PROBIT_B, middle)} END"""


def _power_sql(coefficients, x):
    return "(" + " + ".join(f"{c!r} * pow({x}, {i})" for i, c in enumerate(coefficients)) + ")"


SHAPIRO = f"""WITH long AS ({union(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM lineitem" for c in NUMBERS)}),
  ranked AS (SELECT feature, x - avg(x) OVER (PARTITION BY feature) AS x, row_number() OVER (PARTITION BY feature ORDER BY x) AS i,
    CAST(count(*) OVER (PARTITION BY feature) AS DOUBLE) AS n FROM long),
  placed AS (SELECT *, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS p FROM ranked),
  scored AS (SELECT *, {_probit_sql('p')} AS m FROM placed),
  sums AS (SELECT feature, any_value(n) AS n, sum(m * x) AS mx, sum(m * m) AS ss, sum(x * x) AS xx, max(x) FILTER (i = 1) AS x1, max(x) FILTER (i = 2) AS x2,
    max(x) FILTER (i = n - 1) AS y2, max(x) FILTER (i = n) AS y1, max(m) FILTER (i = n) AS m1, max(m) FILTER (i = n - 1) AS m2 FROM scored GROUP BY feature),
  ends AS (SELECT *, {_power_sql(normality.LARGEST, '(1 / sqrt(n))')} + m1 / sqrt(ss) AS a1, {_power_sql(normality.SECOND, '(1 / sqrt(n))')} + m2 / sqrt(ss) AS a2 FROM sums),
  done AS (SELECT feature, n, pow((mx - m1 * (y1 - x1) - m2 * (y2 - x2)) / sqrt((ss - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2))
    + a1 * (y1 - x1) + a2 * (y2 - x2), 2) / xx AS w FROM ends),
  tested AS (SELECT *, (ln(1 - w) - {_power_sql(normality.MEAN, 'ln(n)')}) / exp({_power_sql(normality.DEVIATION, 'ln(n)')}) AS z FROM done)
SELECT feature, CAST(n AS BIGINT) AS n, {r('w', 6)} AS w, {r('z', 3)} AS z, CASE WHEN z > 2.3263478740408408 THEN 1 ELSE 0 END AS rejected FROM tested"""


@query("g8_shapiro_wilk", SHAPIRO)
def shapiro_wilk(load):
    return rounded(normality.shapiro_wilk(load("lineitem"), NUMBERS).drop("p"), w=6, z=3)


@query("d1_pca", f"SELECT 1 AS component, {r('(1 + abs(c)) / 2', 6)} AS ratio FROM (SELECT corr(l_quantity, net) AS c FROM {NET_LINEITEM})")
def pca(load):
    df = net_lineitem(load)
    fitted = fit_pca(df, ["l_quantity", "net"], 1)
    return rounded(df.sparkSession.createDataFrame([(1, float(fitted.ratio[0]))], "component int, ratio double"), 6)


def _embedding_columns(load):
    wide = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)]
    return load("embeddings").select("vec_id", *wide), [f"e{i}" for i in range(64)]


@query("d1_pca_scores")
def pca_scores(load):
    df, cols = _embedding_columns(load)
    return rounded(fit_pca(df, cols, 8).transform(df, keep=["vec_id"]))


@query("d2_kmeans_segments")
def kmeans_segments(load):
    """Cluster sizes; the labels themselves are arbitrary."""
    df, cols = _embedding_columns(load)
    labelled, _ = screen.kmeans_segments(df, "vec_id", cols)
    return labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).orderBy("n")
