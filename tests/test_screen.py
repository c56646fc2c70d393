import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabfeat.functions import tails
from tabfeat.operators import screen
from tabfeat.operators.gram import fit_pca, masked_correlations, moments, total


def brute_tau(x, y):
    dx, dy = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
    return (dx * dy).sum() / math.sqrt((dx != 0).sum() * (dy != 0).sum())


@pytest.fixture(scope="module")
def tied(spark):
    rng = np.random.default_rng(0)
    n = 1500
    y = rng.normal(size=n).round(2)
    pdf = pd.DataFrame({
        "y": y, "a": (y + rng.normal(size=n)).round(1), "b": rng.integers(0, 4, n).astype(float), "c": -y,
        "hot": np.where(rng.random(n) < 0.4, 0.0, rng.normal(size=n)), "k": 2.0})
    return spark.createDataFrame(pdf).repartition(4), pdf


@pytest.mark.parametrize("bucket", [10**6, 120])
def test_rank_correlations_match_brute_force(tied, bucket):
    df, pdf = tied
    got = {r["feature"]: r for r in screen.corr_screen(df, "y", ["a", "b", "c", "hot", "k"], bucket).collect()}
    for f in ("a", "b", "c", "hot"):
        assert math.isclose(got[f]["kendall_tau"], brute_tau(pdf[f].to_numpy(), pdf["y"].to_numpy()), abs_tol=1e-9)
        assert math.isclose(got[f]["spearman"], pdf[f].rank().corr(pdf["y"].rank()), abs_tol=1e-9)
        assert math.isclose(got[f]["pearson"], pdf[f].corr(pdf["y"]), abs_tol=1e-9)
    assert got["c"]["kendall_p"] < 1e-10 and got["b"]["pearson_p"] > 0.001
    assert math.isnan(got["k"]["pearson"]) and math.isnan(got["k"]["kendall_tau"])


def test_cell_scores_use_every_path():
    rng = np.random.default_rng(1)
    parts, want = [], 0.0
    for g, (size, high) in enumerate([(2, 1024), (3, 8), (9, 64), (60, 32), (64, 1024), (700, 40), (900, 1024), (1500, 1024)]):
        cells = np.unique(rng.integers(0, high, (size, 2)), axis=0)
        w = rng.integers(1, 9, len(cells)).astype(float)
        parts.append((np.full(len(cells), g), cells[:, 0], cells[:, 1], w))
        sx, sy = (np.sign(c[:, None] - c[None]) for c in cells.T)
        want += (sx * sy * np.outer(w, w)).sum() / 2
    group, i, j, w = (np.concatenate(c) for c in zip(*parts))
    mixed = rng.permutation(len(group))
    assert math.isclose(screen._digit_scores(group[mixed], i[mixed], j[mixed], w[mixed]), want)


def test_small_exact_p_values():
    # values from standard tables
    assert math.isclose(tails.t_two_sided(2.228, 10), 0.05, abs_tol=1e-4)
    assert math.isclose(tails.f_tail(4.9646, 1, 10), 0.05, abs_tol=1e-5)
    assert math.isclose(tails.f_tail(3.4780, 4, 10), 0.05, abs_tol=1e-5)
    assert math.isclose(tails.normal_two_sided(1.959964), 0.05, abs_tol=1e-7)
    assert tails.log_f_tail(5000.0, 3, 500) < -300 and math.isfinite(tails.log_f_tail(1e6, 5, 5000))


def test_select_by_pearson_sides(tied):
    df, _ = tied
    screened = screen.corr_screen(df, "y", ["a", "b", "c"])
    assert {r[0] for r in screen.select_by_pearson(screened, 0.6).collect()} == {"a", "c"}
    assert {r[0] for r in screen.select_by_pearson(screened, 0.6, positive_only=True).collect()} == {"a"}


@pytest.mark.parametrize("by", [None, "g"])
def test_narrow_and_wide_moments_agree(spark, by):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(1e6, 2, (900, 5)), columns=list("abcde"))
    pdf["g"] = rng.integers(0, 3, 900)
    pdf["w"] = rng.random(900)
    pdf.loc[5, "a"] = np.nan
    df = spark.createDataFrame(pdf).repartition(7)
    for weight in (None, F.col("w")):
        narrow = moments(df, list("abcde"), by, weight)
        wide = moments(df, list("abcde"), by, weight, narrow=0)
        assert set(narrow) == set(wide) == ({None} if by is None else {0, 1, 2})
        for k in narrow:
            assert np.allclose(narrow[k].scatter, wide[k].scatter, rtol=1e-9)
            assert np.allclose(narrow[k].mean, wide[k].mean)
    whole = total(moments(df, list("abcde"), "g"))
    kept = pdf.dropna()[list("abcde")]
    assert np.allclose(whole.scatter / (whole.n - 1), np.cov(kept.T), rtol=1e-8)
    assert np.allclose(whole.raw, kept.T @ kept)


def test_vif_drops_collinear_columns_once(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=400), rng.normal(size=400)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": a + b, "d": rng.normal(size=400)}))
    rows = {r["feature"]: r for r in screen.vif_select(df, ["a", "b", "c", "d"]).collect()}
    dropped = [f for f, r in rows.items() if r["step"]]
    assert len(dropped) == 1 and dropped[0] in "abc" and math.isinf(rows[dropped[0]]["vif"])
    assert all(r["vif"] < 5 for f, r in rows.items() if not r["step"])


def test_anova_groups_with_one_row_and_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 4.0), ("b", 5.0), ("c", 9.0), (None, 100.0)], "g string, y double")
    r = screen.anova(df, "y", ["g"]).first()
    groups = [[1, 2], [4, 5], [9]]
    grand = np.mean(sum(groups, []))
    between = sum(len(g) * (np.mean(g) - grand) ** 2 for g in groups) / 2
    assert math.isclose(r["f"], between / (1.0 / 2))
    assert math.isclose(r["disparity"], -math.log(r["p"]))


def test_ols_matches_lstsq_and_spark(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3))
    y = x @ [1, -2, 0.5] + 3 + rng.normal(size=500)
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=["a", "b", "c", "y"]))
    rows = screen.ols_summary(df, "y", ["a", "b", "c"]).collect()
    design = np.column_stack([np.ones(500), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    sigma2 = ((y - design @ beta) ** 2).sum() / 496
    se = np.sqrt(sigma2 * np.diag(np.linalg.inv(design.T @ design)))
    assert np.allclose([r["coef"] for r in rows], beta) and np.allclose([r["std_err"] for r in rows], se)


def test_normality_screen_counts_missing_as_zero(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(pd.DataFrame({"n": rng.normal(size=2000), "e": rng.exponential(size=2000)}))
    rows = {r["feature"]: r["rejected"] for r in screen.normality_screen(df, ["n", "e"]).collect()}
    assert rows == {"n": 0, "e": 1}
    assert screen.all_normal(screen.normality_screen(df, ["n"])).first()[0] == 1


def test_pca_expression_and_batch_scores_agree(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20)), columns=[f"x{i}" for i in range(20)])
    pdf["id"] = range(300)
    df = spark.createDataFrame(pdf)
    cols = [f"x{i}" for i in range(20)]
    fitted = fit_pca(df, cols, 10)
    wide = fitted.transform(df, ["id"]).toPandas().sort_values("id")
    narrow = df.select("id", fitted.score(df, 3).alias("pc4")).toPandas().sort_values("id")
    assert np.allclose(wide["pc4"], narrow["pc4"])
    z = (pdf[cols] - pdf[cols].mean()) / pdf[cols].std(ddof=0)
    s = np.linalg.svd(z.to_numpy(), compute_uv=False) ** 2
    assert np.allclose(fitted.ratio, (s / s.sum())[:10])


def test_kmeans_finds_separate_clusters(spark):
    rng = np.random.default_rng(7)
    centres = np.array([[0, 0], [20, 0], [0, 20], [20, 20], [10, 50]])
    x = np.repeat(centres, 40, axis=0) + rng.normal(size=(200, 2))
    df = spark.createDataFrame(pd.DataFrame({"id": range(200), "a": x[:, 0], "b": x[:, 1]}))
    labelled, _ = screen.kmeans_segments(df, "id", ["a", "b"], seed=1)
    assert sum(r["count"] for r in labelled.groupBy("cluster").count().collect()) == 200


def test_many_pairs_share_a_scan_but_stay_pairwise_complete(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame(rng.normal(5, 1, (300, 12)), columns=[f"x{i}" for i in range(12)])
    pdf.loc[rng.random(300) < 0.2, "x3"] = np.nan
    pdf["x5"] = 0.1
    df = spark.createDataFrame(pdf).repartition(4)
    got = screen.correlation_matrix(df, list(pdf.columns[:-1]), "x11").toPandas().pivot(index="a", columns="b", values="corr")
    want = pdf.corr().loc[got.index, got.columns]
    assert got.loc["x5"].isna().all()
    free = [c for c in got.columns if c != "x5"]
    assert np.allclose(got.loc[free, free], want.loc[free, free])
    top = screen.correlation_matrix(df, list(pdf.columns[:-1]), "x11", k=3)
    assert top.count() == 16


@pytest.mark.parametrize("width", [4, 15])
def test_all_pairs_with_gaps_from_one_scan(spark, width):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(300, width)) + np.outer(rng.normal(size=300), np.ones(width)) + 1e5
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 1] = 7.0  # constant
    x[:150, 2], x[150:, 3] = np.nan, np.nan  # never together
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(width)])
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} double" for c in pdf.columns)).repartition(3)
    got, want = masked_correlations(df, list(pdf.columns)), pdf.corr().to_numpy()
    want[1, :] = want[:, 1] = np.nan
    assert np.allclose(got, want, atol=1e-9, equal_nan=True)
