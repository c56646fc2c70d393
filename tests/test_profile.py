import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabfeat.functions.columns import normal_cdf, probit
from tabfeat.operators import profile


def collect(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_missing_counts_nan_and_breaks_ties_by_name(spark):
    df = spark.createDataFrame([(1, float("nan"), None, 1), (2, None, "x", 2), (3, 1.0, None, None)],
                               "id long, a double, b string, c long")
    rows = [(r["feature"], r["total"]) for r in profile.missing_profile(df).collect()]
    assert rows == [("a", 2), ("b", 2), ("c", 1)]


def test_symmetry_is_bias_corrected(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 3, 9, 14)], "x double")
    r = profile.symmetry(df, ["x"]).first()
    assert math.isclose(r["skewness"], 1.284428, abs_tol=1e-6)
    assert math.isclose(r["kurtosis"], 0.323386, abs_tol=1e-6)


def test_describe_interpolates_quartiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 10, 11)], "v double")
    r = profile.describe(df, ["v"]).first()
    assert (r["p25"], r["p50"], r["p75"]) == (2.25, 3.5, 8.5)
    assert r["count"] == 6


def test_describe_small_limit_agrees(spark):
    df = spark.range(2000).select((F.col("id") * 37 % 1009).cast("double").alias("x"), F.lit(1).alias("k"))
    assert profile.describe(df, ["x", "k"], limit=50).collect() == profile.describe(df, ["x", "k"]).collect()


def test_classify_and_divide(spark):
    df = spark.sql("select 1 a, 2L b, 1.5D c, 'x' d, timestamp_ntz'2020-01-01 00:00:00' e")
    groups = profile.classify_dtypes(df, exclude=["b"])
    assert groups == {"int": ["a"], "float": ["c"], "numeric": ["a", "c"], "categorical": ["d"], "datetime": ["e"]}
    assert profile.divide_numeric_categorical(df) == (["a", "b", "c", "e"], ["d"])


def test_histogram_matches_numpy_and_handles_constants(spark):
    x = np.random.default_rng(1).gamma(2, 3, 3000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "c": np.ones(3000)}))
    rows = collect(profile.histogram(df, ["x", "c"], bins=12), "variable", "bin")
    counts, _ = np.histogram(x, 12)
    assert [rows["x", i]["n"] for i in range(12) if counts[i]] == [c for c in counts if c]
    assert sum(r["n"] for (v, _), r in rows.items() if v == "c") == 3000


def test_box_summary_paths_agree(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 3000, p=[0.9, 0.1]), "y": rng.standard_t(2, 3000)})
    df = spark.createDataFrame(pdf)
    plain = profile.box_summary(df, "y", ["g"]).orderBy("value").collect()
    cut = profile.box_summary(df, "y", ["g"], limit=100).orderBy("value").collect()
    for a, b in zip(plain, cut):
        for k in a.asDict():
            assert a[k] == b[k] if isinstance(a[k], (str, int)) else math.isclose(a[k], b[k])


def test_segment_difference_zero_base_is_infinite(spark):
    df = spark.createDataFrame([(1.0, 0.0), (9.0, 2.0)], "y double, f double")
    assert profile.segment_difference(df, "y", ["f"], 5).first()["difference"] == math.inf


def test_normal_functions(spark):
    from statistics import NormalDist
    z = np.linspace(-6, 6, 101)
    df = spark.createDataFrame(pd.DataFrame({"z": z}))
    out = df.select("z", normal_cdf(F.col("z")).alias("p")).withColumn("back", probit(F.col("p"))).toPandas()
    assert np.allclose(out["p"], [NormalDist().cdf(v) for v in out["z"]], rtol=1e-9, atol=1e-15)
    assert np.allclose(out["back"], out["z"], atol=1e-6)


def test_ks_buckets_agree(spark):
    x = np.random.default_rng(3).lognormal(0, 1, 2000).round(2) + 0.01
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    plain = collect(profile.distribution_fit(df, "x"), "distribution")
    cut = collect(profile.distribution_fit(df, "x", bucket_rows=60), "distribution")
    assert {k: round(v["ks"], 9) for k, v in plain.items()} == {k: round(v["ks"], 9) for k, v in cut.items()}
    assert plain["lognormal"]["ks"] < 0.05 < plain["normal"]["ks"]
