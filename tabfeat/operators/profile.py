"""Profiles of a table: one pass per statistic family, one row per feature in the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabfeat.functions.columns import INTEGRALS, NUMERICS, is_missing, normal_cdf, numeric, q
from tabfeat.operators.lookup import lookup_join
from tabfeat.operators.ranks import BUCKET_ROWS, add_rank, exact_quantiles, grouped_quantiles
from tabfeat.session import cut_lineage

MAX_BINS = 50


def divide_numeric_categorical(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Names of the columns that are not strings, and of those that are."""
    kept = [f for f in df.schema.fields if f.name not in set(exclude)]
    text = [f.name for f in kept if isinstance(f.dataType, T.StringType)]
    return [f.name for f in kept if f.name not in set(text)], text


def classify_dtypes(df: DataFrame, exclude: Sequence[str] = ()) -> dict[str, list[str]]:
    """Column names by class. Every integral width counts as int."""
    kept = [f for f in df.schema.fields if f.name not in set(exclude)]

    def of(*types):
        return [f.name for f in kept if isinstance(f.dataType, types)]

    return {
        "int": of(*INTEGRALS),
        "float": of(T.DoubleType, T.FloatType, T.DecimalType),
        "numeric": of(*NUMERICS),
        "categorical": of(T.StringType),
        "datetime": of(T.TimestampType, T.TimestampNTZType, T.DateType),
    }


def one_row_per_feature(row: DataFrame, features: Sequence[str], stats: dict[str, str]) -> DataFrame:
    """Turn a one-row frame with columns ``<i>_<stat>`` into rows (feature, stat...)."""
    entries = [
        F.struct(F.lit(f).alias("feature"),
                 *[F.col(f"{i}_{s}").cast(t).alias(s) for s, t in stats.items()])
        for i, f in enumerate(features)
    ]
    return row.select(F.inline(F.array(*entries)))


def describe(df: DataFrame, features: Sequence[str], limit: int | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max of every feature."""
    kw = {} if limit is None else {"limit": limit}
    quart = exact_quantiles(df, features, [0.25, 0.5, 0.75], **kw)
    aggs = []
    for i, f in enumerate(features):
        v = numeric(df, f)
        aggs += [F.count(v).alias(f"{i}_count"), F.avg(v).alias(f"{i}_mean"), F.stddev_samp(v).alias(f"{i}_std"),
                 F.min(v).alias(f"{i}_min"), F.max(v).alias(f"{i}_max")]
        aggs += [F.any_value(F.lit(x).cast("double")).alias(f"{i}_{n}") for n, x in zip(("p25", "p50", "p75"), quart[f])]
    stats = {"count": "long"} | {s: "double" for s in ("mean", "std", "min", "p25", "p50", "p75", "max")}
    return one_row_per_feature(df.agg(*aggs), features, stats)


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing values per column: total and share of the rows, only where there are any."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count_if(is_missing(df, c)).alias(f"{i}_total") for i, c in enumerate(df.columns)]
    entries = [F.struct(F.lit(c).alias("feature"), F.col(f"{i}_total").alias("total"), F.col("rows"))
               for i, c in enumerate(df.columns)]
    return (
        df.agg(*aggs)
        .select(F.inline(F.array(*entries)))
        .where("total > 0")
        .select("feature", "total", (F.col("total") / F.col("rows")).alias("percent"))
        .orderBy(F.desc("total"), "feature")
    )


def moments_of(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """n, mean, bias-corrected skewness G1 and excess kurtosis G2 per feature."""
    aggs = []
    for i, f in enumerate(features):
        v = numeric(df, f)
        aggs += [F.count(v).cast("double").alias(f"{i}_n"), F.avg(v).alias(f"{i}_mean"),
                 F.skewness(v).alias(f"{i}_g1"), F.kurtosis(v).alias(f"{i}_g2")]
    rows = one_row_per_feature(df.agg(*aggs), features, dict.fromkeys(("n", "mean", "g1", "g2"), "double"))
    n = F.col("n")
    skew = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)
    return rows.withColumn("skewness", F.when(n > 2, skew)).withColumn("kurtosis", F.when(n > 3, kurt))


def symmetry(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return moments_of(df, features).select("feature", "skewness", "kurtosis")


def duplicate_count(df: DataFrame, column: str) -> DataFrame:
    """Number of distinct values that occur more than once."""
    counts = df.groupBy(q(column)).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count_if(F.col("n") > 1).alias("duplicates"))


def melt(df: DataFrame, ids: Sequence[str], features: Sequence[str], as_type: str) -> DataFrame:
    """Wide to long: id columns, ``variable``, ``value``; the values cast to one type."""
    cast = df.select(*[q(c) for c in ids], *[q(f).cast(as_type).alias(f) for f in features])
    return cast.unpivot(list(ids), [q(f) for f in features], "variable", "value")


def value_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows per level of each feature; missing values are not a level."""
    long = melt(df, [], features, "string").where(F.col("value").isNotNull())
    return long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, features: Sequence[str], bins: int | None = None, limit: int | None = None,
              max_bins: int = MAX_BINS) -> DataFrame:
    """Rows per equal-width bin. Without ``bins`` the Freedman-Diaconis width applies, at most ``max_bins`` bins.

    The last bin is closed on the right.
    """
    aggs = []
    for i, f in enumerate(features):
        v = numeric(df, f)
        aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.count(v).alias(f"n{i}")]
    ends = df.agg(*aggs).first()
    kw = {} if limit is None else {"limit": limit}
    quart = None if bins else exact_quantiles(df, features, [0.25, 0.75], **kw)
    parts = []
    for i, f in enumerate(features):
        lo, hi, n = ends[f"lo{i}"], ends[f"hi{i}"], ends[f"n{i}"]
        if not n:
            continue
        k = bins
        if k is None:
            h = 2 * (quart[f][1] - quart[f][0]) / n ** (1 / 3)
            wanted = -(-(hi - lo) // h) if h > 0 else n**0.5
            k = int(max(1, min(max_bins, wanted)))
        if hi == lo:  # constant column: a unit-wide range around it
            lo, hi = lo - 0.5, hi + 0.5
        width = (hi - lo) / k
        v = numeric(df, f)
        at = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(k - 1)).cast("long")
        parts.append(F.struct(F.lit(f).alias("variable"), at.alias("bin"), (F.lit(lo) + at * F.lit(width)).alias("left")))
    if not parts:
        raise ValueError("no values to count")
    long = df.select(F.inline(F.array(*parts))).where(F.col("bin").isNotNull())
    return long.groupBy("variable", "bin").agg(F.min("left").alias("left_edge"), F.count(F.lit(1)).alias("n"))


def box_summary(df: DataFrame, target: str, features: Sequence[str], limit: int | None = None) -> DataFrame:
    """Five-number summary of the target per feature level.

    Whiskers end at the most extreme values within 1.5 interquartile ranges of
    the quartiles; rows beyond them are counted as outliers.
    """
    base = df.select(numeric(df, target).alias("_target"), *[q(f) for f in features])
    long = melt(base, ["_target"], features, "string").where("value is not null and _target is not null")
    kw = {} if limit is None else {"limit": limit}
    keys = ["variable", "value"]
    boxes = grouped_quantiles(long, keys, "_target", [0.25, 0.5, 0.75], **kw).select(
        *keys,
        *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))],
    )
    joined = lookup_join(long, boxes, keys)
    y, iqr = F.col("_target"), F.col("q3") - F.col("q1")
    inside = (y >= F.col("q1") - iqr * 1.5) & (y <= F.col("q3") + iqr * 1.5)
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.first(c).alias(c) for c in ("q1", "median", "q3")],
        F.min(F.when(inside, y)).alias("whisker_low"),
        F.max(F.when(inside, y)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def group_mean_curve(df: DataFrame, target: str, features: Sequence[str], as_type: str = "string") -> DataFrame:
    """Mean target per value of each feature."""
    base = df.select(numeric(df, target).alias("_target"), *[q(f) for f in features])
    long = melt(base, ["_target"], features, as_type).where(F.col("value").isNotNull())
    return long.groupBy("variable", "value").agg(F.avg("_target").alias("mean_target"))


def segment_difference(df: DataFrame, target: str, features: Sequence[str], threshold: float = 200000) -> DataFrame:
    """Relative difference of feature means above and below the target threshold; missing counts as 0."""
    aggs = []
    for i, f in enumerate(features):
        v = F.coalesce(numeric(df, f), F.lit(0.0))
        aggs += [F.avg(F.when(q(target) >= threshold, v)).alias(f"{i}_high"),
                 F.avg(F.when(q(target) < threshold, v)).alias(f"{i}_low")]
    rows = one_row_per_feature(df.agg(*aggs), features, {"high": "double", "low": "double"})
    gap = F.col("high") - F.col("low")
    zero_base = F.when(gap > 0, F.lit(float("inf"))).when(gap < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return rows.select("feature", F.when(F.col("low") == 0, zero_base)
                       .otherwise(F.try_divide(gap, F.col("low"))).alias("difference"))


def ks_distances(df: DataFrame, column: str, cdfs: dict, bucket_rows: int | None = None) -> DataFrame:
    """Kolmogorov-Smirnov distance of the column to each distribution ``name -> cdf(Column)``."""
    values = df.select(numeric(df, column).alias("x")).where("x is not null")
    n = values.count()
    limit = bucket_rows or BUCKET_ROWS
    counted = values.groupBy("x").agg(F.count(F.lit(1)).alias("w"))
    if n > limit:  # ranking then reads the counts several times
        counted = cut_lineage(counted)
    ranked = add_rank(counted, "x", weight="w", bucket_rows=limit, largest=n)
    below, upto = F.col("x_before") / n, (F.col("x_before") + F.col("x_ties")) / n
    aggs = []
    for i, cdf in enumerate(cdfs.values()):
        f = cdf(F.col("x"))
        aggs.append(F.max(F.greatest(F.abs(f - below), F.abs(upto - f))).alias(f"{i}_ks"))
    return one_row_per_feature(ranked.agg(*aggs), list(cdfs), {"ks": "double"}).withColumnRenamed(
        "feature", "distribution"
    )


def distribution_fit(df: DataFrame, target: str, bucket_rows: int | None = None) -> DataFrame:
    """Normal, log-normal and Johnson SU fitted to a positive target, with the KS distance of each."""
    from tabfeat.operators.transforms import fit_johnson

    y = numeric(df, target)
    m = df.agg(F.avg(y).alias("m"), F.stddev_pop(y).alias("s"), F.avg(F.log(y)).alias("lm"),
               F.stddev_pop(F.log(y)).alias("ls")).first()
    john = fit_johnson(df, [target])[target]
    cdfs = {
        "normal": lambda x: normal_cdf((x - m["m"]) / m["s"]),
        "lognormal": lambda x: F.when(x > 0, normal_cdf((F.log(x) - m["lm"]) / m["ls"])).otherwise(F.lit(0.0)),
        "johnson_su": lambda x: normal_cdf(
            F.lit(john.gamma) + F.lit(john.eta) * F.asinh((x - john.epsilon) / john.lam)),
    }
    return ks_distances(df, target, cdfs, bucket_rows)
