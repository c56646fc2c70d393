"""Features computed from several columns of the same row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabfeat.functions.columns import any_of, hat_basis, numeric, q, weighted_sum
from tabfeat.operators.ranks import exact_quantiles


def season_flag(month: Column, months: Sequence[int] = (7,)) -> Column:
    """1 in the listed months, else 0."""
    return F.when(month.isin(list(months)), 1).otherwise(0)


def row_marker(df: DataFrame, key: str, value, out: str) -> DataFrame:
    """1 on the row with the given key, 0 elsewhere."""
    return df.withColumn(out, F.when(q(key) == value, 1).otherwise(0))


def sums(df: DataFrame, weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """One weighted sum per output column, all in a single projection."""
    return df.withColumns({out: weighted_sum(w) for out, w in weights.items()})


def district_tag(name: Column, low: Column) -> Column:
    return F.concat(name, F.when(any_of(low), "_Lower").otherwise("_Upper"))


def district_tag_two_columns(df: DataFrame, name: str, low: Column) -> DataFrame:
    low = any_of(low)
    return df.withColumns({
        "LowerDistrict": F.when(low, F.concat(F.lit("Lower_"), q(name))).otherwise(F.lit("Upper")),
        "UpperDistrict": F.when(~low, F.concat(F.lit("Upper_"), q(name))).otherwise(F.lit("Lower")),
    })


@dataclass
class ModelMatrix:
    """Terms of a design matrix; ``splines`` maps a column to its number of basis functions.

    Spline knots are learned by ``fit`` and kept, so that new rows get the same basis.
    """

    target: str
    main: Sequence[str] = ()
    log1p: Sequence[str] = ()
    squares: Sequence[str] = ()
    products: Sequence[tuple[str, str]] = ()
    splines: Mapping[str, int] = field(default_factory=dict)
    knots: dict[str, list[float]] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "ModelMatrix":
        self.knots = {}
        for k in sorted(set(self.splines.values())):
            cols = [c for c, d in self.splines.items() if d == k]
            found = exact_quantiles(df, cols, [i / k for i in range(k + 1)])
            # a discrete column can repeat a quantile; keep each knot once
            self.knots |= {c: sorted(set(v)) for c, v in found.items()}
        return self

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """The kept columns, intercept, every term as a double, and the target if present."""
        terms = {"intercept": F.lit(1.0)}
        terms |= {c: numeric(df, c) for c in self.main}
        terms |= {f"log1p_{c}": F.log1p(numeric(df, c)) for c in self.log1p}
        terms |= {f"{c}_sq": numeric(df, c) * numeric(df, c) for c in self.squares}
        terms |= {f"{a}:{b}": numeric(df, a) * numeric(df, b) for a, b in self.products}
        for c in self.splines:
            value = numeric(df, c)
            knots = self.knots[c]
            value = F.when(value.isNotNull(), F.greatest(F.lit(knots[0]), F.least(F.lit(knots[-1]), value)))
            terms |= {f"bs_{c}_{i + 1}": b for i, b in enumerate(hat_basis(value, knots))}
        if self.target in df.columns:
            terms[self.target] = numeric(df, self.target)
        return df.select(*[q(c) for c in keep], *[e.alias(n) for n, e in terms.items()])


def group_pc1(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """First principal component of each centred column group, as a new column.

    The largest loading of a component is positive. It is fitted on complete rows;
    a row with a missing value in a group has no score for it.
    """
    from tabfeat.operators.gram import moments, pca_of

    cols = sorted({c for group in groups.values() for c in group})
    m = moments(df, cols)[None]
    return df.withColumns({
        out: F.when(~any_of(*[numeric(df, c).isNull() for c in group]), pca_of(m, list(group), 1, standardize=False).score(df, 0))
        for out, group in groups.items()
    })
