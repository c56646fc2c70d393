"""Affine scalers. Every one is ``(x - centre) / scale`` with statistics from one aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabfeat.functions.columns import numeric, q
from tabfeat.operators.ranks import exact_quantiles


@dataclass(frozen=True)
class Affine:
    centre: float
    scale: float

    def apply(self, value: Column) -> Column:
        return (value - F.lit(self.centre)) / F.lit(self.scale)

    def invert(self, value: Column) -> Column:
        return value * F.lit(self.scale) + F.lit(self.centre)


@dataclass
class Scaler:
    """``plan`` maps 'standard', 'minmax', 'maxabs', 'robust' or 'power' to column names.

    Constant columns are only shifted. 'power' standardises after a Yeo-Johnson transform.
    """

    plan: Mapping[str, Sequence[str]]
    state: dict[tuple[str, str], Affine] = field(default_factory=dict)
    power: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "Scaler":
        from tabfeat.operators.transforms import fit_power

        aggs = []
        for how, cols in self.plan.items():
            for i, c in enumerate(cols):
                v = numeric(df, c)
                pair = {
                    "standard": (F.avg(v), F.stddev_pop(v)),
                    "minmax": (F.min(v), F.max(v) - F.min(v)),
                    "maxabs": (F.lit(0.0), F.max(F.abs(v))),
                }.get(how)
                if pair:
                    aggs += [pair[0].alias(f"{how}{i}a"), pair[1].alias(f"{how}{i}b")]
        row = df.agg(*aggs).first() if aggs else None
        for how, cols in self.plan.items():
            if how in ("robust", "power"):
                continue
            for i, c in enumerate(cols):
                a, b = row[f"{how}{i}a"], row[f"{how}{i}b"]
                self.state[how, c] = Affine(a if a is not None else 0.0, b or 1.0)
        robust = list(self.plan.get("robust", ()))
        if robust:
            for c, (lo, mid, hi) in exact_quantiles(df, robust, [0.25, 0.5, 0.75]).items():
                self.state["robust", c] = Affine(mid or 0.0, ((hi or 0.0) - (lo or 0.0)) or 1.0)
        if self.plan.get("power"):
            self.power = fit_power(df, self.plan["power"], "yeo-johnson")
        return self

    def expr(self, df: DataFrame, how: str, column: str) -> Column:
        if how == "power":
            return self.power[column].apply(numeric(df, column))
        return self.state[how, column].apply(numeric(df, column))

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Only ``keep`` and the scaled columns survive, in plan order."""
        out = [self.expr(df, how, c).alias(c) for how, cols in self.plan.items() for c in cols]
        return df.select(*[q(c) for c in keep], *out)


def scale_column(df: DataFrame, how: str, columns: Sequence[str], suffix: str) -> tuple[DataFrame, Scaler]:
    """Add ``<col><suffix>`` scaled one way; the fitted scaler comes along for the inverse."""
    fitted = Scaler({how: list(columns)}).fit(df)
    return df.withColumns({f"{c}{suffix}": fitted.expr(df, how, c) for c in columns}), fitted


def row_normalize(df: DataFrame, columns: Sequence[str], suffix: str = "_unit") -> DataFrame:
    """Divide a row's columns by their Euclidean length; a zero row stays zero."""
    values = {c: numeric(df, c) for c in columns}
    length = F.sqrt(sum((v * v for v in values.values()), F.lit(0.0)))
    return df.withColumns({
        f"{c}{suffix}": F.when(length > 0, v / length).when(length == 0, F.lit(0.0)) for c, v in values.items()
    })
