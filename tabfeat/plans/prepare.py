"""The whole preparation of a table: clean, impute, derive, recode, encode, scale, expand, drop, split."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabfeat.functions.columns import q
from tabfeat.operators.encode import OneHot, ordinal_encode
from tabfeat.operators.impute import ImputeRule, Imputer, base_plan, tailored_plan
from tabfeat.operators.predicates import conditional_fix, drop_by_key, restore_dtypes
from tabfeat.operators.profile import classify_dtypes
from tabfeat.operators.recode import expand_keys, present_only, recode_levels
from tabfeat.operators.scale import Scaler
from tabfeat.plans import house
from tabfeat.sources.tables import load_inputs, training_rows


@dataclass
class PreparePlan:
    """What to do with which column. ``derive`` adds columns between imputing and recoding."""

    key: str
    target: str
    outlier_keys: Sequence = ()
    test_fix: tuple[str, float, float] | None = None
    rules: Callable[[Mapping], list[ImputeRule]] = base_plan
    derive: Callable[[DataFrame], DataFrame] = lambda df: df
    recode: Mapping = field(default_factory=dict)
    ordinal: Mapping = field(default_factory=dict)
    unknown: str = "error"
    quantitative: Sequence[str] = ()
    onehot_first: Sequence[str] = ()
    onehot_codes: Sequence[str] = ()
    onehot_excluded: Sequence[str] = ()
    dropped: Sequence[str] = ()


def house_plan(marked_key=None) -> PreparePlan:
    return PreparePlan(
        key=house.KEY, target=house.TARGET, outlier_keys=house.OUTLIER_KEYS, test_fix=house.YEAR_FIX,
        rules=lambda groups: tailored_plan(groups, house.NONE_COLUMNS, house.MODE_COLUMNS),
        derive=lambda df: house.additional_features(df, marked_key), recode=house.RECODE, ordinal=house.ORDINAL,
        quantitative=house.QUANTITATIVE, onehot_first=["District"], onehot_codes=house.ONEHOT_CODES,
        onehot_excluded=house.ONEHOT_EXCLUDED, dropped=house.DROPPED,
    )


class Preparation:
    """``fit`` learns modes, scales and levels (one job each); ``transform`` is a projection.

    ``fit_on='all'`` learns from training and test rows together, as the workflow
    does; ``'train'`` keeps the test rows out of it.
    """

    def __init__(self, plan: PreparePlan, fit_on: str = "all"):
        self.plan = plan
        self.fit_on = fit_on

    def gather(self, train, test, extension=None, pseudo=None) -> DataFrame:
        """All rows in one table, without the outliers."""
        p = self.plan
        rows = load_inputs(drop_by_key(train, p.key, p.outlier_keys), test, extension, pseudo)
        if p.test_fix:
            rows = conditional_fix(rows, *p.test_fix, where=F.col("_split") == "test")
        return rows

    def fit(self, rows: DataFrame) -> "Preparation":
        p = self.plan
        learn = rows if self.fit_on == "all" else rows.where(training_rows())
        self.groups = classify_dtypes(rows, exclude=[p.key, p.target, "_split"])
        keep = [c for c in (p.key, "_split", p.target) if c in rows.columns]
        self.imputer = Imputer(p.rules(self.groups), keep).fit(learn)
        coded = self._coded(learn)
        text = [f.name for f in coded.schema.fields if isinstance(f.dataType, T.StringType)]
        aside = {p.key, p.target, "_split"}
        codes = [c for c in [*p.onehot_codes, *text] if c in coded.columns and c not in aside]
        self.onehot = OneHot([*p.onehot_first, *[c for c in codes if c not in p.onehot_excluded]])
        gone = aside | set(self.onehot.columns) | set(p.dropped)
        standard = [c for c in p.quantitative if c in coded.columns]
        minmax = [c for c in coded.columns if c not in gone and c not in set(standard) and c not in text]
        self.scaler = Scaler({"minmax": minmax, "standard": standard}).fit(coded)
        self.onehot.fit(coded)
        self.features = [c for c in [*minmax, *standard] if c not in set(p.dropped)] + self.onehot.names
        return self

    def _coded(self, rows: DataFrame) -> DataFrame:
        p = self.plan
        whole = p.derive(restore_dtypes(self.imputer.transform(rows), self.groups))
        merged = recode_levels(whole, p.recode)
        return ordinal_encode(merged, present_only(merged, expand_keys(p.ordinal)), p.unknown)

    def transform(self, rows: DataFrame) -> DataFrame:
        """Key, ``_split``, ``label`` = log1p(target) and the features."""
        p = self.plan
        coded = self._coded(rows)
        scaled = [self.scaler.expr(coded, how, c).alias(c) for how, cols in self.scaler.plan.items() for c in cols
                  if c not in set(p.dropped)]
        label = F.log1p(q(p.target)) if p.target in coded.columns else F.lit(None)
        return coded.select(q(p.key), "_split", label.cast("double").alias("label"), *scaled, *self.onehot.columns_of(coded))


def train_part(prepared: DataFrame) -> DataFrame:
    return prepared.where(training_rows()).drop("_split")


def held_part(prepared: DataFrame) -> DataFrame:
    return prepared.where(~training_rows()).drop("_split", "label")
