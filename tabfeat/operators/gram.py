"""Second-moment matrices in one pass, and what follows from them without another scan.

A ``Moments`` is p x p and lives on the driver; the rows never do. Sums are taken
about a rough centre to keep precision.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabfeat.functions.columns import numeric, q

# Up to this many columns the sums are plain aggregates that stay in generated code.
NARROW = 12
FAN_IN = 256


@dataclass
class Moments:
    """Weight, sums and products of ``cols`` about ``centre``."""

    cols: list[str]
    centre: np.ndarray
    n: float
    s1: np.ndarray
    s2: np.ndarray

    def __add__(self, other: "Moments") -> "Moments":
        return Moments(self.cols, self.centre, self.n + other.n, self.s1 + other.s1, self.s2 + other.s2)

    def __sub__(self, other: "Moments") -> "Moments":
        return Moments(self.cols, self.centre, self.n - other.n, self.s1 - other.s1, self.s2 - other.s2)

    @property
    def mean(self) -> np.ndarray:
        return self.centre + self.s1 / self.n

    @property
    def scatter(self) -> np.ndarray:
        """Sum of products of deviations from the mean."""
        return self.s2 - np.outer(self.s1, self.s1) / self.n

    @property
    def raw(self) -> np.ndarray:
        """Uncentred sums of products."""
        c = self.centre
        return self.s2 + np.outer(c, self.s1) + np.outer(self.s1, c) + self.n * np.outer(c, c)

    def of(self, cols: Sequence[str]) -> "Moments":
        at = [self.cols.index(c) for c in cols]
        return Moments(list(cols), self.centre[at], self.n, self.s1[at], self.s2[np.ix_(at, at)])


def total(groups: Mapping) -> Moments:
    parts = list(groups.values())
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def moments(
    df: DataFrame,
    cols: Sequence[str],
    by: str | None = None,
    weight: Column | None = None,
    narrow: int = NARROW,
    centre: np.ndarray | None = None,
) -> dict:
    """Moments per value of ``by`` (key None without it). Rows with a missing value are left out.

    ``centre`` may be any value near the middle of the columns; without it a
    first scan takes their means.
    """
    cols = list(cols)
    p = len(cols)
    x = [numeric(df, c) for c in cols]
    if centre is None:
        row = df.select(*[F.avg(v).alias(f"x{i}") for i, v in enumerate(x)]).first()
        centre = np.array([0.0 if v is None else v for v in row])
    work = df.select(
        (q(by) if by else F.lit(None).cast("string")).alias("g"),
        (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"),
        *[(v - F.lit(float(c))).alias(f"x{i}") for i, (v, c) in enumerate(zip(x, centre))],
    ).where(" and ".join(f"x{i} is not null" for i in range(p)))
    sums = _narrow_sums(work, p) if p <= narrow else _wide_sums(work, p)
    upper = np.triu_indices(p)
    out = {}
    for key, values in sums:
        values = np.asarray(values)
        s2 = np.zeros((p, p))
        s2[upper] = values[1 + p:]
        out[key] = Moments(cols, centre, values[0], values[1:1 + p], s2 + np.triu(s2, 1).T)
    if not out:
        raise ValueError("no complete rows")
    return out


def _narrow_sums(work: DataFrame, p: int):
    w = F.col("w")
    exprs = [w] + [w * F.col(f"x{i}") for i in range(p)]
    exprs += [w * F.col(f"x{i}") * F.col(f"x{j}") for i in range(p) for j in range(i, p)]
    rows = work.groupBy("g").agg(*[F.sum(e).alias(f"s{k}") for k, e in enumerate(exprs)]).collect()
    return [(r[0], r[1:]) for r in rows]


def _wide_sums(work: DataFrame, p: int):
    """X'X per Arrow batch, added up per task, then by a bounded number of tasks, then by position."""
    upper = np.triu_indices(p)
    schema = f"g {work.schema['g'].dataType.simpleString()}, s array<double>"
    vector = pa.list_(pa.float64())

    def emit(sums, kind):
        if sums:
            columns = [pa.array(list(sums), type=kind), pa.array([s.tolist() for s in sums.values()], type=vector)]
            yield pa.RecordBatch.from_arrays(columns, names=["g", "s"])

    def multiply(batches):
        sums, kind = {}, None
        for b in batches:
            kind = b.schema.field("g").type
            groups = pc.dictionary_encode(b.column("g"), null_encoding="encode")
            codes = groups.indices.to_numpy(zero_copy_only=False)
            block = np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(1, p + 2)])
            for code, g in enumerate(groups.dictionary.to_pylist()):
                part = block if len(groups.dictionary) == 1 else block[codes == code]
                w, x = part[:, 0], part[:, 1:]
                wx = x * w[:, None]
                s = np.concatenate([[w.sum()], wx.sum(0), (wx.T @ x)[upper]])
                sums[g] = sums[g] + s if g in sums else s
        yield from emit(sums, kind)

    def add(batches):
        sums, kind = {}, None
        for b in batches:
            kind = b.schema.field("g").type
            for g, s in zip(b.column("g").to_pylist(), b.column("s")):
                s = s.values.to_numpy()
                sums[g] = sums[g] + s if g in sums else s
        yield from emit(sums, kind)

    partial = work.mapInArrow(multiply, schema)
    fewer = (
        partial.withColumn("slot", F.spark_partition_id() % FAN_IN)
        .repartition("slot").select("g", "s").mapInArrow(add, schema)
    )
    rows = fewer.select("g", F.posexplode("s").alias("at", "v")).groupBy("g", "at").agg(F.sum("v").alias("v")).collect()
    out: dict = {}
    for r in rows:
        out.setdefault(r["g"], np.zeros(1 + p + len(upper[0])))[r["at"]] = r["v"]
    return list(out.items())


# ---- principal components --------------------------------------------------------------------


@dataclass
class Components:
    cols: list[str]
    mean: np.ndarray
    scale: np.ndarray
    loadings: np.ndarray  # k x p
    variance: np.ndarray
    ratio: np.ndarray

    def score(self, df: DataFrame, k: int) -> Column:
        out = F.lit(0.0)
        for c, m, s, w in zip(self.cols, self.mean, self.scale, self.loadings[k]):
            out = out + (F.coalesce(numeric(df, c), F.lit(0.0)) - F.lit(float(m))) * F.lit(float(w / s))
        return out

    def transform(self, df: DataFrame, keep: Sequence[str] = (), prefix: str = "pc") -> DataFrame:
        """Kept columns and the scores; a matrix product per Arrow batch once there are many terms."""
        k = len(self.loadings)
        if k * len(self.cols) <= NARROW * NARROW:
            return df.select(*[q(c) for c in keep], *[self.score(df, i).alias(f"{prefix}{i + 1}") for i in range(k)])
        mean, turn = self.mean, (self.loadings / self.scale).T

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            return pd.Series(list((np.stack(x.to_numpy()) - mean) @ turn))

        whole = F.array(*[F.coalesce(numeric(df, c), F.lit(0.0)) for c in self.cols])
        rows = df.select(*[q(c) for c in keep], project(whole).alias("_scores"))
        return rows.select(*[q(c) for c in keep], *[F.get("_scores", i).alias(f"{prefix}{i + 1}") for i in range(k)])


def pca_of(m: Moments, cols: Sequence[str], k: int, standardize: bool = True) -> Components:
    """The k leading components; the largest loading of each is positive."""
    m = m.of(cols)
    scale = np.ones(len(cols))
    if standardize:
        scale = np.sqrt(np.diag(m.scatter) / m.n)
        scale[scale == 0] = 1.0
    values, vectors = np.linalg.eigh(m.scatter / np.outer(scale, scale) / max(m.n - 1, 1))
    order = np.argsort(values)[::-1]
    values, loadings = np.maximum(values[order], 0), vectors[:, order].T
    signs = np.sign(loadings[np.arange(len(loadings)), np.abs(loadings).argmax(1)])
    loadings = loadings * signs[:, None]
    whole = values.sum() or 1.0
    return Components(list(cols), m.mean, scale, loadings[:k], values[:k], values[:k] / whole)


def fit_pca(df: DataFrame, cols: Sequence[str], k: int, standardize: bool = True) -> Components:
    """Missing values count as 0."""
    whole = df.select(*[F.coalesce(numeric(df, c), F.lit(0.0)).alias(c) for c in cols])
    return pca_of(moments(whole, cols)[None], cols, k, standardize)


def masked_correlations(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Pearson coefficients of all pairs of columns, each over the rows that have both; nan where either is constant there.

    With missing values as 0 and a mask of those present, four matrix products of a batch hold the sums of every pair, so
    there is one scan after that for the means, whatever is missing where.
    """
    cols, p = list(cols), len(cols)
    x = [numeric(df, c).cast("double") for c in cols]
    row = df.select(*[F.avg(v).alias(f"x{i}") for i, v in enumerate(x)]).first()
    centre = [0.0 if v is None else v for v in row]
    work = df.select(*[(v - F.lit(float(c))).alias(f"x{i}") for i, (v, c) in enumerate(zip(x, centre))])

    def multiply(batches):
        total = np.zeros((4, p, p))
        for batch in batches:
            if batch.num_rows:
                block = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(p)]).astype(float)
                mask = ~np.isnan(block)
                block, mask = np.where(mask, block, 0.0), mask.astype(float)
                total += mask.T @ mask, block.T @ mask, (block * block).T @ mask, block.T @ block
        for i in range(p):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([total[:, i].ravel().tolist()], pa.list_(pa.float64()))], ["i", "s"])

    rows = work.mapInArrow(multiply, "i long, s array<double>").groupBy("i").agg(
        *[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(4 * p)]) if p <= NARROW else _added(work.mapInArrow(multiply, "i long, s array<double>"))
    n, s1, s2, s11 = np.zeros((4, p, p))
    for r in rows.collect():  # columns x columns sums
        n[r[0]], s1[r[0]], s2[r[0]], s11[r[0]] = np.asarray(r[1] if p > NARROW else r[1:], float).reshape(4, p)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = s1 / n  # of the row's column over the rows that have the other one too
        var = s2 / n - mean * mean
        var = np.where(var <= 1e-13 * s2 / n, np.nan, var)
        return np.clip((s11 / n - mean * mean.T) / np.sqrt(var * var.T), -1, 1)


def _added(partial: DataFrame) -> DataFrame:
    """Sums of arrays by ``i``, position by position."""
    summed = partial.select("i", F.posexplode("s")).groupBy("i", "pos").agg(F.sum("col").alias("v"))
    return summed.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda e: e["v"]).alias("s"))
