"""Exact order statistics and ranks without sorting the table in one task.

``exact_quantiles`` narrows a bracket around every wanted rank with bounded
sketches and conditional counts: a few scans, no shuffle of the rows.
``add_rank`` cuts the value range into buckets of bounded size, so that the
windows that count inside a bucket run in parallel; a value frequent enough to
fill a bucket on its own gets one whose ranks need no window.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabfeat.functions.columns import count_below, numeric, q
from tabfeat.operators.lookup import lookup_join

# Values one exact percentile() buffer may hold, and rows one window bucket may hold.
EXACT_VALUES = 1_000_000
BUCKET_ROWS = 1_000_000
SKETCH_ACCURACY = 10_000
# Narrowing costs four counters per wanted rank; beyond this many ranks one sort is cheaper.
MANY_PROBS = 16
MAX_BUCKETS = 100_000
PURE_SALTS = 64


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], limit: int = EXACT_VALUES
) -> dict[str, list[float]]:
    """Linear-interpolation quantiles of each column, ``None`` for an empty column."""
    named = {f"c{i}": numeric(df, c) for i, c in enumerate(cols)}
    work = df.select(*[v.alias(k) for k, v in named.items()])
    counts = work.agg(*[F.count(k).alias(k) for k in named]).first().asDict()
    found: dict[str, list[float]] = {}
    small = [k for k in named if counts[k] <= limit]
    if small:
        row = work.agg(*[F.percentile(k, F.array(*map(F.lit, map(float, probs)))).alias(k) for k in small]).first()
        found.update({k: row[k] if row[k] is not None else [None] * len(probs) for k in small})
    large = [k for k in named if counts[k] > limit]
    if large and len(probs) > MANY_PROBS:
        found.update(_many_quantiles(work, large, probs, counts, limit))
    elif large:
        wanted = {
            (k, r)
            for k in large
            for p in probs
            for r in (math.floor(p * (counts[k] - 1)), math.ceil(p * (counts[k] - 1)))
        }
        values = _select_ranks(work, sorted(wanted), counts, limit)
        for k in large:
            found[k] = _between(probs, counts[k], lambda rank: values[k, rank])
    return {c: found[k] for k, c in zip(named, cols)}


def _between(probs: Sequence[float], n: int, value) -> list[float]:
    """Quantiles interpolated between ``value(rank)`` of the 0-based ranks around them."""
    out = []
    for p in probs:
        at = p * (n - 1)
        low, high = value(math.floor(at)), value(math.ceil(at))
        out.append(low if low == high else low + (high - low) * (at - math.floor(at)))
    return out


def _many_quantiles(work: DataFrame, cols: Sequence[str], probs: Sequence[float], counts: dict[str, int], limit: int) -> dict[str, list[float]]:
    """Quantiles of large columns from the ranks of their distinct values.

    The wanted ranks are one literal of the plan, whatever their number; at most two values for each come to the driver.
    """
    long = work.unpivot([], [F.col(k) for k in cols], "k", "x").where(F.col("x").isNotNull())
    counted = long.groupBy("k", "x").agg(F.count(F.lit(1)).alias("_w"))
    ranked = add_rank(counted, "x", ["k"], weight="_w", bucket_rows=limit, largest=max(counts[k] for k in cols))
    wanted = {k: sorted({side(p * (counts[k] - 1)) for p in probs for side in (math.floor, math.ceil)}) for k in cols}
    marks = reduce(lambda other, k: F.when(F.col("k") == k, F.split(F.lit(" ".join(map(str, wanted[k]))), " ").cast("array<long>")).otherwise(other), cols, F.lit(None))
    most = max(map(len, wanted.values()))
    first, upto = F.col("x_before"), F.col("x_before") + F.col("x_ties")
    covers = count_below(upto, marks, most, True) > count_below(first, marks, most, True)
    hits: dict[str, list[tuple]] = {k: [] for k in cols}
    for r in ranked.where(covers).select("k", "x", first.alias("first")).collect():
        hits[r["k"]].append((r["first"], r["x"]))
    out = {}
    for k in cols:
        starts, values = zip(*sorted(hits[k]))
        out[k] = _between(probs, counts[k], lambda rank: values[bisect_right(starts, rank) - 1])
    return out


def _inside(k: str, lo: float, hi: float) -> Column:
    return (F.col(k) > F.lit(lo)) & (F.col(k) < F.lit(hi))


def _select_ranks(df, wanted, counts, limit):
    """Value at each 0-based rank. Every round shrinks the open bracket (lo, hi) that holds it."""
    open_ = {t: (-math.inf, math.inf, 0, counts[t[0]]) for t in wanted}
    # infinite values sit outside every open bracket; count them once
    ends = df.agg(
        *[F.count_if(F.col(k) == F.lit(-math.inf)).alias(f"l{k}") for k in {k for k, _ in wanted}],
        *[F.count_if(F.col(k) == F.lit(math.inf)).alias(f"h{k}") for k in {k for k, _ in wanted}],
    ).first()
    done: dict[tuple[str, int], float] = {}
    for (k, r), (lo, hi, _, n) in list(open_.items()):
        below, above = ends[f"l{k}"], ends[f"h{k}"]
        if r < below or r >= n - above:
            done[k, r] = lo if r < below else hi
            del open_[k, r]
        else:
            open_[k, r] = (lo, hi, below, n - below - above)
    while open_:
        tight = {t: b for t, b in open_.items() if b[3] <= limit}
        wide = {t: b for t, b in open_.items() if b[3] > limit}
        exprs = []
        for i, ((k, r), (lo, hi, below, n)) in enumerate(tight.items()):
            at = (r - below) / (n - 1) if n > 1 else 0.0
            exprs.append(F.percentile(F.when(_inside(k, lo, hi), F.col(k)), F.lit(at)).alias(f"t{i}"))
        # ranks looked for in the same bracket share one sketch
        shared: dict[tuple, list] = {}
        for (k, r), (lo, hi, below, n) in wide.items():
            at, slack = (r - below) / n, 2 / SKETCH_ACCURACY
            shared.setdefault((k, lo, hi), []).append(((k, r), max(0.0, at - slack), min(1.0, at + slack)))
        for i, ((k, lo, hi), asked) in enumerate(shared.items()):
            probes = F.array(*[F.lit(x) for _, a, b in asked for x in (a, b)])
            inside = F.when(_inside(k, lo, hi), F.col(k))
            exprs.append(F.percentile_approx(inside, probes, F.lit(SKETCH_ACCURACY)).alias(f"w{i}"))
        row = df.agg(*exprs).first()
        for i, t in enumerate(tight):
            done[t] = row[f"t{i}"]
            del open_[t]
        if not wide:
            continue
        cuts = {
            t: (row[f"w{i}"][2 * j], row[f"w{i}"][2 * j + 1])
            for i, asked in enumerate(shared.values()) for j, (t, _, _) in enumerate(asked)
        }
        exprs = []
        for i, (t, (lo, hi, _, _)) in enumerate(wide.items()):
            k, inside = t[0], _inside(t[0], lo, hi)
            for name, cond in (
                ("la", F.col(k) < cuts[t][0]), ("ea", F.col(k) <= cuts[t][0]),
                ("lb", F.col(k) < cuts[t][1]), ("eb", F.col(k) <= cuts[t][1]),
            ):
                exprs.append(F.count_if(inside & cond).alias(f"{name}{i}"))
        row = df.agg(*exprs).first()
        for i, (t, (lo, hi, below, n)) in enumerate(wide.items()):
            a, b = cuts[t]
            la, ea, lb, eb = (row[f"{x}{i}"] for x in ("la", "ea", "lb", "eb"))
            at = t[1] - below
            if la <= at < ea or lb <= at < eb:
                done[t] = a if la <= at < ea else b
                del open_[t]
            elif at < la:
                open_[t] = (lo, a, below, la)
            elif at < lb:
                open_[t] = (a, b, below + ea, lb - ea)
            else:
                open_[t] = (b, hi, below + eb, n - eb)
    return done


def _splits(
    df: DataFrame, keys: Sequence[str], value: str, bucket_rows: int, largest: int | None = None
) -> DataFrame | None:
    """Bucket borders of every key group too large for one window, or None when there is none.

    The number of borders over all groups is at most rows / bucket_rows, so the
    table may be collected. Collecting also fixes them: a sketch evaluated twice
    could differ. Adaptive execution decides how borders and totals are joined.
    """
    if largest is None:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        largest = sizes.agg(F.max("_n")).first()[0] or 0
    buckets = min(MAX_BUCKETS, math.ceil(largest / bucket_rows))
    if buckets <= 1:
        return None
    grid = [i / buckets for i in range(1, buckets)]
    sketch = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx(
            value, F.array(*map(F.lit, grid)), F.lit(max(SKETCH_ACCURACY, 10 * buckets))
        ).alias("_s"),
    )
    every = f"greatest(1, cast(floor({buckets * bucket_rows}D / _n) as int))"
    table = sketch.where(F.col("_n") > bucket_rows).select(
        *keys, F.expr(f"array_distinct(filter(_s, (x, i) -> i % {every} = 0))").alias("_splits")
    )
    rows = table.collect()
    return df.sparkSession.createDataFrame(rows, table.schema)


def _bucket_of(value: Column, splits: Column) -> Column:
    """Twice the number of borders <= value, minus one when the value is a border itself.

    Odd buckets therefore hold a single value.
    """
    count = count_below(value, splits, MAX_BUCKETS, strict=False)
    on_border = F.coalesce(F.get(splits, count - 1) == value, F.lit(False))
    return F.coalesce(count * 2 - on_border.cast("int"), F.lit(0))


def add_rank(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    weight: str | None = None,
    salt: Sequence[str] = (),
    bucket_rows: int = BUCKET_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Add ``<value>_before`` and ``<value>_ties``: rows (or weight) of the key group below and equal.

    ``value`` must be numeric and not null. ``salt`` names columns that tell rows
    of equal value apart; they spread a value that holds much of the table.
    """
    w = q(weight) if weight else F.lit(1).cast("long")
    before, ties = f"{value}_before", f"{value}_ties"
    keys = list(keys)
    work = df
    if not keys:
        work, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    splits = _splits(work, keys, value, bucket_rows, largest)
    if splits is None:
        upto = F.sum(w).over(Window.partitionBy(*keys).orderBy(value))
        same = F.sum(w).over(Window.partitionBy(*keys, value))
        out = work.withColumn(ties, same).withColumn(before, upto - q(ties))
        return out.drop("_all")
    placed = lookup_join(work, splits, keys).withColumn(
        "_bucket", _bucket_of(q(value), F.col("_splits"))
    )
    in_order = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        placed.where(F.col("_splits").isNotNull())
        .groupBy(*keys, "_bucket")
        .agg(F.sum(w).alias("_total"))
        .withColumn("_offset", F.coalesce(F.sum("_total").over(in_order), F.lit(0)))
    )
    pure = F.col("_bucket") % 2 == 1
    spread = F.pmod(F.xxhash64(*[q(c) for c in salt]), F.lit(PURE_SALTS)) if salt else F.lit(0)
    placed = (
        placed.drop("_splits")
        .join(totals, [*keys, "_bucket"], "left")
        .withColumn("_salt", F.when(pure, spread).otherwise(F.lit(0)))
    )
    upto = F.sum(w).over(Window.partitionBy(*keys, "_bucket", "_salt").orderBy(value))
    same = F.sum(w).over(Window.partitionBy(*keys, "_bucket", "_salt", value))
    ranked = placed.withColumn("_same", same).withColumn("_upto", upto)
    return (
        ranked.withColumn(ties, F.when(pure, F.col("_total")).otherwise(F.col("_same")))
        .withColumn(
            before,
            F.coalesce(F.col("_offset"), F.lit(0))
            + F.when(pure, F.lit(0)).otherwise(F.col("_upto") - F.col("_same")),
        )
        .drop("_bucket", "_salt", "_total", "_offset", "_same", "_upto", "_all")
    )


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], limit: int = EXACT_VALUES
) -> DataFrame:
    """Key columns plus ``quantiles`` (array) of the non-null double ``value`` per key group."""
    rows = df.where(q(value).isNotNull())
    largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= limit:
        asked = F.array(*map(F.lit, map(float, probs)))
        return rows.groupBy(*keys).agg(F.percentile(value, asked).alias("quantiles"))
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w"))
    ranked = add_rank(counted, value, keys, weight="_w", bucket_rows=limit)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    at = [(i, F.lit(float(p)) * (F.col("_n") - 1)) for i, p in enumerate(probs)]
    targets = sizes.select(
        *keys,
        F.explode(
            F.array(*[
                F.struct(F.lit(i).alias("i"), (a - F.floor(a)).alias("part"), side(a).cast("long").alias("rank"),
                         F.lit(name).alias("side"))
                for i, a in at for side, name in ((F.floor, "lo"), (F.ceil, "hi"))
            ])
        ).alias("t"),
    ).select(*keys, "t.*")
    # few rows hold a wanted rank: a search in the sorted ranks leaves those whose interval covers one
    per_key = targets.groupBy(*keys).agg(
        F.collect_list(F.struct("i", "part", "rank", "side")).alias("_t"),
        F.array_sort(F.collect_set("rank")).alias("_ranks"))
    first, upto = F.col(f"{value}_before"), F.col(f"{value}_before") + F.col(f"{value}_ties")
    most = 2 * len(probs)
    covers = count_below(upto, F.col("_ranks"), most, True) > count_below(first, F.col("_ranks"), most, True)
    hits = (
        lookup_join(ranked, per_key, keys)
        .where(covers)
        .select(*keys, value, F.explode(
            F.filter("_t", lambda t: (t["rank"] >= first) & (t["rank"] < upto))).alias("t"))
        .select(*keys, value, "t.*")
    )
    per_prob = hits.groupBy(*keys, "i").agg(
        F.max(F.when(F.col("side") == "lo", q(value))).alias("lo"),
        F.max(F.when(F.col("side") == "hi", q(value))).alias("hi"),
        F.max("part").alias("part"),
    )
    point = F.struct("i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("v"))
    return per_prob.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(point)), lambda s: s["v"]).alias("quantiles")
    )


def row_number(
    df: DataFrame, key: str, bucket_rows: int = BUCKET_ROWS, largest: int | None = None
) -> DataFrame:
    """Add ``rn``, the 0-based position by the unique numeric ``key``."""
    ranked = add_rank(df, key, bucket_rows=bucket_rows, largest=largest)
    return ranked.withColumn("rn", q(f"{key}_before").cast("long")).drop(f"{key}_before", f"{key}_ties")
