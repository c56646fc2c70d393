"""Trees with a bound on their leaves and boosting (M-1, R-7, R-9), next to SQL that finds the same splits by trying all."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabfeat.bindings.registry import NET_LINEITEM, net_lineitem, query, r, rounded
from tabfeat.functions.columns import q
from tabfeat.operators import boosting, growth, trees
from tabfeat.operators.folds import holdout_split_arithmetic

# Features of few values, the first with signal, so that every split is on a value and none is a tie.
FEATURES = ["band", "l_discount", "l_quantity"]
BANDED = f"(SELECT *, floor(log_price * 4) AS band FROM {NET_LINEITEM})"


def _banded(load):
    return net_lineitem(load).withColumn("band", F.floor(q("log_price") * 4).cast("double"))


def _by_prediction(model, df):
    """One row for each leaf: rows, and the range of each feature."""
    ranges = [f(c).alias(f"{n}_{c}") for c in FEATURES for n, f in (("least", F.min), ("most", F.max))]
    return rounded(trees.predict(model, df, FEATURES, FEATURES).withColumn("prediction", F.round("prediction", 9)).groupBy("prediction").agg(
        F.count(F.lit(1)).alias("n"), *ranges), 6)


RANGES = ", ".join(f"min({c}) AS least_{c}, max({c}) AS most_{c}" for c in FEATURES)


# ---- leaf by leaf ----------------------------------------------------------------------------

TREE_FEATURES = ["band", "l_discount"]


def _growth_sql(source: str, leaves: int) -> tuple[str, str]:
    """CTEs leaf1, leaf2, ...: the boxes (exclusive low, inclusive high) of the best-first trees of so many leaves, and the test for a box."""
    box = "c.band > l.band_lo AND c.band <= l.band_hi AND c.l_discount > l.l_discount_lo AND c.l_discount <= l.l_discount_hi"
    parts = [f"cells AS (SELECT band, l_discount, count(*) AS n, sum(label) AS s FROM {source} GROUP BY band, l_discount)",
             "leaf1 AS (SELECT 0 AS id, -1e9 AS band_lo, 1e9 AS band_hi, -1e9 AS l_discount_lo, 1e9 AS l_discount_hi)"]
    for k in range(1, leaves):
        tried = "\n    UNION ALL ".join(f"""SELECT id, {i} AS f, cut, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n AS gain FROM (
      SELECT id, c.{f} AS cut, sum(sum(n)) OVER w AS nl, sum(sum(s)) OVER w AS sl, sum(sum(n)) OVER (PARTITION BY id) AS n,
        sum(sum(s)) OVER (PARTITION BY id) AS s FROM leaf{k} l JOIN cells c ON {box} GROUP BY id, c.{f} WINDOW w AS (PARTITION BY id ORDER BY c.{f}))
      WHERE nl < n""" for i, f in enumerate(TREE_FEATURES))
        parts.append(f"best{k} AS (SELECT * FROM ({tried}) ORDER BY gain DESC, id, f, cut LIMIT 1)")

        def side(end):
            return ", ".join(f"CASE WHEN f = {i} THEN cut ELSE l.{c}_{end} END AS {c}_{end}" for i, c in enumerate(TREE_FEATURES))

        def plain(end):
            return ", ".join(f"l.{c}_{end}" for c in TREE_FEATURES)

        columns = "id, band_lo, band_hi, l_discount_lo, l_discount_hi"
        parts.append(f"""leaf{k + 1} AS (SELECT {columns} FROM leaf{k} WHERE id NOT IN (SELECT id FROM best{k})
    UNION ALL SELECT {columns} FROM (SELECT {2 * k - 1} AS id, {plain('lo')}, {side('hi')} FROM leaf{k} l JOIN best{k} b ON l.id = b.id)
    UNION ALL SELECT {columns} FROM (SELECT {2 * k} AS id, {side('lo')}, {plain('hi')} FROM leaf{k} l JOIN best{k} b ON l.id = b.id))""")
    return ",\n  ".join(parts), box


_FOUR, _BOX = _growth_sql(BANDED, 4)


@query("r7_best_first_tree", f"""WITH {_FOUR}
SELECT {r('avg(label)', 6)} AS prediction, count(*) AS n, min(band) AS least_band, max(band) AS most_band, min(l_discount) AS least_l_discount,
  max(l_discount) AS most_l_discount FROM leaf4 l JOIN {BANDED} c ON {_BOX} GROUP BY id""")
def best_first_tree(load):
    """Four leaves, opened by gain."""
    df = _banded(load)
    model = trees.fit_tree(df, TREE_FEATURES, "label", "decision_tree", {"max_leaf_nodes": 4})
    scored = trees.predict(model, df, TREE_FEATURES, TREE_FEATURES)
    ranges = [f(c).alias(f"{n}_{c}") for c in TREE_FEATURES for n, f in (("least", F.min), ("most", F.max))]
    return rounded(scored.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), *ranges), 6)


SIZES = [1, 2, 3, 4, 5, 6, 7, 8]
TRAINED = f"(SELECT * FROM {BANDED} WHERE (l_orderkey * 7919) % 100 < 75)"
_EIGHT, _ = _growth_sql(TRAINED, len(SIZES))


@query("m1_leaf_sizes", f"WITH {_EIGHT}\n" + "\nUNION ALL ".join(f"""SELECT {k} AS size, {r('avg(abs(label - mean))', 6)} AS mae FROM leaf{k} l
  JOIN (SELECT id, sum(s) / sum(n) AS mean FROM leaf{k} l JOIN cells c ON {_BOX} GROUP BY id) m ON l.id = m.id
  JOIN (SELECT * FROM {BANDED} WHERE (l_orderkey * 7919) % 100 >= 75) c ON {_BOX}""" for k in SIZES))
def leaf_sizes(load):
    """Hold-out error of the first eight sizes, from one growth."""
    df = holdout_split_arithmetic(_banded(load), "l_orderkey")
    return rounded(trees.tree_size_search(df, TREE_FEATURES, "label", sizes=SIZES).drop("leaves"), 6)


# ---- one round -------------------------------------------------------------------------------


def _stump_sql(rows: str, g: str, least: float = 0, alpha: float = 0, lam: float = 0) -> str:
    """CTEs rows and best: the split of greatest gain over all features, by soft-thresholded sums of ``g`` (Hessian 1)."""
    def gain(s, n):
        return f"(greatest(abs({s}) - {alpha}, 0) * greatest(abs({s}) - {alpha}, 0) / ({n} + {lam}))"

    tried = "\n    UNION ALL ".join(f"""SELECT {i} AS f, cut, {gain('sl', 'nl')} + {gain('(s - sl)', '(n - nl)')} - {gain('s', 'n')} AS gain FROM (
      SELECT {c} AS cut, sum(count(*)) OVER w AS nl, sum(sum(g)) OVER w AS sl, sum(count(*)) OVER () AS n, sum(sum(g)) OVER () AS s
      FROM rows GROUP BY {c} WINDOW w AS (ORDER BY {c})) WHERE nl < n AND nl >= {least} AND n - nl >= {least}""" for i, c in enumerate(FEATURES))
    side = "CASE " + " ".join(f"WHEN f = {i} THEN {c} <= cut" for i, c in enumerate(FEATURES)) + " END"
    return f"""rows AS (SELECT *, {g} AS g FROM {rows}),
  best AS (SELECT * FROM ({tried}) ORDER BY gain DESC, f, cut LIMIT 1),
  sided AS (SELECT rows.*, {side} AS side FROM rows, best)"""


NEWTON = {"booster": "gbtree", "n_estimators": 1, "max_depth": 1, "learning_rate": 0.3, "reg_lambda": 50.0, "reg_alpha": 20.0, "min_child_weight": 2000,
          "base_score": 10.0}


@query("r9_newton_boosting", f"""WITH {_stump_sql(BANDED, '10.0 - label', 2000, 20, 50)}
SELECT {r('10 - 0.3 * sign(sum(g)) * greatest(abs(sum(g)) - 20, 0) / (count(*) + 50)', 6)} AS prediction, count(*) AS n, {RANGES}
FROM sided GROUP BY side""")
def newton_boosting(load):
    """One round of depth 1 with shrunk leaf values and a least Hessian."""
    df = _banded(load)
    return _by_prediction(trees.fit_tree(df, FEATURES, "label", "gradient_boosting", NEWTON), df)


@query("r9_quantile_boosting", f"""WITH base AS (SELECT quantile_cont(label, 0.8) AS b FROM {BANDED}),
  {_stump_sql(f"(SELECT x.*, label - b AS res FROM {BANDED} x, base)", 'CASE WHEN res > 0 THEN -0.8 ELSE 0.2 END')}
SELECT {r('any_value(b) + 0.5 * quantile_cont(res, 0.8)', 6)} AS prediction, count(*) AS n, {RANGES} FROM sided, base GROUP BY side""")
def quantile_boosting(load):
    df = _banded(load)
    params = {"loss": "quantile", "alpha": 0.8, "n_estimators": 1, "max_depth": 1, "learning_rate": 0.5}
    return _by_prediction(trees.fit_tree(df, FEATURES, "label", "gradient_boosting", params), df)


@query("r9_huber_boosting", f"""WITH base AS (SELECT median(label) AS b FROM {BANDED}),
  spread AS (SELECT quantile_cont(abs(label - b), 0.9) AS delta FROM {BANDED}, base),
  {_stump_sql(f"(SELECT x.*, label - b AS res, delta FROM {BANDED} x, base, spread)", '-least(greatest(res, -delta), delta)')},
  middles AS (SELECT side, median(res) AS m FROM sided GROUP BY side)
SELECT {r('any_value(b) + 0.5 * (any_value(m) + avg(least(greatest(res - m, -delta), delta)))', 6)} AS prediction, count(*) AS n, {RANGES}
FROM sided JOIN middles USING (side), base GROUP BY side""")
def huber_boosting(load):
    df = _banded(load)
    params = {"loss": "huber", "alpha": 0.9, "n_estimators": 1, "max_depth": 1, "learning_rate": 0.5}
    return _by_prediction(trees.fit_tree(df, FEATURES, "label", "gradient_boosting", params), df)


# ---- stopping, dropout -----------------------------------------------------------------------

STOP_ROUNDS, STOP_RATE, STOP_GAIN = 12, 0.6, 0.004


def _rounds_sql() -> str:
    """Stumps on the band in turn: f0, f1, ... have the prediction of each band, from training orders alone."""
    parts = [f"""cells AS (SELECT band, count(*) FILTER (NOT held) AS n, coalesce(sum(label) FILTER (NOT held), 0) AS s, count(*) FILTER (held) AS hn,
    coalesce(sum(label) FILTER (held), 0) AS hs, coalesce(sum(label * label) FILTER (held), 0) AS hq
    FROM (SELECT *, l_orderkey % 5 = 0 AS held FROM {BANDED}) GROUP BY band)""",
             "f0 AS (SELECT *, (SELECT sum(s) / sum(n) FROM cells) AS f FROM cells)"]
    for k in range(STOP_ROUNDS):
        parts.append(f"""cut{k} AS (SELECT * FROM (SELECT band AS cut, sum(s - n * f) OVER w AS gl, sum(n) OVER w AS nl, sum(s - n * f) OVER () AS g, sum(n) OVER () AS nn
    FROM f{k} WINDOW w AS (ORDER BY band)) WHERE nl > 0 AND nl < nn ORDER BY gl * gl / nl + (g - gl) * (g - gl) / (nn - nl) DESC, cut LIMIT 1),
  f{k + 1} AS (SELECT c.* REPLACE (f + {STOP_RATE} * CASE WHEN band <= cut THEN gl / nl ELSE (g - gl) / (nn - nl) END AS f) FROM f{k} c, cut{k})""")
    losses = "\n    UNION ALL ".join(f"SELECT {k} AS round, sum(hq - 2 * f * hs + f * f * hn) / 2 / sum(hn) AS loss FROM f{k}" for k in range(STOP_ROUNDS + 1))
    return ",\n  ".join([*parts, f"losses AS ({losses})"])


@query("r9_early_stopping", f"""WITH {_rounds_sql()},
  steps AS (SELECT *, lag(loss) OVER (ORDER BY round) AS before FROM losses),
  stop AS (SELECT coalesce(min(round), {STOP_ROUNDS + 1}) AS last_round FROM steps WHERE loss >= before - {STOP_GAIN})
SELECT round, {r('loss', 6)} AS loss, round < last_round AS used FROM losses, stop WHERE round <= last_round""")
def early_stopping(load):
    """The loss of held-out orders by round, and whether the model keeps the round."""
    df = _banded(load).withColumn("held", q("l_orderkey") % 5 == 0)
    plan = boosting.Plan(rounds=STOP_ROUNDS, rate=STOP_RATE, rules=growth.Rules(max_leaves=2), held="held", stop_after=1, tolerance=STOP_GAIN)
    bins = growth.fit_bins(df, ["band"])
    with growth.binned(df, bins, "label", ["held"]) as rows:
        model = boosting.fit_binned(rows, bins, plan)
    curve = [(i, float(x), i <= len(model.trees)) for i, x in enumerate(model.losses)]
    return rounded(df.sparkSession.createDataFrame(curve, "round int, loss double, used boolean"), 6)


@query("r9_dropout_and_sampling", f"""SELECT kind, count(*) AS n, 0.0 AS gap FROM {NET_LINEITEM}, (SELECT unnest(['dart', 'goss']) AS kind) GROUP BY kind""")
def dropout_and_sampling(load):
    """Dropout that skips every round, and gradient sampling that takes every row, are plain boosting."""
    df = _banded(load)
    bins = growth.fit_bins(df, FEATURES)
    rules = growth.Rules(max_leaves=6)
    out = None
    with growth.binned(df, bins, "label") as rows:
        plain = boosting.fit_binned(rows, bins, boosting.Plan(rounds=3, rate=0.4, rules=rules))
        for kind, how in (("dart", {"drop_rate": 0.9, "skip_drop": 1.0}), ("goss", {"top_rate": 1.0, "other_rate": 0.0})):
            other = boosting.fit_binned(rows, bins, boosting.Plan(rounds=3, rate=0.4, rules=rules, **how))
            both = plain.predict_binned(other.predict_binned(rows).withColumnRenamed("prediction", "other"))
            row = both.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("prediction") - F.col("other"))).alias("gap"))
            part = df.sparkSession.createDataFrame(row.collect(), row.schema)
            out = part if out is None else out.unionByName(part)
    return rounded(out, 9)
